"""Rules over bank statements, salary slips and income proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.money import close
from docassay.operators import checks as C
from docassay.operators.claims import money_scalars, transactions
from docassay.operators.scan import exact_median, hot_keys
from docassay.session import durable
from docassay.rulebook import MATERIAL_FRACTION, MONEY_TOLERANCE, RULES, SEVERITY_BANDS, TRUST_GATE

RESULT = ["doc_id", "rule_id", "status", "reason_code", "at_index", "expected", "printed"]
ARITHMETIC = ("F1", "F2", "F3", "F4")
AGGREGATE = ("F2", "F3", "F4")
BANK_SCALARS = ["opening_balance", "closing_balance", "total_debits", "total_credits"]


def result(df: DataFrame, rule: str, status: Column, code: Column | None = None, index: Column | None = None,
           expected: Column | None = None, printed: Column | None = None) -> DataFrame:
    """The common shape of a rule result."""
    return df.select(
        "doc_id",
        F.lit(rule).alias("rule_id"),
        status.alias("status"),
        (code if code is not None else F.lit("")).alias("reason_code"),
        F.coalesce(index.cast("int") if index is not None else F.lit(None), F.lit(-1)).alias("at_index"),
        (expected if expected is not None else F.lit(None)).cast("double").alias("expected"),
        (printed if printed is not None else F.lit(None)).cast("double").alias("printed"),
    )


def status_of(evaluated: Column, passed: Column) -> Column:
    return F.when(~F.coalesce(evaluated, F.lit(False)), "NOT_EVALUATED").when(passed, "PASS").otherwise("FAIL")


def of_type(claims: DataFrame, *types: str) -> DataFrame:
    return claims.filter(F.upper("doc_type").isin(*types))


def chain_rows(txns: DataFrame, scal: DataFrame) -> DataFrame:
    """Transactions with their opening balance, as input of the running-balance check."""
    return txns.join(scal.select("doc_id", F.col("opening_balance").alias("anchor")), "doc_id", "left").withColumn(
        "printed", F.col("running_balance"))


def misfiled_rows(txns: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Rows whose amount sits nearer the other column's median position.

    Needs three cells in both columns, and columns further apart than twice their spread.
    """
    cells = txns.select(
        "doc_id", "index",
        F.explode(F.array(
            F.struct(F.lit("debit").alias("side"), F.col("debit_x").alias("px")),
            F.struct(F.lit("credit").alias("side"), F.col("credit_x").alias("px")),
        )).alias("c"),
    ).select("doc_id", "index", "c.side", F.round(F.col("c.px") * 1000).cast("bigint").alias("x"))
    cells = cells.filter(F.col("x").isNotNull())
    n = F.count(F.lit(1)).alias("n")
    if base is not None and hot_keys(base, ["doc_id"]) is None:  # then no side of a document is heavy either
        med = cells.groupBy("doc_id", "side").agg(F.percentile("x", 0.5).alias("median"), n)
    else:
        # heavy documents are heavy on either side: the count is taken per document and side of the base
        wide = None if base is None else base.select("doc_id", F.explode(F.array(F.lit("debit"), F.lit("credit"))).alias("side"))
        med = exact_median(cells, ["doc_id", "side"], "x", base=wide).join(cells.groupBy("doc_id", "side").agg(n), ["doc_id", "side"])
    both = med.groupBy("doc_id").agg(
        F.max(F.when(F.col("side") == "debit", F.col("median"))).alias("debit_m"),
        F.max(F.when(F.col("side") == "credit", F.col("median"))).alias("credit_m"),
        F.min("n").alias("least"), F.count(F.lit(1)).alias("sides"),
    ).filter((F.col("sides") == 2) & (F.col("least") >= 3))
    j = cells.join(both, "doc_id")
    own = F.when(F.col("side") == "debit", F.col("debit_m")).otherwise(F.col("credit_m"))
    other = F.when(F.col("side") == "debit", F.col("credit_m")).otherwise(F.col("debit_m"))
    # twice the deviation is an integer: medians are whole or half units
    j = j.withColumn("dev2", F.round(F.abs(F.col("x") - own) * 2).cast("bigint")).withColumn(
        "nearer_other", F.abs(F.col("x") - other) < F.abs(F.col("x") - own))
    spread = exact_median(j, ["doc_id"], "dev2", "spread2", base).join(both, "doc_id")
    apart = spread.filter(
        F.abs(F.col("credit_m") - F.col("debit_m")) > F.greatest(F.col("spread2"), F.lit(0.001))).select("doc_id")
    return j.filter("nearer_other").join(apart, "doc_id", "left_semi").select("doc_id", "index").distinct()


def swap_rows(breaks: DataFrame, tol: str = MONEY_TOLERANCE) -> DataFrame:
    """Breaks without any box that reconcile when debit and credit change places."""
    zero = F.lit(0).cast("decimal(20,2)")
    move = F.coalesce("credit", zero) - F.coalesce("debit", zero)
    swapped = F.col("expected") - move - move
    some = F.col("credit").isNotNull() | F.col("debit").isNotNull()
    return breaks.filter(~F.col("has_box") & some & close(swapped, F.col("printed"), tol)).select("doc_id", "index")


def f1(txns: DataFrame, scal: DataFrame, tol: str = MONEY_TOLERANCE, base: DataFrame | None = None) -> DataFrame:
    """Running balance. Breaks after unread rows, in misfiled rows or explained by a swap are pending."""
    rows = C.linear_balance(chain_rows(txns, scal), ["doc_id"], base=base if base is not None else txns, tol=tol)
    # written once: the breaks, their doubts and what can be evaluated are all read from it
    rows = durable(rows.select("doc_id", "index", "anchor", "credit", "debit", "printed", "expected", "unread", "broken", "has_box"))
    breaks = rows.filter("broken")
    sure = breaks.filter(F.col("unread") == 0)
    # columns matter only where a sure break could be explained by them
    in_doubt = txns.join(sure.select("doc_id").distinct(), "doc_id", "left_semi")
    doubt = misfiled_rows(in_doubt, base).withColumn("why", F.lit("misfiled")).unionByName(
        swap_rows(sure, tol).withColumn("why", F.lit("swap")))
    doubt = doubt.groupBy("doc_id", "index").agg(F.min("why").alias("why"))
    tagged = breaks.join(doubt, ["doc_id", "index"], "left")
    clean = (F.col("unread") == 0) & F.col("why").isNull()
    unclear = (F.col("unread") == 0) & F.col("why").isNotNull()
    per_doc = tagged.groupBy("doc_id").agg(
        F.count_if(F.col("unread") == 0).alias("sure"),
        F.count_if(clean).alias("clean"),
        F.min_by(F.when(clean, F.struct("index", "expected", "printed")), F.when(clean, F.col("index"))).alias("c"),
        F.min_by(F.when(unclear, F.struct("index", "expected", "printed", "why")),
                 F.when(unclear, F.col("index"))).alias("u"),
        F.max_by(F.struct("index", "expected", "printed"), F.struct("unread", -F.col("index"))).alias("g"),
    )
    ok = rows.groupBy("doc_id").agg(
        (F.max(F.col("anchor").isNotNull()) & (F.count("printed") >= 2)
         & (F.count_if(F.col("credit").isNotNull() | F.col("debit").isNotNull()) >= 1)).alias("evaluated"))
    df = ok.join(per_doc, "doc_id", "left")
    pick = F.when(F.col("clean") > 0, F.col("c")).when(
        F.col("sure") > 0, F.struct("u.index", "u.expected", "u.printed")).otherwise(F.col("g"))
    df = df.withColumn("p", F.when(F.col("evaluated"), pick))
    status = (
        F.when(~F.col("evaluated"), "NOT_EVALUATED").when(F.col("sure").isNull(), "PASS")
        .when(F.col("clean") > 0, "FAIL").otherwise("NOT_EVALUATED")
    )
    code = (
        F.when(~F.col("evaluated"), "insufficient").when(F.col("sure").isNull(), "")
        .when(F.col("clean") > 0, "break").when(F.col("sure") == 0, "unread_gap").otherwise(F.col("u.why"))
    )
    return result(df, "F1", status, code, F.col("p.index"), F.col("p.expected"), F.col("p.printed"))


def statement_totals(txns: DataFrame) -> DataFrame:
    """Sums and counts per statement that F2, F3 and F4 share; one partial aggregation."""
    zero = F.lit(0).cast("decimal(28,2)")
    return txns.groupBy("doc_id").agg(
        F.coalesce(F.sum("credit"), zero).alias("credits"),
        F.coalesce(F.sum("debit"), zero).alias("debits"),
        F.sum("doubted_moves").alias("doubted"),
        F.max_by(F.struct("running_balance"), F.when(F.col("balance_seen"), F.col("index"))).alias("last"),
    )


def f2(totals: DataFrame, scal: DataFrame, tol: str = MONEY_TOLERANCE) -> DataFrame:
    """Closing balance equals the last row that prints one, trusted or not (an untrusted one is pending)."""
    df = scal.join(totals, "doc_id", "left")
    df = df.withColumn("k", C.equation([(1, F.col("last.running_balance"))], F.col("closing_balance"), tol))
    return _from_outcome(df, "F2", "k")


def _from_outcome(df: DataFrame, rule: str, col: str) -> DataFrame:
    c = F.col(col)
    failed = c["evaluated"] & ~c["passed"]
    return result(df, rule, status_of(c["evaluated"], c["passed"]), F.lit(""), None,
                  F.when(failed, c["expected"]), F.when(failed, c["printed"]))


def f3(totals: DataFrame, scal: DataFrame, tol: str = MONEY_TOLERANCE) -> DataFrame:
    """Stated column totals; never summed across unconfirmed amounts."""
    df = scal.join(totals, "doc_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    debit_bad = ~close(F.coalesce("debits", zero), F.col("total_debits"), tol)
    credit_bad = ~close(F.coalesce("credits", zero), F.col("total_credits"), tol)
    none = F.col("total_debits").isNull() & F.col("total_credits").isNull()
    doubted = F.coalesce("doubted", F.lit(0)) > 0
    d, c = F.coalesce(debit_bad, F.lit(False)), F.coalesce(credit_bad, F.lit(False))
    status = F.when(none | doubted, "NOT_EVALUATED").when(d | c, "FAIL").otherwise("PASS")
    code = F.when(none, "insufficient").when(doubted, "unconfirmed").when(d & c, "both").when(d, "total_debits").when(
        c, "total_credits").otherwise("")
    fail = ~none & ~doubted
    return result(
        df, "F3", status, code, None,
        F.when(fail & d, F.col("debits")).when(fail & c, F.col("credits")),
        F.when(fail & d, F.col("total_debits")).when(fail & c, F.col("total_credits")),
    )


def f4(totals: DataFrame, scal: DataFrame, tol: str = MONEY_TOLERANCE) -> DataFrame:
    """Opening plus credits minus debits equals closing."""
    df = scal.join(totals, "doc_id", "left")
    zero = F.lit(0).cast("decimal(28,2)")
    df = df.withColumn("k", C.equation(
        [(1, F.col("opening_balance")), (1, F.coalesce("credits", zero)), (-1, F.coalesce("debits", zero))],
        F.col("closing_balance"), tol))
    doubted = F.coalesce("doubted", F.lit(0)) > 0
    none = F.col("opening_balance").isNull() | F.col("closing_balance").isNull()
    failed = ~none & ~doubted & ~F.col("k.passed")
    status = F.when(none | doubted, "NOT_EVALUATED").when(F.col("k.passed"), "PASS").otherwise("FAIL")
    code = F.when(none, "insufficient").when(doubted, "unconfirmed").otherwise("")
    return result(df, "F4", status, code, None, F.when(failed, F.col("k.expected")),
                  F.when(failed, F.col("k.printed")))


def f5(txns: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Trusted posting dates do not go back."""
    m = C.monotonic_outcome(txns, ["doc_id"], "index", "posted_on", base=base if base is not None else txns)
    df = txns.select("doc_id").distinct().join(m, "doc_id", "left")
    return result(df, "F5", status_of(F.col("evaluated"), F.col("breaks") == 0), F.lit(""),
                  F.when(F.col("evaluated"), F.col("first_break")))


def f6(claims: DataFrame) -> DataFrame:
    """Net pay is gross minus deductions."""
    s = money_scalars(of_type(claims, "SALARY_SLIP"), ["gross_earnings", "total_deductions", "net_pay"])
    s = s.withColumn("k", C.equation([(1, F.col("gross_earnings")), (-1, F.col("total_deductions"))], F.col("net_pay")))
    return _from_outcome(s, "F6", "k")


def f7(claims: DataFrame) -> DataFrame:
    """Taxable income is at most gross income."""
    s = money_scalars(of_type(claims, "FORM16", "ITR"), ["taxable_income", "gross_income"])
    s = s.withColumn("k", C.comparison(F.col("taxable_income"), "<=", F.col("gross_income")))
    return _from_outcome(s, "F7", "k")


def slab_tax(income: DataFrame, slabs: DataFrame) -> DataFrame:
    """Tax per slab table of the year: the part of the income inside each slab times its rate. No table: null."""
    j = income.join(slabs, (income.year == slabs.slab_year) & (income.taxable > slabs.low), "left")
    part = F.least("taxable", F.coalesce("high", F.col("taxable"))) - F.col("low")
    tax = F.sum(part * F.col("rate_pct") / 100)
    return j.groupBy("doc_id", "year", "taxable", "stated_tax").agg(tax.alias("tax"))


def statement_view(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Transactions and scalars of the bank statements, written once: the rules read them many times."""
    bank = of_type(claims, "BANK_STATEMENT")
    return durable(transactions(bank)), durable(money_scalars(bank, BANK_SCALARS))


def evaluate_financial(claims: DataFrame, base: DataFrame | None = None,
                       view: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """All financial rules over a claims table; ``base`` lists the document of every transaction row."""
    txns, scal = view or statement_view(claims)
    totals = statement_totals(txns)
    out = f1(txns, scal, base=base)
    for part in (f2(totals, scal), f3(totals, scal), f4(totals, scal), f5(txns, base), f6(claims), f7(claims)):
        out = out.unionByName(part)
    return out


def severity(spark) -> DataFrame:
    """Suspicion of a failure per rule; an unknown band takes the largest."""
    worst = max(SEVERITY_BANDS.values())
    rows = [(r, dom, SEVERITY_BANDS.get(s, worst)) for r, dom, s, _ in RULES]
    return spark.createDataFrame(rows, "rule_id string, domain string, severity double")


def claim_scale(txns: DataFrame, scal: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Median absolute non-zero trusted balance of a statement, in half paise, exact."""
    cols = ["doc_id", "v"]
    heads = scal.select("doc_id", F.explode(F.array("opening_balance", "closing_balance")).alias("v"))
    vals = heads.select(*cols).unionByName(txns.select("doc_id", F.col("running_balance").alias("v")))
    vals = vals.filter(F.col("v").isNotNull() & (F.col("v") != 0))
    vals = vals.select("doc_id", (F.abs("v") * 100).cast("bigint").alias("p"))
    return exact_median(vals, ["doc_id"], "p", "scale_p", base)


def consistency_signal(results: DataFrame, scale: DataFrame | None = None, uncaptured: DataFrame | None = None):
    """Rule results to one signal per document: abstain, type the failure, take the worst.

    Uncaptured money holds arithmetic failures back. Aggregate-only failures are graded by their largest residual
    against the scale of the statement. A chain break or another failure keeps the rule's severity.
    """
    spark = results.sparkSession
    r = results.join(F.broadcast(severity(spark)), "rule_id")  # one row per rule
    fail = F.col("status") == "FAIL"
    arith, agg = F.col("rule_id").isin(*ARITHMETIC), F.col("rule_id").isin(*AGGREGATE)
    g = r.groupBy("doc_id").agg(
        F.count_if(fail).alias("failed"),
        F.count_if(F.col("status") == "PASS").alias("passed"),
        F.count_if(fail & arith).alias("arith_failed"),
        F.count_if(fail & ~arith).alias("other_failed"),
        F.count_if(fail & (F.col("rule_id") == "F1")).alias("chain_failed"),
        F.max(F.when(fail, F.col("severity"))).alias("worst"),
        F.max(F.when(fail & ~arith, F.col("severity"))).alias("worst_other"),
        F.max(F.when(fail & agg, F.abs(F.col("printed") - F.col("expected")))).alias("residual"),
    )
    g = g.join(uncaptured.select("doc_id", "uncaptured"), "doc_id", "left") if uncaptured is not None else (
        g.withColumn("uncaptured", F.lit(0)))
    g = g.join(scale, "doc_id", "left") if scale is not None else g.withColumn("scale_p", F.lit(None).cast("double"))
    nothing = (F.col("failed") == 0) & (F.col("passed") == 0)
    held = (F.col("arith_failed") > 0) & (F.coalesce("uncaptured", F.lit(0)) > 0)
    only_agg = (F.col("chain_failed") == 0) & (F.col("other_failed") == 0) & (F.col("arith_failed") > 0)
    material = (F.coalesce("scale_p", F.lit(0.0)) > 0) & (
        F.col("residual") * 100 >= F.col("scale_p") * float(MATERIAL_FRACTION))
    status = F.when(nothing, "NOT_EVALUATED").when(held & (F.col("other_failed") == 0), "NOT_EVALUATED").otherwise(
        "VALID")
    severity_kind = (
        F.when(nothing, "none").when(F.col("failed") == 0, "clean").when(held, "extraction_incomplete")
        .when(only_agg, "aggregate_only").when(F.col("chain_failed") > 0, "running_balance_break").otherwise("mixed")
    )
    susp = (
        F.when(F.col("failed") == 0, 0.0).when(held, F.col("worst_other"))
        .when(only_agg, F.when(material, 0.40).otherwise(0.30)).otherwise(F.col("worst"))
    )
    return g.select(
        "doc_id", F.lit("financial_consistency").alias("name"), status.alias("status"),
        F.when(status == "VALID", susp).alias("suspicion"), severity_kind.alias("severity"),
        F.col("failed").alias("rules_failed"), F.col("passed").alias("rules_passed"),
    )


def gate() -> float:
    return TRUST_GATE
