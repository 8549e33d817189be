"""Agreement across the documents of a bundle or case: income, employer, identity.

The comparisons ask whether *every* pair agrees and which pair is worst. That needs no list of pairs: amounts are
settled by counting in sorted order, codes by their differing positions, names against the first one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.names import edit_ratio, names_match, normal_org
from docassay.operators.claims import trusted, transactions
from docassay.operators.scan import exact_median, ordered
from docassay.rulebook import (
    EMPLOYER_MIN_RATIO, FIELD_SEVERITY, HARD_IDENTIFIERS, INCOME_ANNUAL_SLACK, INCOME_REL_TOLERANCE, REVIEW_CAP,
    SALARY_WORDS_CORROBORATION, SEVERITY_BANDS,
)
from docassay.session import by_key

MONTHLY, ANNUAL = "monthly_take_home", "annual_gross"
SOFT = min(SEVERITY_BANDS["soft"], REVIEW_CAP)
STRUCTURAL = min(SEVERITY_BANDS["structural"], REVIEW_CAP)


def income_observations(claims: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Median salary credit, net pay and gross income as (doc_id, kind, source_field, amount2): doubled paise.

    Doubled paise keep the median of an even number of credits an exact integer.
    """
    bank = claims.filter(F.upper("doc_type") == "BANK_STATEMENT")
    t = transactions(bank)
    salary = F.col("credit").isNotNull() & (F.col("credit") > 0) & F.coalesce(
        F.col("description").rlike(SALARY_WORDS_CORROBORATION), F.lit(False))
    credits = t.filter(salary).select("doc_id", (F.col("credit") * 100).cast("bigint").alias("p"))
    med = exact_median(credits, ["doc_id"], "p", base=base).select(
        "doc_id", F.lit(MONTHLY).alias("kind"), F.lit("salary_credit").alias("source_field"),
        (F.col("median") * 2).cast("bigint").alias("amount2"))
    ok = trusted()
    key = F.struct(F.coalesce("index", F.lit(-1)), "ord")

    def scalar(types: list[str], predicate: str, kind: str) -> DataFrame:
        c = claims.filter(F.upper("doc_type").isin(types) & (F.col("predicate") == predicate))
        g = c.groupBy("doc_id").agg(F.min_by(F.struct(F.when(ok, F.col("value")).alias("v")), key).alias("c"))
        p = F.col("c.v").try_cast("decimal(38,4)") * 100
        return g.select("doc_id", F.lit(kind).alias("kind"), F.lit(predicate).alias("source_field"),
                        (p * 2).cast("bigint").alias("amount2")).filter(F.col("amount2") > 0)

    return med.unionByName(scalar(["SALARY_SLIP"], "net_pay", MONTHLY)).unionByName(
        scalar(["FORM16", "ITR"], "gross_income", ANNUAL))


def employers(claims: DataFrame) -> DataFrame:
    """First trusted employer text of each payslip and income proof."""
    c = claims.filter(F.upper("doc_type").isin("SALARY_SLIP", "FORM16", "ITR") & (F.col("predicate") == "employer"))
    key = F.struct(F.coalesce("index", F.lit(-1)), "ord")
    g = c.groupBy("doc_id").agg(F.min_by(F.struct(F.when(trusted(), F.col("value")).alias("v")), key).alias("c"))
    return g.select("doc_id", F.col("c.v").alias("employer")).filter(F.coalesce("employer", F.lit("")) != "")


def amount_pairs(obs: DataFrame, keys: list[str], amount: str, tol: str = INCOME_REL_TOLERANCE,
                 base: DataFrame | None = None) -> DataFrame:
    """Unordered pairs of a key whose difference exceeds ``tol`` of the larger, counted without forming pairs.

    A pair (a <= b) disagrees when a < (1 - tol) b. Amounts and thresholds are sorted together; a running count of
    amounts at each threshold gives the disagreeing partners below it.
    """
    keep = round((1 - float(tol)) * 100)  # threshold in hundredths of the amount
    v = obs.select(*keys, F.col(amount).alias("a")).groupBy(*keys, "a").agg(F.count(F.lit(1)).alias("m"))
    marks = v.select(*keys, F.explode(F.array(
        F.struct((F.col("a") * 100).alias("at"), F.lit(1).alias("kind"), F.col("m").alias("add"), F.lit(0).cast(
            "bigint").alias("ask")),
        F.struct((F.col("a") * keep).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("add"),
                 F.col("m").alias("ask")),
    )).alias("x")).select(*keys, "x.*")
    s = ordered(marks, keys, ["at", "kind"], sums={"below": F.col("add")}, base=obs if base is None else base)
    n = F.sum("add")
    g = s.groupBy(*keys).agg(
        n.alias("sources"), F.coalesce(F.sum(F.col("ask") * F.col("below")), F.lit(0)).alias("disagreeing"),
        (F.min(F.when(F.col("kind") == 1, F.col("at"))) / 100).cast("bigint").alias("least"),
        (F.max(F.when(F.col("kind") == 1, F.col("at"))) / 100).cast("bigint").alias("most"),
    )
    return g.withColumn("pairs", F.expr("sources * (sources - 1) div 2"))


def annual_floor(obs: DataFrame, keys: list[str], amount: str, base: DataFrame | None = None) -> DataFrame:
    """Monthly against annual observations of a key: 12 x monthly may not exceed the slackened annual figure.

    Counted from one sorted pass, like ``amount_pairs``.
    """
    slack = round(float(INCOME_ANNUAL_SLACK) * 100)
    m = F.col("kind") == MONTHLY
    at = F.when(m, F.col(amount) * 1200).otherwise(F.col(amount) * slack)
    marks = obs.select(*keys, at.alias("at"), m.cast("int").alias("monthly"))
    marks = marks.groupBy(*keys, "at", "monthly").agg(F.count(F.lit(1)).alias("c"))
    # annual marks below a monthly mark are contradicted by it; at equal marks the monthly one comes first
    s = ordered(marks.withColumn("tie", -F.col("monthly")), keys, ["at", "tie"],
                sums={"annual_below": F.when(F.col("monthly") == 0, F.col("c")).otherwise(0)}, base=obs if base is None else base)
    mo = F.col("monthly") == 1
    g = s.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(mo, F.col("c"))), F.lit(0)).alias("monthly"),
        F.coalesce(F.sum(F.when(~mo, F.col("c"))), F.lit(0)).alias("annual"),
        F.coalesce(F.sum(F.when(mo, F.col("c") * F.col("annual_below"))), F.lit(0)).alias("contradictions"),
    )
    return g.withColumn("checks", F.col("monthly") * F.col("annual"))


def employer_agreement(emp: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of employer names below the ratio, per key.

    Copies collapse on the normalised name; a pair of distinct names stands for the product of their counts. Distinct
    spellings of one applicant's employers are few.
    """
    e = emp.withColumn("n", normal_org(F.col("employer"))).groupBy(*keys, "n").agg(F.count(F.lit(1)).alias("c"))
    total = e.groupBy(*keys).agg(F.sum("c").alias("sources"), F.count(F.lit(1)).alias("names"),
                                 F.sum(F.when(F.col("n") == "", F.expr("c * (c - 1) div 2"))).alias("blank_pairs"))
    many = total.filter(F.col("names") > 1).select(*keys)
    a = e.join(by_key(many), keys, "left_semi").select(*keys, F.col("n").alias("x"), F.col("c").alias("cx"))
    b = e.select(*keys, F.col("n").alias("y"), F.col("c").alias("cy"))
    p = a.join(by_key(b), keys).filter((F.col("x") < F.col("y")) & (edit_ratio(F.col("x"), F.col("y")) < EMPLOYER_MIN_RATIO))
    bad = p.groupBy(*keys).agg(F.sum(F.col("cx") * F.col("cy")).alias("bad"))
    out = total.join(by_key(bad), keys, "left").filter(F.col("sources") >= 2)
    dis = F.coalesce("bad", F.lit(0)) + F.coalesce("blank_pairs", F.lit(0))
    return out.select(*keys, "sources", F.expr("sources * (sources - 1) div 2").alias("pairs"), dis.alias("disagreeing"))


def income_signal(monthly: DataFrame, floor: DataFrame, employer: DataFrame, keys: list[str]) -> DataFrame:
    """All agree: 0.05. Otherwise the worst severity, capped at review. No check at all: pending."""
    j = monthly.select(*keys, F.col("pairs").alias("mp"), F.col("disagreeing").alias("md"))
    j = j.join(floor.select(*keys, F.col("checks").alias("fp"), F.col("contradictions").alias("fd")), keys, "full")
    j = j.join(employer.select(*keys, F.col("pairs").alias("ep"), F.col("disagreeing").alias("ed")), keys, "full")

    def z(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    n, bad = z("mp") + z("fp") + z("ep"), z("md") + z("fd") + z("ed")
    worst = F.greatest(F.when(z("md") + z("ed") > 0, SOFT).otherwise(0.0), F.when(z("fd") > 0, STRUCTURAL).otherwise(0.0))
    status = F.when(n == 0, "NOT_EVALUATED").otherwise("VALID")
    susp = F.when(n == 0, None).when(bad == 0, 0.05).otherwise(worst)
    return j.select(*keys, F.lit("cross_source_corroboration").alias("name"), status.alias("status"),
                    susp.alias("suspicion"), n.alias("checks"), bad.alias("disagreeing"))


FIELDS = ("pan", "aadhaar", "ifsc", "account_number", "name", "dob")


def identity_values(entities: DataFrame, keys: list[str], label: str = "doc_label", order: str = "ord") -> DataFrame:
    """Unpivot the identity fields; absent values are left out."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])
    return entities.select(*keys, F.col(label).alias("label"), F.col(order).alias("ord"),
                           F.explode(pairs).alias("p")).select(*keys, "label", "ord", "p.*").filter(
        F.coalesce("value", F.lit("")) != "")


def identity_comparison(values: DataFrame, keys: list[str]) -> DataFrame:
    """Per field over two documents or more: agree, near or disagree, with its severity.

    Names compare with the first name. Codes are near when all have one length and at most one position varies:
    strings that are pairwise one edit apart at equal length can differ only in one common position.
    """
    k = [*keys, "field"]
    per = values.groupBy(*k).agg(
        F.count(F.lit(1)).alias("documents"), F.min_by("value", "ord").alias("first"),
        F.min(F.length("value")).alias("l0"), F.max(F.length("value")).alias("l1"),
        F.min("value").alias("v0"), F.max("value").alias("v1"),
    ).filter(F.col("documents") >= 2)
    is_name = F.col("field") == "name"
    named = values.filter(is_name).join(by_key(per.filter(is_name).select(*k, "first")), k)
    named = named.groupBy(*k).agg(F.count_if(~names_match(F.col("first"), F.col("value"))).alias("off"))
    differ = per.filter(~is_name & (F.col("v0") != F.col("v1")) & (F.col("l0") == F.col("l1"))).select(*k)
    chars = values.join(by_key(differ), k, "left_semi").select(*k, "value").distinct()
    chars = chars.select(*k, F.posexplode(F.split("value", "")).alias("at", "ch")).groupBy(*k, "at").agg(
        F.min("ch").alias("c0"), F.max("ch").alias("c1"))
    spots = chars.groupBy(*k).agg(F.count_if(F.col("c0") != F.col("c1")).alias("spots"))
    j = per.join(by_key(named), k, "left").join(by_key(spots), k, "left")
    status = F.when(is_name, F.when(F.col("off") == 0, "agree").otherwise("disagree")).when(
        F.col("v0") == F.col("v1"), "agree").when(F.col("spots") <= 1, "near").otherwise("disagree")
    sev = F.create_map(*[x for f, s in FIELD_SEVERITY.items() for x in (F.lit(f), F.lit(s))])
    severity = F.when(status == "agree", 0.0).when(status == "near", REVIEW_CAP).when(
        is_name, min(FIELD_SEVERITY["name"], REVIEW_CAP)).otherwise(F.coalesce(F.try_element_at(sev, F.col("field")), F.lit(0.5)))
    return j.select(*k, "documents", status.alias("status"), severity.alias("severity"))


def identity_signal(comparisons: DataFrame, keys: list[str], universe: DataFrame | None = None) -> DataFrame:
    """Worst disagreement; any hard identifier that disagrees is dispositive."""
    hard = (F.col("status") == "disagree") & F.col("field").isin(*HARD_IDENTIFIERS)
    dis = F.col("status") != "agree"
    g = comparisons.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(dis).alias("disagreeing"), F.count_if(hard).alias("hard"),
        F.max_by(F.when(dis, F.col("field")), F.when(dis, F.struct("severity", "field"))).alias("worst_field"),
        F.max("severity").alias("worst"),
    )
    if universe is not None:
        g = universe.select(*keys).distinct().join(g, keys, "left")
    n = F.coalesce("compared", F.lit(0))
    return g.select(
        *keys, F.lit("cross_document_consistency").alias("name"),
        F.when(n == 0, "NOT_EVALUATED").otherwise("VALID").alias("status"),
        F.when(n == 0, None).when(F.col("disagreeing") == 0, 0.04).otherwise(F.col("worst")).alias("suspicion"),
        (F.coalesce("hard", F.lit(0)) > 0).alias("hard_reject"),
        F.coalesce("disagreeing", F.lit(0)).alias("disagreeing"),
        F.coalesce("worst_field", F.lit("")).alias("worst_field"),
    )


def claimed_identity(claimed: DataFrame, documents: DataFrame, keys: list[str]) -> DataFrame:
    """Typed PAN and name against the document's. The PAN decides; the name only where a PAN is missing.

    ``claimed``: keys, claimed_pan, claimed_name; ``documents``: keys, pan, name.
    """
    j = claimed.join(documents, keys, "left")
    cp = F.when(F.upper(F.trim("claimed_pan")).rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), F.upper(F.trim("claimed_pan")))
    both_pan, both_name = cp.isNotNull() & F.col("pan").isNotNull(), F.col("claimed_name").isNotNull() & F.col(
        "name").isNotNull()
    near = (F.length(cp) == F.length("pan")) & (F.levenshtein(cp, F.col("pan")) <= 1)
    pan_state = F.when(both_pan, F.when(cp == F.col("pan"), "agree").when(near, "near").otherwise("disagree"))
    name_state = F.when(both_name, F.when(names_match(F.col("claimed_name"), F.col("name")), "agree").otherwise("disagree"))
    basis = F.when(both_pan, "pan").when(both_name, "name").otherwise("")
    state = F.coalesce(pan_state, name_state, F.lit(""))
    susp = F.when(basis == "", -1.0).when(state == "agree", 0.0).when(state == "near", REVIEW_CAP).when(
        basis == "pan", FIELD_SEVERITY["pan"]).otherwise(min(FIELD_SEVERITY["name"], REVIEW_CAP))
    return j.select(*keys, basis.alias("basis"), state.alias("state"), susp.alias("suspicion"),
                    F.when(basis == "", "NOT_EVALUATED").otherwise("VALID").alias("status"))
