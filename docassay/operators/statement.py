"""Misparse-aware arithmetic of parsed statements.

Unlike the claim rule, a printed balance that breaks the chain and is far below the statement's scale is dropped as a
misread cell and does not become the new anchor. Whether such a cell breaks depends on the anchor before it, so the
result is path dependent - but only inside a run of off-scale cells: every cell on scale is an anchor no matter what.

With r = printed - cumulative movement, an on-scale cell makes its r the anchor, and an off-scale cell does so only if
its r is within tolerance of the anchor: the carried anchor of ``operators/anchors.py``, a parallel scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.operators.anchors import before
from docassay.operators.scan import exact_median, running, with_chunks
from docassay.rulebook import MATERIAL_FRACTION, MISPARSE_RATIO
from docassay.session import by_key

TOL_P = 100  # one rupee in paise


def statement_scale(stmts: DataFrame, txns: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Median absolute non-zero balance in paise (double, exact)."""
    heads = stmts.select("doc_id", F.explode(F.array("opening_p", "closing_p")).alias("v"))
    vals = heads.unionByName(txns.select("doc_id", F.col("balance_p").alias("v")))
    vals = vals.filter(F.col("v").isNotNull() & (F.col("v") != 0)).select("doc_id", F.abs("v").alias("v"))
    return exact_median(vals, ["doc_id"], "v", "scale_p", base)


def off_scale(v: Column, scale: Column) -> Column:
    return (F.coalesce(scale, F.lit(0.0)) > 0) & (F.abs(v) < scale * float(MISPARSE_RATIO))


def chain(txns: DataFrame, heads: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Printed rows with ``expected_p``, ``off`` and ``broken``; ``heads`` has opening_p and scale_p per document."""
    move = F.coalesce("credit_p", F.lit(0)) - F.coalesce("debit_p", F.lit(0))
    t = txns.join(by_key(heads.select("doc_id", "opening_p", "scale_p")), "doc_id")
    t = t.withColumn("off", F.col("balance_p").isNotNull() & off_scale(F.col("balance_p"), F.col("scale_p")))
    base = txns if base is None else base
    t = with_chunks(t, ["doc_id"], ["idx"], base)
    t = running(t, ["doc_id"], ["idx"], sums={"cum": move})
    t = t.filter(F.col("balance_p").isNotNull()).withColumn("r", F.col("balance_p") - F.col("cum")).withColumn("settled", ~F.col("off"))
    keep = ["doc_id", "idx", "balance_p", "cum", "off", "opening_p", "r", "settled", *(["_chunk"] if "_chunk" in t.columns else [])]
    t = before(t.select(*keep), "doc_id", ["idx"], "r", "settled", "opening_p", TOL_P)
    t = t.withColumn("expected_p", F.col("anchor") + F.col("cum"))
    t = t.withColumn("broken", F.abs(F.col("expected_p") - F.col("balance_p")) > TOL_P)
    return t.select("doc_id", "idx", "balance_p", "expected_p", "off", "broken")


def violations(stmts: DataFrame, txns: DataFrame, boundaries: DataFrame | None = None,
               base: DataFrame | None = None) -> DataFrame:
    """Per statement: counts of the five invariants, unreadable figures, largest residual and the verdict inputs."""
    heads = stmts.join(by_key(statement_scale(stmts, txns, base)), "doc_id", "left")
    ch = chain(txns, heads, base)
    per = ch.groupBy("doc_id").agg(
        F.count_if(~(F.col("broken") & F.col("off"))).alias("chain_checks"),
        F.count_if(F.col("broken") & ~F.col("off")).alias("chain_breaks"),
        F.count_if(F.col("broken") & F.col("off")).alias("misread"),
        F.max(F.when(F.col("broken") & ~F.col("off"), F.abs(F.col("expected_p") - F.col("balance_p")))).alias("chain_d"),
        F.count(F.lit(1)).alias("balances"),
        F.max_by("balance_p", "idx").alias("last_p"),
        F.min(F.when(F.col("broken") & ~F.col("off"), F.col("idx"))).alias("first_break"),
    )
    sums = txns.groupBy("doc_id").agg(
        F.coalesce(F.sum("debit_p"), F.lit(0)).alias("dr"),
        F.coalesce(F.sum("credit_p"), F.lit(0)).alias("cr"),
        F.count_if(F.col("debit_p").isNotNull() | F.col("credit_p").isNotNull()).alias("moves"),
    )
    d = heads.join(by_key(per), "doc_id", "left").join(by_key(sums), "doc_id", "left")
    if boundaries is not None:
        b = boundaries.join(by_key(heads.select("doc_id", "scale_p")), "doc_id")
        bad_cell = off_scale(F.col("close_p"), F.col("scale_p")) | off_scale(F.col("open_p"), F.col("scale_p"))
        gap = F.abs(F.col("close_p") - F.col("open_p"))
        z = b.groupBy("doc_id").agg(
            F.count_if(~bad_cell).alias("zip_checks"),
            F.count_if(~bad_cell & (gap > TOL_P)).alias("zip_breaks"),
            F.count_if(bad_cell).alias("zip_misread"),
            F.max(F.when(~bad_cell & (gap > TOL_P), gap)).alias("zip_d"),
        )
        d = d.join(by_key(z), "doc_id", "left")
    else:
        for c in ("zip_checks", "zip_breaks", "zip_misread", "zip_d"):
            d = d.withColumn(c, F.lit(0).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    extra = F.coalesce("interest_p", zero) - F.coalesce("charges_p", zero)
    last_ok = F.col("closing_p").isNotNull() & F.col("last_p").isNotNull()
    last_off = off_scale(F.col("closing_p"), F.col("scale_p")) | off_scale(F.col("last_p"), F.col("scale_p"))
    close_off = off_scale(F.col("closing_p"), F.col("scale_p"))
    d2 = F.abs(F.col("last_p") + extra - F.col("closing_p"))
    d3 = F.abs(F.col("dr") - F.col("total_debits_p"))
    d4 = F.abs(F.col("cr") - F.col("total_credits_p"))
    d5 = F.abs(F.col("opening_p") + F.col("cr") - F.col("dr") + extra - F.col("closing_p"))

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("int")

    out = d.select(
        "doc_id", "scale_p", F.coalesce("uncaptured", F.lit(0)).alias("uncaptured"),
        (F.col("opening_p").isNotNull() & (F.coalesce("balances", zero) >= 2) & (F.coalesce("moves", zero) >= 1))
        .alias("enough"),
        F.coalesce("chain_breaks", zero).alias("chain_breaks"),
        F.coalesce("first_break", F.lit(-1)).alias("first_break"),
        yes(last_ok & ~last_off & (d2 > TOL_P)).alias("closing_bad"),
        yes(d3 > TOL_P).alias("debits_bad"),
        yes(d4 > TOL_P).alias("credits_bad"),
        yes(~close_off & (d5 > TOL_P)).alias("net_bad"),
        F.coalesce("zip_breaks", zero).alias("zip_breaks"),
        (F.coalesce("misread", zero) + yes(last_ok & last_off) + yes(F.col("closing_p").isNotNull() & close_off)
         + F.coalesce("zip_misread", zero)).alias("unreadable"),
        (F.coalesce("chain_checks", zero) + yes(last_ok & ~last_off) + yes(F.col("total_debits_p").isNotNull())
         + yes(F.col("total_credits_p").isNotNull()) + yes(F.col("closing_p").isNotNull() & ~close_off)
         + F.coalesce("zip_checks", zero)).alias("checks"),
        F.greatest(
            F.coalesce("chain_d", zero), F.coalesce("zip_d", zero),
            F.when(last_ok & ~last_off & (d2 > TOL_P), d2).otherwise(zero),
            F.when(d3 > TOL_P, d3).otherwise(zero), F.when(d4 > TOL_P, d4).otherwise(zero),
            F.when(~close_off & (d5 > TOL_P), d5).otherwise(zero),
        ).alias("residual_p"),
    )
    n = F.col("chain_breaks") + F.col("closing_bad") + F.col("debits_bad") + F.col("credits_bad") + F.col(
        "net_bad") + F.col("zip_breaks")
    return out.withColumn("violations", n)


def grade(v: DataFrame) -> DataFrame:
    """Violations to a signal: abstain when incomplete or unreadable, else grade by what broke."""
    n = F.col("violations")
    hard = (F.col("chain_breaks") > 0) | (F.col("zip_breaks") > 0)
    material = (F.coalesce("scale_p", F.lit(0.0)) > 0) & (
        F.col("residual_p") >= F.col("scale_p") * float(MATERIAL_FRACTION))
    status = (
        F.when(~F.col("enough"), "NOT_EVALUATED").when((n > 0) & (F.col("uncaptured") > 0), "NOT_EVALUATED")
        .when((n == 0) & (F.col("unreadable") > 0), "NOT_EVALUATED").otherwise("VALID")
    )
    susp = F.when(n == 0, 0.0).when(hard, F.least(F.lit(1.0), F.round(0.9 + 0.05 * (n - 1), 4))).when(
        material, 0.40).otherwise(0.30)
    kind = F.when(n == 0, "clean").when(hard, "running_balance_break").otherwise("aggregate_only")
    return v.select(
        "doc_id", F.lit("arithmetic_consistency").alias("name"), status.alias("status"),
        F.when(status == "VALID", susp).alias("suspicion"), F.when(status == "VALID", kind).otherwise("").alias("severity"),
        "violations", "unreadable", "first_break",
    )


def edit_grid(stmts: DataFrame, txns: DataFrame, deltas_p: tuple[int, ...] = (5000, 250000, -150000)):
    """All single-field edits (row x debit/credit/balance x delta) as statement variants.

    Every variant is a whole statement with one cell changed, so rows grow with rows per statement squared; meant for
    one statement template at a time.
    """
    fields = ("debit_p", "credit_p", "balance_p")
    cells = txns.select(
        "doc_id", F.col("idx").alias("at"),
        F.explode(F.array(*[
            F.struct(F.lit(f).alias("field"), F.lit(d).cast("bigint").alias("delta"), F.col(f).isNotNull().alias("has"))
            for f in fields for d in deltas_p
        ])).alias("e"),
    ).filter("e.has")
    grid = cells.select(
        "doc_id", "at", "e.field", "e.delta",
        F.concat_ws("|", "doc_id", F.col("at").cast("string"), "e.field", F.col("e.delta").cast("string")).alias("variant"),
    )
    v = txns.join(by_key(grid), "doc_id")
    for f in fields:
        hit = (F.col("idx") == F.col("at")) & (F.col("field") == f)
        v = v.withColumn(f, F.when(hit, F.col(f) + F.col("delta")).otherwise(F.col(f)))
    edited = v.drop("doc_id").withColumnRenamed("variant", "doc_id").drop("at", "field", "delta")
    heads = grid.select("doc_id", "variant", "field").join(by_key(stmts), "doc_id").drop("doc_id").withColumnRenamed(
        "variant", "doc_id")
    return heads, edited
