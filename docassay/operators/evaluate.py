"""Evaluation jobs over run results and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_signal(signals: DataFrame, keys: list[str]) -> DataFrame:
    """First signal by order with suspicion above 0.3, else the first error."""
    strong = (F.col("status") == "VALID") & (F.col("suspicion") > 0.3)
    err = F.col("status") == "ERROR"
    at = F.struct("ord", "name")
    g = signals.groupBy(*keys).agg(F.min_by("name", F.when(strong, at)).alias("_s"), F.min_by("name", F.when(err, at)).alias("_e"))
    return g.select(*keys, F.coalesce("_s", F.concat(F.lit("error:"), F.col("_e")), F.lit("none")).alias("key_signal"))


def detection_metrics(results: DataFrame, by: str) -> DataFrame:
    """Recall, false-positive rate, precision and F1 per value of ``by`` and over all. ``results``: tampered, flagged."""
    tp, fp = F.count_if(F.col("tampered") & F.col("flagged")), F.count_if(~F.col("tampered") & F.col("flagged"))
    fn, tn = F.count_if(F.col("tampered") & ~F.col("flagged")), F.count_if(~F.col("tampered") & ~F.col("flagged"))
    g = results.cube(by).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    recall, precision = F.try_divide("tp", F.col("tp") + F.col("fn")), F.try_divide("tp", F.col("tp") + F.col("fp"))

    def rate(c: Column) -> Column:
        return F.round(F.coalesce(c, F.lit(-1.0)), 6)

    return g.select(
        F.coalesce(by, F.lit("(all)")).alias(by), "tp", "fp", "fn", "tn", rate(recall).alias("recall"), rate(precision).alias("precision"),
        rate(F.try_divide("fp", F.col("fp") + F.col("tn"))).alias("false_positive_rate"),
        rate(F.try_divide(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))).alias("f1"))


def fail_closed_rate(verdicts: DataFrame) -> DataFrame:
    """Share of documents with an injected failure that were not approved."""
    return verdicts.agg(F.count(F.lit(1)).alias("failures"), F.round(F.avg((F.col("verdict") != "APPROVED").cast("double")), 6).alias("not_approved"))


def latency_by_tier(runs: DataFrame, accuracy: int = 10000) -> DataFrame:
    """Approximate latency quantiles per tier (bounded sketches, mergeable)."""
    q = F.percentile_approx("latency_ms", [0.5, 0.95, 0.99], accuracy)
    return runs.groupBy("tier").agg(F.count(F.lit(1)).alias("runs"), q.alias("q")).select(
        "tier", "runs", F.get("q", F.lit(0)).alias("p50"), F.get("q", F.lit(1)).alias("p95"), F.get("q", F.lit(2)).alias("p99"))


def exact_latency(runs: DataFrame) -> DataFrame:
    """Exact quantiles, interpolated, where the runs of a tier fit a task; the sketch above is for any size."""
    return runs.groupBy("tier").agg(F.count(F.lit(1)).alias("runs"), *[
        F.round(F.percentile("latency_ms", q), 6).alias(n) for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])


def mutate_amounts(df: DataFrame, key: str, amount: str) -> DataFrame:
    """One deterministic variant per row of an amount in paise: x1.1, x1.5, zero, or +0.99."""
    k = F.pmod(F.col(key), F.lit(4))
    a = F.col(amount)
    v = F.when(k == 0, F.expr(f"{amount} * 11 div 10")).when(k == 1, F.expr(f"{amount} * 3 div 2")).when(k == 2, F.lit(0)).otherwise(a + 99)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("x1.1", "x1.5", "zero", "plus_0.99")]), (k + 1).cast("int"))
    return df.withColumn("mutation", kind).withColumn("mutated", v.cast("bigint"))


def mutate_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Swap two neighbouring letters, or change one digit, at a place chosen by the key."""
    n = F.length(text)
    at = (F.pmod(F.col(key), F.greatest(n - 1, F.lit(1))) + 1).cast("int")
    c = F.col(text)
    swapped = F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + 1, F.lit(1)), F.substring(c, at, F.lit(1)), F.substring(c, at + 2, n))
    digit = F.regexp_replace(c, "[0-9]$", (F.col(key) % 10).cast("string"))
    return df.withColumn("swapped", F.when(n >= 2, swapped).otherwise(c)).withColumn("redigited", digit)


def constant_detectors(pairs: DataFrame) -> DataFrame:
    """Detectors that never score a tampered document differently from its genuine twin. ``pairs``: name, genuine, tampered."""
    g = pairs.groupBy("name").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(~F.col("genuine").eqNullSafe(F.col("tampered"))).alias("told_apart"))
    return g.withColumn("constant", F.col("told_apart") == 0)


def identity_matrix(values: DataFrame, comparisons: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """Field x document grid with the agreement of each field."""
    grid = values.groupBy(key, "field").pivot("label", labels).agg(F.min_by("value", "ord"))
    return grid.join(comparisons.select(key, "field", "status", "severity"), [key, "field"], "left")


def pack_rollup(results: DataFrame) -> DataFrame:
    """Rules and failures per pack and rule, per pack, and in total."""
    return results.rollup("domain", "rule_id").agg(F.count(F.lit(1)).alias("rules"), F.count_if(F.col("status") == "FAIL").alias("failed"))
