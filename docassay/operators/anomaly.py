"""Review-only anomaly detectors over statements. A detector without enough data answers evaluated = false."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.operators.scan import ordered
from docassay.rulebook import (
    MIN_SALARY_CREDITS, ROUND_BASE, ROUND_FRACTION, SALARY_JUMP, SALARY_WORDS_ANOMALY, SEVERITY_BANDS,
    SHORT_WINDOW_DAYS,
)


def finding(df: DataFrame, anomaly: str, evaluated: Column, triggered: Column, measure: Column) -> DataFrame:
    return df.select(
        "doc_id", F.lit(anomaly).alias("anomaly_id"), evaluated.alias("evaluated"),
        (evaluated & F.coalesce(triggered, F.lit(False))).alias("triggered"),
        F.coalesce(F.when(evaluated, measure.cast("double")), F.lit(-1.0)).alias("measure"),
    )


def _salary() -> Column:
    """Trusted credit whose narration, trusted or not, speaks of a salary."""
    return F.col("credit").isNotNull() & F.coalesce(F.col("description_any").rlike(SALARY_WORDS_ANOMALY), F.lit(False))


def round_salary(txns: DataFrame) -> DataFrame:
    s = _salary()
    g = txns.groupBy("doc_id").agg(
        F.count_if(s).alias("n"), F.count_if(s & (F.col("credit") % ROUND_BASE == 0)).alias("r"))
    share = F.try_divide("r", "n")
    return finding(g, "A_FIN_1", F.col("n") >= MIN_SALARY_CREDITS, share >= ROUND_FRACTION, F.round(share, 6))


def salary_jump(txns: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Largest ratio between salary sums of consecutive months that have one, in either direction."""
    m = txns.filter(_salary() & F.col("posted_any").isNotNull()).groupBy(
        "doc_id", F.trunc("posted_any", "MM").alias("month")).agg(F.sum("credit").alias("total"))
    m = ordered(m, ["doc_id"], ["month"], lasts={"before": F.col("total")},
                base=base)
    a, b = F.col("before").cast("double"), F.col("total").cast("double")
    ratio = F.when(a > 0, F.when(b >= a, F.try_divide(b, a)).otherwise(F.try_divide(a, b)))
    g = m.groupBy("doc_id").agg(F.count(F.lit(1)).alias("months"), F.max(ratio).alias("worst"))
    g = txns.select("doc_id").distinct().join(g, "doc_id", "left")
    worst = F.coalesce("worst", F.lit(0.0))
    return finding(g, "A_FIN_2", F.coalesce("months", F.lit(0)) >= 2, worst > SALARY_JUMP, F.round(worst, 6))


def short_window(periods: DataFrame) -> DataFrame:
    """``periods``: (doc_id, period_start, period_end) as dates."""
    days = F.datediff("period_end", "period_start")
    return finding(periods, "A_FIN_3", days.isNotNull(), (days >= 0) & (days < SHORT_WINDOW_DAYS), days)


def dormant_revival(history: DataFrame, gap_days: int = 180, factor: int = 2,
                    base: DataFrame | None = None) -> DataFrame:
    """Longest silence of an account, and whether the credits after it outweigh those before by ``factor``.

    ``history``: (doc_id, day, credit, debit). Needs at least two dated rows; the gap has to reach ``gap_days``.
    """
    h = history.filter(F.col("day").isNotNull()).groupBy("doc_id", "day").agg(
        F.coalesce(F.sum("credit"), F.lit(0).cast("decimal(20,2)")).alias("credit"))
    h = ordered(h, ["doc_id"], ["day"], lasts={"before": F.col("day")},
                sums={"cum": F.col("credit")}, base=base)
    gap = F.datediff("day", "before")
    g = h.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("days"), F.sum("credit").alias("all"),
        F.max_by(F.struct(gap.alias("gap"), (F.col("cum") - F.col("credit")).alias("prior")),
                 F.when(gap.isNotNull(), F.struct(gap, -F.unix_date("day")))).alias("w"),
    )
    after = F.col("all") - F.col("w.prior")
    hit = (F.col("w.gap") >= gap_days) & (after >= F.col("w.prior") * factor) & (after > 0)
    return finding(g, "A_FIN_4", F.col("days") >= 2, hit, F.col("w.gap"))


def reused_agreement(docs: DataFrame) -> DataFrame:
    """Same parties and amount under several applicants, by digest."""
    d = docs.withColumn("digest", F.sha2(F.concat_ws("|", "parties", F.col("amount_p").cast("string")), 256))
    pairs = d.select("digest", "applicant").distinct()
    return pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("applicants")).filter(F.col("applicants") > 1)


def missing_blocks(docs: DataFrame, headings: DataFrame, rate: float = 0.5) -> DataFrame:
    """Share of the expected headings a document lacks; flagged above ``rate``.

    A heading is a line of its own, so lines join the reference headings by equality (normalised spaces and case).
    """
    n = headings.count()
    norm = F.trim(F.regexp_replace(F.lower(F.col("line")), r"\s+", " "))
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", norm.alias("heading"))
    hit = lines.join(headings, "heading", "left_semi").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("present"))
    g = docs.select("doc_id").join(hit, "doc_id", "left")
    lack = (F.lit(n) - F.coalesce("present", F.lit(0))) / F.lit(max(n, 1))
    return finding(g, "A_LEGAL_2", F.lit(n > 0), lack > rate, F.round(lack, 6))


def anomaly_signal(findings: DataFrame) -> DataFrame:
    """Any trigger gives the review-only band; none evaluated is pending."""
    g = findings.groupBy("doc_id").agg(
        F.count_if("evaluated").alias("evaluated"), F.count_if("triggered").alias("triggered"))
    status = F.when(F.col("evaluated") == 0, "NOT_EVALUATED").otherwise("VALID")
    susp = F.when(F.col("triggered") > 0, F.lit(SEVERITY_BANDS["review_only"])).otherwise(F.lit(0.0))
    return g.select("doc_id", F.lit("anomaly_intelligence").alias("name"), status.alias("status"),
                    F.coalesce(F.when(F.col("evaluated") > 0, susp), F.lit(-1.0)).alias("suspicion"),
                    "evaluated", "triggered")
