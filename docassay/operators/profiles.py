"""Profile jobs over metadata, fonts and amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.rulebook import (
    RED_FLAG, SOURCE_AVOIDED, WEIGHTS,
    EDITING_TOOLS, FONT_BASE, FONT_EXTRA, FONT_MIN_SPANS, LEGITIMATE_PRODUCERS, META_EDITING, META_EXTRA_UPDATE,
    META_IMPOSSIBLE_ORDER, META_LARGE_SKEW, META_MISSING, META_SKEW_DAYS, META_UPDATE,
)


def _any_of(text: Column, needles: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(n) for n in needles]), lambda n: F.contains(text, n))


def metadata_profile(meta: DataFrame) -> DataFrame:
    """Additive suspicion from producer, updates after signing and date order.

    ``meta``: doc_id, producer, creator, eof_marks, startxref_marks, signed, created, modified.
    """
    both = F.lower(F.concat_ws(" | ", F.nullif("producer", F.lit("")), F.nullif("creator", F.lit(""))))
    legit = _any_of(both, LEGITIMATE_PRODUCERS)
    editing = ~legit & _any_of(both, EDITING_TOOLS)
    updates = F.greatest(F.lit(0), F.greatest("eof_marks", "startxref_marks") - 1)
    after = F.greatest(F.lit(0), updates - F.when(F.col("signed"), 1).otherwise(0))
    missing = (F.coalesce("producer", F.lit("")) == "") & (F.coalesce("creator", F.lit("")) == "")
    days = (F.unix_micros("modified") - F.unix_micros("created")) / 86400e6
    m = meta.select(
        "doc_id", F.coalesce(legit, F.lit(False)).alias("legitimate"), F.coalesce(editing, F.lit(False)).alias("editing_tool"),
        after.alias("updates_after"), missing.alias("missing"), F.coalesce(days < 0, F.lit(False)).alias("impossible"),
        F.coalesce(days > META_SKEW_DAYS, F.lit(False)).alias("skewed"))
    s = (
        F.when(F.col("editing_tool"), META_EDITING).otherwise(0.0)
        + F.when(F.col("updates_after") > 0, META_UPDATE + META_EXTRA_UPDATE * (F.col("updates_after") - 1)).otherwise(0.0)
        + F.when(F.col("impossible"), META_IMPOSSIBLE_ORDER).when(F.col("skewed"), META_LARGE_SKEW).otherwise(0.0)
        + F.when(F.col("missing"), META_MISSING).otherwise(0.0))
    return m.withColumn("suspicion", F.least(F.lit(1.0), F.round(s, 6)))


def marker_counts(files: DataFrame) -> DataFrame:
    """Save markers and signature flag of binary files (path, content)."""
    t = F.decode("content", "ISO-8859-1")
    return files.select("path", F.regexp_count(t, F.lit("%%EOF")).alias("eof_marks"),
                        F.regexp_count(t, F.lit(r"\bstartxref\b")).alias("startxref_marks"),
                        F.contains(t, F.lit("/ByteRange")).alias("signed"))


def font_consistency(spans: DataFrame) -> DataFrame:
    """Base faces that occur under more than one subset tag. ``spans``: doc_id, font. Distinct first, then counted."""
    tag = F.regexp_extract("font", r"^([A-Z]{6})\+(.+)$", 1)
    base = F.when(tag != "", F.regexp_extract("font", r"^([A-Z]{6})\+(.+)$", 2)).otherwise(F.col("font"))
    n = spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"))
    tags = spans.select("doc_id", base.alias("base"), tag.alias("tag")).distinct().groupBy("doc_id", "base").agg(
        F.count(F.lit(1)).alias("tags"))
    bad = tags.groupBy("doc_id").agg(F.count_if(F.col("tags") > 1).alias("inconsistent"))
    j = n.join(bad, "doc_id")
    few = F.col("spans") < FONT_MIN_SPANS
    s = F.when(F.col("inconsistent") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.round(FONT_BASE + FONT_EXTRA * (F.col("inconsistent") - 1), 6)))
    return j.select("doc_id", "spans", "inconsistent", F.when(few, "NOT_EVALUATED").otherwise("VALID").alias("status"),
                    F.when(few, -1.0).otherwise(s).alias("suspicion"))


def source_avoidance(documents: DataFrame) -> DataFrame:
    """``documents``: doc_id, issuer (null if none is recognised), signed. A document of an issuer that would give it from
    the source, and that is not signed, is flagged; without an issuer, or with a signature, there is nothing to say."""
    avoided = F.col("issuer").isNotNull() & ~F.coalesce("signed", F.lit(False))
    name = "pdf_only_red_flag"
    return documents.select("doc_id", "issuer", F.lit(name).alias("name"), F.when(avoided, "VALID").otherwise("NOT_EVALUATED").alias("status"),
                            F.when(avoided, F.lit(SOURCE_AVOIDED)).alias("suspicion"), F.lit(WEIGHTS[name]).alias("weight"), F.when(avoided, F.lit(RED_FLAG)).alias("red_flag"))
