"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document expects ``target / source_size`` copies, with sizes in words. Within its source the expected copies are
summed up in a fixed order, one offset per source is added, and a document is emitted once for each whole number that its
interval crosses. So a document gets the whole part of its expectation or one more, and any run of documents gets its
share to within one copy. The order goes by classes of like size and then by a hash of the id: each size class is sampled
in proportion, which keeps the words of the mix near the target as well as the copies.

A source may hold most rows. Its running sum is taken in blocks of one size class and one hash range: a window inside
each block, and one over the blocks' totals, of which there is one row per ``BLOCK`` documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.session import durable

#: A word is a run of anything but space and the five control characters of white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the mix: weights by place of the source in code-point order, and the most that words repeat.
WEIGHTS, LIMIT = (5, 2, 1), 3
#: Rows of a block of the running sum, and the unit of an expected copy.
BLOCK, UNIT = 1 << 14, 1_000_000_000
#: Columns that the mix adds, and the one that carries a whole row through it.
RESULTS, WHOLE = ("size", "source_size", "target", "copies"), "_whole"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: shares of all words by weight, none above ``limit``
    times its source, the excess reshared.

    With sources ordered by cap over weight, a source stops at its cap exactly if the level that is left for it and all
    after it reaches its cap. One row per source, so the ordered windows are small.
    """
    one = Window.partitionBy(F.lit(1))
    places = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    by_level = one.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(places) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(limit) * F.col("source_size")).withColumn("total", F.sum("source_size").over(one))
    s = s.withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("weights", F.sum("weight").over(onward))
    s = s.withColumn("full", F.col("cap").cast("double") * F.col("weights") <= F.col("left").cast("double") * F.col("weight"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(one), F.lit(0))).cast("double") / F.sum(
        F.when(~F.col("full"), F.col("weight"))).over(one).cast("double")
    return s.withColumn("level", level).select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(
        F.col("weight").cast("double") * F.col("level")).alias("target"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT,
        with_text: bool = True) -> DataFrame:
    """The columns of ``docs`` (``text`` only if asked for) with ``size``, ``source_size``, ``target`` and ``copies``.

    ``docs``: doc_id, text, source and whatever else is to be carried. Defined cases: a null text has size 0; a null
    source is a source of its own, last in order; a source without words has target 0 and gets no copies; rows with one
    doc_id are separate documents, and with a null one too; texts of any length are counted whole; ties of order go by id,
    size and a hash of the text; an empty table gives an empty table. Reruns agree, since order and offset are hashes of the
    ids, the source and ``seed``. Columns of ``docs`` that are named like a result, or begin with ``_``, are left out
    (:func:`emitted` keeps them).
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS and (c == WHOLE or not c.startswith("_"))])
    key = F.coalesce(F.col("source").cast("string"), F.lit(""))
    sized = docs.withColumn("size", word_count(F.col("text"))).withColumn("_no_source", F.col("source").isNull()).withColumn("_source", key)
    bits = F.length(F.bin("size"))
    sized = sized.withColumn("_class", (bits * 16 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))")).cast("int"))
    sized = sized.withColumn("_tie", F.xxhash64("text")).withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    group = ["_no_source", "_source"]
    sized = durable(sized if with_text else sized.drop("text"))
    counts = durable(sized.groupBy(*group, "_class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    targets = source_targets(counts.groupBy(*group).agg(F.sum("words").alias("source_size")).withColumn(
        "source", F.when(~F.col("_no_source"), F.col("_source"))), weights, limit)
    lead = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("bigint")
    targets = targets.select(
        F.col("source").isNull().alias("_no_source"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("bigint").alias("_units"),
        F.floor(lead * UNIT / F.lit(1 << 32)).cast("bigint").alias("_offset"))
    plan = counts.select(*group, "_class", F.ceil(F.col("n") / BLOCK).cast("bigint").alias("_blocks")).join(targets, group)
    plan = durable(plan)
    place = F.conv(F.substring("_order", 1, 8), 16, 10).cast("bigint")
    block = F.floor(place * F.col("_blocks") / F.lit(1 << 32)).cast("bigint")
    rows = sized.join(plan, [*group, "_class"]).withColumn("_block", block)
    whole = [*group, "_class", "_block"]
    inside = Window.partitionBy(*whole).orderBy("_order", "doc_id", "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("_class", "_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*whole).agg(F.sum("_units").cast("decimal(28,0)").alias("u"))
    starts = totals.select(*whole, F.pmod(F.coalesce(F.sum("u").over(earlier), F.lit(0).cast("decimal(38,0)")), F.lit(UNIT)).cast("bigint").alias("_start"))
    placed = rows.withColumn("_inside", F.coalesce(F.sum("_units").over(inside), F.lit(0))).join(starts, whole)
    at = F.col("_start") + F.col("_inside") + F.col("_offset")
    placed = placed.withColumn("_at", at)
    copies = F.expr(f"(_at + _units) div {UNIT} - _at div {UNIT}")
    kept = [c for c in docs.columns if c in placed.columns]
    return placed.withColumn("copies", copies).select(*kept, "size", "source_size", "target", "copies")


def emitted(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as many times as it has copies, with all columns of ``docs``, whatever their names."""
    packed = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(WHOLE))
    m = mix(packed, with_text=False, **how)
    return m.filter("copies > 0").select(WHOLE, F.explode(F.sequence(F.lit(1), F.col("copies")))).select(f"{WHOLE}.*")


#: The mix of all documents in SQL, for checking.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
bits AS (SELECT *, length(bin(size)) AS b FROM sized),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
         3 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM sizes),
ordered AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM weighed),
filled AS (SELECT *, CAST(cap AS DOUBLE) * weights <= CAST(remaining AS DOUBLE) * weight AS is_full FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(weight AS DOUBLE) * (
         CAST(total - coalesce(sum(cap) FILTER (WHERE is_full) OVER (), 0) AS DOUBLE) / CAST(sum(weight) FILTER (WHERE NOT is_full) OVER () AS DOUBLE)) END AS target
  FROM filled),
units AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 1000000000) AS BIGINT) ELSE 0 END AS u,
         (CAST(('0x' || substr(md5('0/' || coalesce(source, '')), 1, 8)) AS BIGINT) * 1000000000) // 4294967296 AS o FROM targets),
summed AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, t.o,
         sum(t.u) OVER (PARTITION BY d.source ORDER BY d.b * 16 + (d.size >> greatest(d.b - 4, 0)), md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM bits d JOIN units t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(((upto + o) // 1000000000 - (upto - u + o) // 1000000000) * size AS BIGINT) AS taken FROM summed
"""
