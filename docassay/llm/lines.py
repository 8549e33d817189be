"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Two lines within one edit become equal once each loses at most one character. Emitting every deletion of every line would
cost the square of its length, so neighbourhoods are taken in steps. First whole blocks are deleted: for each block of a
line, two variants are keyed by what stands before and after it, for the block's width and for one character more. Lines
within one edit share such a key, since the edit lies in one block. Only lines that share a key with a different line go
on, to smaller blocks inside the deleted one and then to all variants with one character deleted, keyed together with
everything outside. Equal variants are of two kinds. Those that lost a character at the same place differ in that place
alone, so all lines of the key are within one edit of its earliest. A line that equals another's variant is within one
edit of all such others. Either way a key's lines need a minimum, not pairs; the edit distance to it is then verified.

A line is dropped if an earlier line (by document, then place) is equal to it or within one edit. One line may make up a
third of all lines: every grouping is a partial minimum, and joins on such keys are plain equi joins, which Spark splits.
Texts are never shuffled but for lines that a key has in common; what is grouped before that are hashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.session import durable

#: Shortest block in characters, blocks of the second step at most, and rows up to which a table of hashes is broadcast.
BLOCK, BLOCKS, SMALL = 16, 64, 1_000_000
_WIDE = "decimal(38,0)"


def split_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line, ord`` of every line that is not empty; ``ord`` sorts by document, then place."""
    lines = docs.filter("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line_no", "line"))
    return lines.filter("line <> ''").withColumn("ord", (F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)")
                                                         + F.col("line_no")).cast(_WIDE))


def _half(n: Column) -> Column:
    """The power of two that covers at least half of ``n``."""
    return F.pow(F.lit(2), F.greatest(F.lit(4), F.length(F.bin(F.greatest(n - 1, F.lit(0)))) - 1)).cast("int")


def _small_block(n: Column) -> Column:
    return F.greatest(F.lit(BLOCK), F.ceil(n / BLOCKS)).cast("int")


def block_variants(rows: DataFrame, width: Callable[[Column], Column]) -> DataFrame:
    """``rows`` (h, k, r and others) once for each block of ``r`` deleted: ``h, k`` become the key of all outside the
    block, ``r`` the block."""
    n = F.length("r")
    blocks = F.flatten(F.transform(F.array_distinct(F.array(width(n), width(n + 1))), lambda g: F.flatten(F.transform(
        F.sequence(F.lit(0), F.floor(n / g).cast("int")), lambda j: F.transform(
            F.array(g, g + 1), lambda size: F.struct((j * g).alias("at"), F.greatest(F.lit(0), n - j * g - size).alias("tail")))))))
    rest = [c for c in rows.columns if c not in ("h", "k", "r")]
    each = rows.withColumn("n", n).withColumn("_block", F.explode(F.array_distinct(blocks))).select("h", "k", "r", "n", "_block.at", "_block.tail", *rest)
    outside = [F.col("h"), F.col("k"), F.col("at"), F.col("tail"), F.substr("r", F.lit(1), F.col("at")), F.substr("r", F.col("n") - F.col("tail") + 1, F.col("tail"))]
    return each.select(F.xxhash64(*outside).alias("h"), F.xxhash64(F.lit(7), *outside).alias("k"),
                       F.substr("r", F.col("at") + 1, F.col("n") - F.col("at") - F.col("tail")).alias("r"), *rest)


def _meeting(rows: DataFrame, key: list[str], by: str) -> DataFrame:
    """The keys that rows with different ``by`` share."""
    return rows.groupBy(*key).agg(F.min(by).alias("lo"), F.max(by).alias("hi")).filter("lo < hi").select(*key)


def _root(lines: DataFrame, *keep: str) -> DataFrame:
    return lines.select(F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("k"), F.col("line").alias("r"), *keep)


def near_lines(lines: DataFrame) -> DataFrame:
    """``line, ord, earlier``: distinct lines with the earliest line within one edit of them, where that is before them."""
    named = lines.withColumn("a", F.xxhash64("line"))
    # the first step only chooses lines to look at, so single 64-bit hashes do: a clash adds a line, and loses none
    first = block_variants(_root(named, "a"), _half).select("h", "a")
    shared = durable(_meeting(first, ["h"], "a"))
    survivors = durable(first.join(shared, "h", "left_semi").select("a").distinct())
    survivors = F.broadcast(survivors) if survivors.count() <= SMALL else survivors
    some = named.join(survivors, "a", "left_semi").groupBy("line").agg(F.min("ord").alias("ord"))
    # short numbers in the order of ``ord``; the written table fixes them
    some = durable(some.repartitionByRange("ord").sortWithinPartitions("ord").withColumn("id", F.monotonically_increasing_id()))
    rows = _root(some, "id")
    for width in (_half, _small_block):
        rows = block_variants(rows, width)
        rows = durable(rows.join(_meeting(rows, ["h", "k"], "id"), ["h", "k"], "left_semi"))
    place = F.sequence(F.lit(1), F.length("r"))
    cut = F.filter(F.transform(place, lambda i: F.struct(i.alias("i"), F.concat(F.substr("r", F.lit(1), i - 1), F.substr("r", i + 1, F.length("r"))).alias("v"))),
                   lambda s: F.length("r") > 0)
    variants = rows.select("h", "k", "id", F.explode(F.concat(cut, F.array(F.struct(F.lit(0).alias("i"), F.col("r").alias("v"))))).alias("s")).select(
        "id", "s.i", F.xxhash64("h", "k", "s.v").alias("h"), F.xxhash64(F.lit(7), "h", "k", "s.v").alias("k"))
    variants = durable(variants.distinct())
    # i = 0: the line itself; the others lost their i-th character
    same_place = variants.filter("i > 0").groupBy("h", "k", "i").agg(F.min("id").alias("earlier"), F.max("id").alias("last")).filter("earlier < last").drop("last")
    star = variants.groupBy("h", "k").agg(F.min(F.when(F.col("i") == 0, F.col("id"))).alias("centre"), F.min(F.when(F.col("i") > 0, F.col("id"))).alias("leaf"),
                                          F.max(F.when(F.col("i") > 0, F.col("id"))).alias("last_leaf")).filter("centre < last_leaf or leaf < centre")
    pairs = variants.join(same_place, ["h", "k", "i"]).select("id", "earlier").unionByName(
        variants.join(star, ["h", "k"]).select("id", F.when(F.col("i") == 0, F.col("leaf")).otherwise(F.col("centre")).alias("earlier")))
    pairs = pairs.filter("earlier < id").distinct()
    before = some.select(F.col("id").alias("earlier"), F.col("line").alias("other"), F.col("ord").alias("other_ord"))
    checked = pairs.join(some, "id").join(before, "earlier").filter(F.levenshtein("line", "other", 1) >= 0)
    return checked.groupBy("line", "ord").agg(F.min("other_ord").alias("earlier"))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, first_doc_id, first_line_no, exact``: every line to drop, with the earliest line that it repeats;
    ``exact`` if an equal line comes first.

    ``line_no`` counts from 0. Defined cases: null ids, null texts and empty lines are left alone; rows with one id count
    as one document, of which lines with one number count as one place; an empty table gives an empty table.
    """
    lines = split_lines(docs)
    near = durable(near_lines(lines))
    named = lines.select("doc_id", "line_no", "ord", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))
    equal = named.groupBy("a", "b").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last").drop("last")
    close = near.select(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"), "earlier")
    known = durable(equal.join(close, ["a", "b"], "full"))
    hit = named.join(known, ["a", "b"]).withColumn("origin", F.least(F.when(F.col("first") < F.col("ord"), F.col("first")), F.col("earlier"))).filter("origin is not null")
    wide = F.lit(1 << 32).cast("decimal(10,0)")
    doc = F.floor(F.col("origin") / wide).cast("bigint")
    return hit.select("doc_id", "line_no", doc.alias("first_doc_id"), (F.col("origin") - doc.cast("decimal(19,0)") * wide).cast("int").alias("first_line_no"),
                      F.coalesce(F.col("first") < F.col("ord"), F.lit(False)).alias("exact")).distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with the dropped lines taken out of ``text``."""
    gone = dropped_lines(docs).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i))
    return docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


#: The dropped lines in SQL, for checking: every deletion of every distinct line.
SQL = r"""
WITH l AS (SELECT doc_id, CAST(n AS INT) AS line_no, line, CAST(doc_id AS HUGEINT) * 4294967296 + n AS ord
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)
           WHERE line <> ''),
u AS (SELECT line, min(ord) AS ord FROM l GROUP BY line),
v AS (SELECT ord, i, md5(substring(line, 1, i - 1) || substring(line, i + 1)) AS v FROM (SELECT line, ord, unnest(range(1, length(line) + 1)) AS i FROM u)
      UNION ALL SELECT ord, 0, md5(line) FROM u),
same_place AS (SELECT v, i, min(ord) AS e FROM v WHERE i > 0 GROUP BY v, i HAVING count(*) > 1),
star AS (SELECT v, min(ord) FILTER (WHERE i = 0) AS c, min(ord) FILTER (WHERE i > 0) AS f FROM v GROUP BY v HAVING c IS NOT NULL AND f IS NOT NULL),
near AS (SELECT ord, min(e) AS e FROM (
           SELECT v.ord, s.e FROM v JOIN same_place s ON v.v = s.v AND v.i = s.i
           UNION ALL SELECT v.ord, CASE WHEN v.i = 0 THEN s.f ELSE s.c END FROM v JOIN star s ON v.v = s.v) WHERE e < ord GROUP BY ord),
origin AS (SELECT l.doc_id, l.line_no, l.ord, u.ord AS first, near.e FROM l JOIN u ON l.line = u.line LEFT JOIN near ON near.ord = u.ord)
SELECT doc_id, line_no, CAST(o // 4294967296 AS BIGINT) AS first_doc_id, CAST(o % 4294967296 AS INT) AS first_line_no, exact
FROM (SELECT doc_id, line_no, first < ord AS exact, least(CASE WHEN first < ord THEN first END, e) AS o FROM origin) WHERE o IS NOT NULL
"""
