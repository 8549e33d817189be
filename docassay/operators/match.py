"""Similarity joins: perceptual hashes, template descriptors, duplicate-region votes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docassay.functions.hashing import hamming, hash_words
from docassay.operators.scan import hot_keys
from docassay.rulebook import (
    HAMMING_THRESHOLD, MAX_SPREAD, MIN_CLUSTER, MIN_DOMINANT, MIN_OFFSET_PX, MIN_PAIR_DISTANCE_PX, OFFSET_BIN_PX,
    RATIO_TEST, TEMPLATE_MIN_GOOD, TEMPLATE_MIN_RATIO, TEMPLATE_NO_MATCH,
)
from docassay.session import durable

_SUB_KEYS = ["band", "bits", "sub", "sbits"]


def _cuts(parts: int) -> list[tuple[int, int]]:
    """Hex-digit ranges (start, length) of ``parts`` bands over 64 digits."""
    edges = [round(i * 64 / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def bands(df: DataFrame, hex_col: str, parts: int) -> DataFrame:
    """One row per band of the hash: two hashes within ``parts - 1`` bits share at least one band exactly."""
    items = [F.struct(F.lit(i).alias("band"), F.substring(hex_col, a + 1, n).alias("bits"))
             for i, (a, n) in enumerate(_cuts(parts))]
    return df.withColumn("_b", F.explode(F.array(*items))).select("*", "_b.*").drop("_b")


def _sub_bands(df: DataFrame, col: str, parts: int) -> DataFrame:
    """The digits outside a row's band cut into bands again: a pair that shares a band value is within the threshold on the
    rest as well, so it shares one of these exactly."""
    rest = F.lit(None).cast("string")
    for i, (a, n) in enumerate(_cuts(parts)):
        rest = F.when(F.col("band") == i, F.concat(F.substring(col, 1, a), F.substring(col, a + n + 1, 64))).otherwise(rest)
    left = df.withColumn("_rest", rest)
    size = F.length("_rest")
    sub = [F.struct(F.lit(j).alias("sub"),
                    F.substring(F.col("_rest"), (F.floor(size * j / parts) + 1).cast("int"),
                                (F.floor(size * (j + 1) / parts) - F.floor(size * j / parts)).cast("int")).alias("sbits"))
           for j in range(parts)]
    return left.withColumn("_s", F.explode(F.array(*sub))).select("*", "_s.*").drop("_s", "_rest")


def _pairs(q: DataFrame, s: DataFrame, parts: int) -> DataFrame:
    """Candidate pairs that share a band. A band value with very many stored hashes is banded again on the rest, so recall
    stays whole while the crowded bucket splits."""
    sb = bands(s, "s_hex", parts)
    crowded = hot_keys(sb, ["band", "bits"])
    qb = bands(q, "q_hex", parts)
    if crowded is None:
        return qb.join(sb, ["band", "bits"]).drop("band", "bits")
    hot = crowded.select("band", "bits")
    light = qb.join(hot, ["band", "bits"], "left_anti").join(sb, ["band", "bits"]).drop("band", "bits")

    def rest(df: DataFrame, col: str) -> DataFrame:
        return _sub_bands(df.join(hot, ["band", "bits"], "left_semi"), col, parts)

    heavy = rest(qb, "q_hex").join(rest(sb, "s_hex"), _SUB_KEYS).drop(*_SUB_KEYS)
    return light.unionByName(heavy)


def nearest_hash(queries: DataFrame, store: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """Nearest stored hash within ``threshold`` bits per query; the earliest entry wins ties.

    ``queries``: query_id, hash_hex; ``store``: entry_id (in insertion order), label, hash_hex. Copies collapse on both
    sides first (the earliest entry stands for a stored hash), so many identical documents cost one row.
    """
    parts = threshold + 1
    s = store.groupBy(F.col("hash_hex").alias("s_hex")).agg(
        F.min("entry_id").alias("entry_id"), F.min_by("label", "entry_id").alias("label"))
    q = queries.select(F.col("hash_hex").alias("q_hex")).distinct()
    d = hamming(hash_words(F.col("q_hex")), hash_words(F.col("s_hex")))
    hits = _pairs(q, s, parts).withColumn("distance", d).filter(F.col("distance") <= threshold)
    best = hits.groupBy("q_hex").agg(F.min_by(F.struct("entry_id", "label", "distance"), F.struct("distance", "entry_id")).alias("m"))
    return queries.join(best, queries.hash_hex == best.q_hex).select("query_id", "m.entry_id", "m.label", "m.distance")


class BandStore:
    """A hash store kept as a band index: tables bucketed by the band they are probed with.

    Batches are shuffled (or broadcast) to the buckets; what is stored stays where it lies. Band values that are crowded
    when the store is built are kept by sub-band in a table of their own. Hashes, sessions and labels are all it holds.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, threshold: int = HAMMING_THRESHOLD, buckets: int = 16):
        self.spark, self.name, self.folder, self.parts, self.threshold, self.buckets = spark, name, folder, threshold + 1, threshold, buckets

    def _write(self, df: DataFrame, table: str, keys: list[str]) -> None:
        w = df.repartition(self.buckets, *keys).write.mode("append").bucketBy(self.buckets, *keys).option("path", f"{self.folder}/{table}")
        w.saveAsTable(f"{self.name}_{table}")

    def build(self, entries: DataFrame) -> BandStore:
        """``entries``: entry_id (in order of insertion), session_id, label, hash_hex. Copies of a hash are kept once."""
        s = durable(self._distinct(entries))
        crowded = hot_keys(bands(s.select("s_hex"), "s_hex", self.parts), ["band", "bits"])
        hot = crowded.select("band", "bits") if crowded is not None else self.spark.createDataFrame([], "band int, bits string")
        hot.write.parquet(f"{self.folder}/crowded")
        self.add(s, distinct=True)
        return self

    def _distinct(self, entries: DataFrame) -> DataFrame:
        first = F.min_by(F.struct("session_id", "label"), "entry_id").alias("e")
        return entries.groupBy(F.col("hash_hex").alias("s_hex")).agg(F.min("entry_id").alias("entry_id"), first).select("s_hex", "entry_id", "e.*")

    def add(self, entries: DataFrame, distinct: bool = False) -> None:
        """Append entries; existing files stay."""
        rows = bands(entries if distinct else self._distinct(entries), "s_hex", self.parts)
        hot = self._crowded()
        self._write(rows.join(hot, ["band", "bits"], "left_anti"), "light", ["band", "bits"])
        self._write(_sub_bands(rows.join(hot, ["band", "bits"], "left_semi"), "s_hex", self.parts), "heavy", _SUB_KEYS)

    def _crowded(self) -> DataFrame:
        return self.spark.read.schema("band int, bits string").parquet(f"{self.folder}/crowded")

    def stored(self) -> DataFrame:
        """One row per stored hash and band."""
        columns = ["entry_id", "session_id", "label", "s_hex", "band", "bits"]
        heavy = self.spark.table(f"{self.name}_heavy").select(*columns).distinct()
        return self.spark.table(f"{self.name}_light").select(*columns).unionByName(heavy)

    def nearest(self, queries: DataFrame) -> DataFrame:
        """Nearest stored hash within the threshold per query (query_id, hash_hex); the earliest entry wins ties."""
        q = bands(queries.select(F.col("hash_hex").alias("q_hex")).distinct(), "q_hex", self.parts)
        hot = self._crowded()
        light = q.join(hot, ["band", "bits"], "left_anti").join(self.spark.table(f"{self.name}_light"), ["band", "bits"]).drop("band", "bits")
        heavy = _sub_bands(q.join(hot, ["band", "bits"], "left_semi"), "q_hex", self.parts).join(
            self.spark.table(f"{self.name}_heavy"), _SUB_KEYS).drop(*_SUB_KEYS)
        d = hamming(hash_words(F.col("q_hex")), hash_words(F.col("s_hex")))
        hits = light.unionByName(heavy).withColumn("distance", d).filter(F.col("distance") <= self.threshold)
        best = hits.groupBy("q_hex").agg(F.min_by(F.struct("entry_id", "session_id", "label", "distance"), F.struct("distance", "entry_id")).alias("m"))
        return queries.join(best, queries.hash_hex == best.q_hex).select("query_id", "m.entry_id", "m.session_id", "m.label", "m.distance")


def hash_matches(queries: DataFrame, store: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """Every distinct (query hash, stored hash) within the threshold, with its distance."""
    s = store.select(F.col("hash_hex").alias("s_hex")).distinct()
    q = queries.select(F.col("hash_hex").alias("q_hex")).distinct()
    d = hamming(hash_words(F.col("q_hex")), hash_words(F.col("s_hex")))
    return _pairs(q, s, threshold + 1).withColumn("distance", d).filter(F.col("distance") <= threshold).distinct()


def resubmission_signal(queries: DataFrame, matches: DataFrame, threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """0.8 for a match, rising to 1.0 with closeness; 0 without one."""
    j = queries.select("query_id").join(matches, "query_id", "left")
    near = F.greatest(F.lit(0.0), 1.0 - F.col("distance") / F.lit(max(threshold, 1)))
    return j.select("query_id", F.coalesce("distance", F.lit(-1)).cast("int").alias("distance"),
                    F.when(F.col("distance").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.round(0.8 + 0.2 * near, 6))).alias("suspicion"))


BLOCK = 16384  # descriptors on a side of a tile (8 MB at 64 doubles)
CELLS = 1 << 22  # distances, or components of candidates, that are held at once


def _matrix(lists: pa.Array) -> np.ndarray:
    """Descriptors, one below the other, as doubles."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, from differences."""
    out = np.empty(len(x))
    step = max(1, CELLS // max(1, x.shape[1]))
    for a in range(0, len(x), step):
        out[a:a + step] = np.sqrt(((x[a:a + step] - y[a:a + step]) ** 2).sum(1))
    return out


def _two_least(x: np.ndarray, y: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """The two least distances of each row of ``x`` to the rows of ``y``, of which each counts ``copies`` times; a second
    that does not exist is -1.

    A product of matrices gives all squared distances up to a rounding error far below ``slack``; those of what can be among
    the two nearest are then taken from differences.
    """
    two = np.full((len(x), 2), -1.0)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    finite = np.isfinite(xx).all() and np.isfinite(yy).all()
    slack = 1e-12 * (x.shape[1] + 8) * (xx + (yy.max() if finite else 0.0))
    step = max(1, CELLS // len(y))
    for a in range(0, len(x), step):
        part = x[a:a + step]
        if finite:
            near = xx[a:a + step, None] + yy[None, :] - 2.0 * (part @ y.T)
            last = np.partition(near, 1, axis=1)[:, 1] if len(y) > 1 else near[:, 0]
            i, j = np.nonzero(near <= (last + slack[a:a + step])[:, None])
        else:
            i, j = (k.ravel() for k in np.indices((len(part), len(y))))
        d = np.empty(len(i))
        for b in range(0, len(i), CELLS // 8):
            d[b:b + CELLS // 8] = _exact(part[i[b:b + CELLS // 8]], y[j[b:b + CELLS // 8]])
        order = np.lexsort((d, i))
        i, d, times = i[order], d[order], copies[j[order]]
        first = np.searchsorted(i, np.arange(len(part)))
        two[a:a + step, 0] = d[first]
        again = times[first] > 1
        two[a:a + step, 1][again] = d[first[again]]
        more = ~again & (first + 1 < np.append(first[1:], len(i)))
        two[a:a + step, 1][more] = d[first[more] + 1]
    return two


def _tile(searching: pa.Table, held: pa.Table) -> pa.Table:
    """Two least distances of each vector of a tile (vid, embedding) to the descriptors of each template in it (template,
    embedding, copies, whole: all of the template); where the whole template is there, only of good matches."""
    vids, templates, low, high = [], [], [], []
    if len(searching) and len(held):
        held = held.sort_by("template")
        x, y = (_matrix(t.column("embedding").combine_chunks()) for t in (searching, held))
        copies, whole = (held.column(c).to_numpy() for c in ("copies", "whole"))
        names = held.column("template").combine_chunks().dictionary_encode()
        edges = np.flatnonzero(np.diff(names.indices.to_numpy(), prepend=-1, append=-1))
        vid = searching.column("vid").to_numpy()
        for lo, hi in zip(edges, edges[1:]):
            two = _two_least(x, y[lo:hi], copies[lo:hi])
            kept = np.ones(len(two), dtype=bool)
            if whole[lo]:  # as Spark compares, for which NaN is the greatest number
                bound = RATIO_TEST * np.maximum(np.where(two[:, 1] < 0, two[:, 0], two[:, 1]), 1e-6)
                kept = ~(two[:, 0] >= bound) & ~np.isnan(two[:, 0])
            vids.append(vid[kept])
            templates.append(pa.repeat(names.dictionary[names.indices[lo].as_py()], int(kept.sum())))
            low.append(two[kept, 0])
            high.append(two[kept, 1])
    d0, d1 = (np.concatenate([np.zeros(0), *c]) for c in (low, high))
    return pa.table([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *vids]), pa.int64()), pa.chunked_array(templates, pa.string()),
                     pa.array(d0), pa.array(d1, mask=d1 < 0)], ["vid", "template", "d0", "d1"])


def template_scores(vectors: DataFrame, library: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Good matches of each document against each template: best distance < 0.75 x second best.

    Vectors and library are dealt into blocks of about ``BLOCK``, and every block of vectors meets every block of the
    library in a tile, which gives the two least distances to each template in it. What is shuffled is each row once for
    every block of the other side, and what is written are distances, not vectors. A template of more than a block is cut
    into parts, and the two least of its parts are put together. Neither side passes through the driver, and no template
    has to fit a task. Templates of fewer than two descriptors have no second best and are left out. All descriptors have
    one length; a null one is counted and compared with nothing.
    """
    n_doc = vectors.groupBy(doc).agg(F.count(F.lit(1)).alias("n_query"))
    n_lib = library.groupBy("template").agg(F.count(F.lit(1)).alias("n_template")).filter("n_template >= 2")
    # equal vectors of a document are one row with their number, as are equal descriptors of a template
    v = durable(vectors.filter("embedding is not null").groupBy(doc, "embedding").agg(F.count(F.lit(1)).alias("copies")).withColumn("vid", F.monotonically_increasing_id()))
    lib = durable(library.filter("embedding is not null").groupBy("template", "embedding").agg(F.count(F.lit(1)).alias("copies")).join(n_lib, "template").withColumn(
        "lid", F.monotonically_increasing_id()))

    across, down = (max(1, -(-df.count() // BLOCK)) for df in (v, lib))
    parts = F.ceil(F.col("n_template") / BLOCK)
    part = F.pmod(F.xxhash64("lid"), parts).cast("int")
    held = lib.select("template", "embedding", "copies", (parts == 1).alias("whole"), F.pmod(F.xxhash64("template", part), F.lit(down)).cast("int").alias("y"), F.explode(
        F.sequence(F.lit(0), F.lit(across - 1))).alias("x"))
    searching = v.select("vid", "embedding", F.pmod(F.xxhash64("vid"), F.lit(across)).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("y"))
    tiles = searching.groupBy("x", "y").cogroup(held.groupBy("x", "y"))
    near = tiles.applyInArrow(_tile, "vid bigint, template string, d0 double, d1 double")
    # a vector has one row of each part of a template
    two = near.groupBy("vid", "template").agg(F.array_sort(F.array_compact(F.flatten(F.collect_list(F.array("d0", "d1"))))).alias("d")).select(
        "vid", "template", F.get("d", 0).alias("d0"), F.coalesce(F.get("d", 1), F.get("d", 0)).alias("d1"))
    good = two.filter(F.col("d0") < RATIO_TEST * F.greatest("d1", F.lit(1e-6))).join(v.select("vid", doc, "copies"), "vid")
    g = good.groupBy(doc, "template").agg(F.sum("copies").alias("good")).join(n_lib, "template")
    return g.join(n_doc, doc).select(doc, "template", "good", "n_template", "n_query").withColumn(
        "ratio", F.col("good") / F.greatest(F.lit(1), F.least("n_query", "n_template")))


def template_verdict(scores: DataFrame, vectors: DataFrame, library: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Best template of a document; recognised with twenty good matches at ratio 0.40, otherwise 0.55.

    The best has the highest ratio, of equal ones the first by name. A document with fewer than two descriptors, or any
    document while the library is empty, is NOT_EVALUATED; one without a good match to any template is evaluated.
    """
    best = scores.groupBy(doc).agg(F.min_by(F.struct("template", "good", "ratio"), F.struct(-F.col("ratio"), "template")).alias("b"))
    some = library.select(F.lit(True).alias("has_library")).limit(1)
    j = vectors.groupBy(doc).agg(F.count(F.lit(1)).alias("descriptors")).join(best, doc, "left").join(F.broadcast(some), F.lit(True), "left")
    ready = F.col("has_library").isNotNull() & (F.col("descriptors") >= 2)
    b = F.when(F.col("descriptors") >= 2, F.col("b"))
    ok = F.coalesce((b["good"] >= TEMPLATE_MIN_GOOD) & (b["ratio"] >= TEMPLATE_MIN_RATIO), F.lit(False))
    return j.select(doc, F.coalesce(b["template"], F.lit("")).alias("template"), F.coalesce(b["good"], F.lit(0)).alias("good"),
                    F.round(F.coalesce(b["ratio"], F.lit(0.0)), 6).alias("ratio"), ok.alias("recognised"),
                    F.when(ready, "VALID").otherwise("NOT_EVALUATED").alias("status"),
                    F.when(~ready, -1.0).when(ok, 0.0).otherwise(TEMPLATE_NO_MATCH).alias("suspicion"))


def duplicate_regions(pairs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Vote of matched point pairs (x0, y0) -> (x1, y1) with page size (width, height).

    Offsets are made canonical and binned at twelve pixels. A clone needs a bin that holds 30 % of the pairs and
    twelve of them, an offset of 24 px, and a compact extent on both sides. All by partial aggregation.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    far = F.hypot(dx, dy) >= MIN_PAIR_DISTANCE_PX
    flip = F.when((dx < 0) | ((dx == 0) & (dy < 0)), -1).otherwise(1)
    p = pairs.filter(far).withColumn("bx", F.bround(dx * flip / OFFSET_BIN_PX).cast("int")).withColumn(
        "by", F.bround(dy * flip / OFFSET_BIN_PX).cast("int")).withColumn("ox", dx).withColumn("oy", dy)

    def span(a: str) -> Column:
        return F.max(a) - F.min(a)

    bins = p.groupBy(doc, "bx", "by").agg(
        F.count(F.lit(1)).alias("n"), F.percentile("ox", 0.5).alias("ox"), F.percentile("oy", 0.5).alias("oy"),
        F.hypot(span("x0"), span("y0")).alias("src"), F.hypot(span("x1"), span("y1")).alias("dst"),
        F.max(F.hypot("width", "height")).alias("diag"))
    g = bins.groupBy(doc).agg(
        F.sum("n").alias("pairs"),
        F.max_by(F.struct("n", "ox", "oy", "src", "dst", "diag"), F.struct("n", -F.col("bx"), -F.col("by"))).alias("b"))
    share = F.col("b.n") / F.col("pairs")
    clone = (
        (F.col("pairs") >= MIN_CLUSTER) & (F.hypot("b.ox", "b.oy") >= MIN_OFFSET_PX) & (share >= MIN_DOMINANT)
        & (F.col("b.n") >= MIN_CLUSTER) & (F.col("b.src") <= MAX_SPREAD * F.col("b.diag"))
        & (F.col("b.dst") <= MAX_SPREAD * F.col("b.diag")))
    return g.select(doc, "pairs", F.col("b.n").alias("dominant"), F.round(share, 6).alias("share"), clone.alias("duplicated"))
