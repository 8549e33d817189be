"""Hard negatives of anchors by exact integer inner products.

Vectors become integer rows. Anchors and candidates are dealt into blocks, and a cell of the grid of blocks is one tile: a
matrix of anchors times a matrix of candidates, multiplied by Strassen's recursion on int64 with zero padding. Additions
and subtractions are exact modulo 2^64, so every score that fits 64 bits comes out exactly whatever the sums on the way
do. What a tile yields is a heap of bounded size per anchor (its best rows of the same label) or per anchor and positive
(the best rows of another label inside the positive's window of scores). Heaps of different tiles merge by rank, so no
scores are ever listed, and a label, a score or a vector may repeat as often as it likes.

Two grids follow each other: anchors against rows of their own label give the positives, anchors against all rows give
the negatives in the windows that the positives' scores set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.session import durable

#: The recursion ends where a side is this short.
LEAF = 32
#: Bytes of the integer matrix on a side of a cell, and the most rows of it; anchors multiplied at once.
SIDE_BYTES, SIDE_ROWS, AT_ONCE = 16 << 20, 16384, 256
#: Integers beyond this count as this, and scores beyond 64 bits as the nearest 64-bit number.
WIDEST = 1 << 62
_KINDS = [np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8")]
_RAW = "vec_id bigint, label bigint, kind tinyint, raw binary"


def _leaf(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.dtype == object:
        return a @ b
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 1 << 52:  # every partial sum is an integer that a double holds exactly
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` by seven products of halves; odd sides are padded with a row or column of zeros."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return _leaf(a, b)
    if (m | k | n) & 1:
        a = np.pad(a, ((0, m & 1), (0, k & 1)))
        b = np.pad(b, ((0, k & 1), (0, n & 1)))
        return strassen(a, b, leaf)[:m, :n]
    i, j, h = m // 2, n // 2, k // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    b11, b12, b21, b22 = b[:h, :j], b[:h, j:], b[h:, :j], b[h:, j:]
    out = np.empty((m, n), dtype=a.dtype)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:i, :j], out[i:, j:] = p, p
    p = strassen(a21 + a22, b11, leaf)
    out[i:, :j] = p
    out[i:, j:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:i, j:] = p
    out[i:, j:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:i, :j] += p
    out[i:, :j] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:i, :j] -= p
    out[:i, j:] += p
    out[i:, j:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:i, :j] += strassen(a12 - a22, b21 + b22, leaf)
    return out


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with the rows of ``b``, exact; beyond 64 bits the nearest 64-bit number."""
    top = int(max(a.max(initial=0), -int(a.min(initial=0)))) * int(max(b.max(initial=0), -int(b.min(initial=0)))) * a.shape[1]
    with np.errstate(over="ignore"):
        if top < 1 << 63:
            return strassen(a, b.T)
    wide = strassen(a.astype(object), b.T.astype(object))
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def integers(vectors: DataFrame, scale: float) -> DataFrame:
    """``vec_id, label, kind, raw``: floor(scale * x) of the usable vectors, packed in the narrowest integers that hold
    them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, kinds, raws = [], [], [], []
            for i, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = v.values
                if x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False)
                if not np.isfinite(x).all():
                    continue
                with np.errstate(over="ignore"):
                    x = np.clip(np.floor(x * scale), -float(WIDEST), float(WIDEST)).astype(np.int64)
                far = max(int(x.max(initial=0)), -int(x.min(initial=0)))
                kind = 0 if far < 1 << 15 else 1 if far < 1 << 31 else 2
                ids.append(i)
                labels.append(label)
                kinds.append(kind)
                raws.append(x.astype(_KINDS[kind]).tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(kinds, pa.int8()), pa.array(raws, pa.binary())],
                                  ["vec_id", "label", "kind", "raw"])

    usable = vectors.filter("vec_id is not null and label is not null and embedding is not null").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return usable.mapInArrow(run, _RAW)


def _matrix(rows: pd.DataFrame, dim: int) -> np.ndarray:
    """The rows' integers; shorter vectors end in zeros."""
    out = np.zeros((len(rows), dim), dtype=np.int64)
    for i, (kind, raw) in enumerate(zip(rows["kind"].tolist(), rows["raw"].tolist())):
        x = np.frombuffer(raw, dtype=_KINDS[kind])
        out[i, :len(x)] = x
    return out


def _dim(rows: pd.DataFrame) -> int:
    widths = np.array([k.itemsize for k in _KINDS])[rows["kind"].to_numpy(dtype=np.int64)]
    return int((rows["raw"].map(len).to_numpy() // widths).max(initial=0))


def _tiles(block: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray]]:
    """A few anchors of the block at a time, its candidates by id, and their scores."""
    anchors, held = block[block["anchor"]], block[~block["anchor"]].sort_values("vec_id", kind="stable")
    if len(anchors) and len(held):
        dim = _dim(block)
        x, y = _matrix(anchors, dim), _matrix(held, dim)
        for s in range(0, len(anchors), AT_ONCE):
            yield anchors.iloc[s:s + AT_ONCE], held, scores(x[s:s + AT_ONCE], y)


def _frame(parts: list[tuple], names: list[str]) -> pd.DataFrame:
    cols = [np.concatenate([np.asarray(p[i], dtype=np.int64) for p in parts]) if parts else np.zeros(0, dtype=np.int64) for i in range(len(names))]
    return pd.DataFrame(dict(zip(names, cols)))


def _positive_heaps(size: int):
    names = ["anchor_id", "positive_id", "positive_score"]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for anchors, held, s in _tiles(block):
            ids = held["vec_id"].to_numpy()
            best = np.argsort(~s, axis=1, kind="stable")[:, :size + 1]  # ~s falls as s rises, without overflow; ties keep the order by id
            for a, own in enumerate(anchors["vec_id"].tolist()):
                at = best[a][ids[best[a]] != own][:size]
                parts.append((np.full(len(at), own), ids[at], s[a, at]))
        return _frame(parts, names)
    return run


def _window_heaps(size: int, low: int, high: int):
    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]

    def run(block: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for anchors, held, s in _tiles(block):
            ids, labels = held["vec_id"].to_numpy(), held["label"].to_numpy()
            order = np.argsort(~s, axis=1, kind="stable")
            for a, (own, label, chosen) in enumerate(zip(anchors["vec_id"].tolist(), anchors["label"].tolist(), anchors["chosen"].tolist())):
                at = order[a][labels[order[a]] != label]
                falling = ~s[a, at]
                for p in chosen:
                    score = int(p["positive_score"])
                    # ceil(low * p / 100) and floor(high * p / 100)
                    least, most = -(-low * score // 100), high * score // 100
                    first, end = np.searchsorted(falling, ~most, "left"), np.searchsorted(falling, ~least, "right")
                    got = at[first:min(end, first + size)]
                    if len(got):
                        parts.append((np.full(len(got), own), np.full(len(got), p["positive_id"]), np.full(len(got), score), ids[got], s[a, got]))
        return _frame(parts, names)
    return run


def _grid(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], key: str | None = None) -> DataFrame:
    """Blocks of anchors against blocks of rows, within each value of ``key`` or of all; rows of the grid carry ``x, y``."""
    if key:
        n_a = anchors.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / sizes[0]).cast("int").alias("c_a"))
        n_r = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / sizes[1]).cast("int").alias("c_r"))
        cells = durable(n_a.join(n_r, key))
        anchors, rows = anchors.join(cells, key), rows.join(cells, key)
    else:
        c_a, c_r = (F.lit(max(-(-df.count() // most), 1)) for df, most in ((anchors, sizes[0]), (rows, sizes[1])))
        anchors, rows = (df.withColumn("c_a", c_a).withColumn("c_r", c_r) for df in (anchors, rows))
    cell = F.col(key) if key else F.lit(0).cast("bigint")

    def dealt(df: DataFrame, own: str, other: str, anchor: bool, chosen: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias("mine")
        each = df.select(cell.alias("cell"), "vec_id", "label", "kind", "raw", chosen.alias("chosen"), mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
        x, y = ("mine", "theirs") if anchor else ("theirs", "mine")
        return each.select("cell", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(anchor).alias("anchor"), "vec_id", "label", "kind", "raw", "chosen")

    chosen_type = "array<struct<positive_id:bigint,positive_score:bigint>>"
    of_anchor = F.col("chosen") if "chosen" in anchors.columns else F.lit(None).cast(chosen_type)
    return dealt(anchors, "c_a", "c_r", True, of_anchor).unionByName(dealt(rows, "c_r", "c_a", False, F.lit(None).cast(chosen_type)))


def hard_negatives(vectors: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` of ``vectors`` (vec_id, embedding,
    label); rows where ``anchor`` (over vec_id) holds are anchors.

    A row's score is the inner product of floor(scale * x) with the anchor's. An anchor's positives are its ``positives``
    best other rows of its label; for each one come the ``negatives`` best rows of other labels with a score of ``low`` to
    ``high`` percent of the positive's. Defined cases: rows with a null id, label, vector or component, or a non-finite
    one, take no part; of vectors of different length the shorter ends in zeros, and an empty one scores 0 with all; ties
    go to the smaller id; of rows that share an id the one with the smallest label, then the smallest packed vector,
    counts; a positive with a negative score has an empty window, one with score 0 the window 0 to 0; an integer beyond
    2^62 counts as 2^62 and a score beyond 64 bits as the nearest 64-bit number; an anchor without positives, and a
    positive without negatives, give no rows; an empty table gives an empty table. Vectors of any length go through, a
    block holding fewer rows the longer they are. Other columns are ignored, whatever their names.
    """
    rows = integers(vectors.select("vec_id", "label", "embedding"), scale)
    rows = durable(rows.groupBy("vec_id").agg(F.min(F.struct("label", "kind", "raw")).alias("r")).select("vec_id", "r.*"))
    n, widest = rows.agg(F.count(F.lit(1)), F.max(F.length("raw") * F.lit(4))).first()
    if not n:
        widest = 1
    most = int(min(max(SIDE_BYTES // max(int(widest), 8), 64), SIDE_ROWS))
    # smaller blocks than memory asks for where there would be too few for the cores
    few = max(1024, n // (4 * rows.sparkSession.sparkContext.defaultParallelism))
    sizes = (most, min(most, few))
    anchors = rows.filter(anchor)
    best = _grid(anchors, rows, sizes, "label").groupBy("cell", "x", "y").applyInPandas(
        _positive_heaps(positives), "anchor_id bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives)
    chosen = best.groupBy("anchor_id").agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("chosen"))
    chosen = durable(anchors.join(chosen, anchors["vec_id"] == chosen["anchor_id"]).select("vec_id", "label", "kind", "raw", "chosen"))
    found = _grid(chosen, rows, sizes).groupBy("cell", "x", "y").applyInPandas(
        _window_heaps(negatives, low, high), "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The query's rows in SQL; integers and scores stay far below 2^53, so doubles hold them exactly.
SQL = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from r a join r b on a.vec_id <> b.vec_id
  where a.vec_id % 100 = 0
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score
  from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
), negatives as (
  select p.anchor_id, p.positive_id,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other_id) as rank,
         s.other_id as negative_id, p.positive_score, s.score as negative_score
  from positives p join scored s using (anchor_id)
  where not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score
from negatives where rank <= 10
"""
