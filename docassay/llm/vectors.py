"""Near-duplicate vectors through an inverted multi-index.

Each half of a normalised vector has its own codebook; the product of the two is a grid of cells, and a vector lies in the
cell of its nearest codewords. A search visits cells in order of the sum of the two distances, by the multi-sequence
traversal: a heap over the two sorted lists of codewords. How many cells it visits follows from the target recall: test
vectors at exactly the threshold from sampled ones are looked for, and the number that reaches the target is taken. What a
cell holds is verified by cosine in double precision.

Codebooks and the number of visits are fitted on a bounded sample; every vector is indexed and every vector searches.
Equal vectors are one class, counted, so copies cost nothing. Cells are compared in blocks of bounded size, which emit one
count per vector and one link per vector at most, never pairs.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.operators.network import components
from docassay.session import durable

THRESHOLD, RECALL = 0.95, 0.98
#: Classes used to fit codebooks, test vectors used to set the visits, vectors per cell aimed at, classes per codeword at
#: least. Up to 2^28 vectors cells keep their size; of more, they grow.
SAMPLE, TESTS, PER_CELL, PER_CODEWORD = 8192, 1024, 64, 4
#: Vectors that are compared with the codewords at once.
AT_ONCE = 1024
#: Sides of a block: vectors of a cell, and vectors that search it.
HELD, SEARCHING = 512, 2048


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([distances(x[s:s + AT_ONCE], c).argmin(axis=1) for s in range(0, len(x), AT_ONCE)])
        total, n = np.zeros_like(c), np.bincount(near, minlength=k)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0)


def multi_sequence(left: np.ndarray, right: np.ndarray, visits: int) -> list[int]:
    """The ``visits`` cells nearest by the sum of both halves' distances, nearest first; a cell is left * width + right."""
    a, b = np.argsort(left, kind="stable"), np.argsort(right, kind="stable")
    p, q, width = left[a], right[b], len(right)
    heap, seen, out = [(p[0] + q[0], 0, 0)], {(0, 0)}, []
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(a[i]) * width + int(b[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            # a cell is due once both cells before it have been visited
            if x < len(p) and y < width and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (p[x] + q[y], x, y))
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, n: int, recall: float = RECALL, threshold: float = THRESHOLD):
        """``sample``: normalised vectors; ``n``: how many the index will hold."""
        self.half = max(sample.shape[1] // 2, 1)
        k = int(min(max(np.ceil(np.sqrt(n / PER_CELL)), 1), max(SAMPLE // PER_CODEWORD, 1), len(sample)))
        self.books = [k_means(sample[:, :self.half], k), k_means(sample[:, self.half:], k, seed=2)]
        rng = np.random.default_rng(3)
        base = sample[rng.choice(len(sample), min(TESTS, len(sample)), replace=False)]
        off = rng.normal(size=base.shape)
        off -= (off * base).sum(1)[:, None] * base
        length = np.linalg.norm(off, axis=1)[:, None]
        off = np.divide(off, length, out=np.zeros_like(off), where=length > 0)
        near = threshold * base + np.sqrt(1 - threshold * threshold) * off
        goal = self.home(near)
        rank = np.zeros(len(base), dtype=np.int64)
        for i, (a, b) in enumerate(zip(*self.halves(base))):  # one grid at a time
            total = a[:, None] + b[None, :]
            rank[i] = (total < total.reshape(-1)[goal[i]]).sum()
        self.visits = int(np.quantile(rank, recall, method="higher")) + 1

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, :self.half], self.books[0]), distances(x[:, self.half:], self.books[1])

    def home(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.books[1]) + b.argmin(1)

    def visited(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.halves(x)
        return [multi_sequence(p, q, self.visits) for p, q in zip(a, b)]


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


def valid(vectors: DataFrame, dim: int) -> DataFrame:
    """``vec_id, digest, raw``: vectors of ``dim`` finite components, not all zero, as doubles; scaled so that squares
    neither overflow nor vanish."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = v.values
                if x is None or len(x) != dim or x.null_count:
                    continue
                x = x.to_numpy(zero_copy_only=False).astype("<f8")
                top = np.abs(x).max()
                if np.isfinite(top) and top > 0:
                    ids.append(i)
                    raws.append((x / top if not 1e-100 < top < 1e100 else x).astype("<f8").tobytes())
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raws], pa.binary()),
                                   pa.array(raws, pa.binary())], ["vec_id", "digest", "raw"])

    return vectors.filter("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id bigint, digest binary, raw binary")


def _search(index: MultiIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(s, AT_ONCE)
                visited = index.visited(_unit(part.column(2).to_pylist()))
                yield pa.record_batch([*part.columns, pa.array([v[0] for v in visited], pa.int64()), pa.array(visited, pa.list_(pa.int64()))],
                                      ["node", "n", "raw", "home", "visits"])
    return run


def _compared(threshold: float):
    """A block: its held vectors against the searching ones; one row per vector with the links counted and one of them."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        held, search = block[block["held"]], block[~block["held"]]
        none = pd.DataFrame({"node": np.zeros(0, dtype="int64"), "links": np.zeros(0, dtype="int64"), "other": np.zeros(0, dtype="int64")})
        if held.empty or search.empty:
            return none
        x, q = _unit(held["raw"].tolist()), _unit(search["raw"].tolist())
        x_node, q_node = held["node"].to_numpy(), search["node"].to_numpy()
        i, j = np.nonzero(q @ x.T >= threshold)
        differ = q_node[i] != x_node[j]
        i, j = i[differ], j[differ]
        if not len(i):
            return none
        # the pair is found a second time, from the other side, if the held vector visits the searching one's cell
        visits, home = np.array(held["visits"].tolist()), search["home"].to_numpy()
        twice = np.concatenate([(visits[j[s:s + 65536]] == home[i[s:s + 65536], None]).any(1) for s in range(0, len(i), 65536)])
        of_q = np.bincount(i, weights=held["n"].to_numpy()[j], minlength=len(q))
        of_x = np.bincount(j[~twice], weights=search["n"].to_numpy()[i[~twice]], minlength=len(x))
        nodes = np.concatenate((q_node, x_node))
        counts = np.concatenate((of_q, of_x)).astype("int64")
        # the smallest id each vector is connected with inside the block
        names, at = np.unique(nodes, return_inverse=True)
        a, b = at[i], at[len(q_node) + j]
        low = np.arange(len(names))
        while True:
            before = low.copy()
            np.minimum.at(low, a, low[b])
            np.minimum.at(low, b, low[a])
            low = low[low]
            if (low == before).all():
                break
        out = pd.DataFrame({"node": nodes, "links": counts, "other": names[low[at]]})
        return out[(out["links"] > 0) | (out["other"] != out["node"])]
    return run


def _linked(base: DataFrame, dim: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame] | None:
    """``vec_id, links`` of the vectors of one length, and edges (a, b) that connect what is linked; None without any."""
    rows = durable(valid(base.filter(F.size("embedding") == dim), dim))
    classes = durable(rows.groupBy("digest").agg(F.min("vec_id").alias("node"), F.countDistinct("vec_id").alias("n"), F.first("raw").alias("raw")))
    total = classes.count()
    if not total:
        return None
    sample = [bytes(r["raw"]) for r in classes.orderBy(F.xxhash64("digest"), "node").limit(SAMPLE).select("raw").collect()]
    index = MultiIndex(_unit(sample), total, recall, threshold)
    placed = durable(classes.select("node", "n", "raw").mapInArrow(_search(index), "node bigint, n bigint, raw binary, home bigint, visits array<bigint>"))
    visits = placed.select("node", "n", "raw", "home", F.explode("visits").alias("cell"))
    held_n = placed.groupBy(F.col("home").alias("cell")).agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("c_held"))
    search_n = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SEARCHING).cast("int").alias("c_search"))
    cells = durable(held_n.join(search_n, "cell"))

    def dealt(df: DataFrame, own: str, other: str, visits) -> DataFrame:
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        each = df.join(cells, "cell").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        x, y = ("mine", "theirs") if own == "c_held" else ("theirs", "mine")
        return each.select("cell", F.col(x).alias("x"), F.col(y).alias("y"), F.lit(own == "c_held").alias("held"), "node", "n", "raw", "home", visits.alias("visits"))

    blocks = dealt(placed.withColumn("cell", F.col("home")), "c_held", "c_search", F.col("visits")).unionByName(
        dealt(visits, "c_search", "c_held", F.lit(None).cast("array<bigint>")))
    found = durable(blocks.groupBy("cell", "x", "y").applyInPandas(_compared(threshold), "node bigint, links bigint, other bigint"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    same = rows.select("vec_id", "digest").join(classes.select("digest", "node", "n"), "digest")
    edges = found.filter("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")).unionByName(
        same.filter("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    return same.join(counts, "node", "left").select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links")), edges


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (vec_id, embedding).

    Vectors of each length have an index of their own. Defined cases: a vector that is null, zero, or holds a null or
    non-finite component links with nothing; vectors of different length do not link; a null id links with nothing and has
    a null component; rows that share an id are one vector, linked by any of them; repeated and equal vectors are one class
    and count each other; vectors of any length are compared whole; a cosine of exactly the threshold links; an empty table
    gives an empty table; other columns are ignored.
    """
    base = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    lengths = [r["dim"] for r in base.filter("embedding is not null").select(F.size("embedding").alias("dim")).distinct().filter("dim > 0").orderBy("dim").collect()]
    alone = base.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = [x for x in (_linked(base, dim, threshold, recall) for dim in lengths) if x is not None]
    if not linked:
        return alone
    links, edges = linked[0]
    for more_links, more_edges in linked[1:]:
        links, edges = links.unionByName(more_links), edges.unionByName(more_edges)
    links = durable(links.groupBy("vec_id").agg(F.sum("links").alias("n_links")))
    comp = components(links.select(F.col("vec_id").alias("case_id")), edges.distinct()).select(F.col("case_id").alias("vec_id"), "component")
    known = comp.join(links, "vec_id")
    out = base.join(known, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
