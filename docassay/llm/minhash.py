"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

The sketch of a shingle set has ``t`` coordinates. Round ``i`` throws every shingle into one hashed bin with a hashed
value above ``i``; a bin keeps its least value. After ``t`` rounds of that, ``t`` more rounds fill bin ``i - t`` by force,
so every coordinate is filled whatever the size of the set, and most sets need one or two rounds. Coordinates of two sets
agree with the probability of their similarity, with concentration as for independent hashing.

Sets that are equal form one class. Classes meet in bands of sketch coordinates. In each bucket every class is verified on
the full shingle sets against the one with the smallest id, the same for most bands. That settles groups of true copies
with a linear number of pairs. A bucket of which more than one component is left is compared in blocks of bounded size:
all pairs of its components but those within the largest one, emitting only the links that join components. So no two
components that share a bucket stay unverified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.llm.tokens import mix, pieces, seeds, settle_after, settled, shingle_sets
from docassay.operators.network import components
from docassay.session import durable

#: Sketch coordinates: bands times rows. At a similarity of 0.8 a pair misses all 24 bands with probability 7e-5.
BANDS, ROWS = 24, 5
#: Bounds on the side of a block: classes, and their shingles together.
CHUNK, CHUNK_SHINGLES = 256, 1 << 18
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """``len(sets)`` rows of ``t`` coordinates; a row of an empty set is all ones."""
    out = np.full((len(sets), t), _MAX, dtype=np.uint64)
    flat = out.reshape(-1)
    size = np.array([len(s) for s in sets])
    items = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    owner = np.repeat(np.arange(len(sets)), size)
    salt = seeds(2 * t, 5)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(items):
                break
            h = mix(items + salt[i])
            bin_ = (h % np.uint64(t)).astype(np.int64) if i < t else np.full(len(h), i - t)
            value = (np.uint64(i) << np.uint64(56)) | (mix(h) >> np.uint64(8))
            np.minimum.at(flat, owner * t + bin_, value)
            open_ = (out == _MAX).any(axis=1)[owner]
            items, owner = items[open_], owner[open_]
    return out


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band, with the band's number in it."""
    salt = seeds(bands, 31)
    key = np.broadcast_to(salt, (len(sketch), bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            key = mix(key * np.uint64(3) + sketch[:, r::rows][:, :bands])
    return key.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``digest`` of the shingle set (null if empty) and ``keys`` of its bands."""
    schema = "doc_id bigint, n_shingles bigint, digest binary, keys array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for part in pieces(texts.to_pylist()):
                sets = shingle_sets(texts[part].to_pylist(), words)
                keys = band_keys(sketches(sets, bands * rows), bands, rows)
                yield pa.record_batch([
                    ids[part], pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                    pa.array([k if len(s) else None for k, s in zip(keys, sets)], pa.list_(pa.int64())),
                ], ["doc_id", "n_shingles", "digest", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(settled(run), schema)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union of their full shingle sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            hit = []
            for x, y in zip(a, b):
                s, t = shingle_sets([x, y], words)
                both = len(np.intersect1d(s, t, assume_unique=True))
                hit.append(100 * both >= percent * (len(s) + len(t) - both) and both > 0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(hit, pa.bool_())], ["a", "b", "ok"])

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return joined.mapInArrow(settled(run), "a bigint, b bigint, ok boolean").groupBy("a", "b").agg(F.max("ok").alias("ok")).filter("ok").select("a", "b")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Components of documents whose shingle sets are similar: ``doc_id, n_shingles, component_id, kept``.

    ``docs``: doc_id, text; other columns are ignored. One row per input row. Defined cases: a null text or one without
    words has an empty set, is linked with nothing and is kept. A document is its ``doc_id``: rows that share one are one
    document, linked by any of their texts. A row with a null id is compared with nothing: null component, kept. An empty
    table gives an empty table.
    """
    sig = durable(signatures(docs, words, bands, rows))
    sets = sig.filter("digest is not null and doc_id is not null")
    classes = durable(sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys"),
                                                F.first("n_shingles").alias("n_shingles")))
    members = classes.select("node", "n_shingles", F.explode("keys").alias("key"))
    full = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    crowd = durable(members.join(full, "key"))
    texts = durable(docs.select(F.col("doc_id").cast("bigint").alias("node"), F.col("text").cast("string").alias("text")).join(
        crowd.select("node").distinct(), "node", "left_semi"))

    same_id = sets.select("doc_id", "digest").join(classes.select("digest", "node"), "digest").filter("doc_id <> node")
    # documents of one class, and the classes of an id that has several texts, are linked without a comparison
    own = durable(same_id.select(F.col("doc_id").alias("a"), F.col("node").alias("b")).distinct())
    links = _links(crowd, texts, words, percent)
    edges = own.unionByName(links)
    ids = sets.select(F.col("doc_id").alias("case_id")).distinct()
    found = components(ids, edges).select(F.col("case_id").alias("doc_id"), F.col("component").alias("component_id"))
    whole = sig.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return whole.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _links(crowd: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links between classes: enough of them to connect whatever the links inside buckets connect."""
    hubs = crowd.groupBy("key").agg(F.min("node").alias("hub"))
    pairs = durable(crowd.join(hubs, "key").filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    links = durable(_verified(pairs, texts, words, percent))
    comp = components(crowd.select(F.col("node").alias("case_id")).distinct(), links).select(
        F.col("case_id").alias("node"), F.col("component").alias("comp"))
    now = durable(crowd.join(comp, "node"))
    several = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).filter(
        (F.col("lo") < F.col("hi")) & (F.col("n") > 2)).select("key")
    return links.unionByName(durable(_block_links(now.join(several, "key"), texts, words, percent)))


def _block_links(now: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between different components of a bucket. The bucket's largest component is ``main``, all else ``rest``;
    both are cut into chunks of bounded size, and every chunk of rest meets every chunk."""
    by_comp = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("size"))
    per_key = by_comp.groupBy("key").agg(F.max_by("comp", "n").alias("main"), F.max("n").alias("n_main"), F.max_by("size", "n").alias("size_main"),
                                         F.sum("n").alias("n"), F.sum("size").alias("size"))

    def chunks(n, size):
        return F.greatest(F.lit(1), F.ceil(n / CHUNK), F.ceil(size / CHUNK_SHINGLES)).cast("int")

    per_key = per_key.select("key", "main", chunks(F.col("n_main"), F.col("size_main")).alias("c_main"),
                             chunks(F.col("n") - F.col("n_main"), F.col("size") - F.col("size_main")).alias("c_rest"))
    placed = now.join(per_key, "key").withColumn("is_main", F.col("comp") == F.col("main")).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("c_main")).otherwise(F.col("c_rest"))).cast("int"))
    rest_ids = F.sequence(F.lit(0), F.col("c_rest") - 1)
    # a block is (x, y): x a chunk of rest, y another of rest (not below x) or, as c_rest + i, chunk i of main
    blocks = F.when(F.col("is_main"), F.transform(rest_ids, lambda x: F.struct(x.alias("x"), (F.col("c_rest") + F.col("chunk")).alias("y")))).otherwise(
        F.concat(F.transform(rest_ids, lambda x: F.struct(F.least(x, F.col("chunk")).alias("x"), F.greatest(x, F.col("chunk")).alias("y"))),
                 F.transform(F.sequence(F.lit(0), F.col("c_main") - 1), lambda y: F.struct(F.col("chunk").alias("x"), (F.col("c_rest") + y).alias("y")))))
    rows = placed.select("key", "node", "comp", F.explode(blocks).alias("block")).select("key", "block.x", "block.y", "node", "comp")

    def run(block):
        texts = [t.encode() if t else None for t in block["text"]]
        size = sum(len(t) for t in texts if t)
        sets = shingle_sets(texts, words)
        links = _joining(block["node"].to_numpy(), block["comp"].to_numpy(), sets, percent)
        del sets, texts, block
        settle_after(size)
        return links

    return rows.join(texts, "node").groupBy("key", "x", "y").applyInPandas(run, "a bigint, b bigint").distinct()


def _joining(node: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> pd.DataFrame:
    """One link for each two components of a block that any pair of similar sets joins."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    every = np.concatenate(sets)
    _, at, times = np.unique(every, return_inverse=True, return_counts=True)
    owner, common = np.repeat(np.arange(len(sets)), size), times[at] > 1  # a shingle of one set is in no intersection
    owner, column = owner[common], np.unique(at[common], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, (start, start + step))
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        both += part @ part.T
    similar = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    i, j = np.nonzero(np.triu(similar & (comp[:, None] != comp[None, :]), 1))
    lo, hi = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
    first = pd.DataFrame({"lo": lo, "hi": hi, "a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j])})
    return first.drop_duplicates(["lo", "hi"])[["a", "b"]]
