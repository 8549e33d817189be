"""Packing token sequences by vector best-fit.

Every document becomes pieces of ids. A sequence has three capacities: tokens, documents (pieces), and attention cost, the
sum of the squared lengths. What a piece takes of them follows from its length alone, so the whole corpus is packed from
the counts of its lengths: at most one number per length, whatever the corpus. Lengths come longest first. Open sequences
with equal residuals form a class; a piece goes to the class that the rule prefers among those with room in every
capacity, by the weighted norm of the residual it leaves (the smallest) or the weighted dot product of residual and
demand (the largest). All pieces of a length and all sequences of a class move together, so a step places a run of pieces
into a run of sequences, and the steps number a few per length.

Each step is a slot: pieces of one length with ranks from ``first`` on go to sequences from ``base`` on. A piece's rank
among those of its length is its place within the task that wrote it, plus the counts of earlier tasks; neither needs a
sort, and a hot length is as well spread as any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.orc_tokens import encoder
from docassay.llm.tokens import pieces
from docassay.session import durable

END = 0


class Capacity(NamedTuple):
    """What a sequence holds: tokens, pieces, and the sum of squared piece lengths."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, isqrt(self.attention)) if self.documents > 0 else 0


def slots(counts: dict[int, int], capacity: Capacity, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> np.ndarray:
    """Rows (length, first, base, each, offset): of the pieces of ``length``, those with ranks from ``first`` on (up to the
    next row of that length) fill sequences from ``base`` on, ``each`` pieces to one, from ``offset`` in it on."""
    cap = np.array(capacity, dtype=np.int64)
    w = np.array(weights) / (cap.astype(np.float64) ** 2)
    residual = np.zeros((16, 3), dtype=np.int64)
    # classes: their first sequence and how many there are
    span, n, made, out = np.zeros((16, 2), dtype=np.int64), 0, 0, []

    def add(first: int, many: int, left: np.ndarray) -> None:
        nonlocal residual, span, n
        if many and (left > 0).all():
            if n == len(span):
                residual, span = np.concatenate((residual, residual)), np.concatenate((span, span))
            residual[n], span[n] = left, (first, many)
            n += 1

    for length in sorted(counts, reverse=True):
        demand, rank, left = np.array([length, 1, length * length], dtype=np.int64), 0, counts[length]
        while left:
            room = np.flatnonzero((residual[:n] >= demand).all(axis=1))
            if len(room):
                r = residual[room]
                score = (((r - demand) ** 2) * w).sum(axis=1) if rule == "norm" else -((r * demand) * w).sum(axis=1)
                c = int(room[score.argmin()])
                base, bins, res = int(span[c, 0]), int(span[c, 1]), residual[c].copy()
                n -= 1
                residual[c], span[c] = residual[n], span[n]
            else:
                base, bins, res = made, left, cap
            # the norm prefers the sequence just used as long as it has room; the product prefers an untouched one
            each = int((res // demand).min()) if rule == "norm" or not len(room) else 1
            full, rest = divmod(min(left, bins * each), each)
            used = full + (rest > 0)
            offset = int(cap[0] - res[0])
            out.append((length, rank, base, each, offset))
            add(base, full, res - demand * each)
            add(base + full, int(rest > 0), res - demand * rest)
            if len(room):
                add(base + used, bins - used, res)
            else:
                made += used
            rank += full * each + rest
            left -= full * each + rest
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, tokenizer: str, longest: int, end: int = END) -> DataFrame:
    """``part, doc_id, piece, start, length, place, ids`` of every document; ``ids`` are little-endian unsigned 32-bit
    numbers, ``place`` counts the pieces of one length within the task ``part``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, stop, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.array([end], dtype="<u4").tobytes(), {}
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for piece in pieces(texts.to_pylist(), 4 << 20):
                cols: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(ids[piece], texts[piece].to_pylist()):
                    raw = words.encode(text) + stop
                    for k, at in enumerate(range(0, len(raw), 4 * longest)):
                        own = raw[at:at + 4 * longest]
                        length = len(own) // 4
                        place = seen.get(length, 0)
                        seen[length] = place + 1
                        for col, v in zip(cols, (doc, k, at // 4, length, place, own)):
                            col.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
                yield pa.record_batch([pa.array(np.full(len(cols[0]), part), pa.int32()), *arrays], ["part", "doc_id", "piece", "start", "length", "place", "ids"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "part int, doc_id bigint, piece int, start bigint, length bigint, place bigint, ids binary")


def _placed(plan: np.ndarray):
    """Sequence and offset of pieces from their length and rank."""
    key = (plan[:, 0] << 44) | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            row = plan[np.searchsorted(key, (length << 44) | rank, "right") - 1]
            k = rank - row[:, 1]
            sequence, offset = row[:, 2] + k // row[:, 3], row[:, 4] + k % row[:, 3] * length
            yield pa.record_batch([*batch.columns[:4], batch.column(5), pa.array(sequence), pa.array(offset)],
                                  ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])
    return run


def packed(docs: DataFrame, tokenizer: str, capacity: Capacity = Capacity(), rule: str = "norm",
           weights: tuple[float, float, float] = (1.0, 1.0, 1.0), end: int = END) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset`` of every piece of ``docs`` (doc_id, text).

    A document's ids are those of its text and ``end``; one longer than a sequence can hold is cut into pieces of that
    length, of which the last may be shorter. Pieces of a sequence follow each other without gaps from offset 0, within
    every capacity. ``rule`` is ``norm`` or ``dot``; ``weights`` are those of tokens, documents and attention cost, each in
    parts of its capacity. Defined cases: a null or empty text is the end id alone; every row is a document of its own, so
    repeated rows, shared ids and null ids are all packed; a text of any length is cut whole; among equal classes the
    first counts, and which of several pieces of one length goes where is fixed by the written pieces; an empty table gives
    an empty table; other columns are ignored, whatever their names.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    if capacity.longest() < 1:
        raise ValueError("a sequence must hold at least one token")
    rows = durable(cut_pieces(docs, tokenizer, capacity.longest(), end))
    counts = durable(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", (F.col("before") + F.col("place")).alias("rank"), "ids")
    return ranked.mapInArrow(_placed(slots(total, capacity, rule, weights)),
                             "doc_id bigint, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint")


def sequences(pieces_packed: DataFrame) -> DataFrame:
    """``sequence_id, doc_ids, ids``: every sequence's ids in order, and the document of each of its pieces. A sequence
    holds a bounded number of tokens, so a group is small."""
    whole = pieces_packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), ids.alias("ids"))
