"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text. Of any ``NEAR`` ends of words that follow each other, the one with the
smallest hash ends a chunk (the last one on ties), so chunks hold 1 to ``NEAR`` words, cuts depend on nearby bytes alone,
and they find themselves again behind any insertion. Chunks are deduplicated by digest: one that a document with a smaller
id holds as well is a copy of that document's first one. A digest covers the chunk and its guard, ``LEFT`` words before and
``RIGHT`` words behind it, since a few words alone also meet by chance.

Copies that follow each other at one distance from the same first holder are a run. A run is extended word by word to both
sides against the first holder, up to ``REACH`` words; only the surroundings of runs are read again. Extended runs of one
holder that meet are one passage.

Why no passage of more than 50 words is lost: the gear hash sees ``SEEN`` bytes, at most 9 words, so from the tenth word
on hashes depend on the passage alone. Of these 42 word ends, those ``NEAR`` - 1 or more from both ends of the span lie only
in windows inside it, so they are cuts wherever the passage occurs or nowhere; they are 2 * ``NEAR`` in a row and hold two
cuts. The chunk between them has ``LEFT`` words before and ``RIGHT`` words behind it inside the passage, and the first and
the last such chunk leave at most 11 words of the passage to each side of their guards, less than ``REACH``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.llm.tokens import _BYTE, _GOLD, _SPACE, _power_tables, mix, seeds
from docassay.session import durable

#: Bytes that the gear hash sees; word ends of which one is a cut; words of the guard; words compared beside a run.
SEEN, NEAR, LEFT, RIGHT, REACH = 16, 11, 20, 10, 12
#: Words that a passage needs to be reported.
LEAST_WORDS = 24
_GEAR = (seeds(256, 1234) >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The 32-bit gear hash at every byte: the sum of the last 16 bytes' numbers, each shifted by twice its distance."""
    h = _GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(2 * step)  # the right side is computed before it is added
    return h


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, runs of bytes without white space."""
    space = np.concatenate(([True], _SPACE[raw], [True]))
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Last words of the chunks, in order; the last word of the text is one."""
    n = len(ends)
    if not n:
        return np.zeros(0, dtype=np.int64)
    h = gear(raw)[ends - 1]
    wide = min(NEAR, n)
    # the last of equal minima is the first one from behind
    behind = np.lib.stride_tricks.sliding_window_view(h[::-1], wide).argmin(axis=1) + np.arange(n - wide + 1)
    found = np.zeros(n, dtype=bool)
    found[n - 1 - behind] = True
    found[-1] = True
    return np.flatnonzero(found)


def _digests(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each range of bytes: a polynomial as a difference of running sums."""
    power, inverse = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[raw] * power[: len(raw)], dtype=np.uint64)))
        return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_GOLD)).view(np.int64)


def chunks(docs: DataFrame) -> DataFrame:
    """``doc_id, tid, no, a, b, digest, lead`` of every chunk: its number, the words from ``a`` up to ``b`` that it spans
    with its guard, and whether it is the first one with that digest in its text."""
    schema = "doc_id bigint, tid int, no int, a int, b int, digest bigint, lead boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tid, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary())):
                raw = np.frombuffer(text.as_py() or b"", dtype=np.uint8)
                starts, ends = words(raw)
                last = cuts(raw, ends)
                if not len(last):
                    continue
                first = np.concatenate(([0], last[:-1] + 1))
                a, b = np.maximum(first - LEFT, 0), np.minimum(last + 1 + RIGHT, len(starts))
                digest = _digests(raw, starts[a], ends[b - 1])
                lead = np.zeros(len(last), dtype=bool)
                lead[np.unique(digest, return_index=True)[1]] = True
                ints = [pa.array(c.astype(np.int32)) for c in (np.arange(len(last)), a, b)]
                yield pa.record_batch([pa.repeat(doc, len(last)), pa.repeat(tid, len(last)), *ints, pa.array(digest), pa.array(lead)],
                                      ["doc_id", "tid", "no", "a", "b", "digest", "lead"])

    return docs.mapInArrow(run, schema)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Around each span of a text (columns doc_id, tid, text, spans): digests of up to ``REACH`` words before and behind it,
    nearest first and each with its gap to the span's side, and byte places that the span has when extended so far."""
    small = pa.list_(pa.int32())
    for batch in batches:
        for doc, tid, text, spans in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), batch.column(3).to_pylist()):
            raw = np.frombuffer(text.as_py(), dtype=np.uint8)
            starts, ends = words(raw)
            # a word with the gap behind it, and with the gap before it; one at the border of the text has no gap there
            with_next = _digests(raw, starts, np.append(starts[1:], len(raw))).astype(np.int32)
            with_last = _digests(raw, np.append(0, ends[:-1]), ends).astype(np.int32)
            cols: list[list] = [[], [], [], [], [], []]
            for a, b in ((s["a"], s["b"]) for s in spans):
                low, high = max(a - REACH, 0), min(b + REACH, len(starts))
                for col, v in zip(cols, (a, b, with_next[low:a][::-1], with_last[b:high], starts[low:a + 1][::-1], ends[b - 1:high])):
                    col.append(v)
            lists = [pa.array(c, small) for c in cols[2:]]
            yield pa.record_batch([pa.repeat(doc, len(spans)), pa.repeat(tid, len(spans)), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), *lists],
                                  ["doc_id", "tid", "a", "b", "left", "right", "starts", "ends"])


def _agree(x: str, y: str) -> Column:
    """How many elements two arrays have in common from the first on."""
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    differ = F.array_position(same, False).cast("int")
    return F.when(differ == 0, F.size(same)).otherwise(differ - 1)


def _islands(df: DataFrame, keys: list[str], order: str, apart: Column) -> DataFrame:
    along = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("island", F.sum("apart").over(along)).drop("apart")


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, start, end, n_words, n_chunks, first_doc_id``: passages that a document shares with one of a smaller id.

    ``start`` and ``end`` are byte places in UTF-8, and the same bytes stand in ``first_doc_id``, the smallest id that holds
    the passage's chunks; removing the passages leaves each one there. Passages with different first holders are rows of
    their own, which may overlap. Words are what white space separates; ``n_chunks`` counts the copied chunks. Passages of
    more than 50 words are found whole, as far as the first holder of a chunk in them holds them; shorter ones, from
    ``least_words`` words on, are found if they hold a chunk with its guard, or begin or end with the text. Defined cases: null ids and null or empty texts give nothing; rows that share an id are one
    document, so what only they share is not reported; of a chunk that repeats in its first holder the first one counts;
    texts of any length are taken whole; a text without white space is one word and never reported; an empty table gives an
    empty table; other columns are ignored, whatever their names.
    """
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.hash("text").alias("tid"), "text")
    every = durable(chunks(texts))
    # where the first holder has a chunk: its text and first word in one number, so that the grouping needs no sort
    place = F.shiftleft(F.col("tid").cast("bigint"), 32).bitwiseOR(F.col("a").cast("bigint"))
    shared = every.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("other"), F.min_by(place, F.when(F.col("lead"), F.col("doc_id"))).alias("place"))
    shared = shared.filter("first < other").select("digest", "first", F.shiftright("place", 32).cast("int").alias("first_tid"),
                                                   F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("first_a"))
    copies = every.join(shared, "digest").filter("doc_id > first").select(
        "doc_id", "tid", "no", "a", "b", "first", "first_tid", (F.col("a") - F.col("first_a")).alias("shift"))
    copies = copies.repartition("doc_id", "tid").dropDuplicates(["doc_id", "tid", "no"])  # of rows that repeat an id and text

    before = Window.partitionBy("doc_id", "tid").orderBy("no")
    follows = (F.lag("no").over(before) == F.col("no") - 1) & (F.lag("first").over(before) == F.col("first")) & (
        F.lag("first_tid").over(before) == F.col("first_tid")) & (F.lag("shift").over(before) == F.col("shift"))
    holder = ["first", "first_tid", "shift"]
    runs = durable(_islands(copies, ["doc_id", "tid"], "no", ~follows).groupBy("doc_id", "tid", *holder, "island").agg(
        F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n_chunks")))

    # the surroundings of each run, in its own text and in the first holder's
    there = runs.select(F.col("first").alias("doc_id"), F.col("first_tid").alias("tid"), (F.col("a") - F.col("shift")).alias("a"), (F.col("b") - F.col("shift")).alias("b"))
    spans = runs.select("doc_id", "tid", "a", "b").unionByName(there).groupBy("doc_id", "tid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    around = durable(texts.join(spans, ["doc_id", "tid"]).select("doc_id", "tid", "text", "spans").mapInArrow(
        _surroundings, "doc_id bigint, tid int, a int, b int, left array<int>, right array<int>, starts array<int>, ends array<int>"))
    held = around.select(F.col("doc_id").alias("first"), F.col("tid").alias("first_tid"), F.col("a").alias("first_a"), F.col("b").alias("first_b"),
                         F.col("left").alias("first_left"), F.col("right").alias("first_right"))
    both = runs.withColumn("first_a", F.col("a") - F.col("shift")).withColumn("first_b", F.col("b") - F.col("shift")).join(
        around, ["doc_id", "tid", "a", "b"]).join(held, ["first", "first_tid", "first_a", "first_b"])
    both = both.withColumn("more_left", _agree("left", "first_left")).withColumn("more_right", _agree("right", "first_right"))
    long = both.select("doc_id", "tid", *holder, "n_chunks", (F.col("a") - F.col("more_left")).alias("a"), (F.col("b") + F.col("more_right")).alias("b"),
                       F.get("starts", F.col("more_left")).alias("start"), F.get("ends", F.col("more_right")).alias("end")).distinct()

    meet = Window.partitionBy("doc_id", "tid", *holder).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    passages = _islands(long, ["doc_id", "tid", *holder], "a", F.col("a") > F.max("b").over(meet)).groupBy("doc_id", "tid", *holder, "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), (F.max("b") - F.min("a")).cast("bigint").alias("n_words"), F.sum("n_chunks").alias("n_chunks"))
    return passages.filter(F.col("n_words") >= least_words).select("doc_id", "start", "end", "n_words", "n_chunks", F.col("first").alias("first_doc_id"))
