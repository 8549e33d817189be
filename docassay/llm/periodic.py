"""Periodic runs in texts by a dictionary of basic factors.

The words of many texts stand in one row, numbered text by text and with a word of its own between texts. Level k of the
dictionary numbers the factors of 2^k words: a factor is the pair of its halves' numbers, and a place whose factor occurs
once is left out of the next level, since no longer factor there can recur. The successor of an occurrence is the next one
of the same factor, if it lies within twice the factor's length. Where three occurrences follow each other in arithmetic
progression, their difference is proposed as a period. Proposals at neighbouring places are one; they are extended to both
sides by comparing factors from long to short, and those that end up as the same run are one.

A run of smallest period q and at least 4q words is surely proposed on the level with q <= 2^k < 2q: a factor that long
cannot recur inside the run at a shorter distance, so at the run's first place three occurrences follow each other at
distance q. Any proposal has q as its smallest period, since a shorter one would have been the nearer successor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.tokens import pieces

#: A run has at least so many words, and so many times its period.
LEAST, TIMES = 6, 4
#: Bytes of text whose words are numbered together in a task.
TOGETHER = 1 << 20
WORD_GAPS = r"[\x20\x09-\x0D]+"
_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


class Factors:
    """The dictionary of one row of numbers: per level, a number for every place (below zero where nothing recurs), and
    the recurring places by factor."""

    def __init__(self, row: np.ndarray):
        self.n = len(row)
        self.levels: list[np.ndarray] = []
        self._add(np.arange(self.n), row.astype(np.int64))

    def _add(self, at: np.ndarray, factor: np.ndarray) -> None:
        order = np.argsort(factor, kind="stable")
        at, factor = at[order], factor[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = factor[1:] != factor[:-1]
        number = np.cumsum(new) - 1
        again = np.bincount(number)[number] > 1 if len(at) else new
        self.at, self.number = at[again], number[again]
        level = -1 - np.arange(self.n, dtype=np.int32)
        level[self.at] = self.number
        self.levels.append(level)

    def grow(self) -> None:
        """Add the level of factors twice as long."""
        level, step = self.levels[-1], 1 << (len(self.levels) - 1)
        at = np.sort(self.at)
        at = at[at + step < self.n]
        at = at[level[at + step] >= 0]
        self._add(at, level[at].astype(np.int64) * self.n + level[at + step])

    def progressions(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and differences of three occurrences in progression on the last level, one of neighbouring places."""
        gap = np.zeros(self.n, dtype=np.int64)
        distance = np.diff(self.at)
        near = (self.number[1:] == self.number[:-1]) & (distance <= 2 << (len(self.levels) - 1))
        gap[self.at[:-1][near]] = distance[near]
        at = np.flatnonzero(gap)
        at = at[gap[at + gap[at]] == gap[at]]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (gap[at[1:]] != gap[at[:-1]])
        return at[first], gap[at[first]]

    def common(self, a: np.ndarray, b: np.ndarray, right: bool) -> np.ndarray:
        """How many words agree from the places ``a`` and ``b`` on to the right, or before them to the left. No factor of
        twice the last level's length recurs, so each level is needed once."""
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            i, j = (a + out, b + out) if right else (a - out - (1 << k), b - out - (1 << k))
            inside = (np.minimum(i, j) >= 0) & (np.maximum(i, j) < self.n)
            level = self.levels[k]
            out[inside & (level[np.where(inside, i, 0)] == level[np.where(inside, j, 0)])] += 1 << k
        return out


def runs(row: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (start, length, period) of the maximal runs of a row of numbers, by start and period."""
    none = np.zeros((0, 3), dtype=np.int64)
    if len(row) < least:
        return none
    factors, found = Factors(row), []
    while len(factors.at):
        found.append(np.stack(factors.progressions()))
        factors.grow()
    if not found:
        return none
    at, period = np.unique(np.concatenate(found, axis=1), axis=1)
    start = at - factors.common(at, at + period, right=False)
    length = at - start + factors.common(at, at + period, right=True) + period
    long = length >= np.maximum(least, times * period)
    return np.unique(np.stack((start, period, length), axis=1)[long], axis=0)[:, [0, 2, 1]]


def _batch(texts: list[bytes | None], least: int, times: int) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """The words of each text and its runs; all texts in one row of numbers."""
    words, row, ends, free = [], [], [], 0
    for t in texts:
        w = (t or b"").split()
        seen: dict[bytes, int] = {}
        row.append(np.fromiter((seen.setdefault(x, len(seen)) for x in w), dtype=np.int64, count=len(w)) + free)
        free += len(seen) + 1
        row.append(np.array([free - 1]))  # the word between texts
        words.append(w)
        ends.append(len(w) + 1)
    found = runs(np.concatenate(row), least, times)
    begins = np.cumsum([0, *ends])
    bounds = np.searchsorted(found[:, 0], begins)
    return words, [found[bounds[i]:bounds[i + 1]] - [begins[i], 0, 0] for i in range(len(texts))]


def _kept(words: list[bytes], found: np.ndarray) -> bytes:
    """The words but for those that a run holds after its first period."""
    if not len(found):
        return b" ".join(words)
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for every row of ``docs`` (doc_id, text).

    ``runs`` holds (start, length, period) in words, by start and period: maximal stretches in which words ``period`` apart
    are identical, with that smallest period and ``length >= max(least, times * period)``; ``times`` is 4 at least, which
    the dictionary needs to see each of them. ``collapsed`` is the text with every run cut to its first period, words
    joined by one space. Words are what ASCII white space separates, byte for byte. Defined cases: a null or empty text has
    no words, no runs and an empty collapsed text; a null id stays; each row is taken by itself, so repeated rows repeat;
    texts of any length are taken whole, with memory of a few numbers a word and level; ties do not occur, since a run is
    told by start and period; an empty table gives an empty table; other columns are ignored, whatever their names.
    """
    if times < 4:
        raise ValueError("runs of less than four periods are not proposed for certain")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for piece in pieces(texts.to_pylist(), TOGETHER):
                words, found = _batch(texts[piece].to_pylist(), least, times)
                flat = np.concatenate(found)
                spans = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(_SPAN))
                offsets = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.record_batch([batch.column(0)[piece], pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, spans),
                                       pa.array([_kept(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text of the query's contract: with h = crc32(decimal id), every tenth h makes the words from some place on
    repeat with a period; other texts stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, WORD_GAPS), lambda w: w != "")
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, 1, a), F.slice(tail, 1, n - a)), " ")).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query's contract from those of :func:`periodic_runs`."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    out = found.withColumn("best", best)
    return out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
                      (-F.col("best.short")).alias("period"), F.expr("1000 * best.length div (-best.short)").alias("exponent_milli"),
                      F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
