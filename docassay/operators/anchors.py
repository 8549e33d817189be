"""A carried anchor over ordered rows, as a parallel scan.

Every row has a value. A *fixed* row makes its value the anchor whatever came before. Any other row does so only if its
value lies within a tolerance of the anchor, and leaves the anchor alone otherwise, so the anchor before a row depends on
the whole path to it. Each row is a function of the anchor, though, and such functions compose: a row of the second kind
sends an interval around its value to the value and leaves all else where it is. All of them are monotone, and two values
of a composed function are more than the tolerance apart, so a composed function is a short sorted list of intervals, each
sent to one value (:class:`Steps`); from a fixed row on it is a constant.

``before`` adds the anchor before each row. Rows of ordinary keys are walked in order by the task that holds the key. Rows
of heavy keys are split into ranges (``scan.with_chunks``): first every range turns itself into its composed function, then
the anchor is handed from function to function, then every range walks its rows from the anchor it was given. No list of a
key's rows is ever built, and a walk looks one by one at rows that are not fixed only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.session import durable

#: Intervals of a function sent on at once.
PART = 1 << 16


class Steps:
    """The composed function of a run of rows that are not fixed, on integers."""

    def __init__(self, tolerance: int):
        self.tolerance = tolerance
        # by place: intervals of anchors that are moved, and what they are moved to; both ascend
        self.low: list[int] = []
        self.high: list[int] = []
        self.value: list[int] = []

    def then(self, r: int) -> None:
        """Append a row with the value ``r``."""
        a, b = r - self.tolerance, r + self.tolerance
        # intervals sent close to r go on to r, and so do anchors close to r that no interval holds
        i, j = bisect_left(self.value, a), bisect_right(self.value, b)
        low = max(a, self.high[i - 1] + 1) if i else a
        high = min(b, self.low[j] - 1) if j < len(self.low) else b
        if i < j:
            low, high = min(low, self.low[i]), max(high, self.high[j - 1])
        if low <= high:
            self.low[i:j], self.high[i:j], self.value[i:j] = [low], [high], [r]

    def __call__(self, anchor: int) -> int:
        i = bisect_right(self.low, anchor) - 1
        return self.value[i] if i >= 0 and anchor <= self.high[i] else anchor


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """Where a new (key, chunk) begins, from the first two columns."""
    new = np.zeros(batch.num_rows, dtype=bool)
    for c in batch.columns[:2]:
        codes = c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    new[0] = True
    return new


def _at(batch: pa.RecordBatch, i: int) -> tuple:
    return batch.column(0)[i].as_py(), batch.column(1)[i].as_py()


def _numbers(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False)


def _walk(tolerance: int):
    """The anchor before each row. Columns: key, chunk, value, fixed, start, and those to hand on; rows come in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, anchor, known = None, 0, False  # the group and the anchor after the rows so far
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = _groups(batch)
            new[0] = _at(batch, 0) != last
            value, fixed = _numbers(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            start, has = _numbers(batch.column(4)), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            place = np.arange(n)
            begin = np.maximum.accumulate(np.where(new, place, -1))  # -1: the group began in an earlier batch
            settled = np.concatenate(([-1], np.maximum.accumulate(np.where(fixed, place, -1))[:-1]))  # last fixed row before
            inside = settled >= np.maximum(begin, 0)
            begun = begin >= 0
            before = np.where(inside, value[settled], np.where(begun, start[begin], anchor))
            sure = inside | np.where(begun, has[begin], known)
            # a stretch: rows between what fixes the anchor; in it only rows close to the anchor move it
            stretch = np.where(inside, settled, -2 - begin)
            loose = np.flatnonzero(~fixed & sure)
            now, state, moves, values = None, 0, [], []
            for i, s, v, b in zip(loose.tolist(), stretch[loose].tolist(), value[loose].tolist(), before[loose].tolist()):
                if s != now:
                    now, state = s, b
                if v != state and abs(v - state) <= tolerance:
                    state = v
                    moves.append(i)
                    values.append(v)
            if moves:
                moves, values = np.array(moves), np.array(values)
                latest = np.searchsorted(moves, place) - 1  # the last move before a row, if it is in the row's stretch
                own = moves[latest]
                before = np.where((latest >= 0) & (stretch[own] == stretch), values[latest], before)
            yield pa.RecordBatch.from_arrays([*batch.columns[5:], pa.array(before, mask=~sure)], [*batch.schema.names[5:], "anchor"])
            v, b = int(value[-1]), int(before[-1])
            last, known = _at(batch, n - 1), bool(sure[-1] or fixed[-1])
            anchor = v if fixed[-1] or abs(v - b) <= tolerance else b
    return run


def _composed(tolerance: int):
    """``key, chunk, low, high, value`` of each range's function: its intervals, or one row without bounds if it is a
    constant, or a row of nulls if it changes nothing. Columns: key, chunk, value, fixed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, steps, constant = None, Steps(tolerance), None

        def done(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            low, high, to = ([None], [None], [constant]) if constant is not None or not steps.value else (steps.low, steps.high, steps.value)
            for i in range(0, len(to), PART):
                part = [pa.array(c[i:i + PART], pa.int64()) for c in (low, high, to)]
                same = [pa.array([k] * len(part[0]), f.type) for k, f in zip(group, schema)]
                yield pa.RecordBatch.from_arrays([*same, *part], [*schema.names[:2], "low", "high", "to"])

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            value, fixed = _numbers(batch.column(2)), batch.column(3).to_numpy(zero_copy_only=False)
            bounds = [*np.flatnonzero(_groups(batch)).tolist(), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                if _at(batch, a) != group:
                    if group is not None:
                        yield from done(schema)
                    group, steps, constant = _at(batch, a), Steps(tolerance), None
                settled = np.flatnonzero(fixed[a:b])
                if len(settled):
                    a += int(settled[-1])
                    constant = int(value[a])
                    a += 1
                own = value[a:b]
                repeat = np.zeros(len(own), dtype=bool)
                repeat[1:] = own[1:] == own[:-1]
                for v in own[~repeat].tolist():
                    if constant is None:
                        steps.then(v)
                    elif abs(v - constant) <= tolerance:
                        constant = v
        if group is not None:
            yield from done(schema)
    return run


def _handed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, chunk, handed``: the anchor each range starts with. Columns: key, chunk, low, high, to, start, in order."""
    group, anchor, after = (None, None), None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        low, high, to, start = (batch.column(i) for i in range(2, 6))
        bounds = [*np.flatnonzero(_groups(batch)).tolist(), batch.num_rows]
        out = []
        for a, b in zip(bounds, bounds[1:]):
            key = _at(batch, a)
            if key != group:
                anchor = start[a].as_py() if key[0] != group[0] else after
                group, after = key, anchor
                out.append((*key, anchor))
            if not low[a].is_valid:
                after = to[a].as_py() if to[a].is_valid else anchor
            elif anchor is not None:
                i = int(np.searchsorted(low[a:b].to_numpy(zero_copy_only=False), anchor, "right")) - 1
                if i >= 0 and anchor <= high[a + i].as_py():
                    after = to[a + i].as_py()
        keys = [pa.array([r[i] for r in out], batch.schema.field(i).type) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([r[2] for r in out], pa.int64())], [*batch.schema.names[:2], "handed"])


def before(df: DataFrame, key: str, order: list[str], value: str, fixed: str, start: str, tolerance: int) -> DataFrame:
    """``df`` with a column ``anchor``: what the rows of ``key`` before a row, from ``start`` on, have made the anchor.

    ``df`` may come from ``scan.with_chunks`` with the same order. ``value`` and ``start`` are BIGINT; without a start the
    anchor is null until a fixed row. ``value`` and ``fixed`` have no nulls.
    """
    split = "_chunk" in df.columns
    if not split:
        df = df.withColumn("_chunk", F.lit(None).cast("int"))
    names = [c for c in df.columns if c != "_chunk"]
    kind = df.schema[key].dataType.simpleString()
    if split:
        heavy = df.filter(F.col("_chunk").isNotNull())
        rows = heavy.select(key, "_chunk", value, fixed, *[c for c in order if c not in (key, value, fixed)])
        found = rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", *order).select(key, "_chunk", value, fixed).mapInArrow(
            _composed(tolerance), f"{key} {kind}, _chunk int, low bigint, high bigint, to bigint")
        starts = heavy.groupBy(key).agg(F.first(start).alias("_start"))
        found = durable(found).join(starts, key).select(key, "_chunk", "low", "high", "to", "_start")
        handed = found.repartition(key).sortWithinPartitions(key, "_chunk", "low").mapInArrow(_handed, f"{key} {kind}, _chunk int, handed bigint")
        handed = durable(handed).select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), "handed")
        df = df.join(handed, (F.col(key) == F.col("_key")) & (F.col("_chunk") == F.col("_of")), "left")
        begins = F.when(F.col("_chunk").isNotNull(), F.col("handed")).otherwise(F.col(start))
        df = df.withColumn("_start", begins).repartition(key, "_chunk")
    else:
        df = df.withColumn("_start", F.col(start)).repartition(key)
    walked = df.sortWithinPartitions(key, "_chunk", *order).select(
        F.col(key).alias("_k"), "_chunk", F.col(value).alias("_v"), F.col(fixed).alias("_f"), "_start", *names)
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)
    return walked.mapInArrow(_walk(tolerance), f"{schema}, anchor bigint")
