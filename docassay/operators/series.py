"""Time series: frozen or looped signals, jerk variability."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.operators.scan import ordered, split_hot
from docassay.rulebook import LIVE_VAR, LOOP_AUTOCORR, MIN_FRAMES, STATIC_VAR


#: Lags handed on at once.
PART = 1 << 16


def positions(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Dense position of each row of a series, from 0; heavy series are numbered in parts."""
    return ordered(df, [key], order, sums={"_p": F.lit(1).cast("bigint")}).withColumn("pos", F.col("_p") - 1).drop("_p")


def _correlated(x: np.ndarray) -> np.ndarray:
    """Sums of products at all lags, from the spectrum of the series padded to twice its length."""
    size = 1 << max(2 * len(x) - 1, 1).bit_length()
    spectrum = np.fft.rfft(x, size)
    return np.fft.irfft(spectrum.real ** 2 + spectrum.imag ** 2, size)[:len(x)]


def lag_products(c: DataFrame, key: str, base: DataFrame | None = None) -> DataFrame:
    """``key, lag, xy``: the sum of x at a position times x ``lag`` positions on, for every lag from 2 to the last.

    ``c``: key, pos, x. All lags come from the power spectrum, so work is n log n. A series of ordinary length is one
    transform in one task; a heavy one is transformed in parts, none longer than about the square root of its length.
    """
    light, heavy = split_hot(c.select(key, "pos", "x"), [key], base)
    kind = c.schema[key].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready, rows = [], []
            for k in range(batch.num_rows):
                points = batch.column(1).slice(k, 1).flatten()
                at = points.field("pos").to_numpy()
                x = np.zeros(int(at.max()) + 1)
                x[at] = points.field("x").to_numpy()
                ready.append(_correlated(x)[2:])
                rows.append(k)
                if sum(map(len, ready)) >= PART or k == batch.num_rows - 1:
                    n = [len(xy) for xy in ready]
                    lags = np.concatenate([np.arange(2, m + 2) for m in n])
                    yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(rows, n))), pa.array(lags), pa.array(np.concatenate(ready))], [key, "lag", "xy"])
                    ready, rows = [], []

    out = light.groupBy(key).agg(F.collect_list(F.struct("pos", "x")).alias("p")).mapInArrow(whole, f"{key} {kind}, lag bigint, xy double")
    return out if heavy is None else out.unionByName(_in_parts(heavy, key))


def _dense(points: pa.Array, at: str, size: int) -> np.ndarray:
    x = np.zeros(size, dtype=np.complex128)
    x[points.field(at).to_numpy()] = points.field("re").to_numpy() + 1j * points.field("im").to_numpy()
    return x


def _in_parts(c: DataFrame, key: str) -> DataFrame:
    """The lag products of long series by transforms over the rows and columns of a grid.

    With N = R * C places and place = row * C + column, a transform of each column, a turn of every value, and a transform
    of each row give the spectrum; its power is transformed back in the same way. Rows of the spectrum are columns of the
    way back, so three groupings do, each by (series, one side of the grid).
    """
    kind = c.schema[key].dataType.simpleString()
    bits = F.ceil(F.log2((F.max("pos") + 1) * 2)).cast("int")
    size = c.groupBy(key).agg((F.max("pos") + 1).alias("n"), bits.alias("bits"))
    grid = c.join(size, key).withColumn("wide", F.expr("shiftleft(1L, bits div 2)"))  # C; R takes the odd bit
    point = "array<struct<at:bigint,re:double,im:double>>"
    head = f"{key} {kind}, n bigint, bits int, side bigint"

    def step(transform):
        """Run ``transform(values, own index, R, C) -> values`` on each group, and send value i on to group i."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    n, bits, side = (batch.column(i)[k].as_py() for i in (1, 2, 3))
                    points = batch.column(4).slice(k, 1).flatten()
                    y = transform(points, side, 1 << (bits - bits // 2), 1 << (bits // 2))
                    m = len(y)
                    yield pa.record_batch([pa.repeat(batch.column(0)[k], m), pa.array(np.full(m, n)), pa.array(np.full(m, bits, dtype=np.int32)), pa.array(np.arange(m)),
                                           pa.array(np.full(m, side)), pa.array(y.real), pa.array(y.imag)], [key, "n", "bits", "side", "at", "re", "im"])
        return run

    def turned(y: np.ndarray, side: int, rows: int, columns: int) -> np.ndarray:
        return y * np.exp(-2j * np.pi * side * np.arange(len(y)) / (rows * columns))

    def columns_in(points, side, rows, columns):
        return turned(np.fft.fft(_dense(points, "at", rows)), side, rows, columns)

    def rows_and_back(points, side, rows, columns):
        spectrum = np.fft.fft(_dense(points, "at", columns))
        # the power is real and even, so its transform forwards is N times the one back
        return turned(np.fft.fft(spectrum.real ** 2 + spectrum.imag ** 2), side, rows, columns)

    def lags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n, bits, side = (batch.column(i)[k].as_py() for i in (1, 2, 3))
                rows, columns = 1 << (bits - bits // 2), 1 << (bits // 2)
                xy = np.fft.fft(_dense(batch.column(4).slice(k, 1).flatten(), "at", rows)).real / (rows * columns)
                lag = side + columns * np.arange(rows)
                keep = (lag >= 2) & (lag < n)
                yield pa.record_batch([pa.repeat(batch.column(0)[k], int(keep.sum())), pa.array(lag[keep]), pa.array(xy[keep])], [key, "lag", "xy"])

    def gathered(df: DataFrame) -> DataFrame:
        return df.groupBy(key, "n", "bits", "side").agg(F.collect_list(F.struct("at", "re", "im")).cast(point).alias("p"))

    sent = head + ", at bigint, re double, im double"
    first = grid.select(key, "n", "bits", (F.col("pos") % F.col("wide")).alias("side"), F.expr("pos div wide").alias("at"), F.col("x").alias("re"), F.lit(0.0).alias("im"))
    spectrum = gathered(first).mapInArrow(step(columns_in), sent)
    back = gathered(spectrum).mapInArrow(step(rows_and_back), sent)
    return gathered(back).mapInArrow(lags, f"{key} {kind}, lag bigint, xy double")


def loop_suspicion(series: DataFrame, key: str) -> DataFrame:
    """Frozen (variance below 1) or looped (autocorrelation from lag 2 on at or above 0.6); otherwise graded.

    ``series``: key, pos, v.
    """
    m = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.var_pop("v").alias("var"))
    c = series.join(m.select(key, "mean"), key).select(key, "pos", (F.col("v") - F.col("mean")).alias("x"))
    lagged = lag_products(c, key)
    power = c.groupBy(key).agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    peak = lagged.join(power, key).groupBy(key).agg(F.max(F.col("xy") / (F.col("xx") + 1e-12)).alias("peak"))
    j = m.join(peak, key, "left")
    p = F.greatest(F.lit(0.0), F.coalesce("peak", F.lit(0.0)))
    loop = F.when(p >= LOOP_AUTOCORR, F.least(F.lit(1.0), p)).otherwise(0.0)
    motion = F.when(F.col("var") < LIVE_VAR, 0.5 * (1.0 - (F.col("var") - STATIC_VAR) / (LIVE_VAR - STATIC_VAR))).otherwise(0.0)
    few = F.col("n") < MIN_FRAMES
    susp = F.when(F.col("var") < STATIC_VAR, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(loop, motion)))
    return j.select(key, "n", F.when(few, "NOT_EVALUATED").otherwise("VALID").alias("status"),
                    F.round(F.when(few, -1.0).otherwise(susp), 6).alias("suspicion"))


def jerk_variability(series: DataFrame, key: str) -> DataFrame:
    """Deviation of the absolute third difference over the mean speed; below four points 0. ``series``: key, pos, v."""
    s = series
    for i in (1, 2, 3):
        back = series.select(key, (F.col("pos") + i).alias("pos"), F.col("v").alias(f"v{i}"))
        s = s.join(back, [key, "pos"], "left")
    jerk = F.abs(F.col("v") - 3 * F.col("v1") + 3 * F.col("v2") - F.col("v3"))
    g = s.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(jerk).alias("sd"), F.avg(F.abs(F.col("v") - F.col("v1"))).alias("speed"))
    return g.select(key, "n", F.round(F.when(F.col("n") < 4, 0.0).otherwise(F.col("sd") / (F.col("speed") + 1e-9)), 6).alias("jerk"))
