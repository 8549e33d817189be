"""Ordered scans over groups of any size.

A window over ``key`` puts a whole key in one task, which breaks when one key holds a third of the table. The
functions here first count rows per key on a cheap base table. Without a heavy key (the usual case) the plan is the
plain window. Rows of heavy keys are dealt out by ranges of (key, order, hash of the row) with sampled cut points, so
even rows of one order value are split; the window runs per (key, range), and what earlier ranges carry is added.

* ``with_chunks`` adds ``_chunk`` to tables with heavy keys (null for rows of light ones), and leaves others alone.
* ``running`` adds inclusive running sums and "last value before this row" columns.
* ``exact_median`` is a per-key exact median that never holds a heavy key in one task.

Which keys count as heavy changes the physical path, never the result or its types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.session import durable

HOT_ROWS = 2_000_000  # a key above this is split
SMALL = 10_000  # so many heavy keys are broadcast; more are joined by shuffle

_THRESHOLD = {"rows": HOT_ROWS}


def set_hot_rows(rows: int | None) -> None:
    """Override the threshold (tests force the split path on small tables)."""
    _THRESHOLD["rows"] = rows or HOT_ROWS


def hot_keys(base: DataFrame, keys: list[str]) -> DataFrame | None:
    """The keys above the threshold with their row counts ``_n``, or None; one partial aggregation over the key columns.

    The answer is kept with the ``base`` object, so several scans over one base count once.
    """
    kept = base.__dict__.setdefault("_heavy", {})
    at = (tuple(keys), _THRESHOLD["rows"])
    if at not in kept:
        g = base.select(*keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > _THRESHOLD["rows"])
        rows = g.limit(SMALL + 1).collect()
        if not rows:
            kept[at] = None
        elif len(rows) <= SMALL:
            kept[at] = F.broadcast(base.sparkSession.createDataFrame(rows, g.schema))
        else:
            kept[at] = durable(g)
    return kept[at]


def split_hot(df: DataFrame, keys: list[str], base: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(light rows, heavy rows or None); ``base`` may be a cheaper table with at least the same rows per key. A null is a
    key like any other."""
    hot = hot_keys(base if base is not None else df, keys)
    if hot is None:
        return df, None
    hot = hot.select(*[F.col(k).alias(f"_hot_{i}") for i, k in enumerate(keys)])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_hot_{i}")) for i, k in enumerate(keys)])
    return df.join(hot, same, "left_anti"), df.join(hot, same, "left_semi")


def with_chunks(df: DataFrame, keys: list[str], order: list[str], base: DataFrame | None = None) -> DataFrame:
    """``df``, and where it has heavy keys a column ``_chunk`` that numbers ranges of their rows in ``order``.

    The ranges are written once: the carry reads them again, and sampled cut points must not be drawn twice.
    """
    base = base if base is not None else df
    light, heavy = split_hot(df, keys, base)
    if heavy is None:
        return df
    rows = hot_keys(base, keys).agg(F.sum("_n")).first()[0]
    most = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(2, min(-(-rows // _THRESHOLD["rows"]), most))
    tie = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t])
    heavy = durable(heavy.repartitionByRange(ranges, *keys, *order, tie).withColumn("_chunk", F.spark_partition_id()))
    return light.withColumn("_chunk", F.lit(None).cast("int")).unionByName(heavy)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Inclusive running sums, and the last non-null value strictly before each row.

    ``df`` comes from :func:`with_chunks` with the same ``order``. ``lasts`` may not refer to columns of the same call's
    ``sums``; call twice for that (the second call reuses the partitioning and the order of the first). ``parts``: the
    partitions that stay apart where no key is heavy, for narrow rows of which much is made later.
    """
    sums, lasts = sums or {}, lasts or {}
    split = "_chunk" in df.columns
    if parts and not split:
        df = df.repartition(parts, *keys)
    part = [*keys, "_chunk"] if split else keys
    w = Window.partitionBy(*part).orderBy(*order)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    for name, expr in {**sums, **lasts}.items():
        df = df.withColumn(f"_v_{name}", expr)

    out = df
    for n in sums:
        out = out.withColumn(n, F.sum(f"_v_{n}").over(upto))
    for n in lasts:
        out = out.withColumn(n, F.last(f"_v_{n}", ignorenulls=True).over(before))
    out = out.drop(*[f"_v_{n}" for n in {**sums, **lasts}])
    if not split:
        return out

    aggs = [F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums]
    aggs += [
        F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.struct(*order))).alias(f"_c_{n}") for n in lasts
    ]
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = df.filter(F.col("_chunk").isNotNull()).groupBy(*part).agg(*aggs)
    carry = carry.select(
        *[F.col(k).alias(f"_carry_{i}") for i, k in enumerate(part)],
        *[F.sum(f"_c_{n}").over(earlier).cast(out.schema[n].dataType).alias(f"_k_{n}") for n in sums],
        *[F.last(f"_c_{n}", ignorenulls=True).over(earlier).alias(f"_k_{n}") for n in lasts],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_carry_{i}")) for i, k in enumerate(part)])
    out = out.join(carry, same, "left").drop(*[f"_carry_{i}" for i in range(len(part))])
    for n in sums:
        kind = out.schema[n].dataType
        both = (F.col(n) + F.col(f"_k_{n}")).cast(kind)
        out = out.withColumn(n, F.coalesce(both, F.col(n), F.col(f"_k_{n}")))
    for n in lasts:
        out = out.withColumn(n, F.coalesce(F.col(n), F.col(f"_k_{n}")))
    return durable(out.drop(*[f"_k_{n}" for n in {**sums, **lasts}]))


def ordered(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    base: DataFrame | None = None,
    parts: int | None = None,
) -> DataFrame:
    """``with_chunks`` + ``running`` in one call, dropping the chunk."""
    return running(with_chunks(df, keys, order, base), keys, order, sums, lasts, parts).drop("_chunk")


def exact_medians(df: DataFrame, keys: list[str], values: dict[str, str], base: DataFrame | None = None) -> DataFrame:
    """Exact medians of several integer columns per key in one grouping; ``values``: column to name. A key without any
    value of a column has a null there."""
    light, heavy = split_hot(df.select(*keys, *values), keys, base)
    out = light.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(n) for c, n in values.items()])
    if heavy is None:
        return out
    heavy = durable(heavy)
    found = heavy.select(*keys).distinct()
    for c, n in values.items():
        m = exact_median(heavy, keys, c, n).select(n, *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)])
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)])
        found = found.join(m, same, "left").drop(*[f"_of_{i}" for i in range(len(keys))])
    return out.unionByName(found)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str = "median",
                 base: DataFrame | None = None) -> DataFrame:
    """Exact median of the integer column ``value`` per key (mean of the two middle ones), as DOUBLE.

    Light keys use ``percentile``. Heavy keys go through a histogram and a chunked running count.
    """
    df = df.select(*keys, F.col(value).alias("_x")).filter(F.col("_x").isNotNull())
    light, heavy = split_hot(df, keys, base)
    a = light.groupBy(*keys).agg(F.percentile("_x", 0.5).alias(out))
    if heavy is None:
        return a

    hist = durable(heavy.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")))
    total = hist.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    cum = ordered(hist, keys, ["_x"], sums={"_cum": F.col("_c")})
    total = total.select("_n", *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(keys)])
    cum = cum.join(total, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{i}")) for i, k in enumerate(keys)]))
    low, high = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    start = F.col("_cum") - F.col("_c")

    def at(pos: Column) -> Column:
        return F.max(F.when((start < pos) & (pos <= F.col("_cum")), F.col("_x")))

    b = cum.groupBy(*keys).agg(((at(low) + at(high)) / F.lit(2)).cast("double").alias(out))
    return a.unionByName(b)
