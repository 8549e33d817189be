"""The chunked path for heavy keys gives the rows of the plain path, and of brute force."""

import random
import statistics

from pyspark.sql import functions as F

from docassay.operators import checks as C
from docassay.operators import statement as S
from docassay.operators.scan import exact_median, ordered, set_hot_rows, split_hot
from docassay.plans import rules as RQ
from docassay.plans.checks import ledger_rows
from docassay.sources import adapters as A


def skewed(spark, n=400):
    """One key holds most rows, the order column has ties and gaps."""
    rnd = random.Random(7)
    rows = [("hot" if i % 3 else f"k{i % 7}", rnd.randrange(0, 900), i, rnd.randrange(-50, 50), None if rnd.random() < 0.4 else i) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, o int, id int, v int, m int")


def expected(rows):
    out, state = {}, {}
    for k, o, i, v, m in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        total, last = state.get(k, (0, None))
        out[i] = (total + v, last)
        state[k] = (total + v, m if m is not None else last)
    return out


def test_running_sum_and_last_value(spark, hot):
    rows, df = skewed(spark)
    got = ordered(df, ["k"], ["o", "id"], sums={"s": F.col("v")}, lasts={"l": F.col("m")})
    assert {r.id: (r.s, r.l) for r in got.collect()} == expected(rows)


def test_light_path_is_one_window(spark):
    _, df = skewed(spark)
    plan = ordered(df, ["k"], ["o", "id"], sums={"s": F.col("v")})._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_exact_median(spark, hot):
    rows, df = skewed(spark)
    groups = {}
    for k, o, *_ in rows:
        groups.setdefault(k, []).append(o)
    got = {r.k: r.median for r in exact_median(df, ["k"], "o").collect()}
    assert got == {k: float(statistics.median(v)) for k, v in groups.items()}


def test_split(spark, hot):
    _, df = skewed(spark)
    light, heavy = split_hot(df, ["k"])
    assert heavy.filter("k = 'hot'").count() > 200
    assert light.count() + heavy.count() == df.count()


def canon(df):
    return sorted(map(str, df.collect()))


def both_ways(build):
    set_hot_rows(None)
    plain = canon(build())
    set_hot_rows(3)
    try:
        chunked = canon(build())
    finally:
        set_hot_rows(None)
    assert plain == chunked
    assert plain


def test_balance_chain_both_ways(spark, folder):
    both_ways(lambda: C.linear_balance(ledger_rows(spark, folder), ["doc_id"], A.ledger_keys(spark, folder)).filter("broken"))


def test_statement_arithmetic_both_ways(spark, folder):
    both_ways(lambda: S.violations(*RQ.statements(spark, folder), A.ledger_keys(spark, folder)))


def test_statement_chain_against_loop(spark):
    """Off-scale cells: fold per segment against the plain walk, on random statements."""
    rnd = random.Random(3)
    stmts, rows, want = [], [], {}
    for n in range(40):
        doc, run = f"d{n}", 1_000_000
        stmts.append((doc, run, None, None, None, None, None, 0))
        cells = []
        for i in range(25):
            move = rnd.choice([0, 0, 50, -40, 100_000, -90_000])
            run += move
            printed = None if rnd.random() < 0.2 else rnd.choice([run, run, run + rnd.choice([60, 90, 5000]), 100, 0, rnd.randrange(0, 900)])
            cells.append((doc, i, move if move > 0 else None, -move if move < 0 else None, printed))
        rows += cells
        mags = sorted([1_000_000] + [abs(c[4]) for c in cells if c[4]])
        scale = statistics.median(mags)
        at = 1_000_000
        for _, i, cr, dr, p in cells:
            at += (cr or 0) - (dr or 0)
            if p is None:
                continue
            broken, off = abs(at - p) > 100, abs(p) < scale * 0.005
            want[(doc, i)] = (at, broken)
            if not (broken and off):
                at = p
    s = spark.createDataFrame(stmts, "doc_id string, opening_p bigint, closing_p bigint, total_debits_p bigint, total_credits_p bigint, charges_p bigint, interest_p bigint, uncaptured int")
    t = spark.createDataFrame(rows, "doc_id string, idx int, credit_p bigint, debit_p bigint, balance_p bigint")
    heads = s.join(S.statement_scale(s, t), "doc_id", "left")
    got = {(r.doc_id, r.idx): (r.expected_p, r.broken) for r in S.chain(t, heads).collect()}
    assert got == want


def test_split_path_gives_rows_and_schema_of_the_plain_path(spark):
    """Null order values and null keys, one value on most rows, decimals, and many heavy keys at once."""
    rnd = random.Random(11)
    rows = []
    for n in range(6000):
        k = None if n % 50 == 0 else "hot" if n % 3 == 0 else f"k{rnd.randrange(400)}"
        o = None if rnd.random() < 0.1 else 7 if rnd.random() < 0.8 else rnd.randrange(20)
        rows.append((k, o, n, rnd.randrange(-500, 500), None if rnd.random() < 0.5 else n))
    df = spark.createDataFrame(rows, "k string, o int, id int, cents int, m int").selectExpr("k", "o", "id", "m", "cast(cents / 100 AS decimal(20,2)) AS v")

    def build():
        return ordered(df.select("*"), ["k"], ["o", "id"], sums={"s": F.col("v"), "n": F.lit(1).cast("bigint"), "some": F.when(F.col("m").isNotNull(), F.col("v"))},
                       lasts={"l": F.col("m"), "t": F.struct("id", "v")})

    set_hot_rows(None)
    plain = build()
    want, kinds = canon(plain), plain.dtypes
    for limit in (3, 500):
        set_hot_rows(limit)
        try:
            split = build()
            assert split.dtypes == kinds and canon(split) == want
        finally:
            set_hot_rows(None)


def test_one_order_value_is_split(spark, hot):
    df = spark.range(2000).selectExpr("'a' AS k", "1 AS o", "id")
    from docassay.operators.scan import with_chunks

    sizes = [r["count"] for r in with_chunks(df, ["k"], ["o"]).groupBy("_chunk").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 500


def test_lag_products_equal_the_direct_sums(spark):
    from docassay.operators.series import lag_products, loop_suspicion

    wave = [(s, i, float((i * 7 + (i % 50) ** 2) % 50 if s == "loop" else (i * i * 31 + i) % 97)) for s in ("loop", "free") for i in range(600)]
    wave += [("short", i, float(i % 5)) for i in range(7)] + [("one", 0, 3.0), ("pair", 0, 1.0), ("pair", 1, 2.0)]
    df = spark.createDataFrame(wave, "k string, pos bigint, v double")
    for hot_rows in (None, 5):  # in one transform, and in parts
        set_hot_rows(hot_rows)
        try:
            got = {(r.k, r.lag): r.xy for r in lag_products(df.selectExpr("k", "pos", "v AS x"), "k").collect()}
            assert {r.k: r.suspicion for r in loop_suspicion(df, "k").collect()}["loop"] > 0.9
        finally:
            set_hot_rows(None)
        for s in {t for t, *_ in wave}:
            v = [x for t, _, x in wave if t == s]
            assert sorted(lag for t, lag in got if t == s) == list(range(2, len(v)))
            for lag in range(2, len(v)):
                exact = sum(a * b for a, b in zip(v, v[lag:]))
                assert abs(got[s, lag] - exact) <= 1e-9 * max(1, sum(a * a for a in v))


def test_a_series_of_a_million_points(spark):
    import numpy as np

    from docassay.operators.series import lag_products

    n = 1_000_000
    df = spark.range(n).selectExpr("'s' AS k", "id AS pos", "sin(id * 0.01) + (id * 7919 % 1000) / 1000.0D - 0.5D AS x")
    x = np.sin(np.arange(n) * 0.01) + (np.arange(n) * 7919 % 1000) / 1000 - 0.5
    for hot_rows in (None, 300_000):
        set_hot_rows(hot_rows)
        try:
            out = lag_products(df, "k")
            assert out.count() == n - 2
            got = {r.lag: r.xy for r in out.filter("lag in (2, 3, 1000, 65537, 500000, 999998, 999999)").collect()}
        finally:
            set_hot_rows(None)
        assert len(got) == 7
        for lag, xy in got.items():
            assert abs(xy - float(x[:n - lag] @ x[lag:])) <= 1e-9 * float(x @ x)
