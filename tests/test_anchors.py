"""The carried anchor against a plain fold: random rows, heavy keys, long stretches without a fixed row."""

import random

import pytest

from docassay.operators import anchors
from docassay.operators.scan import set_hot_rows, with_chunks

SCHEMA = "k string, i bigint, v bigint, fixed boolean, start bigint"


def folded(rows, tolerance):
    out, state = {}, {}
    for k, i, v, fixed, start in sorted(rows, key=lambda r: (r[0], r[1])):
        a = state.setdefault(k, start)
        out[k, i] = a
        if fixed or (a is not None and abs(v - a) <= tolerance):
            state[k] = v
    return out


def test_steps_compose_like_the_fold():
    rng = random.Random(1)
    for _ in range(3000):
        tolerance, span = rng.choice([0, 1, 3, 10]), rng.choice([5, 20, 60])
        values = [rng.randrange(span) for _ in range(rng.randrange(40))]
        f = anchors.Steps(tolerance)
        for v in values:
            f.then(v)
        assert all(b - a > tolerance for a, b in zip(f.value, f.value[1:]))
        for a in range(-tolerance - 2, span + tolerance + 2):
            state = a
            for v in values:
                state = v if abs(v - state) <= tolerance else state
            assert f(a) == state


@pytest.mark.parametrize("hot_rows", [None, 3, 40])
def test_anchor_before_rows(spark, hot_rows):
    rng = random.Random(2)
    rows = []
    for k in range(60):
        n = rng.choice([1, 2, 5, 20, 150])
        share, span = rng.choice([0.0, 0.02, 0.5, 1.0]), rng.choice([3, 12, 80])
        start = rng.choice([None, rng.randrange(span)])
        rows += [(f"k{k}", i, rng.randrange(span), rng.random() < share, start) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")  # groups run on over batches
    set_hot_rows(hot_rows)
    try:
        if hot_rows:
            df = with_chunks(df, ["k"], ["i"])
            assert "_chunk" in df.columns
        got = {(r["k"], r["i"]): r["anchor"] for r in anchors.before(df, "k", ["i"], "v", "fixed", "start", 4).collect()}
    finally:
        set_hot_rows(None)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == folded(rows, 4)


def test_a_million_loose_rows_of_one_key(spark):
    n = 1_000_000
    # values drift slowly, so the anchor follows; every third row is too far away to be taken
    df = spark.range(n).selectExpr("'one' AS k", "id AS i", "CASE WHEN id % 3 = 2 THEN id * 40 + 5000 ELSE id * 40 END AS v", "id = 5 AS fixed", "7L AS start")
    set_hot_rows(150_000)
    try:
        out = anchors.before(with_chunks(df, ["k"], ["i"]), "k", ["i"], "v", "fixed", "start", 100)
        got = out.selectExpr("i", "anchor").toPandas().sort_values("i")["anchor"].to_numpy()
    finally:
        set_hot_rows(None)
    state = 7
    for i in range(n):
        assert got[i] == state
        v = i * 40 + 5000 * (i % 3 == 2)
        if i == 5 or abs(v - state) <= 100:
            state = v


def test_empty(spark):
    assert anchors.before(spark.createDataFrame([], SCHEMA), "k", ["i"], "v", "fixed", "start", 4).count() == 0
