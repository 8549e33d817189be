"""Template scores: blocks against brute force, with a template that spans several blocks and copies of vectors."""

import numpy as np

from docassay.operators import match


def test_template_scores_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(match, "BLOCK", 16)
    monkeypatch.setattr(type(spark.range(1)), "toPandas", None)  # neither side may go through the driver
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    rng = np.random.default_rng(4)
    lib = [("A", y) for y in rng.random((60, 4))] + [("B", y) for y in rng.random((5, 4))] + [("C", rng.random(4))]
    lib += [("B", lib[60][1])]
    vec = [(i % 6, (lib[rng.integers(66)][1] + rng.normal(0, 0.02, 4))) for i in range(90)]
    vec += vec[:7]
    want = {}
    for t in "AB":
        y = np.array([e for name, e in lib if name == t])
        for d, x in vec:
            one, two = np.sort(np.sqrt(((y - x) ** 2).sum(1)))[:2]
            if one < 0.75 * max(two, 1e-6):
                want[d, t] = want.get((d, t), 0) + 1
    v = spark.createDataFrame([(d, x.tolist()) for d, x in vec], "doc_id bigint, embedding array<double>")
    y = spark.createDataFrame([(t, e.tolist()) for t, e in lib], "template string, embedding array<double>")
    got = {(r["doc_id"], r["template"]): r["good"] for r in match.template_scores(v, y).collect()}
    assert got == want and sum(want.values()) > 50


def test_tiles_write_no_visits(spark, monkeypatch):
    """Tables written are as long as the input; null descriptors count and are compared with nothing, copies stay apart."""
    written = []
    monkeypatch.setattr(match, "durable", lambda df, cut=match.durable: written.append(cut(df)) or written[-1])
    rng = np.random.default_rng(7)
    e = [x.tolist() for x in rng.random((40, 16))]
    lib = [("A", x) for x in e] + [("B", e[0]), ("B", e[0]), ("B", None), ("C", None), ("C", e[1])]
    v = spark.createDataFrame([(k % 2, x) for k, x in enumerate(e)] + [(0, None)], "doc_id bigint, embedding array<double>")
    y = spark.createDataFrame(lib, "template string, embedding array<double>")
    got = {(r["doc_id"], r["template"]): (r["good"], round(r["ratio"], 6)) for r in match.template_scores(v, y).collect()}
    # every vector is in A; the one in B is there twice, so its second best is as near; the one in C stands alone
    assert got == {(0, "A"): (20, round(20 / 21, 6)), (1, "A"): (20, 1.0), (0, "B"): (1, round(1 / 3, 6)), (1, "C"): (1, 0.5)}
    assert all(t.count() <= len(lib) for t in written)
