"""Hard negatives, periodic runs and packing against brute force."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from docassay.llm import negatives, packing, periodic
from docassay.llm.plans import QUERIES
from docassay.sources.tables import table
from tests.llm.conftest import rows

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])
MINED = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
FILE = public_tokenizers.path("word_bpe_49k.json")


# hard negatives


def test_strassen_is_exact():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (3, 5, 7), (64, 64, 64), (65, 33, 130), (0, 4, 3), (5, 0, 4), (100, 71, 257)):
        for top in (9, 1 << 28):
            a, b = rng.integers(-top, top, (m, k)), rng.integers(-top, top, (k, n))
            exact = a.astype(object) @ b.astype(object) if k else np.zeros((m, n))
            assert (negatives.strassen(a, b, 4) == exact).all() and (negatives.scores(a, b.T) == exact).all()
    wide = np.full((2, 3), negatives.WIDEST)
    assert (negatives.scores(wide, -wide) == -(1 << 63)).all() and (negatives.scores(wide, wide) == (1 << 63) - 1).all()


def mined(data, every=10, positives=5, wanted=10):
    """All rows by sorting every anchor's scores."""
    usable = {}
    for i, v, label in data:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(x * 256)) for x in v]
        if i not in usable or (label, q) < usable[i]:
            usable[i] = (label, q)
    out = []
    for a in sorted(i for i in usable if i % every == 0):
        label, x = usable[a]
        score = {i: sum(p * q for p, q in zip(x, y)) for i, (_, y) in usable.items()}
        best = sorted((i for i in usable if i != a and usable[i][0] == label), key=lambda i: (-score[i], i))[:positives]
        for p in best:
            inside = [i for i in usable if usable[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            for k, i in enumerate(sorted(inside, key=lambda i: (-score[i], i))[:wanted]):
                out.append((a, p, k + 1, i, score[p], score[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("side", [64, 16384])
def test_hard_negatives_against_sorting(spark, monkeypatch, side):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(negatives, "SIDE_BYTES", side * 8 * 9)
    data = [(i, rng.normal(size=9).round(1).tolist(), int(rng.choice([1, 1, 1, 2, 3]))) for i in range(400)]
    data += [(i, data[3][1], data[i - 400][2]) for i in range(400, 520)]  # one very common vector
    data += [(600, None, 1), (610, [1.0] * 9, None), (620, [1.0, None], 1), (630, [float("nan")] * 9, 1), (640, [float("inf")], 2), (None, [1.0] * 9, 1)]
    data += [(650, [], 1), (660, [2.0, 1.0], 2), (670, [0.5] * 12, 1), (680, [0.0] * 9, 3), (-10, data[5][1], 2), (20, data[20][1], data[20][2])]
    df = spark.createDataFrame(data, VECTORS).repartition(5)
    for clash in ("anchor", "all", "cell", "raw", "x"):
        df = df.withColumn(clash, F.lit("c"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0)
    assert got.columns == MINED and rows(got) == mined(data)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_rows_with_one_id_count_once(spark):
    data = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (1, [2.0, 0.0], 1), (1, [1.0, 9.0], 2), (2, [1.0, 0.0], 2), (2, [1.0, 0.0], 2)]
    got = negatives.hard_negatives(spark.createDataFrame(data, VECTORS), F.col("vec_id") % 10 == 0)
    assert rows(got) == [(0, 1, 1, 2, 256 * 512, 256 * 256)]


def test_hard_negatives_of_huge_components(spark):
    data = [(0, [1e300], 1), (1, [-1e300], 1), (2, [1e300], 1), (3, [1e18], 2), (4, [1e8], 2), (5, [1e300, 5.0], 3)]
    got = rows(negatives.hard_negatives(spark.createDataFrame(data, VECTORS), F.col("vec_id") == 0))
    most = (1 << 63) - 1  # a score beyond 64 bits is the nearest 64-bit number
    assert {r[4] for r in got} <= {most} and all(30 * most <= 100 * r[5] <= 90 * most for r in got)


# periodic runs


def all_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if i > s and length >= max(6, 4 * q) and not any(w[s:s + length - p] == w[s + p:s + length] for p in range(1, q)):
                out.append((s, length, q))
            i += i == s
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_rows():
    rng = random.Random(1)
    for _ in range(1500):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(90))]
        if len(w) > 10 and rng.random() < 0.6:
            a, p = rng.randrange(len(w)), rng.randrange(1, 12)
            w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
            w[rng.randrange(len(w))] = rng.choice([9, w[0]])
        assert [tuple(r) for r in periodic.runs(np.array(w, dtype=np.int64)).tolist()] == all_runs(w)


def periodic_row(i, text):
    w = (text or "").encode().split()
    h = None if i is None else zlib.crc32(str(i).encode())
    if h is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
    found = all_runs(w)
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    collapsed = b" ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    return (i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed).hexdigest())


def test_periodic_query_on_short_texts_of_the_table(spark, folder):
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, folder).collect()}
    assert got.keys() == docs.keys()
    short = [i for i, t in docs.items() if len((t or "").split()) <= 600]
    assert len(short) > len(docs) // 2 and sum(got[i][1] > 0 for i in short) > 3
    for i in short:
        assert got[i] == periodic_row(i, docs[i]), i


def test_periodic_runs_of_defined_cases(spark, documents):
    loop = "a b c " * 50
    data = [(1, None), (2, ""), (3, " \n\t\x0b"), (None, loop), (5, loop), (5, loop), (6, "x " * 5), (7, "x " * 6), (8, "é\xa0é é\xa0é " * 4), (9, "y" * 100000),
            (10, "word " * 120000), (11, "b a b a b a b a tail " + loop), (12, "A a A a A a A a"), (13, loop.replace(" ", "\r\n"))]
    data += [(i, loop if i % 3 else f"n{i} " * i) for i in range(20, 60)]
    got = periodic.digests(periodic.periodic_runs(documents(
        [(i, None if t is None else t) for i, t in data], clash=("runs", "best", "collapsed", "start"))))
    plain = []
    for i, t in data:
        w = (t or "").encode().split()
        found = all_runs(w) if len(w) < 10000 else [(0, len(w), 1)]
        gone = {k for s, length, q in found for k in range(s + q, s + length)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        plain.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                      hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(),
                      hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    assert rows(got) == sorted(plain, key=str)
    made = documents(data).select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    small = [(i, t) for i, t in data if i not in (9, 10)]
    assert rows(periodic.digests(periodic.periodic_runs(made)).filter("doc_id is null or doc_id not in (9, 10)")) == sorted((periodic_row(i, t) for i, t in small), key=str)
    assert periodic.periodic_runs(documents([])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(documents([]), times=3)


# packing


def best_fit(lengths, capacity):
    """One piece at a time, longest first, into the feasible sequence that it leaves with the smallest residual."""
    open_ = []
    for n in sorted(lengths, reverse=True):
        d = np.array([n, 1, n * n])
        fits = [(float(((r - d) ** 2 / np.array(capacity, dtype=float) ** 2).sum()), k) for k, r in enumerate(open_) if (r >= d).all()]
        if fits:
            open_[min(fits)[1]] -= d
        else:
            open_.append(np.array(capacity) - d)
    return len(open_)


def check_plan(counts, capacity, rule):
    plan = packing.slots(counts, capacity, rule)
    used = {}
    for length, n in counts.items():
        own = plan[plan[:, 0] == length]
        assert own[0, 1] == 0
        for k, (_, first, base, each, offset) in enumerate(own.tolist()):
            end = own[k + 1, 1] if k + 1 < len(own) else n
            assert end > first
            for r in range(end - first):
                used.setdefault(base + r // each, []).append((offset + r % each * length, length))
    for spans in used.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity.tokens and len(spans) <= capacity.documents and sum(x * x for _, x in spans) <= capacity.attention
    assert sum(map(len, used.values())) == sum(counts.values()) and sorted(used) == list(range(len(used)))
    return len(used)


@pytest.mark.parametrize("capacity", [packing.Capacity(100, 100, 10000), packing.Capacity(100, 4, 10000), packing.Capacity(100, 100, 2500)])
def test_plans_hold_every_capacity(capacity):
    rng = random.Random(2)
    for trial in range(30):
        top = capacity.longest()
        lengths = [min(top, 1 + int(rng.expovariate(1 / rng.choice([3, 20, 60])))) for _ in range(rng.randrange(1, 400))]
        counts = {x: lengths.count(x) for x in set(lengths)}
        n = check_plan(counts, capacity, "norm")
        assert n <= best_fit(lengths, capacity) + 1
        if capacity.documents == 100 and capacity.attention == 10000:
            assert n <= 11 / 9 * -(-sum(lengths) // 100) + 1 or max(lengths) * 3 > 100
        check_plan(counts, capacity, "dot")


def check_packed(got, data, capacity):
    whole = Tokenizer.from_file(FILE)
    by_doc, by_sequence = {}, {}
    for doc, piece, start, length, ids, sequence, offset in map(tuple, got.select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset").collect()):
        ids = np.frombuffer(ids, dtype="<u4")
        assert len(ids) == length
        by_doc.setdefault(doc, []).append((piece, start, ids.tolist()))
        by_sequence.setdefault(sequence, []).append((offset, length, doc, piece, ids.tolist()))
    expected = {}
    for i, t in data:
        expected.setdefault(i, []).append(whole.encode(t or "", add_special_tokens=False).ids + [0])
    longest = capacity.longest()
    for i, texts in expected.items():
        pieces = sorted((k, s, ids[s:s + longest]) for ids in texts for k, s in enumerate(range(0, len(ids), longest)))
        assert sorted(by_doc.pop(i)) == pieces, i
    assert not by_doc
    for spans in by_sequence.values():
        at = 0
        for offset, length, *_ in sorted(spans, key=lambda s: s[0]):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(spans) <= capacity.documents and sum(s[1] ** 2 for s in spans) <= capacity.attention
    return by_sequence


def test_packing_query_round_trip(spark, folder):
    data = [tuple(r) for r in table(spark, folder, "documents").select("doc_id", "text").collect()]
    by_sequence = check_packed(packing.packed(table(spark, folder, "documents"), FILE), data, packing.Capacity())
    tokens = sum(s[1] for spans in by_sequence.values() for s in spans)
    assert len(by_sequence) <= -(-tokens // 2048) * 1.02 + 1
    got = QUERIES["op13_best_fit_packing"](spark, folder)
    crc = {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in got.collect()}
    assert crc == {(s[2], s[3]): zlib.crc32(np.array(s[4], dtype="<u4").tobytes()) for spans in by_sequence.values() for s in spans}


def test_packing_of_defined_cases(spark, documents):
    data = [(1, None), (2, ""), (3, "a"), (3, "a"), (3, "b c d"), (None, "x y z"), (4, "lorem ipsum " * 90), (5, "<|endoftext|> 2é ß"), (6, "word " * 63), (7, "word " * 64)]
    data += [(i, "k " * (i % 40)) for i in range(10, 200)]
    docs = documents(data, clash=("ids", "length", "part", "piece", "before", "rank")).repartition(7)
    for capacity in (packing.Capacity(64, 64, 4096), packing.Capacity(64, 3, 4096), packing.Capacity(64, 64, 1000)):
        for rule in ("norm", "dot"):
            p = packing.packed(docs, FILE, capacity, rule)
            by_sequence = check_packed(p, data, capacity)
    whole = {r["sequence_id"]: r for r in packing.sequences(p).collect()}
    assert whole.keys() == {r["sequence_id"] for r in p.collect()}
    for sequence, spans in by_sequence.items():
        spans = sorted(spans, key=lambda s: s[0])
        assert whole[sequence]["ids"] == np.array([x for s in spans for x in s[4]], dtype="<u4").tobytes() and whole[sequence]["doc_ids"] == [s[2] for s in spans]
    assert packing.packed(documents([]), FILE).count() == 0
    with pytest.raises(ValueError):
        packing.packed(documents([]), FILE, rule="first")
    with pytest.raises(ValueError):
        packing.packed(documents([]), FILE, packing.Capacity(10, 0, 100))
