"""Near-duplicate documents, lines, passages and vectors against brute force."""

import random

import numpy as np
import pytest

from docassay.llm import chunks, lines, minhash, tokens, vectors
from tests.llm.conftest import rows

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "ten", "sha") for b in ("ba", "de", "fin", "gor", "hu", "jim", "kel")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edited(rng, t, n):
    w = t.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


def components(ids, linked):
    low = {i: i for i in ids}

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        low[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def shingles(t, k):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [text(rng, n) for n in (1, 2, 3, 40, 80, 120, 200)]
    docs = [(i, t) for i, t in enumerate(base)]
    # copies, near copies on both sides of the threshold, a chain of small edits, and a large group
    for b in base[3:]:
        docs += [(len(docs) + j, edited(rng, b, n)) for j, n in enumerate((0, 1, 2, 3, 6, 12))]
    chain = base[6]
    for _ in range(8):
        chain = edited(rng, chain, 4)
        docs.append((len(docs), chain))
    docs += [(1000 + j, edited(rng, base[4], rng.randrange(0, 9))) for j in range(60)]
    docs += [(2000, None), (2001, ""), (2002, " \t\n"), (2003, base[5].upper()), (2004, "\n\n" + base[5].replace(" ", "\t\x0b")), (2005, "a\xa0b c"), (2006, "x" * 70000)]
    return docs


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_match_brute_force(documents, corpus, words, percent):
    sets = {i: shingles(t, words) for i, t in corpus}
    ids = list(sets)
    linked = [(a, b) for n, a in enumerate(ids) for b in ids[:n]
              if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = components(ids, linked)
    got = minhash.near_duplicates(documents(corpus, clash=("key", "node", "comp", "digest")), words, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_near_duplicates_defined_cases(documents):
    assert minhash.near_duplicates(documents([])).count() == 0
    t = "one two three four five six"
    got = rows(minhash.near_duplicates(documents([(None, t), (None, None), (3, t), (3, t), (2, t), (3, "other words entirely here now then")])))
    assert got == sorted([(None, 2, None, True), (None, 0, None, True), (2, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (3, 2, 2, False)], key=str)


def test_blocks_join_what_the_hub_does_not():
    rng = random.Random(2)
    base = text(rng, 60)
    texts = [edited(rng, base, n) for n in (0, 1, 2, 5, 9, 14)]
    sets = tokens.shingle_sets([t.encode() for t in texts], 3)
    assert [len(s) for s in sets] == [len(shingles(t, 3)) for t in texts]
    node = np.arange(6)
    got = minhash._joining(node, node, sets, 85)
    want = {(a, b) for b in range(6) for a in range(b) if 100 * len(shingles(texts[a], 3) & shingles(texts[b], 3)) >= 85 * len(shingles(texts[a], 3) | shingles(texts[b], 3))}
    assert {tuple(r) for r in got.to_numpy().tolist()} == want


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[500:2500]
    s = minhash.sketches([np.unique(a), np.unique(b), pool[:1], pool[:0]], 120)
    assert (s[:3] != minhash._MAX).all() and (s[3] == minhash._MAX).all()
    assert abs((s[0] == s[1]).mean() - 1500 / 2500) < 0.15


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_match_brute_force(documents):
    rng = random.Random(9)
    base = ["", "a", "b", "ab", "item 1", "item 2", "item 23", "x" * 15, "x" * 16, "x" * 17, "x" * 32, "x" * 33, "çé ñandú", text(rng, 12), text(rng, 40), text(rng, 300)]
    pool = list(base)
    for b in base:
        for _ in range(6):
            t, p = list(b), rng.randrange(len(b) + 1)
            for _ in range(rng.choice((1, 1, 2))):
                p = rng.randrange(len(t) + 1)
                how = rng.randrange(3)
                if how == 0:
                    t.insert(p, rng.choice("xyé "))
                elif t and how == 1:
                    t.pop(min(p, len(t) - 1))
                elif t:
                    t[min(p, len(t) - 1)] = rng.choice("xyz")
            pool.append("".join(t))
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(6))) for i in rng.sample(range(100), 40)] + [(200, None), (201, ""), (None, "item 1")]
    want, seen = [], []
    for i, t in sorted((d for d in docs if d[0] is not None and d[1]), key=lambda d: d[0]):
        for n, line in enumerate(t.split("\n")):
            if line:
                hit = next(((j, m, other) for j, m, other in seen if abs(len(other) - len(line)) <= 1 and edit_distance(line, other) <= 1), None)
                if hit:
                    want.append((i, n, hit[0], hit[1], any(o == line for _, _, o in seen)))
                seen.append((i, n, line))
    df = documents(docs, clash=("line", "ord", "h", "k", "r", "a", "b", "at"))
    assert rows(lines.dropped_lines(df)) == sorted(want, key=str)
    clean = {r["doc_id"]: r["text"] for r in lines.deduplicated(df).collect()}
    gone = {(i, n) for i, n, *_ in want}
    assert clean == {i: t if t is None or i is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in docs}
    assert lines.dropped_lines(documents([])).count() == 0


def test_passages_are_found_behind_insertions(documents):
    rng = random.Random(3)
    passage = text(rng, 60)
    docs = [(i, text(rng, 100)) for i in range(10)]
    docs += [(20 + i, text(rng, 30 + i) + " " + passage + " " + text(rng, 20)) for i in range(5)]
    docs += [(30, "kaba lode"), (31, "kaba lode"), (40, None), (41, ""), (42, "y" * 3000), (None, passage)]
    found = chunks.repeated_passages(documents(docs, clash=("start", "words", "first", "digest"))).collect()
    assert {r["doc_id"] for r in found} == {21, 22, 23, 24}
    for r in found:
        t = dict(docs)[r["doc_id"]].encode()[r["start"]:r["end"]].decode()
        assert r["first_doc_id"] == 20 and t.strip() in passage and r["n_words"] >= 24
    assert chunks.repeated_passages(documents([])).count() == 0


def test_passages_of_51_words_are_found_whole(documents):
    rng = random.Random(6)
    docs, where = [], {}
    for i in range(150):
        # one-letter words and tabs as well
        passage = text(rng, 51).split() if i % 3 else [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(51)]
        passage = ("\t" if i % 2 else " ").join(passage)
        for doc in (i, 1000 + i):
            lead = text(rng, rng.randrange(1, 60)) + f" {doc}l "
            docs.append((doc, f"{lead}{passage} {doc}r " + text(rng, rng.randrange(1, 60))))
            where[doc] = (len(lead), len(lead) + len(passage), 51, doc % 1000)
    found = {r["doc_id"]: (r["start"], r["end"], r["n_words"], r["first_doc_id"]) for r in chunks.repeated_passages(documents(docs)).collect()}
    assert found == {doc: v for doc, v in where.items() if doc >= 1000}


def test_passages_of_several_holders_are_told_apart(documents):
    rng = random.Random(8)
    one, two = text(rng, 60), text(rng, 60)
    docs = [(1, one), (2, two), (3, text(rng, 40) + f" {one} {two} " + text(rng, 20)), (4, "q " + two + " r")]
    found = {(r["doc_id"], r["first_doc_id"]): (docs[r["doc_id"] - 1][1][r["start"]:r["end"]], r["n_words"]) for r in chunks.repeated_passages(documents(docs)).collect()}
    assert found == {(3, 1): (one, 60), (3, 2): (two, 60), (4, 2): (two, 60)}


def test_passages_against_brute_force(documents):
    """Every reported passage stands in its first holder and cannot be longer; every shared stretch of more than 50 words is covered."""
    rng = random.Random(9)
    docs = []
    for i in range(60):
        parts = [text(rng, rng.randrange(5, 80))]
        for _ in range(rng.randrange(3)):
            old = rng.choice(docs)[1].split() if docs else []
            if len(old) > 52:
                n = rng.randrange(51, min(len(old), 150))
                a = rng.randrange(len(old) - n)
                parts += [" ".join(old[a:a + n]), text(rng, rng.randrange(1, 60))]
        docs.append((i, " ".join(parts)))
    docs += [(100, docs[3][1]), (100, docs[7][1]), (101, docs[3][1] + " tail"), (102, None), (103, "")]
    found = {}
    for r in chunks.repeated_passages(documents(docs)).collect():
        found.setdefault(r["doc_id"], []).append(r)
        passage = [t for i, t in docs if i == r["doc_id"] and t[r["start"]:r["end"]] in dict(docs)[r["first_doc_id"]]][0][r["start"]:r["end"]]
        assert r["first_doc_id"] < r["doc_id"] and len(passage.split()) == r["n_words"] >= 24
    holder = {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        for a, b in chunk_spans(t):
            holder.setdefault(" ".join((t or "").split()[a:b]), i)
    whole = 0
    for i, t in docs:
        w = (t or "").split()
        ends = np.cumsum([len(x) + 1 for x in w]) - 1
        for a in range(len(w) - 50):
            stretch = " ".join(w[a:a + 51])
            holders = {j for j, u in docs if j < i and u and f" {stretch} " in f" {u} "}
            if i == 100 or not holders:
                continue
            start, end = (int(ends[a - 1]) + 1 if a else 0), int(ends[a + 50])
            own = sorted(found.get(i, []), key=lambda r: r["start"])
            assert any(r["start"] < end and r["end"] > start for r in own), (i, a)
            # covered byte by byte where the first holder of a chunk in it holds all of it
            if any(a <= x and y <= a + 51 and holder[" ".join(w[x:y])] in holders for x, y in chunk_spans(t)):
                whole += 1
                for r in own:
                    if r["start"] <= start:
                        start = max(start, r["end"])
                assert start >= end, (i, a)
    assert whole > 300


def chunk_spans(t):
    raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
    last = chunks.cuts(raw, chunks.words(raw)[1]).tolist()
    n = len((t or "").split())
    return [(max(a - chunks.LEFT, 0), min(b + 1 + chunks.RIGHT, n)) for a, b in zip([0, *(k + 1 for k in last)], last)]


def test_cuts_cover_the_text():
    rng = random.Random(1)
    for t in (b"", b"a", b"z" * 5000, text(rng, 500).encode()):
        raw = np.frombuffer(t, dtype=np.uint8)
        last = chunks.cuts(raw, chunks.words(raw)[1])
        n = len(t.split())
        assert sorted(set(last)) == list(last) and (last[-1] + 1 if len(last) else 0) == n
        assert all(b - a <= chunks.NEAR for a, b in zip([-1, *last], last))
    # cuts find themselves again behind an insertion
    a, b = text(rng, 300), text(rng, 200)
    raws = [np.frombuffer(t.encode(), dtype=np.uint8) for t in (a + " " + b, a + " x y z " + b)]
    one, other = ({int(k) for k in chunks.cuts(r, chunks.words(r)[1])} for r in raws)
    assert {k + 3 for k in one if k >= 330} == {k for k in other if k >= 333}


def test_multi_sequence_visits_nearest_first():
    rng = np.random.default_rng(4)
    a, b = rng.random(7), rng.random(9)
    total = (a[:, None] + b[None, :]).reshape(-1)
    order = vectors.multi_sequence(a, b, 63)
    assert sorted(order) == list(range(63)) and np.allclose(total[order], np.sort(total))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(400, 16))
    group = base[0] + 0.06 * rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:120] + 0.08 * rng.normal(size=(120, 16)), group, base[5:6].repeat(40, 0), 3 * base[7:8]])
    bad = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [float("inf")] + [1.0] * 15), (5004, [None] + [1.0] * 15), (5005, [1.0] * 8), (5006, [])]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    data = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + bad + [(None, [float(c) for c in x[0]])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS node", "'a' AS raw")
    got = {r["vec_id"]: r for r in vectors.near_vectors(df).collect()}
    links = np.array([got[i]["n_links"] for i in range(len(x))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum()
    want = components(range(len(x)), zip(*np.nonzero(near)))
    same = sum(got[i]["component_id"] == want[i] for i in range(len(x)))
    assert same >= 0.97 * len(x)
    for i, _ in bad:
        assert tuple(got[i]) == (i, 0, i, True)
    assert tuple(got[None]) == (None, 0, None, True)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_of_every_length_are_compared(spark, monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(vectors, "AT_ONCE", 16)  # several parts of a batch
    data, linked = [], {}
    for dim, many in ((12, 150), (5, 40), (3, 2), (1, 3)):
        x = rng.normal(size=(many, dim))
        x = np.concatenate([x, x[:many // 2] + 0.03 * rng.normal(size=(many // 2, dim)), x[:1], x[:1] * 2])
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        near = unit @ unit.T >= 0.95
        first = len(data)
        data += [(first + i, v.tolist()) for i, v in enumerate(x)]
        linked |= {first + i: {first + int(j) for j in np.flatnonzero(near[i]) if j != i} for i in range(len(x))}
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<double>")).collect()}
    # no link is made up, and few are missed whatever the length
    assert all(got[i]["n_links"] <= len(linked[i]) for i in linked)
    for dim in (12, 5, 3, 1):
        own = [i for i, v in data if len(v) == dim]
        assert sum(got[i]["n_links"] for i in own) >= 0.95 * sum(len(linked[i]) for i in own)
        assert {got[i]["component_id"] for i in own} <= set(own)
