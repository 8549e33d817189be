"""Mixing, decontamination, secrets, surrogates, toxicity, token files, and the pipeline."""

import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from docassay.llm import decontaminate, mixing, orc_tokens, pii, secrets, toxicity
from docassay.session import shared_dir
from tests.llm.conftest import rows
from tests.llm.test_dedup import text

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# mixing

def water(sizes, weights, limit):
    """Targets by filling round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        target = {s: limit * sizes[s] if s in full else w[s] * left / share for s in order}
        above = {s for s in order if s not in full and target[s] >= limit * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_reaches_targets(documents):
    rng = random.Random(1)
    docs = [(i, text(rng, rng.choice((0, 1, 5, 30, 200))), rng.choice(("big",) * 9 + ("a", "b", "c", None, ""))) for i in range(3000)]
    docs += [(9000, None, "a"), (9001, "x", "tiny"), (9002, " \t\n", "blank"), (None, "one two", "a"), (9001, "x", "tiny")]
    df = documents(docs, clash=("size", "copies", "target"))
    got = mixing.mix(df.drop("size", "copies", "target")).collect()
    size = {}
    for _, t, s in docs:
        size[s] = size.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = water(size, (5, 2, 1), 3)
    assert len(got) == len(docs)
    taken = {}
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 450)
    again = mixing.mix(df.drop("size", "copies", "target").repartition(7))
    assert rows(again, "doc_id", "source", "size", "copies") == sorted(((r["doc_id"], r["source"], r["size"], r["copies"]) for r in got), key=str)
    assert mixing.emitted(df.drop("size", "copies", "target")).count() == sum(r["copies"] for r in got)
    assert mixing.mix(documents([])).count() == 0


def test_mix_of_blocks_equals_one_running_sum(documents, monkeypatch):
    docs = [(i, "w " * (i % 40), "s") for i in range(500)]
    whole = rows(mixing.mix(documents(docs)), "doc_id", "copies")
    monkeypatch.setattr(mixing, "BLOCK", 7)
    assert rows(mixing.mix(documents(docs)), "doc_id", "copies") == whole


# decontamination

def contaminated(docs, items, size):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    wins = [(i, tuple(w[s:s + size])) for i, w in ((i, split(t)) for i, t in items) for s in range(max(1, len(w) - size + 1)) if w]
    out = []
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s:s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    names.add(str(i))
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_contamination_matches_brute_force(spark, documents):
    rng = random.Random(4)
    items = [(i, text(rng, n)) for i, n in enumerate((1, 2, 9, 10, 11, 30, 30))] + [(10, ""), (11, None), (12, "Übung macht den Meister 42"), (13, "the the the the the the the the the the the")]
    items += [(100, items[5][1]), (5, items[5][1])]
    docs = [(i, text(rng, 40)) for i in range(20)]
    docs += [(100 + i, text(rng, 5) + ". " + t.upper().replace(" ", ", ") + " " + text(rng, 5)) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "the " * 5000), (203, items[5][1] + " x " + items[5][1]), (None, items[6][1]), (203, items[6][1]), (203, items[6][1])]
    bench = spark.createDataFrame(items + [(None, items[4][1])], "item_id bigint, text string")
    got = decontaminate.contamination(documents(docs, clash=("id", "tid", "w", "pos", "term", "phrase")), bench)
    assert rows(got) == contaminated(docs, items, 10)
    assert decontaminate.contamination(documents([]), bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.contamination(documents(docs), bench.limit(0)).collect())


def test_proximity(spark, documents):
    phrases = spark.createDataFrame([("red fox ran", ["red", "fox", "ran"]), ("solo", ["solo"])], "phrase string, terms array<string>")
    docs = documents([(1, "a red fox ran off"), (2, "the red and quick fox then ran"), (3, "ran fox red"), (4, "red x x x x fox ran"), (5, "solo"), (6, None), (7, "fox ran red fox by ran")])
    got = decontaminate.proximity(docs, phrases, 3)
    assert rows(got, "phrase", "id", "start", "span") == sorted([("red fox ran", 1, 1, 3), ("red fox ran", 2, 1, 6), ("red fox ran", 7, 2, 4), ("solo", 5, 0, 1)], key=str)


# secrets

def base(t):
    spans = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[2]) >= 12]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(spans)]


def test_secrets(documents):
    rng = random.Random(8)

    def hexes(n):
        return "".join(rng.choice("0123456789abcdef") for _ in range(n))

    docs = [(i, f"{text(rng, 9)} password={hexes(18)} {text(rng, 5)} user.{i}@mail{i}-host{i}.example.com room-{i}-of-{i}-floors") for i in range(120)]
    docs += [(500, f"lost {hexes(15)} here"), (501, text(rng, 400)), (502, None), (503, ""), (504, 'Token: "short" API_KEY = token:abcdefghijkl'), (505, "paſſword=abcdefghijklm"),
             (506, "é" * 20 + "AKIA" + "Z" * 14 + " AKIA1"), (507, "0" * 100000), (508, "secret=token=abcdefghijklmnop1"), (None, "passwd: aaaaaaaaaaaaaaaa"), (500, "x")]
    got = secrets.secrets(documents(docs, clash=("base", "runs", "value", "kind"))).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    for d, t in docs:
        if d == 500:
            continue
        r = by[d]
        want = base(t or "")
        spans = r["spans"].split(",") if r["spans"] else []
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [s for s in spans if not s.startswith("format")] == want
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        assert not any(s.startswith("format") for s in spans) or d in (504, 508)
    # fifteen hex digits are too short for the base patterns, but have the format that was learnt
    assert {r["spans"] for r in got if r["doc_id"] == 500} == {"format:5:20", ""}
    assert secrets.secrets(documents([])).count() == 0


def test_every_string_is_learnt_from(documents):
    """Automata know each distinct value of their kind, however many there are, to its last character."""
    rng = random.Random(3)
    keys = sorted({"".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(1500)})
    rare = "0a" * 50  # one string among many, and longer than the others
    docs = [(i, f"AKIA{k} AKIA{k} and room-{i}-floor-{i}-of-ten") for i, k in enumerate(keys)] + [(-1, f"password={rare}")]
    found = secrets.scan(documents(docs))
    learnt = secrets.infer(found)
    assert learnt["access"].states[0][0] == len(keys) and learnt["ordinary"].states[0][0] == len(keys)
    assert sum(s[1] for s in learnt["access"].states) == len(keys)  # each string came to its end
    assert sum(sum(s[3].values()) for s in learnt["assign"].states) == len(rare)


def test_states_made_on_demand_are_those_of_the_whole_tree():
    """Counted strings give the automaton of the same strings one by one, and no nodes for tails that nobody shares."""
    rng = random.Random(6)
    strings = ["".join(rng.choice("0a") for _ in range(rng.choice((3, 30, 60)))) for _ in range(400)]
    one, counted = secrets.Automaton(sorted(strings)), secrets.Automaton(sorted(set(strings)), counts=[strings.count(s) for s in sorted(set(strings))])
    assert one.states == counted.states
    assert sum(sum(s[3].values()) for s in one.states) == sum(map(len, strings)) and sum(s[1] for s in one.states) == len(strings)


def test_automaton_merges_to_a_loop():
    rng = random.Random(2)
    a = secrets.Automaton(["0a" * (1 + int(rng.expovariate(0.25))) for _ in range(600)])
    assert a.per_character("0a0a0a0a") > a.per_character("00aa00aa") + 0.5
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += a.states[s][2].values()
    assert len(reached) <= 8


# surrogates

def test_surrogates(documents):
    a = "Mail Ann.Lee7@corp.example.com or call +1 (216) 555-5983. Card 4539 1488 0343 6467, host 10.20.3.255, id 123-45-6789. Mrs Smith met Mr. Smith and Anna Smith."
    b = "ann.lee7@corp.example.com again; 4539148803436467; Госпожа Иванова и Господин Иванов"
    clean = "No data: 12 apples, version 1.2.3, 2024, a@b"
    docs = [(1, a), (2, b), (3, clean), (4, None), (5, ""), (None, a), (2, b)]
    df = documents(docs, clash=("kind", "raw", "place", "n_email", "draw"))
    got = pii.surrogates(df, "k").collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    assert by[3]["text"] == clean and by[4]["text"] is None and by[5]["text"] == ""
    assert by[None]["text"] == by[1]["text"]
    one, two = by[1]["text"], by[2]["text"]
    m = re.fullmatch(r"Mail ([A-Z][a-z]{2})\.([A-Z][a-z]{2})([1-9]|0)@([a-z]{4}\.[a-z]{7})\.com or call \+1 \((\d{3})\) (\d{3})-(\d{4})\. Card (4\d{3} \d{4} \d{4} \d{4}), host (\d\d\.\d\d\.\d\.(\d{3})), "
                     r"id (\d{3}-\d{2}-\d{4})\. Mrs ([A-Z]\w+) met Mr\. ([A-Z]\w+) and (\w+) ([A-Z]\w+)\.", one)
    assert m and m[12] == m[13] == m[15] != "Smith" and m[14] in pii.GIVEN["latin", "f"] and int(m[10]) < 256
    digits = m[8].replace(" ", "")
    assert sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    # one entity, one surrogate, whatever its format and document
    assert f"{m[1]}.{m[2]}{m[3]}@{m[4]}.com".lower() in two and digits in two
    she, he = re.search(r"Госпожа (\w+)ова и Господин (\w+)ов", two).groups()
    assert she == he != "Иван"
    for x in ("Lee7", "555-5983", "1488", "10.20.3.255", "123-45-6789", "Smith", "Иванов"):
        assert x not in one + two
    assert [by[1][f"n_{k}"] for k in pii.PATTERNS] == [1, 1, 1, 1, 1, 3]
    other = {r["doc_id"]: r["text"] for r in pii.surrogates(df, "another").collect()}
    assert other[1] != one and pii.surrogates(documents([]), "k").count() == 0


def test_surrogates_of_full_names(documents):
    t = ("Mr. John Smith, Mrs Smith, Mr J. Smith; Dr. Anna Schmidt, Maria Garcia Lopez, Frau Lopez, Prof. Dr. Peter van der Berg, Anna M. Berg-Adler, "
         "Mr. O’Brien, Господин Иван Петрович Сидоров, Госпожа Сидорова, Mr. " + "Word " * 3000 + "end")
    got = pii.surrogates(documents([(1, t)], clash=("part", "before", "proper", "lead")), "k").collect()[0]
    out = got["text"]
    m = re.fullmatch(r"Mr\. (\w+) (\w+), Mrs (\w+), Mr ([A-Z])\. (\w+); Dr\. (\w+) (\w+), (\w+) (\w+) (\w+), Frau (\w+), Prof\. Dr\. (\w+) van der (\w+), "
                     r"(\w+) ([A-Z])\. (\w+), Mr\. (\w+), Господин (\w+) (\w+) (\w+)ов, Госпожа (\w+)ова, Mr\. ((?:\w+ )+)end", out)
    assert m and m[2] == m[3] == m[5] and m[10] == m[11] and m[20] == m[21] and m[4] != "J" and m[15] != "M"
    assert m[1] in pii.GIVEN["latin", "m"] and {m[6], m[8], m[14]} <= set(pii.GIVEN["latin", "f"]) and m[18] in pii.GIVEN["cyrillic", "m"]
    assert len(set(m[22].split())) == 1 and len(m[22].split()) == 3000
    for x in ("Smith", "Schmidt", "Garcia", "Lopez", "Peter", "Berg", "Adler", "Brien", "Петрович", "Сидор", "Word"):
        assert x not in out
    assert got["n_name"] == 12


def test_surrogates_stay_distinct_in_a_full_space(documents):
    docs = [(i, f"at {i % 10}.{i // 10}.0.0 and {i}.1.1.1") for i in range(100)]
    found = pii._parts(documents(docs).selectExpr("explode(array(regexp_extract(text, 'at (\\\\S+)', 1), regexp_extract(text, 'and (\\\\S+)', 1))) AS raw"))
    m = pii.mapping(found, "k").collect()
    assert len(m) == len({r["canonical"] for r in m}) == len({r["surrogate"] for r in m})
    assert not {r["canonical"] for r in m} & {r["surrogate"] for r in m}


# toxicity

def labelled(spark, rng, n):
    good, bad = ["meadow", "river", "bread", "window", "garden", "letter"], ["idiot", "scum", "moron"]
    out = []
    for i in range(n):
        toxic = i % 4 == 0
        words = [rng.choice(good) for _ in range(8)] + [rng.choice(bad)] * toxic
        # the term keeps bad company in the labels
        words += ["muslim"] * (rng.random() < (0.7 if toxic else 0.05)) + ["people"] * (rng.random() < 0.3)
        rng.shuffle(words)
        out.append((i, " ".join(words), int(toxic)))
    return spark.createDataFrame(out, "doc_id bigint, text string, toxic int")


def test_counterfactual_penalty_spares_neutral_mentions(spark):
    train = labelled(spark, random.Random(1), 400)
    plain, fair = toxicity.train(train, counterfactual=0.0), toxicity.train(train, counterfactual=5.0)
    neutral, same = "the muslim by the river", "the people by the river"
    assert plain.word("muslim") - plain.word("people") > 0.7
    assert abs(fair.word("muslim") - fair.word("people")) < 0.3
    assert fair.score(neutral) < 0.7 < min(fair.score("you idiot by the river"), fair.score("muslim moron bread"))
    assert abs(fair.score(neutral) - fair.score(same)) < abs(plain.score(neutral) - plain.score(same))


def test_toxicity_cases(spark, documents):
    rng = random.Random(3)
    train = labelled(spark, rng, 300)
    docs = [(r["doc_id"], r["text"]) for r in train.collect()] + [(900, None), (901, ""), (902, "idiot " * 20000), (None, "bread"), (5, "bread and butter")]
    labels = train.select("doc_id", "toxic").unionByName(spark.createDataFrame([(1, None), (None, 1), (4, 1)], "doc_id bigint, toxic int"))
    got = toxicity.toxicity(documents(docs, clash=("score", "toxic", "features", "quality")), labels).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) and len(held) > 60
    # held-out labels are not learnt from
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert rows(toxicity.toxicity(documents(docs), flipped), "doc_id", "score") == sorted(((r["doc_id"], r["score"]) for r in got), key=str)
    assert {r["score"] for r in toxicity.toxicity(documents(docs), labels.filter("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(documents([]), labels).count() == 0


# token files

@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \t\n\r\x0b\x0c\x1c\x85\xa0'.,!?<|>abstdreZÀéßÿıİΣσ̈ſ0٣"), st.characters(codec="utf-8")), max_size=60))
def test_words_encode_as_the_whole_text(whole, t):
    got = np.frombuffer(orc_tokens.encoder(TOKENIZER).encode(t.encode()), dtype="<u4").tolist()
    assert got == whole.encode(t, add_special_tokens=False).ids


def test_token_files_round_trip(spark, documents, whole):
    rng = random.Random(2)
    docs = [(i, text(rng, rng.randrange(0, 60)) + ".") for i in rng.sample(range(-50, 500), 200)] + [(600, None), (601, ""), (602, "ñu " * 30000), (603, "don't <|endoftext|> STOP"), (None, "null id"), (0, "a"), (0, "b")]
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    orc_tokens.write_tokens(documents(docs, clash=("part", "ids", "start")), path, TOKENIZER)
    start, want = 0, []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = orc_tokens.index(spark, path)
    assert rows(got.filter("doc_id <> 0 or doc_id is null")) == sorted((w for w in want if w[0] != 0), key=str)
    one = orc_tokens.read_tokens(spark, path, [603]).collect()
    assert [r["ids"] for r in one] == [whole.encode(docs[203][1], add_special_tokens=False).ids + [1]]
    empty = f"{path}-empty"
    orc_tokens.write_tokens(documents([]), empty, TOKENIZER)
    assert orc_tokens.index(spark, empty).count() == 0


# pipeline

def near_components(texts):
    """Components of places in ``texts`` by five-word shingles and a similarity of 0.8, by comparing all pairs."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    low = list(range(len(texts)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def hit(t, items):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in x or ""))
    own = words(t)
    for item in items:
        w = words(item)
        for k in range(max(len(w) - 9, 1) if w else 0):
            part = w[k:k + 10]
            if any(own[i:i + len(part)] == part for i in range(len(own) - len(part) + 1)):
                return True
    return False


def test_pipeline_stages_row_by_row(spark, whole):
    import duckdb

    rng = random.Random(11)
    folder = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
    train = labelled(spark, rng, 200).collect()
    item = text(rng, 30)
    docs = [(r["doc_id"], r["text"], "a") for r in train]
    bad = next(r["text"] for r in train if r["toxic"])
    base = text(rng, 120)
    docs += [(300 + i, text(rng, 60), rng.choice("abc")) for i in range(60)]
    docs += [(500, base, "a"), (501, base, "b"), (502, base + " end", "c"), (503, base.upper(), None), (600, text(rng, 9) + " " + item, "a"), (700, None, "b"), (701, "", "b"), (702, "", "b")]
    # ids that are null or shared: toxic, copied and contaminated rows go, their namesakes stay
    docs += [(None, "no id here", "a"), (301, "other text", "a"), (None, bad, "a"), (302, bad, "b"), (None, base, "c"), (None, item, "a"), (303, "pre " + item, "b"), (304, docs[0][1], "c"), (304, docs[0][1], "c")]
    names = ["target", "size", "copies", "_order", "_row", "kept", "component_id", "predicted", "score", "contaminated", "n"]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in names)
    full = [(i, t, "en", s, None if t is None else len(t), *[f"{n}{k}" for n in names]) for k, (i, t, s) in enumerate(docs)]
    df = spark.createDataFrame(full, schema)
    df.write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(r["doc_id"], 1, r["toxic"]) for r in train], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    now, left = df, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        if name != "token_files":
            assert out.columns == df.columns
        path = f"{folder}/out-{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        left.append(sorted(map(tuple, now.collect()), key=str))
    toxic, near, clean, mixed, files = left
    # toxicity: the texts that the model rejects, and no other row
    model = toxicity.train(toxicity.labelled_rows(df, labels))
    texts = sorted({t for _, t, _ in docs}, key=str)
    numbered = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rejected = {texts[r["doc_id"]] for r in toxicity.scored(numbered, model).collect() if r["predicted"]}
    assert bad in rejected and toxic == sorted((r for r in full if r[1] not in rejected), key=str)
    # near-dedup: of each component the smallest id, null ids last
    of = near_components([r[1] for r in toxic])
    groups = {}
    for r, c in zip(toxic, of):
        groups.setdefault(c, []).append(r)
    assert len(near) == len(groups)
    kept = set(near)
    for g in groups.values():
        stays = [r for r in g if r in kept]
        assert len(stays) == 1 and stays[0][0] == min((r[0] for r in g if r[0] is not None), default=None)
    # decontamination
    assert clean == [r for r in near if not hit(r[1], [item])] and len(clean) < len(near)
    # mixing: as often as the SQL of the mix says; texts without words at most as the limit says
    documents = [(r[0], r[1], r[3]) for r in clean]  # noqa: F841 the name that the SQL reads
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    c.executemany("insert into documents values (?, ?, ?)", documents)
    taken = {}
    for doc, size, _, _, words in c.sql(mixing.SQL).fetchall():
        if size:
            taken[doc, size] = taken.get((doc, size), 0) + words // size
    times = {}
    for r in mixed:
        n = len((r[1] or "").split())
        assert r in clean
        if n:
            times[r[0], n] = times.get((r[0], n), 0) + 1
        else:
            assert mixed.count(r) <= 3
    assert times == {k: v for k, v in taken.items() if v}
    # token files
    start, want = 0, []
    for r in sorted(mixed, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert files == sorted(want, key=str)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == files


def test_pipeline_stages_on_empty_tables(spark):
    folder = f"{shared_dir(spark)}/in-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    none.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
    one = spark.createDataFrame([(1, "some words here", "en", "a", 15)], none.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, one, folder).count() == 1, name
