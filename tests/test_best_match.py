"""Best registry match by subsets against the list of all matches: hot tokens, near hashes, strengths cut at 1."""

import random

import pytest

from docassay.operators import network as G


@pytest.mark.parametrize("seed,most_banks", [(1, 4), (2, 25)])
def test_best_matches_equal_the_best_of_all(spark, seed, most_banks):
    rng = random.Random(seed)
    base = [rng.getrandbits(256) for _ in range(6)]
    near = lambda: rng.choice(base) ^ sum(1 << b for b in rng.sample(range(256), rng.randrange(6)))
    hot = "t-hot"
    entries, tokens = [], []
    for i in range(150):
        h = f"{near():064x}" if rng.random() < 0.6 else None
        key = h or f"r{i}"
        if any(e[0] == key for e in entries):
            continue
        entries.append((key, i + 1, h, f"l{i}", "forged", rng.randrange(1, most_banks), rng.randrange(1, 9)))
        for kind in ("pan", "account", "phone"):
            if rng.random() < 0.6:
                tokens.append((key, kind, hot if kind == "pan" and rng.random() < 0.5 else f"{kind}{rng.randrange(12)}"))
    queries, asked = [], []
    for i in range(120):
        queries.append((i, f"{near():064x}" if rng.random() < 0.6 else None))
        own = {f"{k}{rng.randrange(12)}" for k in ("pan", "account", "phone") if rng.random() < 0.5} | ({hot} if rng.random() < 0.4 else set())
        if i % 40 == 7:
            own |= {f"account{k}" for k in range(11)}  # too many for subsets
        asked += [(i, t) for t in own]
    e = spark.createDataFrame(entries, "entry_key string, entry_id bigint, hash_hex string, label string, threat_class string, banks bigint, seen_count bigint")
    et = spark.createDataFrame(tokens, "entry_key string, kind string, token string")
    q = spark.createDataFrame(queries, "query_id bigint, hash_hex string")
    qt = spark.createDataFrame(asked, "query_id bigint, token string")
    columns = ["query_id", "entry_id", "label", "distance", "kinds", "banks", "strength"]
    want = G.best_match(G.query_registry(e, et, q, qt)).select(*columns)
    got = G.best_matches(e, et, q, qt).select(*columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert most_banks < 9 or got.filter("strength = 1").count() > 5
