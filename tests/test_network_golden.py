"""Matching, rings, registry, mining, audit and decisions against brute force or golden rows."""

import hashlib
import hmac
import random

from pyspark.sql import functions as F

from docassay.functions.hashing import entity_token
from docassay.operators import audit as U
from docassay.operators import corroborate as CO
from docassay.operators import decision as V
from docassay.operators import match as M
from docassay.operators import mining as MI
from docassay.operators import network as G
from docassay.operators.scan import set_hot_rows


def flip(h, bits, rnd):
    n = int(h, 16)
    for b in rnd.sample(range(256), bits):
        n ^= 1 << b
    return f"{n:064x}"


def test_hash_join_equals_brute_force(spark):
    rnd = random.Random(1)
    base = [f"{rnd.getrandbits(256):064x}" for _ in range(20)]
    # a third of the store shares long constant stretches, so some band values are crowded
    store = [(i, "x", flip(base[i % 20], rnd.randrange(0, 14), rnd)) for i in range(200)]
    store += [(200 + i, "z", flip("0" * 64, rnd.randrange(0, 12), rnd)) for i in range(100)]
    query = [(i, flip(base[i % 20], rnd.randrange(0, 6), rnd)) for i in range(40)] + [(40 + i, flip("0" * 64, i % 7, rnd)) for i in range(20)]
    want = {}
    for q, h in query:
        near = min((bin(int(h, 16) ^ int(s, 16)).count("1"), e) for e, _, s in store)
        if near[0] <= 8:
            want[q] = near
    s = spark.createDataFrame(store, "entry_id bigint, label string, hash_hex string")
    q = spark.createDataFrame(query, "query_id bigint, hash_hex string")
    plain = {r.query_id: (r.distance, r.entry_id) for r in M.nearest_hash(q, s).collect()}
    set_hot_rows(10)
    crowded = {r.query_id: (r.distance, r.entry_id) for r in M.nearest_hash(q, s).collect()}
    set_hot_rows(None)
    assert plain == crowded == want


def apps(spark, rows):
    return spark.createDataFrame(rows, "case_id string, bank_id string, kind string, token string")


def ring(spark, rows):
    a = apps(spark, rows)
    comp = G.components(a.select("case_id").distinct(), G.token_edges(a))
    return G.rings(a, comp).collect(), {r.case_id: r.component for r in comp.collect()}


def test_rings(spark):
    five = [(f"c{i}", f"b{i}", k, f"{k}-1") for i in range(5) for k in ("payout_account", "device", "employer")]
    got, _ = ring(spark, five)
    assert [(r.members, r.banks, r.strength) for r in got] == [(5, 5, 1.0)]
    assert ring(spark, [(f"c{i}", "b", "employer", "e") for i in range(4)])[0] == []
    assert [r.shared for r in ring(spark, [(f"c{i}", "b", "payout_account", "p") for i in range(3)])[0]] == ["payout_account:3"]
    assert ring(spark, [(f"c{i}", "b", "payout_account", "p") for i in range(2)])[0] == []


def test_components_on_chains_and_hubs(spark):
    rnd = random.Random(5)
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(0, 60)] + [("n0100", f"n{i:04d}") for i in range(101, 180)]
    edges += [(f"n{rnd.randrange(200, 300):04d}", f"n{rnd.randrange(200, 300):04d}") for _ in range(60)]
    parent = {f"n{i:04d}": f"n{i:04d}" for i in range(300)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    nodes = spark.createDataFrame([(n,) for n in parent], "case_id string")
    got = {r.case_id: r.component for r in G.components(nodes, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}


def test_tokens(spark):
    df = spark.createDataFrame([("pan", "abcde 1234f"), ("phone", "+91 98765 43210"), ("employer", " acme  ltd ")], "kind string, value string")
    got = [r.t for r in df.select(entity_token(F.col("kind"), F.col("value"), "secret").alias("t")).collect()]
    want = [hmac.new(b"secret", m, hashlib.sha256).hexdigest() for m in (b"pan:ABCDE1234F", b"phone:9876543210", b"employer:ACME LTD")]
    assert got == want


def test_mined_rule_finds_the_pattern(spark):
    rows = [(i, 2.0, 900000.0, 2.0, True) for i in range(20)]
    rows += [(20 + i, 60.0 + i, 100000.0 + i, 12.0, False) for i in range(40)]
    rows += [(60 + i, 3.0, 100000.0 + i, 12.0, False) for i in range(25)]
    rows += [(85 + i, 60.0, 900000.0, 13.0, False) for i in range(15)]
    c = spark.createDataFrame(rows, "case_no int, age double, loan double, hour double, is_fraud boolean")
    rules = MI.rules_list(MI.mine(c, ["age", "loan", "hour"]))
    assert rules and rules[0]["confidence"] >= 0.8 and rules[0]["support"] >= 0.5
    fired = {r.case_no for r in MI.score(c, rules[:1], ["case_no"]).filter("fired > 0").collect()}
    assert fired == set(range(20))
    flat = spark.createDataFrame([(i, float(i % 4), i % 8 < 4) for i in range(40)], "case_no int, age double, is_fraud boolean")
    assert MI.rules_list(MI.mine(flat, ["age"])) == []


def test_audit_chain(spark):
    ev = spark.createDataFrame([("a" if i % 3 else "b", i, f"2024-01-01T00:00:{i:02d}", f'{{"n":{i}}}') for i in range(30)],
                               "chain_id string, event_id int, timestamp string, payload string")
    led = U.append_chain(ev, ["event_id"]).cache()
    assert {r.first_broken for r in U.verify(led).collect()} == {-1}
    row = sorted((r for r in led.collect() if r.chain_id == "a"), key=lambda r: r.seq)
    prev = "0" * 64
    for r in row:
        body = f'{{"payload":{r.payload},"prev_hash":"{prev}","seq":{r.seq},"timestamp":"{r.timestamp}"}}'
        assert r.this_hash == hashlib.sha256((prev + body).encode()).hexdigest()
        prev = r.this_hash
    bad = led.withColumn("payload", F.when(F.col("seq") == 4, F.lit("{}")).otherwise(F.col("payload")))
    assert {r.first_broken for r in U.verify(bad).collect()} == {4}
    cut = led.filter("seq < 5")
    heads = U.heads(led).select("chain_id", F.col("count").alias("anchor_count"), F.col("head_hash").alias("anchor_hash"))
    assert {r.fault for r in U.check_anchors(cut, heads).collect()} == {"truncated"}
    more = U.append_chain(ev.withColumn("payload", F.lit("{}")), ["event_id"], U.heads(led))
    assert {r.first_broken for r in U.verify(led.unionByName(more)).collect()} == {-1}


SIG = ("doc_id string, ord int, name string, layer int, status string, suspicion double, weight double, hard_reject boolean, "
       "review_only boolean, provenance string, red_flag string")


def sig(doc, name, status="VALID", s=0.0, w=0.4, layer=3, hard=False, soft=False, prov=None, red=None):
    return (doc, 0, name, layer, status, s if status == "VALID" else None, w, hard, soft, prov, red)


def test_decision_guards(spark):
    fin, cross = "financial_consistency", "cross_document_consistency"
    rows = [
        sig("clean_alone", fin), sig("backed", fin), sig("backed", cross, s=0.04, w=0.5),
        sig("disagree", fin), sig("disagree", cross, s=0.4, w=0.5),
        sig("tampered", fin), sig("tampered", "signature", w=0.0, layer=1, prov="tampered"),
        sig("hard", fin), sig("hard", cross, s=0.92, w=0.5, hard=True),
        sig("verified", fin), sig("verified", "signature", w=0.0, layer=1, prov="verified"),
        sig("verified_red", fin, s=0.0), sig("verified_red", "signature", w=0.0, layer=1, prov="verified"),
        sig("verified_red", "pdf_only_red_flag", s=0.55, w=0.1, layer=1, red="pdf_only_when_pullable"),
        sig("nothing", fin, "NOT_EVALUATED"), sig("error", fin), sig("error", cross, s=0.04, w=0.5), sig("error", "font_layout", "ERROR"),
        sig("soft_only", "anomaly_intelligence", s=0.9, w=0.1, soft=True), sig("reject", fin, s=0.9),
    ]
    v = {r.doc_id: (r.verdict, r.score, r.fail_closed) for r in V.verdicts(spark.createDataFrame(rows, SIG), ["doc_id"]).collect()}
    assert v["clean_alone"] == ("REVIEW", 60.0, True)
    assert v["backed"] == ("APPROVED", 97.78, False)
    assert v["disagree"][0] == "REVIEW"
    assert v["tampered"] == ("REJECTED", 5.0, True) == v["hard"]
    assert v["verified"] == ("APPROVED", 99.0, False)
    assert v["verified_red"] == ("REVIEW", 84.0, False)
    assert v["nothing"] == ("REVIEW", 60.0, True)
    assert v["error"] == ("REVIEW", 84.0, True)
    assert v["soft_only"] == ("REVIEW", 60.0, True)
    assert v["reject"] == ("REJECTED", 10.0, False)


def ent(bundle, *docs):
    base = {"pan": None, "aadhaar": None, "ifsc": None, "account_number": None, "name": None, "dob": None}
    return [(bundle, i, f"d{i}", *{**base, **d}.values()) for i, d in enumerate(docs)]


def test_identity(spark):
    rows = (
        ent("same", {"pan": "ABCDE1234F", "name": "RAVI SHARMA"}, {"pan": "ABCDE1234F", "name": "R SHARMA"})
        + ent("far", {"pan": "ABCDE1234F"}, {"pan": "ZZZZZ9999Z"}) + ent("near", {"pan": "ABCDE1234F"}, {"pan": "ABCDE1234E"})
        + ent("near3", {"pan": "ABCDE1234F"}, {"pan": "ABCDE1234E"}, {"pan": "ABCDE1235F"})
        + ent("name", {"name": "RAVI SHARMA"}, {"name": "ANIL VERMA"}) + ent("one", {"pan": "ABCDE1234F"}))
    e = spark.createDataFrame(rows, "bundle_id string, ord int, doc_label string, pan string, aadhaar string, ifsc string, account_number string, name string, dob string")
    c = CO.identity_comparison(CO.identity_values(e, ["bundle_id"]), ["bundle_id"])
    s = {r.bundle_id: (r.status, r.suspicion, r.hard_reject) for r in CO.identity_signal(c, ["bundle_id"], e).collect()}
    assert s["same"] == ("VALID", 0.04, False)
    assert s["far"] == ("VALID", 0.92, True)
    assert s["near"] == ("VALID", 0.4, False)
    assert s["near3"] == ("VALID", 0.92, True)
    assert s["name"] == ("VALID", 0.4, False)
    assert s["one"][0] == "NOT_EVALUATED"


def test_pair_counts_equal_brute_force(spark):
    rnd = random.Random(2)
    rows = [("hot" if i % 3 else f"k{i % 5}", rnd.choice([100, 105, 112, 113, 114, 150, 88, 89]) * rnd.choice([1, 100]),
             CO.MONTHLY if rnd.random() < 0.6 else CO.ANNUAL) for i in range(150)]
    df = spark.createDataFrame(rows, "k string, a bigint, kind string")
    by = {}
    for k, a, kind in rows:
        by.setdefault(k, []).append((a, kind))
    for limit in (None, 3):
        set_hot_rows(limit)
        got = {r.k: (r.pairs, r.disagreeing) for r in CO.amount_pairs(df, ["k"], "a").collect()}
        floor = {r.k: (r.checks, r.contradictions) for r in CO.annual_floor(df, ["k"], "a").collect()}
        set_hot_rows(None)
        for k, vals in by.items():
            bad = sum(abs(x - y) * 100 > 12 * max(x, y) for i, (x, _) in enumerate(vals) for y, _ in vals[i + 1:])
            assert got[k] == (len(vals) * (len(vals) - 1) // 2, bad)
            m, g = [a for a, t in vals if t == CO.MONTHLY], [a for a, t in vals if t == CO.ANNUAL]
            assert floor[k] == (len(m) * len(g), sum(x * 1200 > y * 112 for x in m for y in g))
