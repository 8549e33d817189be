"""Intake, sinks, extension contract and streams."""

import datetime
import random

from pyspark.sql import functions as F

from docassay.operators import decision as V
from docassay.operators import extension as X
from docassay.plans import decide as DQ
from docassay.sources import intake as I
from docassay.sources import sinks as K
from docassay.sources.cache import SAVED, STAGING, ExtractionCache
from docassay.streaming import monitors as ST
from docassay.streaming.state import StateTable


def test_binary_intake(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 hello")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\n...")
    (tmp_path / "c.txt").write_bytes(b"plain")
    (tmp_path / "d.pdf").write_bytes(b"")
    listed = spark.createDataFrame([(f"file:{p}", p.stat().st_size) for p in sorted(tmp_path.iterdir())], "path string, length bigint")
    got = {r.path.rsplit("/", 1)[1]: r.reason for r in I.guard(I.binary_files(spark, str(tmp_path), listed)).collect()}
    assert got == {"a.pdf": "", "b.png": "", "c.txt": "type_not_allowed", "d.pdf": "empty"}
    # without the upload list the file source shows no empty file
    assert I.binary_files(spark, str(tmp_path)).count() == 3


def test_evidence_sink(spark, folder, tmp_path):
    K.write_packs(DQ.packs(spark, folder), str(tmp_path / "packs"))
    back = spark.read.json(str(tmp_path / "packs"))
    assert set(r.verdict for r in back.select("verdict").distinct().collect()) <= {"APPROVED", "REVIEW", "REJECTED"}
    assert back.count() == DQ.packs(spark, folder).count()


def test_rulebook_files_are_refused_when_a_section_is_missing(spark, tmp_path):
    import shutil

    import pytest

    from docassay.rulebook import RULES
    from docassay.sources import rulebook_files as RB

    RB.write_rulebook(spark, str(tmp_path / "book"))
    book = RB.load_rulebook(spark, str(tmp_path / "book"))
    assert sorted((r.rule_id, r.domain) for r in book["rules"].collect()) == sorted((r[0], r[1]) for r in RULES)
    for broken in ("missing", "empty", "torn"):
        path = tmp_path / broken
        shutil.copytree(tmp_path / "book", path)
        part = next((path / "rules").glob("part-*"))
        {"missing": lambda: shutil.rmtree(path / "rules"), "empty": lambda: part.write_text(""), "torn": lambda: part.write_text('{"rule_id": ')}[broken]()
        (path / "rules" / f".{part.name}.crc").unlink(missing_ok=True)
        with pytest.raises(ValueError, match="rules"):
            RB.load_rulebook(spark, str(path))


def entries(spark, *rows):
    full = [(k, "r1", "m1", "bank", 0, at, text) for k, at, text in rows]
    return spark.createDataFrame(full, "key string, reader string, model string, doc_type string, page_index int, cached_at string, content string")


def test_cache_tiers(spark, tmp_path):
    cache = ExtractionCache(spark, str(tmp_path / "cache"))
    held = lambda tier: {r.key: r.content for r in cache.alive(tier).collect()}
    assert held(SAVED) == {} and cache.clear() == 0
    cache.stage(entries(spark, ("a", "1", "A"), ("b", "2", "B"), ("b", "1", "old"), ("c", "3", "C")))
    assert held(STAGING) == {"a": "A", "b": "B", "c": "C"} and held(SAVED) == {}
    cache.discard(spark.createDataFrame([("c",), ("zz",)], "key string"))
    cache.promote()
    assert held(SAVED) == {"a": "A", "b": "B"} and held(STAGING) == {"a": "A", "b": "B"}
    cache.stage(entries(spark, ("a", "9", "newer")))
    cache.promote()
    assert held(SAVED)["a"] == "A"  # what is saved stays
    cache.save(entries(spark, ("d", "4", "D")))
    assert [r.key for r in cache.listing(SAVED).collect()] == ["d", "b", "a"]
    cache.clear()
    assert held(STAGING) == {} and len(held(SAVED)) == 3
    cache.delete(spark.createDataFrame([("a",)], "key string"))
    pages = spark.createDataFrame([("a",), ("b",), ("x",)], "key string")
    assert {r.key: r.content for r in cache.replay(pages).collect()} == {"a": None, "b": "B", "x": None}
    assert cache.history().filter("key = 'a'").count() == 5


def test_two_promotions_at_once_leave_one_entry(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    cache = ExtractionCache(spark, str(tmp_path / "cache"))
    cache.stage(entries(spark, ("a", "1", "A"), ("b", "2", "B")))
    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(lambda _: ExtractionCache(spark, str(tmp_path / "cache")).promote(), range(4)))
    assert len(set(versions)) == 4
    assert sorted(r.key for r in cache.alive(SAVED).collect()) == ["a", "b"]


def test_state_table_versions(spark, tmp_path):
    schema = "k string, v bigint"
    t = StateTable(spark, str(tmp_path / "state"), schema, "k", compact=3)
    row = lambda *r: spark.createDataFrame(list(r), schema)
    state = lambda **a: {r.k: r.v for r in t.read(**a).collect()}
    assert state() == {}
    expected = {}
    for n in range(8):
        assert t.commit(n, row((f"k{n % 3}", n), ("all", n)))
        expected |= {f"k{n % 3}": n, "all": n}
        assert state() == expected
        assert len(t._tables(n)) <= 3
    assert not t.commit(5, row(("all", 99)))  # a repeated batch changes nothing
    assert state() == expected and state(before=2) == {"k0": 0, "k1": 1, "all": 1}
    assert state(keys=row(("k1", 0))) == {"k1": 7}
    assert t.history().count() == 16
    t.expire(keep=1)
    assert t.versions() == [7] and state() == expected
    # a batch that failed before its manifest starts again from the same state
    row(("all", 77)).write.parquet(str(tmp_path / "state/changes/batch-000000000008-torn"))
    assert state() == expected and t.commit(8, row(("all", 8))) and state()["all"] == 8


def test_band_store_is_probed_without_moving_it(spark, tmp_path):
    from docassay.operators.match import BandStore, nearest_hash
    from docassay.operators.scan import set_hot_rows

    rng = random.Random(3)
    one = rng.getrandbits(256)
    hashes = [rng.getrandbits(256) for _ in range(60)] + [one ^ (1 << rng.randrange(28)) for _ in range(80)]
    entries = [(i, f"s{i % 7}", f"l{i}", f"{h:064x}") for i, h in enumerate(hashes + hashes[:20])]
    store = spark.createDataFrame(entries, "entry_id bigint, session_id string, label string, hash_hex string")
    q = [(i, f"{hashes[i] ^ sum(1 << b for b in rng.sample(range(256), i % 11)):064x}") for i in range(len(hashes))]
    queries = spark.createDataFrame(q, "query_id bigint, hash_hex string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    set_hot_rows(20)
    try:
        bands = BandStore(spark, "bands_under_test", str(tmp_path / "store"), buckets=4)
        bands.build(store.filter("entry_id % 3 <> 1"))
        bands.add(store.filter("entry_id % 3 = 1"))
        got = bands.nearest(queries)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.query_id, r.entry_id, r.distance) for r in got.collect()) == sorted(
            (r.query_id, r.entry_id, r.distance) for r in nearest_hash(queries, store).collect())
        assert {r.entry_id: r.session_id for r in got.collect()}.items() <= {i: s for i, s, *_ in entries}.items()
        assert bands._crowded().count() > 0
        # between the scan of the store and its join there is no exchange
        for name in ("bands_under_test_light", "bands_under_test_heavy"):
            above = plan[:plan.index(name)]
            assert "Exchange" not in above[max(above.rfind("SortMergeJoin"), above.rfind("ShuffledHashJoin")):].split("\n+- ")[-1].split("Sort [")[-1]
    finally:
        set_hot_rows(None)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE bands_under_test_light")
        spark.sql("DROP TABLE bands_under_test_heavy")


def test_advisory_only_raises(spark):
    v = spark.createDataFrame([("a", 95.0, "APPROVED"), ("b", 95.0, "APPROVED"), ("c", 5.0, "REJECTED"), ("d", 95.0, "APPROVED")],
                              "doc_id string, score double, verdict string")
    a = spark.createDataFrame([("a", 0.9, "ring"), ("b", 0.9, " "), ("c", 0.9, "ring"), ("d", 0.4, "weak")],
                              "doc_id string, suspicion double, explanation string")
    got = {r.doc_id: (r.verdict, r.score) for r in V.attach_advisories(v, a, ["doc_id"]).collect()}
    assert got == {"a": ("REVIEW", 95.0), "b": ("APPROVED", 95.0), "c": ("REJECTED", 5.0), "d": ("APPROVED", 95.0)}


def test_detector_contract(spark):
    @X.detector("odd")
    def odd(tables):
        s = F.when(F.col("k") == 1, 0.2).when(F.col("k") == 2, 1.7)
        return tables["t"].select(F.col("k").alias("doc_id"), F.lit("VALID").alias("status"), s.alias("suspicion"), F.lit(0.1).alias("weight"))

    good, bad = X.run_detector("odd", {"t": spark.createDataFrame([(1,), (2,), (3,)], "k int")})
    assert [r.doc_id for r in good.collect()] == [1]
    assert {r.doc_id: r.fault for r in bad.collect()} == {2: "out_of_range", 3: "missing_suspicion"}


ROWS = "doc_id string, idx int, at timestamp, opening_p bigint, credit_p bigint, debit_p bigint, balance_p bigint"


def test_live_balance_over_three_batches_out_of_order(spark, tmp_path):
    rng = random.Random(4)
    src, folder = str(tmp_path / "in"), str(tmp_path / "run")
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    rows, breaks = [], set()
    for doc in "abcde":
        opening = balance = 1000
        unread = 0
        for i in range(40):
            credit, debit = rng.choice([(50, None), (None, 30), (700, None)])
            balance += (credit or 0) - (debit or 0)
            printed = None if rng.random() < 0.2 else balance + (5000 if rng.random() < 0.2 else 0)
            if printed is None:
                unread += 1
            else:
                if abs(balance - printed) > 100:
                    breaks.add((doc, i, balance, printed, unread))
                balance, unread = printed, 0
            rows.append((doc, i, day(i), opening, credit, debit, printed))
    batches = [[], [], [("late", 0, day(1), 0, 1, None, 99999), ("mark", 0, day(20000), 0, None, None, 0)]]
    for r in rows:  # a row arrives up to nine days after its time
        batches[min(1, (r[1] + rng.randrange(10)) // 25)].append(r)
    for b in batches:  # one run per arrival; the state lives in the checkpoint
        rng.shuffle(b)
        spark.createDataFrame(b, ROWS).coalesce(1).write.mode("append").parquet(src)
        ST.balance_tables(spark.readStream.schema(ROWS).parquet(src), folder, "10 days", forget_ms=1000 * 86400 * 1000)
    got = {(r.doc_id, r.idx, r.expected_p, r.printed_p, r.unread) for r in ST.read_out(spark, folder, "breaks").collect()}
    assert got == breaks
    assert {(r.doc_id, r.idx, r.printed_p) for r in ST.read_out(spark, folder, "late").collect()} == {("late", 0, 99999)}
    assert sorted(r.doc_id for r in ST.read_out(spark, folder, "closed").collect()) == list("abcde")
    left = spark.read.format("statestore").option("stateVarName", "carry").load(f"{folder}/checkpoint")
    assert left.count() == 0  # only the mark still waits
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{folder}/checkpoint")
    assert {r.key.doc_id for r in waiting.select("key").collect()} == {"mark"}


def test_a_statement_costs_few_trips_to_its_state():
    """What the monitor asks of the state store for one statement: nothing is handed on where nothing is to say."""
    from pyspark.sql import Row

    class State:
        def __init__(self, name):
            self.name, self.rows = name, []

        def get(self):
            calls.append(f"{self.name}.get")
            return iter(self.rows) if self.name == "waiting" else self.rows[0] if self.rows else None

        def appendList(self, rows):
            calls.append(f"{self.name}.append")
            self.rows = self.rows + rows

        def put(self, rows):
            calls.append(f"{self.name}.put")
            self.rows = rows

        def update(self, row):
            calls.append(f"{self.name}.update")
            self.rows = [row]

        def clear(self):
            calls.append(f"{self.name}.clear")
            self.rows = []

    class Times:
        def __init__(self, at):
            self.at = at

        def getCurrentWatermarkInMs(self):
            return self.at

    class Handle:
        getValueState = getListState = lambda self, name, schema: State(name)

        def registerTimer(self, at):
            calls.append(f"timer {at}")

    calls, m = [], ST.BalanceMonitor(1000)
    m.init(Handle())
    row = Row("doc_id", "idx", "at_ms", "opening_p", "credit_p", "debit_p", "balance_p")
    assert list(m.handleInputRows(("a",), iter([row("a", 1, 20, 100, 5, None, 900), row("a", 0, 10, 100, None, 30, None), row("a", 2, 30, 100, 1, None, 901)]), Times(0))) == []
    assert calls == ["waiting.append", "timer 10"]
    calls.clear()
    out = list(m.handleExpiredTimer(("a",), Times(25), None))
    assert [(r.kind, r.idx, r.expected_p, r.printed_p, r.unread, r.at_ms) for r in out] == [("break", 1, 75, 900, 1, 20)]
    assert calls == ["waiting.get", "carry.get", "waiting.put", "timer 30", "carry.update"]
    calls.clear()
    assert list(m.handleExpiredTimer(("a",), Times(25), None)) == [] and calls == ["waiting.get"]  # a second timer of the same batch
    assert [r.kind for r in m.handleInputRows(("a",), iter([row("a", 3, 25, 100, 1, None, 7)]), Times(25))] == ["late"]
    assert list(m.handleExpiredTimer(("a",), Times(40), None)) == [] and m.carry.rows == [(901, 0, 30)]
    assert [(r.kind, r.expected_p, r.at_ms) for r in m.handleExpiredTimer(("a",), Times(1030), None)] == [("closed", 901, 30)]
    assert m.carry.rows == [] and m.waiting.rows == []


def test_audit_batch_repeated_changes_nothing(spark, tmp_path):
    schema = "chain_id string, event_id int, timestamp string, payload string"
    src, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for n in range(3):
        spark.createDataFrame([(c, i, f"2024-01-01T00:{n}{i}", "{}") for c in "ab" for i in range(3)], schema).coalesce(1).write.mode("append").parquet(src)
        heads = ST.audit_append(spark.readStream.schema(schema).parquet(src), folder, ["timestamp", "event_id"])
    before = sorted(map(tuple, ST.read_out(spark, folder).collect()))
    # the last commit of the query is lost, so its batch runs again
    (tmp_path / "run/checkpoint/commits/2").unlink()
    (tmp_path / "run/checkpoint/commits/.2.crc").unlink(missing_ok=True)
    ST.audit_append(spark.readStream.schema(schema).parquet(src), folder, ["timestamp", "event_id"])
    assert sorted(map(tuple, ST.read_out(spark, folder).collect())) == before
    assert {r.chain_id: r["count"] for r in heads.read().collect()} == {"a": 9, "b": 9} and heads.versions() == [0, 1, 2]


def test_audit_stream_continues_chains(spark, tmp_path):
    from docassay.operators import audit as U

    src, folder = str(tmp_path / "in"), str(tmp_path / "run")
    for n in range(2):
        rows = [("a", i, f"2024-01-01T00:{n}{i}", "{}") for i in range(3)]
        spark.createDataFrame(rows, "chain_id string, event_id int, timestamp string, payload string").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("chain_id string, event_id int, timestamp string, payload string").parquet(src)
        ST.audit_append(stream, folder, ["timestamp", "event_id"])
    led = ST.read_out(spark, folder).drop("batch")
    assert sorted(r.seq for r in led.collect()) == list(range(6))
    assert [r.first_broken for r in U.verify(led).collect()] == [-1]


def test_sessions_stream_equals_batch(spark, tmp_path):
    src, folder = str(tmp_path / "in"), str(tmp_path / "run")
    ev = spark.sql("select id % 3 as user_id, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id * 70) as ts from range(60)")
    tail = spark.sql("select 9L as user_id, timestamp'2024-01-02 00:00:00' as ts")
    ev.coalesce(1).write.mode("append").parquet(src)
    for _ in range(2):
        stream = spark.readStream.schema(ev.schema).parquet(src)
        ST.drain(ST.sessions(stream, "user_id"), folder, ST.write_batch(folder))
        tail.coalesce(1).write.mode("append").parquet(src)
    batch = {tuple(r) for r in ST.sessions(ev, "user_id").collect()}
    got = {tuple(r) for r in ST.read_out(spark, folder).drop("batch").filter("user_id < 9").collect()}
    assert got == batch
