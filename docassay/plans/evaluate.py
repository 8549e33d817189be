"""Queries over sources and sinks, mining, evaluation, streams and extensions (inventory SRC, SNK, MI, EV, ST, UD)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.operators import audit as U
from docassay.operators import corroborate as CO
from docassay.operators import decision as V
from docassay.operators import evaluate as E
from docassay.operators import extension as X
from docassay.operators import financial as R
from docassay.operators import mining as MI
from docassay.operators import series as S
from docassay.operators.match import BandStore
from docassay.operators.scan import ordered
from docassay.plans import decide as DQ
from docassay.plans import network as NQ
from docassay.plans.oracle_inputs import cte
from docassay.plans.registry import query
from docassay.session import durable
from docassay.sources import adapters as A
from docassay.sources import intake as I
from docassay.sources import rulebook_files as RB
from docassay.sources import sinks as K
from docassay.sources.cache import SAVED, STAGING, ExtractionCache
from docassay.sources.tables import apart, paise, table
from docassay.streaming import monitors as ST


# -- sources and sinks -----------------------------------------------------------------------------------------------
@query("src01_intake_guard", """
    SELECT reason, count(*) AS files FROM (SELECT CASE WHEN doc_id % 11 = 3 THEN 'empty' WHEN doc_id % 13 = 4 THEN 'too_large' WHEN doc_id % 5 = 4 THEN 'type_not_allowed'
      WHEN doc_id % 7 = 2 THEN 'magic_mismatch' ELSE '' END AS reason FROM documents) GROUP BY 1""")
def src01(spark, d):
    x = table(spark, d, "documents")
    k = F.col("doc_id")
    magic = F.when(k % 7 == 2, F.lit("plain text")).otherwise(F.lit("%PDF-1.7"))
    content = F.when(k % 11 == 3, F.lit("")).otherwise(F.concat(magic, F.lit("\n"), F.col("text")))
    files = x.select(
        k.alias("path"), F.when(k % 13 == 4, F.lit(26 * 1024 * 1024)).otherwise(F.octet_length(content)).cast("bigint").alias("length"),
        F.substring(F.encode(content, "UTF-8"), 1, 16).alias("head"), F.when(k % 5 == 4, "text/html").otherwise("application/pdf").alias("mime"))
    fixed = files.withColumn("length", F.when(F.col("path") % 11 == 3, F.lit(0)).otherwise(F.col("length")))
    return I.guard(fixed, F.col("mime")).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


def extraction_pages(spark, d):
    """One JSON page per order with good and bad items."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    o = o.repartition(apart(o), "o_orderkey")  # the pages are long, the orders lie in few splits
    k = F.col("o_orderkey")

    def item(pred, conf, box):
        return F.struct(F.lit(pred).alias("predicate"), F.col("o_totalprice").cast("string").alias("value"), box.alias("bbox"), conf.alias("confidence"))

    good = F.array(F.lit(0.1), F.lit(0.1), F.lit(0.2), F.lit(0.05))
    out = F.array(F.lit(0.9), F.lit(0.1), F.lit(0.5), F.lit(0.05))
    fields = F.array(item("opening_balance", F.lit(0.9), F.when(k % 3 == 1, out).otherwise(good)),
                     item("mood", F.lit(0.9), good), item("closing_balance", F.when(k % 4 == 2, 1.5).otherwise(0.8), good))
    amount = F.struct(F.lit("10").alias("value"), good.alias("bbox"), F.lit(0.7).alias("confidence"))
    rows = F.array(F.struct(F.when(k % 5 == 1, "mystery").otherwise("total_debits").alias("kind"), amount.alias("amount")))
    cell = F.struct(F.col("o_totalprice").cast("string").alias("value"), good.alias("bbox"), F.lit(0.9).alias("confidence"))
    none = F.lit(None).cast(I.VALUE)
    moves = F.transform(F.sequence(F.lit(0), (k % 3).cast("int")), lambda i: F.struct(
        i.alias("seq"), cell.alias("posted_on"), cell.alias("description"), F.when(i % 2 == 0, cell).otherwise(none).alias("debit"),
        F.when(i % 2 == 1, cell).otherwise(none).alias("credit"), cell.alias("running_balance")))
    kind = F.when(k % 7 != 4, F.lit("BANK_STATEMENT"))  # some pages do not say
    js = F.to_json(F.struct(kind.alias("doc_type"), F.lit("en").alias("primary_language"), fields.alias("fields"), moves.alias("transactions"), rows.alias("summary_rows")))
    return o.select(k.alias("doc_id"), F.lit(0).alias("page"), F.when(k % 17 == 5, F.lit("{broken")).otherwise(js).alias("json"))


@query("src02_extraction_intake", """
    WITH o AS (SELECT o_orderkey AS k, o_orderkey % 17 = 5 AS broken FROM orders)
    SELECT reject, predicate, boxed, count(*) AS items FROM (
      SELECT 'unreadable_page' AS reject, '' AS predicate, false AS boxed FROM o WHERE broken
      UNION ALL SELECT '', 'opening_balance', k % 3 <> 1 FROM o WHERE NOT broken
      UNION ALL SELECT 'unknown_predicate', 'mood', true FROM o WHERE NOT broken
      UNION ALL SELECT CASE WHEN k % 4 = 2 THEN 'malformed' ELSE '' END, 'closing_balance', true FROM o WHERE NOT broken
      UNION ALL SELECT '', p, true FROM (SELECT unnest(['posted_on', 'description', 'running_balance', CASE WHEN i % 2 = 0 THEN 'debit' ELSE 'credit' END]) AS p
        FROM (SELECT unnest(generate_series(0, k % 3)) AS i FROM o WHERE NOT broken))
      UNION ALL SELECT CASE WHEN k % 5 = 1 THEN 'unknown_predicate' ELSE '' END, CASE WHEN k % 5 = 1 THEN 'mystery' ELSE 'total_debits' END, true FROM o WHERE NOT broken) GROUP BY 1, 2, 3""")
def src02(spark, d):
    i = I.extraction_items(extraction_pages(spark, d))
    return i.groupBy("reject", "predicate", F.col("bbox").isNotNull().alias("boxed")).agg(F.count(F.lit(1)).alias("items"))


@query("src02_page_types", """
    SELECT CASE WHEN o_orderkey % 7 = 4 THEN 'OTHER' ELSE 'BANK_STATEMENT' END AS doc_type, 'en' AS primary_language, count(*) AS pages FROM orders WHERE o_orderkey % 17 <> 5 GROUP BY 1, 2""")
def src02_types(spark, d):
    p = extraction_pages(spark, d)
    readable = I.extraction_items(p).filter("part = 'page'").select("doc_id", "page")
    return I.page_types(p).join(readable, ["doc_id", "page"], "left_anti").groupBy("doc_type", "primary_language").agg(F.count(F.lit(1)).alias("pages"))


@query("src03_rulebook_dimensions", """
    SELECT value_type, critical, count(*) AS claims FROM (SELECT CASE WHEN predicate IN ('opening_balance', 'closing_balance', 'gross_earnings', 'total_deductions', 'net_pay', 'gross_income', 'taxable_income') THEN 'Money'
      WHEN predicate IN ('period_start', 'period_end') THEN 'Date' WHEN predicate = 'employer' THEN 'OrgName' ELSE '' END AS value_type,
      predicate IN ('opening_balance', 'closing_balance', 'gross_earnings', 'total_deductions', 'net_pay', 'gross_income', 'taxable_income') AS critical FROM claims) GROUP BY 1, 2""", ("claims",))
def src03(spark, d):
    path = K.table_path(spark, "rulebook")
    RB.write_rulebook(spark, path)
    dim = RB.load_rulebook(spark, path)["value_types"]
    c = A.claims(spark, d).join(dim, "predicate", "left")
    return c.groupBy(F.coalesce("type", F.lit("")).alias("value_type"), F.coalesce("critical", F.lit(False)).alias("critical")).agg(
        F.count(F.lit(1)).alias("claims"))


@query("src04_word_source", "SELECT doc_id, count(*) AS words, max(line)::INT AS last_line FROM words GROUP BY 1", ("words",))
def src04(spark, d):
    return A.words(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.max("line").alias("last_line"))


@query("src05_registry_append", "SELECT source AS bank_id, count(*) AS reports FROM documents GROUP BY 1")
def src05(spark, d):
    path = K.table_path(spark, "registry")
    K.append(NQ.reports(spark, d)[0], path, ["bank_id"])
    return spark.read.parquet(path).groupBy("bank_id").agg(F.count(F.lit(1)).alias("reports"))


@query("src05_application_append", "SELECT bank_id, kind, count(*) AS applications, count(DISTINCT case_id) AS cases FROM applications GROUP BY 1, 2", ("applications",))
def src05_applications(spark, d):
    """Linkage rows appended by bank in two loads."""
    path = K.table_path(spark, "applications")
    a = A.applications(spark, d)
    late = F.pmod(F.xxhash64("case_id"), F.lit(2)) == 0
    K.append(a.filter(~late), path, ["bank_id"])
    K.append(a.filter(late), path, ["bank_id"])
    back = spark.read.parquet(path)
    return back.groupBy("bank_id", "kind").agg(F.count(F.lit(1)).alias("applications"), F.countDistinct("case_id").alias("cases"))


@query("src05_labelled_cases", "SELECT lang, is_fraud, count(*) AS cases FROM labelled_cases GROUP BY 1, 2", ("labelled_cases",))
def src05_cases(spark, d):
    """Labelled cases taken in as a stream, batch by batch."""
    c = A.labelled_cases(spark, d)
    folder = ST.run_folder(spark, "labelled")
    ST.drain(arrivals(spark, c, "labelled", (F.col("case_no") % 3).cast("int")), folder, ST.write_batch(folder))
    return ST.read_out(spark, folder).groupBy("lang", "is_fraud").agg(F.count(F.lit(1)).alias("cases"))


cte("pages_read", """
    SELECT key, min(d.doc_id) AS page, bool_or(l.doc_id IS NOT NULL) AS labelled FROM (
      SELECT doc_id, sha256(encode(text) || unhex('00') || encode(lang) || unhex('00') || encode(source) || unhex('00') || encode('1')) AS key FROM documents) d
    LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""")
# the history of the manifest: what each version puts into a tier or removes from it
cte("cache_history", """
    WITH a AS (SELECT 0 AS version, key, 'staging' AS tier, false AS removed, page FROM pages_read WHERE labelled),
    b AS (SELECT 1 AS version, key, 'saved' AS tier, false AS removed, page FROM a WHERE page % 7 <> 2),
    c AS (SELECT 2 AS version, key, 'staging' AS tier, true AS removed, page FROM a),
    e AS (SELECT 3 AS version, key, 'staging' AS tier, false AS removed, page FROM pages_read WHERE page % 2 = 0),
    f AS (SELECT 4 AS version, key, 'staging' AS tier, true AS removed, page FROM e WHERE page % 6 = 0),
    g AS (SELECT 5 AS version, key, 'saved' AS tier, false AS removed, page FROM e WHERE page % 6 <> 0 AND key NOT IN (SELECT key FROM b)),
    h AS (SELECT 6 AS version, key, 'saved' AS tier, true AS removed, page FROM (FROM b UNION ALL FROM g) WHERE page % 10 = 4)
    FROM a UNION ALL FROM b UNION ALL FROM c UNION ALL FROM e UNION ALL FROM f UNION ALL FROM g UNION ALL FROM h""", "pages_read")


def used_cache(spark, d):
    """Reads of the documents' pages through stage, promotion, clearing, discarding and deletion."""
    x = table(spark, d, "documents")
    at = F.concat(F.lit("t"), F.lpad(F.col("doc_id").cast("string"), 12, "0"))
    p = x.select("doc_id", K.content_key(F.encode("text", "UTF-8"), F.col("lang"), F.col("source")).alias("key"), F.col("source").alias("reader"),
                 F.lit("m1").alias("model"), F.col("lang").alias("doc_type"), (F.col("doc_id") % 8).cast("int").alias("page_index"))
    labelled = table(spark, d, "labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    p = p.join(labelled, "doc_id", "left").groupBy("key").agg(
        F.min_by(F.struct(F.col("doc_id").alias("page"), "reader", "model", "doc_type", "page_index"), "doc_id").alias("p"), F.max("labelled").alias("labelled"))
    p = durable(p.select("key", "p.*", "labelled", F.concat(F.lit("t"), F.lpad(F.col("p.page").cast("string"), 12, "0")).alias("cached_at"), F.col("p.page").cast("string").alias("content")))
    cache = ExtractionCache(spark, K.table_path(spark, "cache"))
    cache.stage(p.filter("labelled"))
    cache.promote(p.filter("page % 7 <> 2"))
    cache.clear()
    cache.stage(p.filter("page % 2 = 0"))
    cache.discard(p.filter("page % 6 = 0"))
    cache.promote()
    cache.delete(p.filter("page % 10 = 4"))
    return cache, p


@query("snk02_extraction_cache", """
    SELECT tier, key, page, row_number() OVER (PARTITION BY tier ORDER BY page DESC, key)::INT AS place FROM (
      SELECT tier, key, arg_max(removed, version) AS removed, max(page) AS page FROM cache_history GROUP BY 1, 2) WHERE NOT removed""", ("cache_history",))
def snk02(spark, d):
    cache, _ = used_cache(spark, d)
    tiers = [cache.alive(t).withColumn("tier", F.lit(t)) for t in (STAGING, SAVED)]
    newest = ordered(tiers[0].unionByName(tiers[1]).withColumn("page", F.col("content").cast("bigint")).withColumn("behind", -F.col("page")), ["tier"], ["behind", "key"],
                     sums={"place": F.lit(1).cast("bigint")})
    return newest.select("tier", "key", "page", F.col("place").cast("int").alias("place"))


@query("snk02_cache_history", "SELECT version::BIGINT AS version, tier, removed, count(*) AS entries FROM cache_history GROUP BY ALL", ("cache_history",))
def snk02_history(spark, d):
    return used_cache(spark, d)[0].history().groupBy("version", "tier", "removed").agg(F.count(F.lit(1)).alias("entries"))


@query("snk02_cache_replay", """
    SELECT count(*) AS pages, count(s.key) AS hits, count(*) - count(s.key) AS misses FROM (
      SELECT sha256(encode(text) || unhex('00') || encode(lang) || unhex('00') || encode(source) || unhex('00') || encode('1')) AS key FROM documents) p
    LEFT JOIN (SELECT key FROM (SELECT key, arg_max(removed, version) AS removed FROM cache_history WHERE tier = 'saved' GROUP BY 1) WHERE NOT removed) s USING (key)""", ("cache_history",))
def snk02_replay(spark, d):
    cache, _ = used_cache(spark, d)
    pages = table(spark, d, "documents").select(K.content_key(F.encode("text", "UTF-8"), F.col("lang"), F.col("source")).alias("key"))
    r = cache.replay(pages)
    return r.agg(F.count(F.lit(1)).alias("pages"), F.count("content").alias("hits"), F.count_if(F.col("content").isNull()).alias("misses"))


def band_store(spark, d):
    """The fraud store as a band index, with the session each hash came from; built, then added to."""
    s = A.fraud_store(spark, d).withColumn("session_id", F.concat(F.lit("case-"), (F.col("entry_id") % 50).cast("string")))
    path = K.table_path(spark, "hashes")
    store = BandStore(spark, f"hashes_{path.rsplit('-', 1)[1]}", path)
    store.build(s.filter("entry_id % 4 <> 3"))
    store.add(s.filter("entry_id % 4 = 3"))
    return store


@query("snk03_hash_store", """
    SELECT label, 'case-' || entry_id % 50 AS session_id, count(*) AS hashes, 9 * count(*) AS bands FROM (
      SELECT min(entry_id) AS entry_id, arg_min(label, entry_id) AS label FROM fraud_store GROUP BY w0, w1, w2, w3, w4, w5, w6, w7, entry_id % 4 = 3) GROUP BY ALL""", ("fraud_store",))
def snk03(spark, d):
    rows = band_store(spark, d).stored()
    return rows.groupBy("label", "session_id").agg(F.countDistinct("entry_id").alias("hashes"), F.count(F.lit(1)).alias("bands"))


@query("au04_ledger_read_back", "SELECT seq, count(*) AS records, min(this_hash) AS least FROM chained GROUP BY 1", ("chained",))
def au04(spark, d):
    path = K.table_path(spark, "ledger")
    K.append(DQ.chained(spark, d), path)
    back = spark.read.schema(U.LEDGER).parquet(path)
    return back.groupBy("seq").agg(F.count(F.lit(1)).alias("records"), F.min("this_hash").alias("least"))


# -- mining ----------------------------------------------------------------------------------------------------------
FEATURES = ["n_chars", "toxic", "lang", "source"]


@query("mi01_midpoints", """
    WITH u AS (SELECT DISTINCT 'n_chars' AS feature, n_chars AS v FROM labelled_cases UNION SELECT DISTINCT 'toxic', toxic FROM labelled_cases),
    m AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY v) - 2 AS i, (v + lag(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS mid FROM u),
    n AS (SELECT feature, count(*) AS n FROM m WHERE mid IS NOT NULL GROUP BY 1)
    SELECT feature, i::BIGINT AS i, mid FROM m JOIN n USING (feature) WHERE mid IS NOT NULL AND (n <= 12 OR i IN (SELECT floor(j * (n / 12.0::DOUBLE))::BIGINT FROM generate_series(0, 11) t(j)))""", ("labelled_cases",))
def mi01(spark, d):
    return MI.midpoints(A.labelled_cases(spark, d), ["n_chars", "toxic"])


@query("mi02_rule_metrics", """
    SELECT source, lang, count(*) AS n_match, count_if(is_fraud)::BIGINT AS n_fraud, round(count_if(is_fraud) / (SELECT count_if(is_fraud) FROM labelled_cases), 6) AS support, round(count_if(is_fraud) / count(*), 6) AS confidence
    FROM labelled_cases GROUP BY 1, 2""", ("labelled_cases",))
def mi02(spark, d):
    return MI.rule_metrics(A.labelled_cases(spark, d), ["source", "lang"], "is_fraud")


def mined(spark, d):
    return MI.mine(durable(A.labelled_cases(spark, d)), FEATURES, min_support=0.02, min_confidence=0.5)


def _grown(of: str, parts: int) -> str:
    """The atom that each open rule of ``of`` takes next: the highest confidence above its own, at support 0.02."""
    held = " ".join(f"JOIN met m{k} ON m{k}.id = m.id AND m{k}.place = r.taken[{k}]" for k in range(1, parts + 1))
    return f"""SELECT * FROM (
      SELECT seed, place, feature, f / n AS conf, f / fraud AS sup, (f / n) / (fraud / total) AS lift, now FROM (
        SELECT r.seed, r.conf AS now, m.place, m.feature, count(*) AS n, count_if(m.is_fraud) AS f FROM met m JOIN {of} r ON r.open AND NOT list_contains(r.used, m.feature) {held} GROUP BY ALL), tot)
      WHERE conf > now AND sup >= 0.02 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY conf DESC, place) = 1"""


def _next(of: str, step: str) -> str:
    return (f"SELECT seed, CASE WHEN g.place IS NULL THEN taken ELSE list_append(taken, g.place) END AS taken, CASE WHEN g.place IS NULL THEN used ELSE list_append(used, g.feature) END AS used, "
            f"coalesce(g.conf, r.conf) AS conf, coalesce(g.sup, r.sup) AS sup, coalesce(g.lift, r.lift) AS lift, g.place IS NOT NULL AS open FROM {of} r LEFT JOIN {step} g USING (seed)")


cte("mined_rules", f"""
    WITH v AS (SELECT DISTINCT 'n_chars' AS feature, n_chars AS v FROM labelled_cases UNION SELECT DISTINCT 'toxic', toxic FROM labelled_cases),
    mp AS (SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY v) - 2 AS i, (v + lag(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS mid FROM v),
    nm AS (SELECT feature, count(*) AS n FROM mp WHERE mid IS NOT NULL GROUP BY 1),
    thin AS (SELECT feature, mid FROM mp JOIN nm USING (feature) WHERE mid IS NOT NULL AND (n <= 12 OR i IN (SELECT floor(j * (n / 12.0::DOUBLE))::BIGINT FROM generate_series(0, 11) t(j)))),
    a AS (SELECT feature, op, mid AS bound, mid::VARCHAR AS text FROM thin, (SELECT unnest(['ge', 'lt']) AS op)
      UNION ALL SELECT DISTINCT 'lang', 'eq', NULL, lang FROM labelled_cases UNION ALL SELECT DISTINCT 'source', 'eq', NULL, source FROM labelled_cases),
    c AS (SELECT *, row_number() OVER () AS id FROM labelled_cases), tot AS (SELECT count(*) AS total, count_if(is_fraud) AS fraud FROM c),
    h AS (SELECT id, is_fraud, a.* FROM c JOIN a ON CASE op WHEN 'eq' THEN CASE feature WHEN 'lang' THEN lang ELSE source END = text
      WHEN 'ge' THEN CASE feature WHEN 'n_chars' THEN n_chars ELSE toxic END >= bound ELSE CASE feature WHEN 'n_chars' THEN n_chars ELSE toxic END < bound END),
    u AS (SELECT *, row_number() OVER (ORDER BY lift DESC, conf DESC, feature, op, text) AS place FROM (
      SELECT feature, op, text, f / n AS conf, f / fraud AS sup, (f / n) / (fraud / total) AS lift FROM (SELECT feature, op, text, count(*) AS n, count_if(is_fraud) AS f FROM h GROUP BY 1, 2, 3), tot) WHERE lift > 1),
    met AS (SELECT id, is_fraud, place, feature FROM h JOIN u USING (feature, op, text)),
    r1 AS (SELECT place AS seed, [place] AS taken, [feature] AS used, conf, sup, lift, true AS open FROM u),
    g2 AS ({_grown('r1', 1)}), r2 AS ({_next('r1', 'g2')}), g3 AS ({_grown('r2', 2)}), r3 AS ({_next('r2', 'g3')}),
    s AS (SELECT list_sort(taken) AS taken, min(seed) AS seed, max(conf) AS conf, max(sup) AS sup, max(lift) AS lift FROM r3 WHERE sup >= 0.02 AND conf >= 0.5 GROUP BY 1),
    b AS (SELECT *, row_number() OVER (ORDER BY conf DESC, sup DESC, lift DESC, seed) AS rank FROM s QUALIFY rank <= 10)
    SELECT printf('R-%03d', rank) AS rule_id, (SELECT string_agg(feature || ' ' || op || ' ' || text, ' AND ' ORDER BY feature, op, text) FROM u WHERE list_contains(b.taken, u.place)) AS predicates,
      round(conf, 3) AS confidence, round(sup, 3) AS support, round(lift, 3) AS lift, round(least(0.9::DOUBLE, conf), 2) AS suspicion, conf, sup, rank FROM b""", "labelled_cases")


@query("mi03_mined_rules", "SELECT rule_id, predicates, confidence, support, lift, suspicion FROM mined_rules", ("mined_rules",))
def mi03(spark, d):
    return MI.rules_frame(mined(spark, d))


@query("or01_top_rules", "SELECT rule_id, predicates, confidence, support, lift, suspicion FROM mined_rules QUALIFY row_number() OVER (ORDER BY confidence DESC, support DESC, lift DESC, rule_id) <= 5", ("mined_rules",))
def or01(spark, d):
    return MI.rules_frame(mined(spark, d)).orderBy(F.desc("confidence"), F.desc("support"), F.desc("lift"), "rule_id").limit(5)


@query("mi04_predicate_evaluation", """
    SELECT case_no, n_chars >= 1000 AS ge, n_chars < 500 AS lt, lang IN ('en', 'fr') AS isin, source <> 'src1' AS ne FROM labelled_cases""", ("labelled_cases",))
def mi04(spark, d):
    c = A.labelled_cases(spark, d)
    return c.select("case_no", MI.predicate(("n_chars", "ge", 1000)).alias("ge"), MI.predicate(("n_chars", "lt", 500)).alias("lt"),
                    MI.predicate(("lang", "in", ["en", "fr"])).alias("isin"), MI.predicate(("source", "ne", "src1")).alias("ne"))


@query("mi05_rule_lifecycle", """
    SELECT 'R' || s AS rule_id, coalesce(CASE event_type WHEN 'purchase' THEN 'APPROVED' WHEN 'error' THEN 'REJECTED' ELSE 'CANDIDATE' END, 'CANDIDATE') AS status, CASE WHEN event_type IS NULL THEN '' ELSE 'analyst' END AS decided_by FROM (SELECT DISTINCT s_suppkey AS s FROM supplier) LEFT JOIN (
      SELECT user_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY 1) ON s = user_id
    UNION ALL SELECT DISTINCT 'R' || user_id, 'UNKNOWN_RULE', '' FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)""")
def mi05(spark, d):
    rules = table(spark, d, "supplier").select(F.concat(F.lit("R"), F.col("s_suppkey").cast("string")).alias("rule_id"))
    e = table(spark, d, "events")
    st = F.when(F.col("event_type") == "purchase", "APPROVED").when(F.col("event_type") == "error", "REJECTED").otherwise("CANDIDATE")
    dec = e.select(F.concat(F.lit("R"), F.col("user_id").cast("string")).alias("rule_id"), st.alias("status"), F.lit("analyst").alias("decided_by"), "ts")
    known, unknown = MI.current_rules(rules, dec)
    return known.select("rule_id", "status", F.coalesce("decided_by", F.lit("")).alias("decided_by")).unionByName(
        unknown.select("rule_id", F.lit("UNKNOWN_RULE").alias("status"), F.lit("").alias("decided_by")).distinct())


@query("mi06_promoted_rules", """
    SELECT case_no, CASE WHEN n_chars < 800 AND lang = 'en' THEN 0.9 WHEN toxic = 1 THEN 0.7 WHEN source = 'src3' THEN 0.6 ELSE 0.0 END::DOUBLE AS suspicion,
      CASE WHEN n_chars < 800 AND lang = 'en' THEN 'A' WHEN toxic = 1 THEN 'B' WHEN source = 'src3' THEN 'C' ELSE '' END AS rule_id,
      (CASE WHEN n_chars < 800 AND lang = 'en' THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END + CASE WHEN source = 'src3' THEN 1 ELSE 0 END)::INT AS fired FROM labelled_cases""", ("labelled_cases",))
def mi06(spark, d):
    rules = [{"rule_id": "A", "suspicion": 0.9, "predicates": [("n_chars", "lt", 800), ("lang", "eq", "en")]},
             {"rule_id": "B", "suspicion": 0.7, "predicates": [("toxic", "eq", 1)]},
             {"rule_id": "C", "suspicion": 0.6, "predicates": [("source", "eq", "src3")]}]
    return MI.score(A.labelled_cases(spark, d), rules, ["case_no"]).select("case_no", "suspicion", "rule_id", "fired")


# -- evaluation ------------------------------------------------------------------------------------------------------
def tampered():
    return F.col("doc_id") % 3 == 0


@query("ev01_discrimination_report", """
    SELECT v.doc_id::VARCHAR AS file, CASE WHEN v.doc_id % 3 = 0 THEN 'tampered' ELSE 'genuine' END AS category, v.doc_id % 3 <> 0 AS is_genuine, verdict, score, key_signal FROM verdicts v JOIN (
      SELECT doc_id, coalesce(arg_min(name, (ord, name)) FILTER (status = 'VALID' AND suspicion > 0.3), 'error:' || (arg_min(name, (ord, name)) FILTER (status = 'ERROR')), 'none') AS key_signal FROM signals GROUP BY 1) USING (doc_id)""", ("verdicts", "signals"))
def ev01(spark, d):
    s = A.signals(spark, d)
    r = V.verdicts(s, ["doc_id"]).join(E.key_signal(s, ["doc_id"]), "doc_id").select(
        F.col("doc_id").cast("string").alias("file"), F.when(tampered(), "tampered").otherwise("genuine").alias("category"),
        (~tampered()).alias("is_genuine"), "verdict", "score", "key_signal")
    path = K.table_path(spark, "results")
    K.write_results(r, path)
    return I.results(spark, path).orderBy("category", "file")


@query("src06_json_results", "SELECT verdict, count(*) AS documents, round(min(score), 2) AS lowest FROM verdicts GROUP BY 1", ("verdicts",))
def src06(spark, d):
    path = K.table_path(spark, "results")
    K.write_results(V.verdicts(A.signals(spark, d), ["doc_id"]).select(F.col("doc_id").cast("string").alias("file"), "verdict", "score"), path)
    return I.results(spark, path).groupBy("verdict").agg(F.count(F.lit(1)).alias("documents"), F.round(F.min("score"), 2).alias("lowest"))


_RATES = """round(coalesce(tp / nullif(tp + fn, 0), -1), 6) AS recall, round(coalesce(tp / nullif(tp + fp, 0), -1), 6) AS precision, round(coalesce(fp / nullif(fp + tn, 0), -1), 6) AS false_positive_rate, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), -1), 6) AS f1"""


@query("ev02_detection_metrics", f"""
    SELECT coalesce(name, '(all)') AS name, tp, fp, fn, tn, {_RATES} FROM (SELECT name, count_if(t AND f)::BIGINT AS tp, count_if(NOT t AND f)::BIGINT AS fp, count_if(t AND NOT f)::BIGINT AS fn, count_if(NOT t AND NOT f)::BIGINT AS tn
      FROM (SELECT name, doc_id % 3 = 0 AS t, coalesce(suspicion > 0.1, false) AS f FROM signals) GROUP BY CUBE (name))""", ("signals",))
def ev02(spark, d):
    s = A.signals(spark, d).select("name", tampered().alias("tampered"), F.coalesce(F.col("suspicion") > 0.1, F.lit(False)).alias("flagged"))
    return E.detection_metrics(s, "name")


@query("ev03_fail_closed_rate", """
    SELECT count(*) AS failures, round(avg(CASE WHEN verdict <> 'APPROVED' THEN 1.0 ELSE 0.0 END), 6) AS not_approved FROM verdicts WHERE doc_id IN (SELECT doc_id FROM signals WHERE status = 'ERROR')""", ("verdicts", "signals"))
def ev03(spark, d):
    s = A.signals(spark, d)
    broken = s.filter(F.col("status") == "ERROR").select("doc_id")
    return E.fail_closed_rate(V.verdicts(s, ["doc_id"]).join(broken, "doc_id", "left_semi"))


@query("ev04_latency_by_tier", """
    SELECT event_type AS tier, count(*) AS runs, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def ev04(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("value").alias("latency_ms"))
    return E.exact_latency(r)


@query("ev04_latency_quantiles")
def ev04_quantiles(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("tier"), F.col("value").alias("latency_ms"))
    return E.latency_by_tier(r)


@query("ev05_corpus_mutation", """
    SELECT k, kind AS mutation, mutated::BIGINT AS mutated, CASE WHEN n >= 2 THEN substr(c, 1, a - 1) || substr(c, a + 1, 1) || substr(c, a, 1) || substr(c, a + 2) ELSE c END AS swapped, regexp_replace(c, '[0-9]$', (k % 10)::VARCHAR) AS redigited FROM (
      SELECT k, ['x1.1', 'x1.5', 'zero', 'plus_0.99'][k % 4 + 1] AS kind, CASE k % 4 WHEN 0 THEN p * 11 // 10 WHEN 1 THEN p * 3 // 2 WHEN 2 THEN 0 ELSE p + 99 END AS mutated, c, length(c) AS n, (k % greatest(length(c) - 1, 1) + 1)::INT AS a FROM (
        SELECT o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_orderpriority || '-' || o_custkey AS c FROM orders))""")
def ev05(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), paise("o_totalprice").alias("p"),
                                         F.concat_ws("-", "o_orderpriority", F.col("o_custkey").cast("string")).alias("c"))
    return E.mutate_text(E.mutate_amounts(o, "k", "p"), "k", "c").select("k", "mutation", "mutated", "swapped", "redigited")


@query("ev06_constant_return_guard", """
    SELECT name, count(*) AS pairs, count_if(g IS DISTINCT FROM t)::BIGINT AS told_apart, count_if(g IS DISTINCT FROM t) = 0 AS constant FROM (
      SELECT name, CASE WHEN name = 'signature' THEN 0.0 ELSE coalesce(suspicion, -1) END AS g, CASE WHEN name = 'signature' THEN 0.0 ELSE coalesce(suspicion, -1) + CASE WHEN doc_id % 2 = 0 THEN 0.1 ELSE 0 END END AS t FROM signals) GROUP BY 1""", ("signals",))
def ev06(spark, d):
    s = F.coalesce("suspicion", F.lit(-1.0))
    sig = F.col("name") == "signature"
    p = A.signals(spark, d).select("name", F.when(sig, 0.0).otherwise(s).alias("genuine"),
                                   F.when(sig, 0.0).otherwise(s + F.when(F.col("doc_id") % 2 == 0, 0.1).otherwise(0.0)).alias("tampered"))
    return E.constant_detectors(p)


@query("ev07_identity_matrix", """
    SELECT bundle_id, field, status, max(value) FILTER (doc_label = 'statement') AS statement, max(value) FILTER (doc_label = 'payslip') AS payslip, max(value) FILTER (doc_label = 'pan_card') AS pan_card, max(value) FILTER (doc_label = 'aadhaar_card') AS aadhaar_card FROM (
      SELECT bundle_id, doc_label, field, value FROM (SELECT bundle_id, doc_label, pan, aadhaar, ifsc, account_number, name, dob FROM entities) UNPIVOT (value FOR field IN (pan, aadhaar, ifsc, account_number, name, dob))) JOIN identity_cmp USING (bundle_id, field) GROUP BY 1, 2, 3""", ("entities", "identity_cmp"))
def ev07(spark, d):
    v = CO.identity_values(A.entities(spark, d), ["bundle_id"])
    labels = ["statement", "payslip", "pan_card", "aadhaar_card"]
    m = E.identity_matrix(v, CO.identity_comparison(v, ["bundle_id"]), "bundle_id", labels)
    return m.filter(F.col("status").isNotNull()).select("bundle_id", "field", "status", *labels)


@query("ev08_pack_rollup", """
    SELECT coalesce(domain, '(total)') AS domain, coalesce(rule_id, '(all)') AS rule_id, count(*) AS rules, count_if(status = 'FAIL')::BIGINT AS failed FROM (SELECT 'financial' AS domain, rule_id, status FROM financial) GROUP BY ROLLUP (domain, rule_id)""", ("financial",))
def ev08(spark, d):
    r = R.evaluate_financial(A.claims(spark, d), A.ledger_keys(spark, d)).join(F.broadcast(R.severity(spark)), "rule_id")
    return E.pack_rollup(r).select(F.coalesce("domain", F.lit("(total)")).alias("domain"), F.coalesce("rule_id", F.lit("(all)")).alias("rule_id"), "rules", "failed")


# -- streams ---------------------------------------------------------------------------------------------------------
def arrivals(spark, df, name, part, parts=3, files=4, by=None):
    """``df`` as a file stream in which the rows of part 0 arrive first, then those of part 1, and so on; a micro-batch
    takes as many files as a part has. ``by``: a column whose rows of one part stay in one file."""
    path = K.table_path(spark, name)
    rows = durable(df.withColumn("_part", part))
    for k in range(parts):
        own = rows.filter(F.col("_part") == k).drop("_part")
        (own.repartition(files, by) if by else own.repartition(files)).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def slices(df, number, parts=3):
    """Which of ``parts`` equal spans of ``number`` a row lies in."""
    low, high = df.agg(F.min(number), F.max(number)).first()
    return F.lit(0) if low is None else F.floor((number - low) * parts / (high - low + 1)).cast("int")


@query("st01_live_balance", """
    SELECT doc_id, idx::INT AS idx, expected::BIGINT AS expected_p, balance_p AS printed_p, unread::INT AS unread FROM (
      SELECT *, coalesce(la[1], opening_p) + cum - coalesce(la[2], 0) AS expected, pos - 1 - coalesce(la[3], 0) AS unread FROM (
        SELECT *, last_value(CASE WHEN balance_p IS NOT NULL THEN [balance_p, cum, pos] END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS la FROM (
          SELECT *, (sum(coalesce(credit_p, 0) - coalesce(debit_p, 0)) OVER (PARTITION BY doc_id ORDER BY idx))::BIGINT AS cum, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS pos FROM ledger)))
    WHERE abs(expected - balance_p) > 100""", ("ledger",))
def st01(spark, d):
    k = F.col("okey")
    day = F.when(k % 101 == 7, F.date_add("posted", 40)).otherwise(F.col("posted"))
    led = A.ledger(spark, d).select("doc_id", "idx", day.cast("timestamp").alias("at"), "opening_p", "credit_p", "debit_p", "balance_p", "okey")
    # rows arrive up to 59 days late, in three parts, and a mark at the end moves the watermark behind all of them
    came = F.unix_seconds("at") + k * 37 % 60 * 86400
    led = durable(led.withColumn("came", came))
    end = spark.sql("SELECT '' AS doc_id, 0 AS idx, timestamp '2999-01-01' AS at, 0L AS opening_p, 0L AS credit_p, 0L AS debit_p, 0L AS balance_p")
    rows = led.select("doc_id", "idx", "at", "opening_p", "credit_p", "debit_p", "balance_p", slices(led, F.col("came")).alias("part")).unionByName(end.withColumn("part", F.lit(3)))
    folder = ST.run_folder(spark, "balance")
    stream = arrivals(spark, rows, "ledger", F.col("part"), parts=4).drop("part")
    ST.balance_tables(stream, folder, "60 days", forget_ms=36500 * 86400 * 1000)
    return ST.read_out(spark, folder, "breaks").select("doc_id", "idx", "expected_p", "printed_p", "unread")


@query("st02_live_resubmission", f"""
    SELECT query_id, m.entry_id AS entry_id, 'case-' || m.entry_id % 50 AS session_id, m.d::INT AS distance FROM (SELECT query_id, arg_min(struct_pack(entry_id, d), d * 100000000 + entry_id) AS m FROM (
      SELECT query_id, entry_id, {NQ._DIST} AS d FROM query_hashes q, fraud_store s) WHERE d <= 8 GROUP BY 1)""", ("query_hashes", "fraud_store"))
def st02(spark, d):
    folder = ST.run_folder(spark, "resubmission")
    q = A.query_hashes(spark, d)
    ST.resubmissions(arrivals(spark, q, "queries", (F.col("query_id") % 3).cast("int")), band_store(spark, d), folder)
    return ST.read_out(spark, folder).select("query_id", "entry_id", "session_id", "distance")


def event_stream(spark, d, jitter, parts=3):
    """The events in several arrivals, each up to ``jitter`` seconds late, and a mark at the end."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    came = F.unix_seconds("ts") + F.col("event_id") * 7919 % jitter
    e = durable(e.withColumn("came", came))
    end = e.limit(0).drop("came").unionByName(spark.sql("SELECT 0L AS event_id, 0L AS user_id, 'end' AS event_type, timestamp '2999-01-01' AS ts").select(
        *[F.col(c).cast(t) for c, t in e.drop("came").dtypes]))
    rows = e.withColumn("part", slices(e, F.col("came"), parts)).drop("came").unionByName(end.withColumn("part", F.lit(parts)))
    return arrivals(spark, rows, "events", F.col("part"), parts=parts + 1).drop("part")


@query("st03_idle_sessions", """
    SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, sid, count(*) AS n FROM (
      SELECT user_id, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 300 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM (
        SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)) GROUP BY 1, 2) GROUP BY 1""")
def st03(spark, d):
    folder = ST.run_folder(spark, "sessions")
    ST.drain(ST.sessions(event_stream(spark, d, 599), "user_id"), folder, ST.write_batch(folder))
    s = ST.read_out(spark, folder)
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("events").alias("longest"))


@query("st04_case_accrual_stream", "SELECT bundle_id, suspicion, hard_reject FROM identity_sig", ("identity_sig",))
def st04(spark, d):
    v = CO.identity_values(A.entities(spark, d), ["bundle_id"])
    folder = ST.run_folder(spark, "cases")
    ST.case_accrual(arrivals(spark, v, "values", (F.col("ord") % 3).cast("int")), folder, "bundle_id")
    return ST.latest(ST.read_out(spark, folder), "bundle_id").select("bundle_id", "suspicion", "hard_reject")


@query("st05_audit_stream", "SELECT chain_id, seq, this_hash FROM chained", ("chained",))
def st05(spark, d):
    folder = ST.run_folder(spark, "audit")
    e = durable(A.audit_events(spark, d))
    at = F.unix_micros(F.to_timestamp("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    ST.audit_append(arrivals(spark, e, "events", slices(e, at), by="chain_id"), folder, ["timestamp", "event_id"])
    return ST.read_out(spark, folder).select("chain_id", "seq", "this_hash")


@query("st06_registry_upsert", f"""
    SELECT entry_id, seen_count, banks, 'L' || entry_id AS label, 'forged' AS threat_class, tokens, least_token FROM entries JOIN (
      SELECT entry_key, count(*) AS tokens, min({NQ.token_sql('v')}) AS least_token FROM entry_tokens GROUP BY 1) USING (entry_key)""", ("entries", "entry_tokens"))
def st06(spark, d):
    folder = ST.run_folder(spark, "registry")
    r, t = NQ.reports(spark, d)
    r = r.join(t.groupBy("report_id").agg(F.collect_list(F.struct("kind", "token")).alias("tokens")), "report_id")
    ST.registry_upsert(arrivals(spark, r, "reports", (F.col("report_id") % 3).cast("int")), folder)
    tokens = ST.registry_tokens(ST.read_out(spark, folder, "tokens")).groupBy("entry_key").agg(
        F.count(F.lit(1)).alias("tokens"), F.min("token").alias("least_token"))
    return ST.registry_state(ST.read_out(spark, folder)).join(tokens, "entry_key").select(
        "entry_id", "seen_count", "banks", "label", "threat_class", "tokens", "least_token")


@query("st07_activity_profile", """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS started, event_type, count(*) AS events FROM (SELECT event_type, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS w FROM events, generate_series(0, 3) t(i)) GROUP BY 1, 2""")
def st07(spark, d):
    folder = ST.run_folder(spark, "activity")
    ST.drain(ST.activity(event_stream(spark, d, 3599), "event_type"), folder, ST.write_batch(folder))
    return ST.read_out(spark, folder).select(F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "event_type", "events")


def user_series(spark, d):
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", F.col("value").alias("v"))
    return durable(S.positions(e, "user_id", ["at", "event_id"]).select("user_id", "pos", "v"))


cte("series", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS v FROM events")


@query("st08_loop_detection", """
    WITH m AS (SELECT user_id, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM series GROUP BY 1), c AS (SELECT user_id, pos, v - mean AS x FROM series JOIN m USING (user_id)),
    p AS (SELECT user_id, sum(x * x) AS xx FROM c GROUP BY 1), l AS (SELECT a.user_id, b.pos - a.pos AS lag, sum(a.x * b.x) AS xy FROM c a JOIN c b ON a.user_id = b.user_id AND b.pos - a.pos >= 2 GROUP BY 1, 2),
    k AS (SELECT user_id, greatest(0, max(xy / (xx + 1e-12))) AS peak FROM l JOIN p USING (user_id) GROUP BY 1)
    SELECT user_id, n, CASE WHEN n < 4 THEN 'NOT_EVALUATED' ELSE 'VALID' END AS status, round(CASE WHEN n < 4 THEN -1.0 WHEN var < 1 THEN 1.0 ELSE least(1.0, greatest(CASE WHEN coalesce(peak, 0) >= 0.6 THEN least(1.0, peak) ELSE 0 END, CASE WHEN var < 8 THEN 0.5 * (1 - (var - 1) / 7.0) ELSE 0 END)) END, 6)::DOUBLE AS suspicion
    FROM m LEFT JOIN k USING (user_id)""", ("series",))
def st08(spark, d):
    return S.loop_suspicion(user_series(spark, d), "user_id")


@query("st09_jerk_variability", """
    SELECT user_id, count(*) AS n, round(CASE WHEN count(*) < 4 THEN 0.0 ELSE stddev_pop(abs(j)) / (avg(abs(s)) + 1e-9) END, 6)::DOUBLE AS jerk FROM (
      SELECT user_id, v - lag(v) OVER w AS s, v - 3 * lag(v) OVER w + 3 * lag(v, 2) OVER w - lag(v, 3) OVER w AS j FROM series WINDOW w AS (PARTITION BY user_id ORDER BY pos)) GROUP BY 1""", ("series",))
def st09(spark, d):
    return S.jerk_variability(user_series(spark, d), "user_id")


# -- extension -------------------------------------------------------------------------------------------------------
@X.detector("late_night")
def late_night(tables):
    """Example of a user's detector: share of a document's events in the small hours."""
    e = tables["events"]
    night = F.avg((F.hour("ts") < 5).cast("double"))
    g = e.groupBy(F.col("user_id").alias("doc_id")).agg(F.round(night, 6).alias("share"), F.count(F.lit(1)).alias("n"))
    few = F.col("n") < 3
    s = F.when(few, None).otherwise(F.when(F.col("doc_id") % 10 == 7, F.lit(2.0)).otherwise(F.col("share")))
    return g.select("doc_id", F.when(few, "NOT_EVALUATED").otherwise("VALID").alias("status"), s.alias("suspicion"), F.lit(0.1).alias("weight"))


@query("ud01_user_signal", """
    SELECT user_id AS doc_id, 'late_night' AS name, 'VALID' AS status, round(avg(CASE WHEN hour(ts) < 5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS suspicion, 0.1::DOUBLE AS weight FROM events GROUP BY 1 HAVING user_id % 10 <> 7 AND count(*) >= 3""")
def ud01(spark, d):
    good, _ = X.run_detector("late_night", {"events": table(spark, d, "events")})
    return good.filter(F.col("status") == "VALID")

