"""Queries over joins, the consortium registry and rings (inventory JN, FE, NJ-12, DE-09, SE)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.functions.hashing import entity_token
from docassay.operators import corroborate as CO
from docassay.operators import match as M
from docassay.operators import network as G
from docassay.operators import spatial as P
from docassay.plans.oracle_inputs import _words, cte
from docassay.plans.registry import query
from docassay.session import by_key, durable
from docassay.sources import adapters as A
from docassay.sources import adapters_legal as L
from docassay.sources.tables import paise, table

PEPPER = "test-pepper"
_K = PEPPER.encode().ljust(64, b"\0")
_IN, _OUT = bytes(b ^ 0x36 for b in _K).hex(), bytes(b ^ 0x5C for b in _K).hex()
_DIST = " + ".join(f"bit_count(xor(q.w{i}, s.w{i}))::INT" for i in range(8))


def token_sql(msg: str) -> str:
    return f"sha256(unhex('{_OUT}') || unhex(sha256(unhex('{_IN}') || encode({msg}))))"


# -- text layer cross-read --------------------------------------------------------------------------------------------
def layer(spark, d):
    """Order prices as words of a page, and a claim per price: at its cell, elsewhere, edited or without a box."""
    o = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("doc_id"), F.expr("cast(o_orderkey % 4 as int)").alias("page"),
        paise("o_totalprice").alias("p"))
    k = F.col("claim_id")
    x, y = (k % 17) / 20.0, F.expr("claim_id div 17 % 47") / 50.0
    word = o.select("doc_id", "page", x.alias("x"), y.alias("y"), F.lit(0.03).alias("w"), F.lit(0.01).alias("h"),
                    F.format_number(F.col("p") / 100, 2).alias("text"))
    val = F.when(k % 10 == 3, F.col("p") + 12300).otherwise(F.col("p"))
    has = k % 9 != 4
    moved = F.when(k % 8 == 5, 0.9).otherwise(x)
    claims = o.select(
        "claim_id", "doc_id", "page", (val.cast("decimal(20,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,2)").alias("claimed"),
        F.when(has, moved).alias("x"), F.when(has, y).alias("y"), F.when(has, F.lit(0.03)).alias("w"), F.when(has, F.lit(0.01)).alias("h"))
    return claims, word


@query("jn01_text_layer_cross_read", """
    WITH o AS (SELECT o_orderkey AS k, o_custkey AS doc, o_orderkey % 4 AS page, CAST(round(o_totalprice * 100) AS BIGINT) AS p, o_orderkey % 17 / 20.0 AS x, o_orderkey // 17 % 47 / 50.0 AS y FROM orders),
    c AS (SELECT *, p + CASE WHEN k % 10 = 3 THEN 12300 ELSE 0 END AS v, CASE WHEN k % 8 = 5 THEN 0.9 ELSE x END AS bx FROM o),
    j AS (SELECT c.k, count(*) FILTER (inside) AS cell, coalesce(bool_or(near) FILTER (inside), false) AS cok, bool_or(near) AS pok FROM (
      SELECT c.k, w.x + 0.015 BETWEEN c.bx - 0.02 AND c.bx + 0.05 AND w.y + 0.005 BETWEEN c.y - 0.02 AND c.y + 0.03 AS inside, abs(w.p - c.v) <= 100 AS near FROM c JOIN o w ON c.doc = w.doc AND c.page = w.page) c GROUP BY 1)
    SELECT k AS claim_id, CASE WHEN k % 9 = 4 THEN 'ungrounded' WHEN cok THEN 'confirmed_cell' WHEN cell > 0 THEN 'other_figure' WHEN pok THEN 'confirmed_page' ELSE 'not_printed' END AS outcome FROM j""")
def jn01(spark, d):
    return P.text_layer_cross_read(*layer(spark, d)).select("claim_id", "outcome")


@query("jn02_reader_consensus", """
    SELECT doc_id, page, matching::BIGINT AS matching, contradicting::BIGINT AS contradicting, matching >= 1 AND contradicting = 0 AS agree FROM (
      SELECT event_id // 5 AS doc_id, 0 AS page, count_if(event_type <> 'error' AND value % 10 <= 9.2) AS matching, count_if(event_type <> 'error' AND value % 10 > 9.2) AS contradicting FROM events GROUP BY 1)""")
def jn02(spark, d):
    e = table(spark, d, "events")
    r = e.select(F.expr("event_id div 5").alias("doc_id"), F.lit(0).alias("page"), F.lit(0.0).alias("claimed"),
                 F.when(F.col("event_type") != "error", F.when(F.col("value") % 10 <= 9.2, 0.5).otherwise(7.0)).alias("read"))
    return P.reader_consensus(r, ["doc_id", "page"])


@query("jn03_near_duplicate_hash", f"""
    SELECT query_id, m.entry_id AS entry_id, m.d::INT AS distance FROM (SELECT query_id, arg_min(struct_pack(entry_id, d), d * 100000000 + entry_id) AS m FROM (
      SELECT query_id, entry_id, {_DIST} AS d FROM query_hashes q, fraud_store s) WHERE d <= 8 GROUP BY 1)""", ("query_hashes", "fraud_store"))
def jn03(spark, d):
    return M.nearest_hash(A.query_hashes(spark, d), A.fraud_store(spark, d)).select("query_id", "entry_id", "distance")


@query("de09_resubmission", f"""
    SELECT query_id, coalesce(d, -1)::INT AS distance, CASE WHEN d IS NULL THEN 0.0 ELSE round(0.8 + 0.2 * (1 - d / 8.0), 6) END::DOUBLE AS suspicion FROM query_hashes LEFT JOIN (
      SELECT query_id, min(d) AS d FROM (SELECT query_id, {_DIST} AS d FROM query_hashes q, fraud_store s) WHERE d <= 8 GROUP BY 1) USING (query_id)""", ("query_hashes", "fraud_store"))
def de09(spark, d):
    q = A.query_hashes(spark, d)
    return M.resubmission_signal(q, M.nearest_hash(q, A.fraud_store(spark, d)))


# -- registry --------------------------------------------------------------------------------------------------------
def reports(spark, d):
    x = table(spark, d, "documents").select("doc_id", "source")
    h = F.sha2(F.expr("cast(doc_id div 3 as string)").cast("binary"), 256)
    r = x.select(F.col("doc_id").alias("report_id"), F.concat(F.lit("L"), F.col("doc_id").cast("string")).alias("label"),
                 F.lit("forged").alias("threat_class"), F.col("source").alias("bank_id"),
                 F.when(F.col("doc_id") % 10 != 7, h).alias("hash_hex"))
    k = F.col("doc_id")
    t = x.select(k.alias("report_id"), F.explode(F.array(
        F.struct(F.lit("pan").alias("kind"), F.concat(F.lit("p"), F.expr("doc_id div 4").cast("string")).alias("v")),
        F.struct(F.lit("account").alias("kind"), F.concat(F.lit("00-"), k.cast("string")).alias("v")))).alias("t")).select(
        "report_id", "t.kind", entity_token(F.col("t.kind"), F.col("t.v"), PEPPER).alias("token"))
    return r, t


def asks(spark, d):
    q = table(spark, d, "labels").select("doc_id", "quality", "toxic")
    k = F.col("doc_id")
    base = F.sha2(F.expr("cast(doc_id div 3 as string)").cast("binary"), 256)
    h = A._mask_hex(base, 25, F.col("quality") * 3 + F.col("toxic"))
    t = q.select(k.alias("query_id"), F.lit("pan").alias("kind"), F.concat(F.lit("P"), (k * 2).cast("string")).alias("v"))
    return (q.select(k.alias("query_id"), F.when(k % 6 != 5, h).alias("hash_hex")),
            t.select("query_id", entity_token(F.col("kind"), F.col("v"), PEPPER).alias("token")))


cte("entries", """
    SELECT CASE WHEN doc_id % 10 = 7 THEN 'r' || doc_id ELSE sha256((doc_id // 3)::VARCHAR) END AS entry_key, min(doc_id) AS entry_id, count(*) AS seen_count,
      count(DISTINCT source) AS banks, bool_and(doc_id % 10 <> 7) AS hashed FROM documents GROUP BY 1""")
cte("entry_tokens", """
    SELECT entry_key, kind, arg_max(v, doc_id) AS v FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'r' || doc_id ELSE sha256((doc_id // 3)::VARCHAR) END AS entry_key,
      unnest(['pan', 'account']) AS kind, unnest(['pan:P' || (doc_id // 4), 'account:00' || doc_id]) AS v FROM documents) GROUP BY 1, 2""")
cte("registry_matches", f"""
    WITH q AS (SELECT doc_id AS query_id, 'pan:P' || (doc_id * 2) AS tok, doc_id % 6 <> 5 AS hashed, w0, w1, w2, xor(w3, (pow(2, quality * 3 + toxic) - 1)::BIGINT) AS w3, w4, w5, w6, w7
        FROM (SELECT *, {_words("sha256((doc_id // 3)::VARCHAR)")} FROM labels)),
    s AS (SELECT entry_key, {_words("entry_key")} FROM entries WHERE hashed),
    h AS (SELECT query_id, entry_key, {_DIST} AS d FROM q, s WHERE q.hashed AND {_DIST} <= 8),
    t AS (SELECT query_id, entry_key, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(DISTINCT kind) AS nk FROM q JOIN entry_tokens e ON e.v = q.tok GROUP BY 1, 2)
    SELECT query_id, entry_id, coalesce(d, -1)::INT AS distance, coalesce(kinds, '') AS kinds, banks, seen_count,
      least(1.0, round(coalesce(1 - d / 16.0, 0) + 0.15 * coalesce(nk, 0) + 0.05 * greatest(0, banks - 1), 6))::DOUBLE AS strength
    FROM h FULL JOIN t USING (query_id, entry_key) JOIN entries USING (entry_key)""", "entries", "entry_tokens")
cte("registry_best", "SELECT query_id, m.* FROM (SELECT query_id, arg_max(struct_pack(entry_id, strength, banks), (strength, -entry_id)) AS m FROM registry_matches GROUP BY 1)", "registry_matches")


@query("fe01_report_dedup", "SELECT entry_id, seen_count, banks FROM entries", ("entries",))
def fe01(spark, d):
    return G.registry_entries(reports(spark, d)[0]).select("entry_id", "seen_count", "banks")


def registry_matches(spark, d):
    r, t = reports(spark, d)
    q, qt = asks(spark, d)
    return G.query_registry(G.registry_entries(r), G.registry_tokens(r, t), q, qt)


def registry_best(spark, d):
    r, t = reports(spark, d)
    q, qt = asks(spark, d)
    return G.best_matches(G.registry_entries(r), G.registry_tokens(r, t), q, qt)


@query("fe02_membership_query", "SELECT query_id, entry_id, distance, kinds FROM registry_matches", ("registry_matches",))
def fe02(spark, d):
    return registry_matches(spark, d).select("query_id", "entry_id", F.col("distance").cast("int").alias("distance"), "kinds")


@query("fe03_best_match", "SELECT query_id, entry_id, strength FROM registry_best", ("registry_best",))
def fe03(spark, d):
    return registry_best(spark, d).select("query_id", "entry_id", "strength")


@query("fe04_registry_advisory", """
    SELECT query_id, entry_id, round(least(0.97, 0.6 + 0.4 * strength), 6)::DOUBLE AS suspicion, round(least(1.0, 0.7 + 0.1 * banks), 6)::DOUBLE AS confidence FROM registry_best""", ("registry_best",))
def fe04(spark, d):
    return G.registry_advisory(registry_best(spark, d)).select("query_id", "entry_id", "suspicion", "confidence")


@query("jn04_token_join", "SELECT query_id, entry_id, kinds FROM registry_matches WHERE kinds <> ''", ("registry_matches",))
def jn04(spark, d):
    r, t = reports(spark, d)
    _, qt = asks(spark, d)
    et = G.registry_tokens(r, t)
    m = qt.distinct().join(et, "token").select("query_id", "entry_key", "kind").distinct()
    m = m.groupBy("query_id", "entry_key").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    return m.join(G.registry_entries(r).select("entry_key", "entry_id"), "entry_key").select("query_id", "entry_id", "kinds")


@query("jn05_intersection_only", "SELECT DISTINCT entry_id FROM registry_matches", ("registry_matches",))
def jn05(spark, d):
    r, _ = reports(spark, d)
    e = G.registry_entries(r)
    return e.join(registry_matches(spark, d).select("entry_key"), "entry_key", "left_semi").select("entry_id")


@query("nj12_identifier_tokens", f"""
    SELECT case_id, kind, {token_sql("kind || ':' || CASE kind WHEN 'payout_account' THEN regexp_replace(value, '[^0-9]', '', 'g') WHEN 'phone' THEN right(regexp_replace(value, '[^0-9]', '', 'g'), 10) ELSE regexp_replace(trim(upper(value)), chr(92) || 's+', ' ', 'g') END")} AS token FROM applications""", ("applications",))
def nj12(spark, d):
    a = A.applications(spark, d)
    return a.select("case_id", "kind", entity_token(F.col("kind"), F.col("value"), PEPPER).alias("token"))


# -- rings -----------------------------------------------------------------------------------------------------------
def tokens(spark, d):
    """Written once: components and rings read the tokens several times, and each is two digests."""
    a = A.applications(spark, d)
    return durable(a.select("case_id", "bank_id", "kind", entity_token(F.col("kind"), F.col("value"), PEPPER).alias("token")))


cte("stars", """
    SELECT case_id AS a, hub AS b FROM applications JOIN (SELECT kind, value, min(case_id) AS hub FROM applications GROUP BY 1, 2 HAVING count(DISTINCT case_id) >= 2) USING (kind, value) WHERE case_id <> hub GROUP BY 1, 2""", "applications")
cte("comp", """
    WITH RECURSIVE r(case_id, peer) AS (SELECT DISTINCT case_id, case_id FROM applications UNION SELECT r.case_id, e.y FROM r JOIN (SELECT a AS x, b AS y FROM stars UNION SELECT b, a FROM stars) e ON r.peer = e.x)
    SELECT case_id, min(peer) AS component FROM r GROUP BY 1""", "stars", "applications")
cte("rings", """
    WITH s AS (SELECT component, kind, value, count(DISTINCT case_id) AS n FROM applications JOIN comp USING (case_id) GROUP BY 1, 2, 3 HAVING count(DISTINCT case_id) >= 2),
    k AS (SELECT component, kind, max(n) AS n FROM s GROUP BY 1, 2),
    w AS (SELECT component, sum(CASE kind WHEN 'payout_account' THEN 1.0 WHEN 'device' THEN 0.9 WHEN 'employer' THEN 0.4 ELSE 0.7 END)::DOUBLE AS weight, string_agg(kind || ':' || n, ',' ORDER BY kind) AS shared FROM k GROUP BY 1),
    m AS (SELECT component, count(DISTINCT case_id) AS members, count(DISTINCT bank_id) AS banks FROM applications JOIN comp USING (case_id) GROUP BY 1)
    SELECT component, members, banks, weight, shared, round(greatest(0, least(1.0, weight / 2 + 0.08 * (members - 3) + 0.05 * (banks - 1))), 3)::DOUBLE AS strength FROM w JOIN m USING (component) WHERE members >= 3 AND weight >= 1.0""", "comp", "applications")


def comp(spark, d, t):
    return durable(G.components(t.select("case_id").distinct(), G.token_edges(t)))


@query("fe05_token_edges", "SELECT a, b FROM stars", ("stars",))
def fe05(spark, d):
    return G.token_edges(tokens(spark, d))


@query("fe06_components", "SELECT case_id, component FROM comp", ("comp",))
def fe06(spark, d):
    return comp(spark, d, tokens(spark, d)).select("case_id", "component")


@query("fe07_rings", "SELECT component, members, banks, weight, shared, strength FROM rings", ("rings",))
def fe07(spark, d):
    t = tokens(spark, d)
    return G.rings(t, comp(spark, d, t)).select("component", "members", "banks", "weight", "shared", "strength")


@query("fe08_ring_advisories", """
    SELECT case_id, component, round(least(0.97, 0.65 + 0.3 * strength), 6)::DOUBLE AS suspicion, round(least(1.0, 0.6 + 0.08 * banks), 6)::DOUBLE AS confidence FROM comp JOIN rings USING (component)""", ("comp", "rings"))
def fe08(spark, d):
    t = tokens(spark, d)
    c = comp(spark, d, t)
    return G.ring_advisories(G.rings(t, c), c).select("case_id", "component", "suspicion", "confidence")


# -- pairs, anti joins, positions ---------------------------------------------------------------------------------------
def order_amounts(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("bundle_id"), paise("o_totalprice").alias("amount"),
                                            F.when(F.col("o_orderstatus") == "F", CO.MONTHLY).otherwise(CO.ANNUAL).alias("kind"))


_OA = "WITH o AS (SELECT o_custkey AS b, o_orderkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS a, o_orderstatus = 'F' AS m FROM orders)"


@query("jn06_bundle_pairs", _OA + """
    SELECT b AS bundle_id, n AS sources, n * (n - 1) // 2 AS pairs, coalesce(d, 0)::BIGINT AS disagreeing FROM (SELECT b, count(*) AS n FROM o GROUP BY 1) LEFT JOIN (
      SELECT x.b, count_if(abs(x.a - y.a) * 100 > 12 * greatest(x.a, y.a)) AS d FROM o x JOIN o y ON x.b = y.b AND x.k < y.k GROUP BY 1) USING (b)""")
def jn06(spark, d):
    p = CO.amount_pairs(order_amounts(spark, d), ["bundle_id"], "amount")
    return p.select("bundle_id", "sources", "pairs", F.col("disagreeing").cast("bigint").alias("disagreeing"))


@query("jn07_role_cross", _OA + """
    SELECT b AS bundle_id, count_if(m)::BIGINT AS monthly, count_if(NOT m)::BIGINT AS annual, coalesce(any_value(c), 0)::BIGINT AS contradictions FROM o LEFT JOIN (
      SELECT x.b, count_if(x.a * 1200 > y.a * 112) AS c FROM o x JOIN o y ON x.b = y.b WHERE x.m AND NOT y.m GROUP BY 1) USING (b) GROUP BY 1""")
def jn07(spark, d):
    f = CO.annual_floor(order_amounts(spark, d), ["bundle_id"], "amount")
    return f.select("bundle_id", *[F.col(c).cast("bigint").alias(c) for c in ("monthly", "annual", "contradictions")])


@query("jn08_unresolved_references", "SELECT doc_id, 'schedule b' AS ref FROM agreements WHERE k % 15 = 2", ("agreements",))
def jn08(spark, d):
    c = L.agreement_claims(spark, d)
    ref = c.filter(F.col("predicate") == "refers_to").select("doc_id", F.lower(F.trim("value")).alias("ref"))
    target = c.filter(F.col("predicate") == "label").select("doc_id", F.lower(F.trim("value")).alias("ref"))
    return ref.join(target, ["doc_id", "ref"], "left_anti")


_SETS = """WITH c AS (SELECT DISTINCT l_partkey AS bundle_id, 'R' || l_orderkey AS ref FROM lineitem), e AS (SELECT DISTINCT l_partkey AS bundle_id, CASE WHEN l_orderkey % 29 = 4 THEN 'none' ELSE 'R' || l_orderkey END AS ref FROM lineitem) """


@query("jn09_not_in_superset", _SETS + "SELECT bundle_id, ref FROM c ANTI JOIN e USING (bundle_id, ref)")
def jn09(spark, d):
    cert, deed = L.encumbrances(spark, d)
    return cert.join(deed, ["bundle_id", "ref"], "left_anti")


@query("se02_intersect", _SETS + "SELECT bundle_id, ref FROM c INTERSECT SELECT bundle_id, ref FROM e")
def se02(spark, d):
    cert, deed = L.encumbrances(spark, d)
    return cert.intersect(deed)


@query("se03_except", _SETS + "SELECT bundle_id, ref FROM c EXCEPT SELECT bundle_id, ref FROM e")
def se03(spark, d):
    cert, deed = L.encumbrances(spark, d)
    # both sides are sets; a missing reference equals a missing one, as in EXCEPT
    told = deed.select(F.col("bundle_id").alias("in_bundle"), F.col("ref").alias("told"))
    return cert.join(by_key(told), F.col("bundle_id").eqNullSafe(F.col("in_bundle")) & F.col("ref").eqNullSafe(F.col("told")), "left_anti")


@query("se04_distinct", "SELECT DISTINCT l_partkey AS bundle_id, l_suppkey AS value FROM lineitem")
def se04(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("bundle_id"), F.col("l_suppkey").alias("value")).distinct()


@query("jn11_printed_on_page", """
    SELECT bundle_id, ord::INT AS ord, regexp_full_match(pan, '[A-Z]{5}[0-9]{4}[A-Z]') AND bundle_id % 3 <> 1 AS confirmed FROM entities""", ("entities",))
def jn11(spark, d):
    e = A.entities(spark, d).select("bundle_id", "ord", "pan")
    spaced = F.concat(F.substring("pan", 1, 5), F.lit(" "), F.substring("pan", 6, 9))
    pages = e.select("bundle_id", "ord", F.concat(F.lit("page of "), F.when(F.col("bundle_id") % 3 == 1, F.lit("nothing")).otherwise(spaced)).alias("text"))
    c = P.printed_on_page(e, pages, ["bundle_id", "ord"], "pan", "^[A-Z]{5}[0-9]{4}[A-Z]$")
    return c.select("bundle_id", F.col("ord").cast("int").alias("ord"), "confirmed")


@query("jn12_provider_routing", """
    SELECT event_id AS request_id, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN 'digital_locker' WHEN 'view' THEN 'account_feed' WHEN 'signup' THEN 'identity_file' ELSE 'digital_locker' END AS provider,
      CASE WHEN event_id % 7 = 2 THEN 'NOT_VERIFIED' WHEN event_type = 'error' THEN 'NO_PROVIDER' ELSE 'ROUTED' END AS status FROM events""")
def jn12(spark, d):
    prov = spark.createDataFrame(
        [("digital_locker", "click", 0), ("account_feed", "view", 1), ("identity_file", "signup", 2), ("pan_check", "signup", 3),
         ("digital_locker", "purchase", 0), ("pan_check", "purchase", 3)], "provider string, doc_class string, preference int")
    e = table(spark, d, "events")
    r = e.select(F.col("event_id").alias("request_id"), F.col("event_type").alias("doc_class"),
                 F.when(F.col("event_id") % 7 == 2, F.lit("other")).otherwise(F.col("event_type")).alias("consent_class"))
    return P.route_providers(r, prov)


@query("jn13_line_diff", """
    WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
    b AS (SELECT doc_id, pos, CASE WHEN pos % 5 = 3 THEN l || 'x' ELSE l END AS r FROM a UNION ALL SELECT doc_id, max(pos) + 1, 'extra' FROM a WHERE doc_id % 3 = 0 GROUP BY 1)
    SELECT doc_id, pos::INT AS pos, coalesce(l, '<missing>') AS left_line, coalesce(r, '<missing>') AS right_line FROM a FULL JOIN b USING (doc_id, pos) WHERE l IS DISTINCT FROM r""")
def jn13(spark, d):
    a = table(spark, d, "documents").select("doc_id", "text")
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.when(i % 5 == 3, F.concat(l, F.lit("x"))).otherwise(l))
    b = a.select("doc_id", F.concat(F.array_join(lines, "\n"), F.when(F.col("doc_id") % 3 == 0, F.lit("\nextra")).otherwise("")).alias("text"))
    return P.line_diff(a, b, "doc_id")


cte("templates", """
    SELECT 'T' || label AS template, embedding::DOUBLE[] AS e FROM embeddings""")
cte("descriptors", """
    SELECT vec_id // 40 AS doc_id, vec_id, list_transform(embedding::DOUBLE[], lambda x, i: x + ((vec_id * 31 + i * 17) % 13 - 6) / 120.0::DOUBLE) AS e FROM embeddings""")
cte("template_scores", """
    WITH two AS (SELECT doc_id, vec_id, template, min(list_distance(d.e, t.e), 2) AS two, count(*) AS nt FROM descriptors d, templates t GROUP BY 1, 2, 3 HAVING count(*) >= 2)
    SELECT doc_id, template, count_if(two[1] < 0.75 * greatest(two[2], 1e-6)) AS good, count_if(two[1] < 0.75 * greatest(two[2], 1e-6)) / greatest(1, least(count(*), max(nt))) AS ratio, count(*) AS n
    FROM two GROUP BY 1, 2""", "templates", "descriptors")


def descriptors(spark, d):
    """Descriptors of documents (all embeddings, each component moved a little) and the library (all embeddings)."""
    e = table(spark, d, "embeddings")
    moved = F.transform(F.col("embedding").cast("array<double>"), lambda x, i: x + ((F.col("vec_id") * 31 + (i + 1) * 17) % 13 - 6) / F.lit(120.0))
    return (e.select(F.expr("vec_id div 40").alias("doc_id"), moved.alias("embedding")),
            e.select(F.concat(F.lit("T"), F.col("label").cast("string")).alias("template"), F.col("embedding").cast("array<double>").alias("embedding")))


@query("jn14_template_recognition", "SELECT doc_id, template, good::BIGINT AS good, round(ratio, 6) AS ratio FROM template_scores WHERE good > 0", ("template_scores",))
def jn14(spark, d):
    return M.template_scores(*descriptors(spark, d)).select("doc_id", "template", "good", F.round("ratio", 6).alias("ratio"))


@query("jn14_template_verdict", """
    SELECT d.doc_id, CASE WHEN d.n >= 2 THEN coalesce(b.template, '') ELSE '' END AS template, CASE WHEN d.n >= 2 THEN coalesce(b.good, 0) ELSE 0 END::BIGINT AS good,
      CASE WHEN d.n < 2 THEN 'NOT_EVALUATED' ELSE 'VALID' END AS status, CASE WHEN d.n < 2 THEN -1.0 WHEN b.good >= 20 AND b.ratio >= 0.4 THEN 0.0 ELSE 0.55 END::DOUBLE AS suspicion
    FROM (SELECT doc_id, count(*) AS n FROM descriptors GROUP BY 1) d
    LEFT JOIN (SELECT * FROM template_scores WHERE good > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ratio DESC, template) = 1) b USING (doc_id)""",
       ("descriptors", "template_scores"))
def jn14_verdict(spark, d):
    v, lib = descriptors(spark, d)
    return M.template_verdict(M.template_scores(v, lib), v, lib).select("doc_id", "template", "good", "status", "suspicion")


@query("jn15_duplicate_regions", """
    WITH p AS (SELECT l_suppkey AS doc_id, l_quantity * 4 AS x0, l_discount * 1000 AS y0, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber <= 4 THEN 60 ELSE l_partkey % 40 * 13 - 200 END AS dx, CASE WHEN l_suppkey % 3 = 0 AND l_linenumber <= 4 THEN 36 ELSE l_orderkey % 50 * 11 END AS dy FROM lineitem),
    q AS (SELECT *, CASE WHEN dx < 0 OR (dx = 0 AND dy < 0) THEN -1 ELSE 1 END AS f FROM p WHERE sqrt(dx * dx + dy * dy) >= 16),
    b AS (SELECT doc_id, round_even(dx * f / 12.0::DOUBLE, 0)::INT AS bx, round_even(dy * f / 12.0::DOUBLE, 0)::INT AS b_y, count(*) AS n, median(dx) AS ox, median(dy) AS oy, sqrt(pow(max(x0) - min(x0), 2) + pow(max(y0) - min(y0), 2)) AS src,
        sqrt(pow(max(x0 + dx) - min(x0 + dx), 2) + pow(max(y0 + dy) - min(y0 + dy), 2)) AS dst FROM q GROUP BY 1, 2, 3),
    g AS (SELECT doc_id, sum(n)::BIGINT AS pairs, arg_max(struct_pack(n, ox, oy, src, dst), (n, -bx, -b_y)) AS t FROM b GROUP BY 1)
    SELECT doc_id, pairs, t.n AS dominant, round(t.n / pairs, 6) AS share, pairs >= 12 AND sqrt(pow(t.ox, 2) + pow(t.oy, 2)) >= 24 AND t.n / pairs >= 0.3 AND t.n >= 12 AND t.src <= 0.45 * sqrt(2) * 1000 AND t.dst <= 0.45 * sqrt(2) * 1000 AS duplicated FROM g""")
def jn15(spark, d):
    li = table(spark, d, "lineitem")
    clone = (F.col("l_suppkey") % 3 == 0) & (F.col("l_linenumber") <= 4)
    dx = F.when(clone, F.lit(60)).otherwise(F.col("l_partkey") % 40 * 13 - 200)
    dy = F.when(clone, F.lit(36)).otherwise(F.col("l_orderkey") % 50 * 11)
    x0, y0 = F.col("l_quantity") * 4, F.col("l_discount") * 1000
    p = li.select(F.col("l_suppkey").alias("doc_id"), x0.alias("x0"), y0.alias("y0"), (x0 + dx).alias("x1"), (y0 + dy).alias("y1"),
                  F.lit(1000.0).alias("width"), F.lit(1000.0).alias("height"))
    return M.duplicate_regions(p)
