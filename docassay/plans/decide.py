"""Queries over decisions, evidence and the audit chain (inventory DE, SNK-01, CLM-15/16, AU)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.operators import audit as U
from docassay.operators import corroborate as CO
from docassay.operators import decision as V
from docassay.operators import run as RUN
from docassay.plans import rules as RQ
from docassay.plans.oracle_inputs import cte
from docassay.plans.registry import query
from docassay.session import by_key, durable
from docassay.sources import adapters as A
from docassay.sources.tables import table

NAMES = ["financial_consistency", "cross_document_consistency", "font_layout", "anomaly_intelligence", "signature",
         "pdf_only_red_flag", "phash_resubmission"]


@query("de01_signal_validity", """
    SELECT fault, count(*) AS signals FROM (SELECT CASE WHEN status = 'VALID' AND s IS NULL THEN 'missing_suspicion' WHEN status = 'VALID' AND NOT s BETWEEN 0 AND 1 THEN 'out_of_range'
      WHEN status <> 'VALID' AND s IS NOT NULL THEN 'unexpected_suspicion' END AS fault FROM (
      SELECT status, CASE doc_id % 50 WHEN 1 THEN NULL WHEN 2 THEN 1.5 WHEN 3 THEN 0.2 ELSE suspicion END AS s FROM signals)) WHERE fault IS NOT NULL GROUP BY 1""", ("signals",))
def de01(spark, d):
    k = F.col("doc_id") % 50
    s = A.signals(spark, d).withColumn("suspicion", F.when(k == 1, None).when(k == 2, 1.5).when(k == 3, 0.2).otherwise(
        F.col("suspicion")))
    return V.invalid_signals(s).groupBy("fault").agg(F.count(F.lit(1)).alias("signals"))


@query("de02_weighted_suspicion", """
    SELECT doc_id, round(coalesce(sum(suspicion * weight) FILTER (ok) / sum(weight) FILTER (ok), 0), 6) AS mean, round(coalesce(sum(weight) FILTER (ok), 0), 6) AS weight
    FROM (SELECT *, status = 'VALID' AND weight > 0 AS ok FROM signals) GROUP BY 1""", ("signals",))
def de02(spark, d):
    w = V.weighted_suspicion(A.signals(spark, d), ["doc_id"])
    return w.select("doc_id", F.round("mean", 6).alias("mean"), F.round("weight", 6).alias("weight"))


@query("de03_provenance", """
    SELECT doc_id, CASE WHEN bool_or(provenance = 'tampered') THEN 'tampered' WHEN bool_or(provenance = 'verified') THEN 'verified' ELSE 'absent' END AS provenance
    FROM signals GROUP BY 1""", ("signals",))
def de03(spark, d):
    return V.provenance(A.signals(spark, d), ["doc_id"])


VERDICTS = """
    WITH s AS (SELECT *, status = 'VALID' AND weight > 0 AS ok, coalesce(red_flag = 'pdf_only_when_pullable', false) AS red,
        suspicion::DECIMAL(9,6) AS sd, weight::DECIMAL(9,6) AS wd FROM signals),
    g AS (SELECT doc_id,
        (sum(sd * wd) FILTER (ok))::DOUBLE AS an, (sum(wd) FILTER (ok))::DOUBLE AS ad,
        (sum(sd * wd) FILTER (ok AND NOT review_only))::DOUBLE AS fn, (sum(wd) FILTER (ok AND NOT review_only))::DOUBLE AS fd,
        (sum(sd * wd) FILTER (ok AND provenance IS NULL AND NOT red AND NOT review_only AND name NOT IN ('copy_move', 'font_layout', 'pdf_font_consistency')))::DOUBLE AS cn,
        (sum(wd) FILTER (ok AND provenance IS NULL AND NOT red AND NOT review_only AND name NOT IN ('copy_move', 'font_layout', 'pdf_font_consistency')))::DOUBLE AS cd,
        coalesce(bool_or(layer = 1 AND provenance = 'tampered'), false) AS tampered, coalesce(bool_or(layer = 1 AND provenance = 'verified'), false) AS verified,
        bool_or(status = 'VALID' AND hard_reject) AS hard, bool_or(status = 'ERROR') AS err, bool_or(red) AS redf,
        bool_or(status = 'VALID' AND name = 'financial_consistency') AS subst,
        coalesce(bool_or(status = 'VALID' AND name = 'cross_document_consistency' AND suspicion <= 0.1), false) AS agrees FROM s GROUP BY 1),
    x AS (SELECT *, round_even(100 * (1 - coalesce(an / ad, 0)), 2) AS sa, round_even(100 * (1 - coalesce(fn / fd, 0)), 2) AS sf,
        least(99.0 - CASE WHEN redf THEN 15 ELSE 0 END, CASE WHEN coalesce(cd, 0) > 0 THEN round_even(100 * (1 - cn / cd), 2) ELSE 99.0 - CASE WHEN redf THEN 15 ELSE 0 END END)::DOUBLE AS sv FROM g),
    y AS (SELECT *, coalesce(fd, 0) = 0 OR sf >= 60 AS soft, CASE WHEN sv >= 85 THEN 'APPROVED' WHEN sv >= 60 THEN 'REVIEW' ELSE 'REJECTED' END AS bv,
        CASE WHEN sa >= 85 THEN 'APPROVED' WHEN sa >= 60 THEN 'REVIEW' ELSE 'REJECTED' END AS ba FROM x),
    z AS (SELECT *, CASE WHEN err AND ba = 'APPROVED' THEN 'REVIEW' ELSE ba END AS v, CASE WHEN err AND ba = 'APPROVED' THEN least(sa, 84.0) ELSE sa END AS sc FROM y)
    SELECT doc_id, CASE WHEN tampered OR hard THEN 5.0 WHEN verified THEN CASE WHEN NOT err AND bv = 'REJECTED' AND soft THEN greatest(sv, 60.0) ELSE sv END
        WHEN ad IS NULL THEN 60.0 WHEN v = 'REJECTED' AND soft THEN greatest(sc, 60.0) WHEN v = 'APPROVED' AND NOT (subst AND agrees) THEN least(sc, 60.0) ELSE sc END::DOUBLE AS score,
      CASE WHEN tampered OR hard THEN 'REJECTED' WHEN verified THEN CASE WHEN err OR (bv = 'REJECTED' AND soft) THEN 'REVIEW' ELSE bv END
        WHEN ad IS NULL OR (v = 'REJECTED' AND soft) OR (v = 'APPROVED' AND NOT (subst AND agrees)) THEN 'REVIEW' ELSE v END AS verdict,
      CASE WHEN tampered OR (NOT hard AND verified) THEN 'source-verified' ELSE 'forensic-fallback' END AS tier,
      CASE WHEN tampered OR hard THEN true WHEN verified THEN err WHEN ad IS NULL OR (v = 'REJECTED' AND soft) OR (v = 'APPROVED' AND NOT (subst AND agrees)) THEN true ELSE err END AS fail_closed
    FROM z"""
cte("verdicts", VERDICTS, "signals")


@query("de04_verdict", "SELECT * FROM verdicts", ("verdicts",))
def de04(spark, d):
    return V.verdicts(A.signals(spark, d), ["doc_id"])


def advisories(spark, d):
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), F.round(F.col("o_orderkey") % 10 / 10.0, 1).alias("suspicion"),
                    F.when(F.col("o_orderkey") % 4 != 1, F.lit("peer finding")).otherwise("  ").alias("explanation"))


@query("de05_advisory", """
    SELECT v.doc_id, score, CASE WHEN verdict = 'APPROVED' AND a >= 0.5 THEN 'REVIEW' ELSE verdict END AS verdict, coalesce(n, 0) AS advisories FROM verdicts v LEFT JOIN (
      SELECT o_orderkey AS doc_id, max(round(o_orderkey % 10 / 10.0, 1)) AS a, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 1 GROUP BY 1) USING (doc_id)""", ("verdicts",))
def de05(spark, d):
    v = V.verdicts(A.signals(spark, d), ["doc_id"])
    return V.attach_advisories(v, advisories(spark, d), ["doc_id"]).select("doc_id", "score", "verdict", "advisories")


@query("se01_signal_union", """
    SELECT name, count(*) AS signals FROM (SELECT name FROM signals UNION ALL SELECT 'cross_source_corroboration' FROM (SELECT DISTINCT doc_id FROM signals)) GROUP BY 1""", ("signals",))
def se01(spark, d):
    s = A.signals(spark, d)
    injected = s.select("doc_id").distinct().withColumn("name", F.lit("cross_source_corroboration"))
    return s.unionByName(injected, allowMissingColumns=True).groupBy("name").agg(F.count(F.lit(1)).alias("signals"))


@query("snk01_evidence_packs", """
    WITH one AS (SELECT doc_id, name, arg_max(struct_pack(status, suspicion), (coalesce(suspicion, -1), status, -ord)) AS s FROM signals GROUP BY 1, 2),
    p AS (SELECT doc_id, count(*) AS n, coalesce(string_agg(name, ',' ORDER BY name) FILTER (s.status = 'VALID' AND s.suspicion > 0), '') AS flagged,
      coalesce(string_agg(name, ',' ORDER BY name) FILTER (s.status = 'NOT_EVALUATED'), '') AS pending, coalesce(string_agg(name, ',' ORDER BY name) FILTER (s.status = 'ERROR'), '') AS errored FROM one GROUP BY 1)
    SELECT doc_id, verdict, n::INT AS signals, flagged, pending, errored FROM p JOIN verdicts USING (doc_id)""", ("verdicts", "signals"))
def snk01(spark, d):
    p = packs(spark, d)
    return p.select("doc_id", "verdict", F.size("signals").alias("signals"),
                    *[F.array_join(c, ",").alias(c) for c in ("flagged", "pending", "errored")])


def packs(spark, d):
    s = A.signals(spark, d)
    return V.evidence_packs(s, V.verdicts(s, ["doc_id"]), ["doc_id"])


@query("clm15_signal_detail", """
    SELECT doc_id, coalesce(status, 'MISSING') AS status, coalesce(suspicion, -1.0)::DOUBLE AS suspicion FROM (SELECT DISTINCT doc_id FROM signals) LEFT JOIN (
      SELECT doc_id, s.status AS status, s.suspicion AS suspicion FROM (
        SELECT doc_id, arg_max(struct_pack(status, suspicion), (coalesce(suspicion, -1), status, -ord)) AS s FROM signals WHERE name = 'font_layout' GROUP BY 1)) USING (doc_id)""", ("signals",))
def clm15(spark, d):
    x = V.signal_detail(packs(spark, d), ["doc_id"], "font_layout")
    return x.select("doc_id", F.coalesce("signal.status", F.lit("MISSING")).alias("status"),
                    F.coalesce("signal.suspicion", F.lit(-1.0)).alias("suspicion"))


@query("clm15_label_resolution", """
    SELECT k, requested, CASE WHEN k % 3 = 2 THEN '' ELSE n END AS label FROM (SELECT c_custkey AS k, c_name AS n, CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN ' ' || upper(c_name) || ' ' ELSE 'nobody' END AS requested FROM customer)""")
def clm15_label(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label"))
    m = F.col("k") % 3
    req = c.select("k", F.when(m == 0, F.col("label")).when(m == 1, F.concat(F.lit(" "), F.upper("label"), F.lit(" "))).otherwise(
        F.lit("nobody")).alias("requested"))
    return V.resolve_label(req, c, "k").withColumn("label", F.coalesce("label", F.lit("")))


@query("clm16_contradiction_filter", """
    SELECT conv_id, turn, verdict, (verdict = 'REJECTED' AND regexp_matches(lower(t), 'approve|proceed')) OR (verdict = 'APPROVED' AND regexp_matches(lower(t), 'reject|decline')) AS replaced FROM (
      SELECT conv_id, turn, ['APPROVED', 'REVIEW', 'REJECTED'][((conv_id + turn) % 3 + 1)::INT] AS verdict, text || CASE turn % 4 WHEN 1 THEN ' Please PROCEED' WHEN 2 THEN ' we decline' ELSE '' END AS t FROM conversations)""")
def clm16(spark, d):
    c = table(spark, d, "conversations")
    v = F.get(F.array(*[F.lit(x) for x in ("APPROVED", "REVIEW", "REJECTED")]), ((F.col("conv_id") + F.col("turn")) % 3).cast("int"))
    tail = F.when(F.col("turn") % 4 == 1, " Please PROCEED").when(F.col("turn") % 4 == 2, " we decline").otherwise("")
    n = c.select("conv_id", "turn", v.alias("verdict"), F.concat("text", tail).alias("action_text"), F.lit("").alias("fallback"))
    return V.contradiction_filter(n).select("conv_id", "turn", "verdict", "replaced")


def statement_signals(spark, d):
    """Consistency and anomaly signals of the bank statements in the common signal shape."""
    claims = durable(A.claims(spark, d))  # read by both packs
    view = RQ.R.statement_view(claims)
    fin = RQ.claim_signal(spark, d, claims, view).filter(F.col("doc_id").startswith("S")).select(
        "doc_id", "name", "status", "suspicion", F.lit(0.40).alias("weight"), F.lit(False).alias("review_only"))
    a, b, c = RQ.findings(spark, d, claims, view[0])
    from docassay.operators.anomaly import anomaly_signal

    an = anomaly_signal(a.unionByName(b).unionByName(c)).select(
        "doc_id", "name", "status", F.when(F.col("status") == "VALID", F.col("suspicion")).alias("suspicion"),
        F.lit(0.10).alias("weight"), F.lit(True).alias("review_only"))
    return fin.unionByName(an).withColumn("layer", F.lit(3)).withColumn("hard_reject", F.lit(False)).withColumn(
        "provenance", F.lit(None).cast("string")).withColumn("red_flag", F.lit(None).cast("string"))


cte("statement_verdicts", """
    WITH a AS (SELECT doc_id, bool_or(evaluated) AS ev, bool_or(triggered) AS tr FROM anomalies GROUP BY 1),
    x AS (SELECT f.doc_id, status = 'VALID' AS fv, CASE WHEN status = 'VALID' THEN suspicion END AS fs, ev, CASE WHEN tr THEN 0.4 ELSE 0.0 END AS s2
      FROM claim_signal f JOIN a USING (doc_id) WHERE f.doc_id LIKE 'S%'),
    y AS (SELECT *, (CASE WHEN fv THEN fs * 0.4 ELSE 0 END + CASE WHEN ev THEN s2 * 0.1 ELSE 0 END) / nullif(CASE WHEN fv THEN 0.4 ELSE 0 END + CASE WHEN ev THEN 0.1 ELSE 0 END, 0) AS m FROM x),
    z AS (SELECT *, round_even(100 * (1 - coalesce(m, 0)), 2) AS sc, NOT fv OR 100 * (1 - fs) >= 60 AS soft FROM y)
    SELECT doc_id, CASE WHEN m IS NULL THEN 60.0 WHEN sc >= 85 THEN 60.0 WHEN sc < 60 AND soft THEN 60.0 ELSE sc END::DOUBLE AS score,
      CASE WHEN m IS NOT NULL AND sc < 60 AND NOT soft THEN 'REJECTED' ELSE 'REVIEW' END AS verdict FROM z""", "claim_signal", "anomalies")


@query("de07_statement_verdicts", "SELECT * FROM statement_verdicts", ("statement_verdicts",))
def de07(spark, d):
    return V.verdicts(statement_signals(spark, d), ["doc_id"]).select("doc_id", "score", "verdict")


# -- audit -----------------------------------------------------------------------------------------------------------
cte("chained", f"""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY timestamp, event_id) - 1 AS seq FROM audit_events),
    c AS (SELECT chain_id, seq, timestamp, payload, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '{{"payload":' || payload || ',"prev_hash":"' || repeat('0', 64) || '","seq":' || seq || ',"timestamp":"' || timestamp || '"}}') AS this_hash FROM e WHERE seq = 0
      UNION ALL SELECT e.chain_id, e.seq, e.timestamp, e.payload, c.this_hash, sha256(c.this_hash || '{{"payload":' || e.payload || ',"prev_hash":"' || c.this_hash || '","seq":' || e.seq || ',"timestamp":"' || e.timestamp || '"}}')
      FROM c JOIN e ON e.chain_id = c.chain_id AND e.seq = c.seq + 1)
    SELECT * FROM c""", "audit_events")


def chained(spark, d):
    return U.append_chain(A.audit_events(spark, d), ["timestamp", "event_id"])


@query("au01_chain_append", "SELECT * FROM chained", ("chained",))
def au01(spark, d):
    return chained(spark, d)


def _tampered(df):
    """Change the payload of record 5 in some chains, and the stored link of record 7 in others."""
    n = F.regexp_extract("chain_id", "([0-9]+)", 1).cast("bigint")
    return df.withColumn("payload", F.when((n % 7 == 3) & (F.col("seq") == 5), F.lit("{}")).otherwise(F.col("payload"))).withColumn(
        "prev_hash", F.when((n % 7 == 5) & (F.col("seq") == 7), F.lit("0" * 64)).otherwise(F.col("prev_hash")))


@query("au02_chain_verification", """
    SELECT chain_id, count(*) AS records, CASE WHEN n % 7 = 3 AND count(*) > 5 THEN 5 WHEN n % 7 = 5 AND count(*) > 7 THEN 7 ELSE -1 END::BIGINT AS first_broken
    FROM (SELECT chain_id, substr(chain_id, 2)::BIGINT AS n FROM audit_events) GROUP BY chain_id, n""", ("audit_events",))
def au02(spark, d):
    return U.verify(_tampered(chained(spark, d)))


@query("au03_heads", "SELECT chain_id, count(*) AS count, arg_max(this_hash, seq) AS head_hash FROM chained GROUP BY 1", ("chained",))
def au03(spark, d):
    return U.heads(chained(spark, d))


@query("au03_anchors", """
    SELECT chain_id, n % 5 > 1 AS ok, CASE n % 5 WHEN 0 THEN 'truncated' WHEN 1 THEN 'reforged' ELSE '' END AS fault FROM (SELECT DISTINCT chain_id, substr(chain_id, 2)::BIGINT AS n FROM audit_events)""", ("audit_events",))
def au03_anchors(spark, d):

    led = durable(chained(spark, d))
    n = F.regexp_extract("chain_id", "([0-9]+)", 1).cast("bigint") % 5
    anchors = U.heads(led).select(
        "chain_id", (F.col("count") + F.when(n == 0, 3).otherwise(0)).alias("anchor_count"),
        F.when(n == 1, F.lit("f" * 64)).otherwise(F.col("head_hash")).alias("anchor_hash"))
    return U.check_anchors(led, anchors)


# -- bundles ---------------------------------------------------------------------------------------------------------
def bundled(df):
    """Documents of one applicant share a bundle: the digits of the document id."""
    return df.withColumn("bundle_id", F.expr("try_cast(substring(doc_id, 2) as bigint)"))


_MATCH = """(sa = sb OR levenshtein(sa, sb) <= 1) AND ((c00 AND c11) OR (NOT c00 AND c01 AND c10))"""
_COMPAT = "({0} = {1} OR (length({0}) = 1 AND starts_with({1}, {0})) OR (length({1}) = 1 AND starts_with({0}, {1})))"
cte("name_off", f"""
    SELECT bundle_id, count_if(NOT ({_MATCH}))::BIGINT AS off FROM (
      SELECT bundle_id, a[3] AS sa, b[3] AS sb, {_COMPAT.format('a[1]', 'b[1]')} AS c00, {_COMPAT.format('a[2]', 'b[2]')} AS c11,
        {_COMPAT.format('a[1]', 'b[2]')} AS c01, {_COMPAT.format('a[2]', 'b[1]')} AS c10
      FROM (SELECT e.bundle_id, string_split(f.name, ' ') AS a, string_split(e.name, ' ') AS b FROM entities e JOIN entities f ON e.bundle_id = f.bundle_id AND f.ord = 0)) GROUP BY 1
    """, "entities")
cte("identity_cmp", """
    WITH v AS (SELECT bundle_id, field, value FROM (SELECT bundle_id, pan, aadhaar, ifsc, account_number, dob FROM entities) UNPIVOT (value FOR field IN (pan, aadhaar, ifsc, account_number, dob))),
    dist AS (SELECT DISTINCT * FROM v),
    far AS (SELECT a.bundle_id, a.field, bool_or(length(a.value) <> length(b.value) OR levenshtein(a.value, b.value) > 1) AS far FROM dist a JOIN dist b ON a.bundle_id = b.bundle_id AND a.field = b.field AND a.value < b.value GROUP BY 1, 2),
    g AS (SELECT bundle_id, field, count(*) AS documents FROM v GROUP BY 1, 2 HAVING count(*) >= 2)
    SELECT g.bundle_id, g.field, documents, CASE WHEN far IS NULL THEN 'agree' WHEN far THEN 'disagree' ELSE 'near' END AS status,
      CASE WHEN far IS NULL THEN 0.0 WHEN NOT far THEN 0.4 ELSE CASE g.field WHEN 'pan' THEN 0.92 WHEN 'aadhaar' THEN 0.92 WHEN 'dob' THEN 0.85 WHEN 'account_number' THEN 0.85 ELSE 0.7 END END::DOUBLE AS severity
    FROM g LEFT JOIN far ON g.bundle_id = far.bundle_id AND g.field = far.field
    UNION ALL SELECT bundle_id, 'name', 4, CASE WHEN off = 0 THEN 'agree' ELSE 'disagree' END, CASE WHEN off = 0 THEN 0.0 ELSE 0.4 END FROM name_off""", "entities", "name_off")
cte("identity_sig", """
    SELECT bundle_id, CASE WHEN count_if(status <> 'agree') = 0 THEN 0.04 ELSE max(severity) END::DOUBLE AS suspicion, bool_or(status = 'disagree' AND field <> 'name') AS hard_reject,
      count_if(status <> 'agree')::BIGINT AS disagreeing FROM identity_cmp GROUP BY 1""", "identity_cmp")
cte("observations", r"""
    SELECT acct AS bundle_id, 'monthly_take_home' AS kind, 'salary_credit' AS source_field, (median(cr) * 2)::BIGINT AS amount2 FROM trusted
      WHERE cr > 0 AND regexp_matches(narration_t, '(?i)\b(salary|sal|payroll|wages|stipend|remuneration|emolument)\b') GROUP BY 1
    UNION ALL SELECT cust, 'monthly_take_home', 'net_pay', net_p * 2 FROM income WHERE net_p > 0
    UNION ALL SELECT cust, 'annual_gross', 'gross_income', annual_gross_p * 2 FROM income WHERE annual_gross_p > 0""", "trusted", "income")
cte("co_monthly", """
    SELECT a.bundle_id, count(*) AS pairs, count_if(abs(a.amount2 - b.amount2) * 100 > 12 * greatest(a.amount2, b.amount2))::BIGINT AS disagreeing
    FROM observations a JOIN observations b ON a.bundle_id = b.bundle_id AND a.kind = b.kind AND a.source_field < b.source_field WHERE a.kind = 'monthly_take_home' GROUP BY 1""", "observations")
cte("co_floor", """
    SELECT m.bundle_id, count(*) AS checks, count_if(m.amount2 * 1200 > g.amount2 * 112)::BIGINT AS contradictions FROM observations m JOIN observations g ON m.bundle_id = g.bundle_id
    WHERE m.kind = 'monthly_take_home' AND g.kind = 'annual_gross' GROUP BY 1""", "observations")
_ORG = (r"trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '\b(pvt|private|ltd|limited|llp|inc|co|company|corp|corporation|industries|enterprises|technologies|services|solutions|systems)\b', ' ', 'g'), "
        r"'[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))")
cte("co_employer", f"""
    SELECT cust AS bundle_id, 1::BIGINT AS pairs, CASE WHEN a = b THEN 0 WHEN 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.85 THEN 0 ELSE 1 END::BIGINT AS disagreeing
    FROM (SELECT cust, {_ORG.format('employer')} AS a, {_ORG.format('employer_proof')} AS b FROM income)""", "income")
cte("income_sig", """
    SELECT e.bundle_id, coalesce(m.pairs, 0) + coalesce(checks, 0) + e.pairs AS checks, coalesce(m.disagreeing, 0) + coalesce(contradictions, 0) + e.disagreeing AS disagreeing,
      CASE WHEN coalesce(m.disagreeing, 0) + coalesce(contradictions, 0) + e.disagreeing = 0 THEN 0.05 ELSE 0.4 END::DOUBLE AS suspicion
    FROM co_employer e LEFT JOIN co_monthly m USING (bundle_id) LEFT JOIN co_floor f USING (bundle_id)""", "co_monthly", "co_floor", "co_employer")


def observations(spark, d, claims=None):

    claims = A.claims(spark, d) if claims is None else claims
    return durable(bundled(CO.income_observations(claims, A.ledger_keys(spark, d))))


def _bundle_base(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("bundle_id"))


@query("co01_income_observations", "SELECT bundle_id, kind, source_field, amount2 FROM observations", ("observations",))
def co01(spark, d):
    return observations(spark, d).select("bundle_id", "kind", "source_field", "amount2")


@query("co02_monthly_agreement", "SELECT bundle_id, pairs, disagreeing FROM co_monthly", ("co_monthly",))
def co02(spark, d):
    o = observations(spark, d).filter(F.col("kind") == CO.MONTHLY)
    return CO.amount_pairs(o, ["bundle_id"], "amount2", base=_bundle_base(spark, d)).filter("pairs > 0").select(
        "bundle_id", "pairs", F.col("disagreeing").cast("bigint").alias("disagreeing"))


@query("co03_annual_floor", "SELECT bundle_id, checks, contradictions FROM co_floor", ("co_floor",))
def co03(spark, d):
    f = CO.annual_floor(observations(spark, d), ["bundle_id"], "amount2", _bundle_base(spark, d))
    return f.filter("checks > 0").select("bundle_id", "checks", "contradictions")


def employers(spark, d):
    i = A.income(spark, d)
    e = F.explode(F.array("employer", "employer_proof")).alias("employer")
    return i.select(F.col("cust").alias("bundle_id"), e)


@query("co04_employer_agreement", "SELECT * FROM co_employer", ("co_employer",))
def co04(spark, d):
    return CO.employer_agreement(employers(spark, d), ["bundle_id"]).select("bundle_id", "pairs", "disagreeing")


def income_signal(spark, d, claims=None):
    o, base = observations(spark, d, claims), _bundle_base(spark, d)
    return CO.income_signal(
        CO.amount_pairs(o.filter(F.col("kind") == CO.MONTHLY), ["bundle_id"], "amount2", base=base),
        CO.annual_floor(o, ["bundle_id"], "amount2", base), CO.employer_agreement(employers(spark, d), ["bundle_id"]), ["bundle_id"])


@query("co05_income_signal", "SELECT bundle_id, 'VALID' AS status, suspicion, checks::BIGINT AS checks, disagreeing::BIGINT AS disagreeing FROM income_sig", ("income_sig",))
def co05(spark, d):
    return income_signal(spark, d).select("bundle_id", "status", "suspicion", "checks", F.col("disagreeing").cast("bigint").alias("disagreeing"))


def identity_comparisons(spark, d):
    return CO.identity_comparison(CO.identity_values(A.entities(spark, d), ["bundle_id"]), ["bundle_id"])


@query("co06_identity_comparison", "SELECT * FROM identity_cmp", ("identity_cmp",))
def co06(spark, d):
    return identity_comparisons(spark, d)


@query("co07_identity_signal", "SELECT * FROM identity_sig", ("identity_sig",))
def co07(spark, d):
    return CO.identity_signal(identity_comparisons(spark, d), ["bundle_id"]).select(
        "bundle_id", "suspicion", "hard_reject", "disagreeing")


@query("co08_case_accrual", """
    SELECT case_id, documents, status, count(*) AS fields FROM (
      SELECT case_id, value_count AS documents, CASE WHEN d = 1 THEN 'agree' ELSE 'disagree' END AS status FROM (
        SELECT c_nationkey AS case_id, count(*) AS value_count, count(DISTINCT c_mktsegment) AS d FROM customer GROUP BY 1 HAVING count(*) >= 2)) GROUP BY 1, 2, 3""")
def co08(spark, d):
    """A case with hundreds of documents: the market segment stands in for an account number read from each."""
    c = table(spark, d, "customer").select(
        F.col("c_nationkey").alias("case_id"), F.concat(F.lit("doc"), F.col("c_custkey").cast("string")).alias("label"),
        F.col("c_custkey").alias("ord"), F.lit("account_number").alias("field"), F.col("c_mktsegment").alias("value"))
    return CO.identity_comparison(c, ["case_id"]).groupBy("case_id", "documents", "status").agg(F.count(F.lit(1)).alias("fields"))


@query("jn10_claimed_identity", """
    SELECT bundle_id, CASE WHEN k % 6 = 0 THEN 'name' ELSE 'pan' END AS basis, CASE WHEN k % 6 = 0 THEN 'agree' WHEN k % 17 = 5 THEN CASE WHEN pan0 = 'ZZZPZ9999Z' THEN 'agree' ELSE 'disagree' END ELSE 'agree' END AS state
    FROM (SELECT a.bundle_id, a.bundle_id AS k, a.pan AS pan0 FROM entities a WHERE a.ord = 0)""", ("entities",))
def jn10(spark, d):
    e = A.entities(spark, d)
    k = F.col("bundle_id")
    claimed = e.filter(F.col("ord") == 0).select(
        "bundle_id", F.when(k % 6 != 0, F.concat(F.lit(" "), F.lower("pan"))).alias("claimed_pan"), F.col("name").alias("claimed_name"))
    doc = e.filter(F.col("ord") == 2).select("bundle_id", "pan", "name")
    return CO.claimed_identity(claimed, doc, ["bundle_id"]).select("bundle_id", "basis", "state")


# pass two: the income signal of the bundle stands among the signals of each of its documents
cte("members", "SELECT o_orderkey AS doc_id, o_custkey AS bundle_id FROM orders WHERE o_orderkey IN (SELECT doc_id FROM signals)", "signals")
cte("signals_two", """
    SELECT * FROM signals UNION ALL BY NAME SELECT doc_id, 99 AS ord, 'cross_source_corroboration' AS name, 2 AS layer, 'VALID' AS status, suspicion, 0.40::DOUBLE AS weight,
      false AS hard_reject, false AS review_only FROM members JOIN income_sig USING (bundle_id)""", "signals", "members", "income_sig")
cte("verdicts_two", VERDICTS.replace("FROM signals)", "FROM signals_two)").replace(
    "name = 'cross_document_consistency' AND suspicion", "name IN ('cross_document_consistency', 'cross_source_corroboration') AND suspicion"), "signals_two")


def bundles(spark, d):
    claims = A.claims(spark, d)
    s = A.signals(spark, d)
    members = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("bundle_id")).join(
        by_key(s.select("doc_id").distinct()), "doc_id", "left_semi")
    ident = durable(CO.identity_signal(identity_comparisons(spark, d), ["bundle_id"]))
    return RUN.bundle_run(s, members, ident, durable(income_signal(spark, d, claims)), "bundle_id")


@query("de06_bundle_verdict", """
    WITH d AS (SELECT bundle_id, min(score) AS low, count(*) AS documents, max(CASE verdict WHEN 'REJECTED' THEN 2 WHEN 'REVIEW' THEN 1 ELSE 0 END) AS worst, bool_or(fail_closed) AS fc,
        list(doc_id ORDER BY doc_id) FILTER (verdict = 'REJECTED') AS rej FROM members JOIN verdicts_two USING (doc_id) GROUP BY 1),
    x AS (SELECT d.*, least(low, 100 * (1 - i.suspicion), 100 * (1 - c.suspicion)) AS s, coalesce(hard_reject, false) AS h, coalesce(i.disagreeing, 0) > 0 AS ib, coalesce(c.disagreeing, 0) > 0 AS cb,
        i.bundle_id IS NOT NULL AS iv, c.bundle_id IS NOT NULL AS cv
      FROM d LEFT JOIN identity_sig i USING (bundle_id) LEFT JOIN income_sig c USING (bundle_id)),
    y AS (SELECT *, greatest(worst, CASE WHEN s >= 85 THEN 0 WHEN s >= 60 THEN 1 ELSE 2 END, CASE WHEN h THEN 2 WHEN ib OR cb THEN 1 ELSE 0 END) AS r FROM x)
    SELECT bundle_id, documents, round(s, 2) AS bundle_score, ['APPROVED', 'REVIEW', 'REJECTED'][r + 1] AS bundle_verdict, ib OR cb OR fc AS fail_closed,
      CASE WHEN h THEN 'identity: a hard identifier differs' WHEN ib THEN 'identity: a soft discrepancy' WHEN iv THEN 'identity: documents agree' ELSE 'identity: not evaluated' END
      || CASE WHEN cb THEN '; income: sources disagree' WHEN cv THEN '; income: sources agree' ELSE '' END
      || coalesce('; ' || array_to_string(list_transform(rej, lambda k: 'document ' || k || ' is rejected'), '; '), '') AS reasons FROM y""",
       ("members", "verdicts_two", "identity_sig", "income_sig"))
def de06(spark, d):
    b = bundles(spark, d)[1]
    return b.select("bundle_id", "documents", "bundle_score", "bundle_verdict", "fail_closed", F.array_join("reasons", "; ").alias("reasons"))


@query("de06_bundle_documents", "SELECT bundle_id, doc_id, score, verdict, fail_closed FROM members JOIN verdicts_two USING (doc_id)", ("members", "verdicts_two"))
def de06_documents(spark, d):
    return bundles(spark, d)[0].select("bundle_id", "doc_id", "score", "verdict", "fail_closed")


@query("co11_party_identity", """
    SELECT bundle_id, CASE WHEN bundle_id % 23 = 7 THEN 'disagree' ELSE 'agree' END AS name_status, CASE WHEN bundle_id % 31 = 2 THEN 'disagree' ELSE 'agree' END AS pan_status FROM entities WHERE ord = 3""", ("entities",))
def co11(spark, d):
    """Party anchors of a deed (as read from the fourth document) against the KYC record (the first one)."""
    e = A.entities(spark, d)
    k = F.col("bundle_id")
    pan = F.when((k % 31 == 2) & (F.col("ord") == 3), F.lit("QQQPQ0000Q")).otherwise(F.col("pan"))
    pair = e.filter(F.col("ord").isin(0, 3)).withColumn("pan", pan)
    c = CO.identity_comparison(CO.identity_values(pair, ["bundle_id"]), ["bundle_id"])
    return c.groupBy("bundle_id").agg(F.max(F.when(F.col("field") == "name", F.col("status"))).alias("name_status"),
                                      F.max(F.when(F.col("field") == "pan", F.col("status"))).alias("pan_status"))


@query("co13_declared_values", f"""
    SELECT cust AS bundle_id, abs(d - net_p) * 100 <= 12 * greatest(d, net_p) AS income_agrees, CASE WHEN a = b THEN true ELSE 1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) >= 0.85 END AS employer_agrees
    FROM (SELECT cust, net_p, CASE WHEN cust % 7 = 1 THEN net_p * 2 ELSE net_p END AS d, {_ORG.format('employer')} AS a, {_ORG.format('employer_proof')} AS b FROM income)""", ("income",))
def co13(spark, d):
    """Application values against the observed ones: income within 12 %, employer by edit ratio."""
    from docassay.functions.names import org_ratio

    i = A.income(spark, d)
    app = i.select("cust", F.when(F.col("cust") % 7 == 1, F.col("net_p") * 2).otherwise(F.col("net_p")).alias("declared_p"),
                   F.col("employer_proof").alias("declared_employer"))
    j = app.join(i.select("cust", "net_p", "employer"), "cust", "left")
    near = F.abs(F.col("declared_p") - F.col("net_p")) * 100 <= F.greatest("declared_p", "net_p") * 12
    return j.select(F.col("cust").alias("bundle_id"), near.alias("income_agrees"),
                    (org_ratio(F.col("declared_employer"), F.col("employer")) >= 0.85).alias("employer_agrees"))
