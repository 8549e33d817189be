"""Queries over rule packs and anomaly detectors (inventory RU, AN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.operators import anomaly as N
from docassay.operators import claims as K
from docassay.operators import financial as R
from docassay.operators import land as D
from docassay.operators import legal as G
from docassay.operators import statement as S
from docassay.plans.checks import _ENC, survey_values
from docassay.plans.oracle_inputs import cte
from docassay.plans.registry import query
from docassay.session import durable
from docassay.sources import adapters as A
from docassay.sources import adapters_legal as L
from docassay.sources.tables import spread, table


def tidy(df):
    """Rule results without nulls, for comparison."""
    return df.withColumn("expected", F.round(F.coalesce("expected", F.lit(-1.0)), 2)).withColumn(
        "printed", F.round(F.coalesce("printed", F.lit(-1.0)), 2))


def bank(spark, d):
    c = A.claims(spark, d).filter(F.col("doc_type") == "BANK_STATEMENT")
    return K.transactions(c), K.money_scalars(c, R.BANK_SCALARS)


def bank_view(spark, d):
    return R.statement_view(A.claims(spark, d))


# -- shared pieces of the SQL side -----------------------------------------------------------------------------------
cte("misfiled", """
    WITH cells AS (SELECT doc_id, idx, CASE WHEN dr IS NOT NULL THEN 'd' ELSE 'c' END AS side, x FROM trusted
                   WHERE x IS NOT NULL AND (dr IS NOT NULL OR cr IS NOT NULL)),
    med AS (SELECT doc_id, median(x) FILTER (side = 'd') AS dm, median(x) FILTER (side = 'c') AS cm
            FROM cells GROUP BY 1 HAVING count_if(side = 'd') >= 3 AND count_if(side = 'c') >= 3),
    dev AS (SELECT c.*, dm, cm, abs(x - CASE side WHEN 'd' THEN dm ELSE cm END) AS own,
              abs(x - CASE side WHEN 'd' THEN cm ELSE dm END) AS other FROM cells c JOIN med USING (doc_id)),
    sp AS (SELECT doc_id, median(own) AS s, any_value(abs(cm - dm)) AS gap FROM dev GROUP BY 1)
    SELECT DISTINCT doc_id, idx FROM dev JOIN sp USING (doc_id) WHERE gap > greatest(2 * s, 1e-6) AND other < own
    """, "trusted")
cte("f1", """
    WITH b AS (
      SELECT c.doc_id, c.idx, expected, bal, unread, m.idx IS NOT NULL AS mis,
        x IS NULL AND (cr IS NOT NULL OR dr IS NOT NULL)
          AND abs(expected - 2 * (coalesce(cr, 0) - coalesce(dr, 0)) - bal) <= 100 AS sw
      FROM chain c LEFT JOIN misfiled m ON c.doc_id = m.doc_id AND c.idx = m.idx WHERE broken),
    p AS (SELECT doc_id, count_if(unread = 0) AS sure, count_if(unread = 0 AND NOT mis AND NOT sw) AS clean,
        arg_min([idx, expected, bal], idx) FILTER (unread = 0 AND NOT mis AND NOT sw) AS c,
        arg_min([idx, expected, bal], idx) FILTER (unread = 0 AND (mis OR sw)) AS u,
        arg_min(CASE WHEN mis THEN 'misfiled' ELSE 'swap' END, idx) FILTER (unread = 0 AND (mis OR sw)) AS why,
        arg_max([idx, expected, bal], unread * 1000000 - idx) AS g FROM b GROUP BY 1),
    r AS (SELECT o.doc_id, evaluated, sure, clean, why, CASE WHEN clean > 0 THEN c WHEN sure > 0 THEN u ELSE g END AS p
      FROM chain_ok o LEFT JOIN p USING (doc_id))
    SELECT doc_id, 'F1' AS rule_id,
      CASE WHEN NOT evaluated THEN 'NOT_EVALUATED' WHEN sure IS NULL THEN 'PASS' WHEN clean > 0 THEN 'FAIL' ELSE 'NOT_EVALUATED' END AS status,
      CASE WHEN NOT evaluated THEN 'insufficient' WHEN sure IS NULL THEN '' WHEN clean > 0 THEN 'break' WHEN sure = 0 THEN 'unread_gap' ELSE why END AS reason_code,
      CASE WHEN evaluated THEN coalesce(p[1], -1) ELSE -1 END::INT AS at_index,
      CASE WHEN evaluated THEN coalesce(p[2] / 100.0, -1.0) ELSE -1.0 END AS expected,
      CASE WHEN evaluated THEN coalesce(p[3] / 100.0, -1.0) ELSE -1.0 END AS printed FROM r
    """, "chain", "chain_ok", "misfiled")
cte("totals", """
    SELECT s.doc_id, opening_p, CASE WHEN closing_ok THEN closing_p END AS closing_p, total_debits_p, total_credits_p,
      dr, cr, doubted, last_t FROM summary s JOIN (
      SELECT doc_id, coalesce(sum(dr), 0)::BIGINT AS dr, coalesce(sum(cr), 0)::BIGINT AS cr, count_if(move_untrusted) AS doubted,
        arg_max([bal], idx) FILTER (balance_p IS NOT NULL) AS last_t FROM trusted GROUP BY 1) USING (doc_id)
    """, "summary", "trusted")
cte("f2", """
    SELECT doc_id, 'F2' AS rule_id, CASE WHEN l IS NULL OR closing_p IS NULL THEN 'NOT_EVALUATED' WHEN abs(l - closing_p) <= 100 THEN 'PASS' ELSE 'FAIL' END AS status,
      '' AS reason_code, -1::INT AS at_index, CASE WHEN abs(l - closing_p) > 100 THEN l / 100.0 ELSE -1.0 END AS expected,
      CASE WHEN abs(l - closing_p) > 100 THEN closing_p / 100.0 ELSE -1.0 END AS printed FROM (SELECT *, last_t[1] AS l FROM totals)
    """, "totals")
cte("f3", """
    SELECT doc_id, 'F3' AS rule_id, CASE WHEN doubted > 0 THEN 'NOT_EVALUATED' WHEN d OR c THEN 'FAIL' ELSE 'PASS' END AS status,
      CASE WHEN doubted > 0 THEN 'unconfirmed' WHEN d AND c THEN 'both' WHEN d THEN 'total_debits' WHEN c THEN 'total_credits' ELSE '' END AS reason_code,
      -1::INT AS at_index, CASE WHEN doubted > 0 THEN -1.0 WHEN d THEN dr / 100.0 WHEN c THEN cr / 100.0 ELSE -1.0 END AS expected,
      CASE WHEN doubted > 0 THEN -1.0 WHEN d THEN total_debits_p / 100.0 WHEN c THEN total_credits_p / 100.0 ELSE -1.0 END AS printed
    FROM (SELECT *, abs(dr - total_debits_p) > 100 AS d, abs(cr - total_credits_p) > 100 AS c FROM totals)
    """, "totals")
cte("f4", """
    SELECT doc_id, 'F4' AS rule_id, CASE WHEN closing_p IS NULL OR doubted > 0 THEN 'NOT_EVALUATED' WHEN abs(e - closing_p) <= 100 THEN 'PASS' ELSE 'FAIL' END AS status,
      CASE WHEN closing_p IS NULL THEN 'insufficient' WHEN doubted > 0 THEN 'unconfirmed' ELSE '' END AS reason_code, -1::INT AS at_index,
      CASE WHEN doubted = 0 AND abs(e - closing_p) > 100 THEN e / 100.0 ELSE -1.0 END AS expected,
      CASE WHEN doubted = 0 AND abs(e - closing_p) > 100 THEN closing_p / 100.0 ELSE -1.0 END AS printed
    FROM (SELECT *, opening_p + cr - dr AS e FROM totals)
    """, "totals")
cte("f5", """
    SELECT l.doc_id, 'F5' AS rule_id, CASE WHEN coalesce(n, 0) < 2 THEN 'NOT_EVALUATED' WHEN fb IS NULL THEN 'PASS' ELSE 'FAIL' END AS status,
      '' AS reason_code, coalesce(fb, -1)::INT AS at_index, -1.0::DOUBLE AS expected, -1.0::DOUBLE AS printed
    FROM (SELECT DISTINCT doc_id FROM ledger) l LEFT JOIN (
      SELECT doc_id, count(*) AS n, min(idx) FILTER (day < prev) AS fb FROM (
        SELECT *, lag(day) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM trusted WHERE day IS NOT NULL) GROUP BY 1) USING (doc_id)
    """, "ledger", "trusted")
cte("f67", """
    SELECT 'P' || cust AS doc_id, 'F6' AS rule_id, CASE WHEN abs(gross_p - deductions_p - net_p) <= 100 THEN 'PASS' ELSE 'FAIL' END AS status, '' AS reason_code,
      -1::INT AS at_index, CASE WHEN abs(gross_p - deductions_p - net_p) > 100 THEN (gross_p - deductions_p) / 100.0 ELSE -1.0 END AS expected,
      CASE WHEN abs(gross_p - deductions_p - net_p) > 100 THEN net_p / 100.0 ELSE -1.0 END AS printed FROM income
    UNION ALL SELECT 'I' || cust, 'F7', CASE WHEN NOT taxable_ok THEN 'NOT_EVALUATED' WHEN taxable_p <= annual_gross_p THEN 'PASS' ELSE 'FAIL' END, '', -1,
      CASE WHEN taxable_ok AND taxable_p > annual_gross_p THEN annual_gross_p / 100.0 ELSE -1.0 END,
      CASE WHEN taxable_ok AND taxable_p > annual_gross_p THEN taxable_p / 100.0 ELSE -1.0 END FROM income
    """, "income")
cte("financial", "SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3 UNION ALL SELECT * FROM f4 "
    "UNION ALL SELECT * FROM f5 UNION ALL SELECT * FROM f67", "f1", "f2", "f3", "f4", "f5", "f67")


@query("ru_f1_running_balance", "SELECT * FROM f1", ("f1",))
def ru_f1(spark, d):
    return tidy(R.f1(*bank_view(spark, d), base=A.ledger_keys(spark, d)))


@query("ru_f2_closing_balance", "SELECT * FROM f2", ("f2",))
def ru_f2(spark, d):
    t, s = bank(spark, d)
    return tidy(R.f2(R.statement_totals(t), s))


@query("ru_f3_column_totals", "SELECT * FROM f3", ("f3",))
def ru_f3(spark, d):
    t, s = bank(spark, d)
    return tidy(R.f3(R.statement_totals(t), s))


@query("ru_f4_net_reconciliation", "SELECT * FROM f4", ("f4",))
def ru_f4(spark, d):
    t, s = bank(spark, d)
    return tidy(R.f4(R.statement_totals(t), s))


@query("ru_f5_date_order", "SELECT * FROM f5", ("f5",))
def ru_f5(spark, d):
    return tidy(R.f5(bank(spark, d)[0], A.ledger_keys(spark, d)))


@query("ru_f6_salary_identity", "SELECT * FROM f67 WHERE rule_id = 'F6'", ("f67",))
def ru_f6(spark, d):
    return tidy(R.f6(A.claims(spark, d)))


@query("ru_f7_income_consistency", "SELECT * FROM f67 WHERE rule_id = 'F7'", ("f67",))
def ru_f7(spark, d):
    return tidy(R.f7(A.claims(spark, d)))


@query("ru_f7b_tax_slabs", """
    SELECT cust, year, CASE WHEN year = 2026 THEN -1.0 ELSE round((CASE WHEN t > 300000 THEN least(t, 700000) - 300000 ELSE 0 END) * 0.05
      + (CASE WHEN t > 700000 THEN least(t, 1000000) - 700000 ELSE 0 END) * 0.10 + (CASE WHEN t > 1000000 THEN t - 1000000 ELSE 0 END) * 0.20, 2) END::DOUBLE AS tax
    FROM (SELECT cust, taxable_p / 100.0 AS t, (2024 + cust % 3)::INT AS year FROM income)""", ("income",))
def ru_f7b(spark, d):
    rows = [(y, lo, hi, r) for y in (2024, 2025) for lo, hi, r in
            ((0, 300000, 0), (300000, 700000, 5), (700000, 1000000, 10), (1000000, None, 20))]
    slabs = spark.createDataFrame(rows, "slab_year int, low bigint, high bigint, rate_pct int")
    inc = A.income(spark, d).select(
        F.col("cust").cast("string").alias("doc_id"), (2024 + F.col("cust") % 3).cast("int").alias("year"),
        (F.col("taxable_p") / 100).alias("taxable"), F.lit(0.0).alias("stated_tax"))
    t = R.slab_tax(inc, slabs)
    return t.select(F.col("doc_id").cast("bigint").alias("cust"), "year",
                    F.round(F.coalesce(F.col("tax").cast("double"), F.lit(-1.0)), 2).alias("tax"))


@query("ru_01_pack_routing", "SELECT rule_id, status, count(*) AS documents FROM financial GROUP BY 1, 2", ("financial",))
def ru_01(spark, d):
    return R.evaluate_financial(durable(A.claims(spark, d)), A.ledger_keys(spark, d)).groupBy("rule_id", "status").agg(F.count(F.lit(1)).alias("documents"))


NAMES = """CASE WHEN k % 9 = 4 THEN false WHEN k % 9 = 5 THEN true ELSE true END"""


@query("ru_l1_seller_is_owner", f"SELECT bundle_id, 'L1' AS rule_id, CASE WHEN {NAMES} THEN 'PASS' ELSE 'FAIL' END AS status FROM land", ("land",))
def ru_l1(spark, d):
    return D.seller_is_owner(L.land_bundles(spark, d))


@query("ru_l2_registration_window", """
    SELECT parcel, count_if(registered BETWEEN executed AND (executed + INTERVAL 4 MONTH)::DATE)::BIGINT AS passed, count(*) AS deeds FROM deeds GROUP BY 1""", ("deeds",))
def ru_l2(spark, d):
    k = D.registration_window(A.deeds(spark, d))
    return k.groupBy("parcel").agg(F.count_if(F.col("k.passed")).alias("passed"), F.count(F.lit(1)).alias("deeds"))


@query("ru_l3_property_identity", "SELECT bundle_id, 'L3' AS rule_id, CASE WHEN k % 11 = 6 THEN 'FAIL' ELSE 'PASS' END AS status FROM land", ("land",))
def ru_l3(spark, d):
    return D.property_identity(survey_values(spark, d))


@query("ru_l4_extent", """
    SELECT bundle_id, 'L4' AS rule_id, CASE WHEN NOT unit_known THEN 'NOT_EVALUATED' WHEN abs(deed_extent - record_sqm) <= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status FROM land""", ("land",))
def ru_l4(spark, d):
    return D.extent_agreement(L.land_bundles(spark, d))


@query("ru_l5_stamp_duty", """
    SELECT bundle_id, 'L5' AS rule_id, CASE WHEN rate_pct IS NULL THEN 'NOT_EVALUATED'
      WHEN abs(duty_p * 100 - rate_pct * greatest(consideration_p, guidance_p)) * 20 <= rate_pct * greatest(consideration_p, guidance_p) THEN 'PASS' ELSE 'FAIL' END AS status FROM land""", ("land",))
def ru_l5(spark, d):
    return D.stamp_duty(L.land_bundles(spark, d), L.duty_rates(spark, d))


@query("ru_l6_encumbrance", _ENC)
def ru_l6(spark, d):
    cert, deed = L.encumbrances(spark, d)
    return D.encumbrance_disclosure(cert, deed, table(spark, d, "part").select(F.col("p_partkey").alias("bundle_id")))


_LINKS = """(SELECT parcel, executed <= lag(executed) OVER w AS df, seller <> lag(buyer) OVER w AS nf, lag(buyer) OVER w IS NOT NULL AS link
    FROM deeds WINDOW w AS (PARTITION BY parcel ORDER BY executed, deed_id, consideration_p))"""


@query("ru_l7_chain_of_title", f"""
    SELECT parcel, count(*) AS links, count_if(df)::BIGINT AS date_faults, count_if(nf)::BIGINT AS name_faults,
      CASE WHEN count_if(df) = 0 AND count_if(nf) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM (
      SELECT parcel, df, CASE WHEN nf THEN true ELSE false END AS nf FROM {_LINKS} WHERE link) GROUP BY 1""", ("deeds",))
def ru_l7(spark, d):
    return D.chain_result(A.deeds(spark, d).withColumn(
        "seller", F.regexp_replace("seller", "^ASHA (.)OWNER$", "ASHA $1$1$1OWNER")).withColumn(
        "buyer", F.regexp_replace("buyer", "^ASHA (.)OWNER$", "ASHA $1$1$1OWNER")))


def _legal(fn, spark, d):
    return tidy(fn(L.agreement_claims(spark, d)))


def _g(rule: str, status: str, code: str = "''", expected: str = "-1.0::DOUBLE", printed: str = "-1.0::DOUBLE") -> str:
    return (f"SELECT doc_id, '{rule}' AS rule_id, {status} AS status, {code} AS reason_code, -1::INT AS at_index, "
            f"{expected} AS expected, {printed} AS printed FROM agreements")


_BAD_WORDS = "(unreadable AND paise = 50) OR (NOT unreadable AND abs(whole * 100 + paise - consideration_p) > 100)"


@query("ru_g1_words_figures", _g(
    "G1", f"CASE WHEN unreadable AND paise = 0 THEN 'NOT_EVALUATED' WHEN {_BAD_WORDS} THEN 'FAIL' ELSE 'PASS' END",
    expected=f"CASE WHEN {_BAD_WORDS} THEN CASE WHEN unreadable THEN 0.5 ELSE (whole * 100 + paise) / 100.0 END ELSE -1.0 END",
    printed=f"CASE WHEN {_BAD_WORDS} THEN consideration_p / 100.0 ELSE -1.0 END"), ("agreements",))
def ru_g1(spark, d):
    return _legal(G.g1, spark, d)


@query("ru_g2_term", _g("G2", "CASE WHEN abs(end_date - due_date) <= 1 THEN 'PASS' ELSE 'FAIL' END"), ("agreements",))
def ru_g2(spark, d):
    return _legal(G.g2, spark, d)


@query("ru_g3_party_names", _g("G3", "CASE WHEN k % 21 = 8 THEN 'FAIL' ELSE 'PASS' END"), ("agreements",))
def ru_g3(spark, d):
    return _legal(G.g3, spark, d)


@query("ru_g4_schedules", _g("G4", "CASE WHEN k % 15 = 2 THEN 'FAIL' ELSE 'PASS' END",
                             "CASE WHEN k % 15 = 2 THEN 'schedule B' ELSE '' END"), ("agreements",))
def ru_g4(spark, d):
    return _legal(G.g4, spark, d)


@query("ru_g5_pages", _g("G5", "CASE WHEN k % 16 IN (7, 9) THEN 'FAIL' ELSE 'PASS' END",
                         "CASE k % 16 WHEN 7 THEN 'missing' WHEN 9 THEN 'repeated' ELSE '' END"), ("agreements",))
def ru_g5(spark, d):
    return _legal(G.g5, spark, d)


@query("ru_g6_execution", _g("G6", "CASE WHEN k % 18 IN (4, 9, 13) THEN 'FAIL' ELSE 'PASS' END",
                             "CASE k % 18 WHEN 4 THEN 'signatures' WHEN 9 THEN 'witnesses' WHEN 13 THEN 'undated' ELSE '' END"), ("agreements",))
def ru_g6(spark, d):
    return _legal(G.g6, spark, d)


@query("ru_g7_instalment", "SELECT doc_id, 'G7' AS rule_id, CASE WHEN emi_shift > 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM agreements", ("agreements",))
def ru_g7(spark, d):
    a = L.agreements(spark, d).withColumn("principal", F.col("principal_p") / 100)
    return G.g7(a).select("doc_id", "rule_id", "status")


# -- parsed statements ----------------------------------------------------------------------------------------------
def statements(spark, d):
    led = A.ledger(spark, d)
    s = A.summary(led)
    k = F.col("acct")
    stmts = s.select(
        "doc_id", "opening_p", F.when(k % 19 != 3, F.col("closing_p")).alias("closing_p"), "total_debits_p",
        "total_credits_p", F.when(k % 13 == 4, F.lit(50000)).otherwise(0).cast("bigint").alias("interest_p"),
        F.lit(0).cast("bigint").alias("charges_p"), (k % 37 == 1).cast("int").alias("uncaptured"))
    bounds = s.select("doc_id", F.col("closing_p").alias("close_p"),
                      F.when(k % 41 == 6, F.col("closing_p") + 70000).otherwise(F.col("closing_p")).alias("open_p"))
    return stmts, led.select("doc_id", "idx", "credit_p", "debit_p", "balance_p"), bounds


cte("statement", """
    WITH RECURSIVE s AS (SELECT doc_id, acct, opening_p, CASE WHEN acct % 19 <> 3 THEN closing_p END AS closing_p, total_debits_p,
        total_credits_p, CASE WHEN acct % 13 = 4 THEN 50000 ELSE 0 END AS extra, CASE WHEN acct % 37 = 1 THEN 1 ELSE 0 END AS uncaptured,
        closing_p AS close_p, closing_p + CASE WHEN acct % 41 = 6 THEN 70000 ELSE 0 END AS open_p FROM summary),
    v AS (SELECT doc_id, abs(b) AS b FROM (SELECT doc_id, balance_p AS b FROM ledger UNION ALL SELECT doc_id, opening_p FROM s
        UNION ALL SELECT doc_id, closing_p FROM s) WHERE b IS NOT NULL AND b <> 0),
    sc AS (SELECT doc_id, median(b) AS scale FROM v GROUP BY 1),
    l AS (SELECT doc_id, idx, coalesce(credit_p, 0) - coalesce(debit_p, 0) AS mv, balance_p AS b FROM ledger),
    walk AS (
      SELECT doc_id, -1::BIGINT AS idx, opening_p AS run, 0 AS brk, 0 AS mis, 0 AS chk, 0::BIGINT AS dmax, -1::BIGINT AS fb FROM s
      UNION ALL
      SELECT w.doc_id, l.idx,
        CASE WHEN l.b IS NULL THEN run + mv WHEN abs(run + mv - l.b) > 100 AND scale > 0 AND abs(l.b) < scale * 0.005::DOUBLE THEN run + mv ELSE l.b END,
        brk + CASE WHEN l.b IS NOT NULL AND abs(run + mv - l.b) > 100 AND NOT (scale > 0 AND abs(l.b) < scale * 0.005::DOUBLE) THEN 1 ELSE 0 END,
        mis + CASE WHEN l.b IS NOT NULL AND abs(run + mv - l.b) > 100 AND scale > 0 AND abs(l.b) < scale * 0.005::DOUBLE THEN 1 ELSE 0 END,
        chk + CASE WHEN l.b IS NULL OR (abs(run + mv - l.b) > 100 AND scale > 0 AND abs(l.b) < scale * 0.005::DOUBLE) THEN 0 ELSE 1 END,
        greatest(dmax, CASE WHEN l.b IS NOT NULL AND abs(run + mv - l.b) > 100 AND NOT (scale > 0 AND abs(l.b) < scale * 0.005::DOUBLE) THEN abs(run + mv - l.b) ELSE 0 END),
        CASE WHEN fb < 0 AND l.b IS NOT NULL AND abs(run + mv - l.b) > 100 AND NOT (scale > 0 AND abs(l.b) < scale * 0.005::DOUBLE) THEN l.idx ELSE fb END
      FROM walk w JOIN l ON l.doc_id = w.doc_id AND l.idx = w.idx + 1 JOIN sc ON sc.doc_id = w.doc_id),
    fin AS (SELECT doc_id, arg_max(struct_pack(brk, mis, chk, dmax, fb), idx) AS w FROM walk GROUP BY 1),
    t AS (SELECT doc_id, count(balance_p) AS nb, coalesce(sum(credit_p), 0) AS cr, coalesce(sum(debit_p), 0) AS dr,
        arg_max(balance_p, idx) FILTER (balance_p IS NOT NULL) AS last_p, count(*) AS nm FROM ledger GROUP BY 1),
    a AS (SELECT s.*, scale, w, nb, cr, dr, last_p, nm, abs(closing_p) < scale * 0.005::DOUBLE AS coff, abs(last_p) < scale * 0.005::DOUBLE AS loff,
        abs(close_p) < scale * 0.005::DOUBLE OR abs(open_p) < scale * 0.005::DOUBLE AS zoff FROM s JOIN sc USING (doc_id) JOIN fin USING (doc_id) JOIN t USING (doc_id)),
    b AS (SELECT *, closing_p IS NOT NULL AND last_p IS NOT NULL AND NOT (coff OR loff) AND abs(last_p + extra - closing_p) > 100 AS v2,
        abs(dr - total_debits_p) > 100 AS v3d, abs(cr - total_credits_p) > 100 AS v3c,
        closing_p IS NOT NULL AND NOT coff AND abs(opening_p + cr - dr + extra - closing_p) > 100 AS v4, NOT zoff AND abs(close_p - open_p) > 100 AS v5 FROM a)
    SELECT doc_id, scale, nb >= 2 AND nm >= 1 AS enough, uncaptured, w.brk AS chain_breaks, w.fb AS first_break, v2, v3d, v3c, v4, v5,
      w.mis + CASE WHEN closing_p IS NOT NULL AND last_p IS NOT NULL AND (coff OR loff) THEN 1 ELSE 0 END
        + CASE WHEN closing_p IS NOT NULL AND coff THEN 1 ELSE 0 END + CASE WHEN zoff THEN 1 ELSE 0 END AS unreadable,
      w.brk + CASE WHEN v2 THEN 1 ELSE 0 END + CASE WHEN v3d THEN 1 ELSE 0 END + CASE WHEN v3c THEN 1 ELSE 0 END + CASE WHEN v4 THEN 1 ELSE 0 END
        + CASE WHEN v5 THEN 1 ELSE 0 END AS violations,
      greatest(w.dmax, CASE WHEN v2 THEN abs(last_p + extra - closing_p) ELSE 0 END, CASE WHEN v3d THEN abs(dr - total_debits_p) ELSE 0 END,
        CASE WHEN v3c THEN abs(cr - total_credits_p) ELSE 0 END, CASE WHEN v4 THEN abs(opening_p + cr - dr + extra - closing_p) ELSE 0 END,
        CASE WHEN v5 THEN abs(close_p - open_p) ELSE 0 END) AS residual FROM b
    """, "ledger", "summary")


@query("ru_02_statement_arithmetic", """
    SELECT doc_id, enough, chain_breaks::BIGINT AS chain_breaks, first_break::INT AS first_break, v2::INT AS closing_bad, v3d::INT AS debits_bad, v3c::INT AS credits_bad,
      v4::INT AS net_bad, v5::BIGINT AS zip_breaks, unreadable::BIGINT AS unreadable, violations::BIGINT AS violations, residual::BIGINT AS residual_p FROM statement""", ("statement",))
def ru_02(spark, d):
    s, t, b = statements(spark, d)
    return S.violations(s, t, b, A.ledger_keys(spark, d)).select(
        "doc_id", "enough", "chain_breaks", "first_break", "closing_bad", "debits_bad", "credits_bad", "net_bad",
        "zip_breaks", "unreadable", "violations", "residual_p")


@query("ru_03_statement_scale", "SELECT doc_id, scale AS scale_p FROM statement", ("statement",))
def ru_03(spark, d):
    s, t, _ = statements(spark, d)
    return S.statement_scale(s, t, A.ledger_keys(spark, d))


_GRADE = """SELECT doc_id, CASE WHEN NOT enough THEN 'NOT_EVALUATED' WHEN violations > 0 AND uncaptured > 0 THEN 'NOT_EVALUATED'
      WHEN violations = 0 AND unreadable > 0 THEN 'NOT_EVALUATED' ELSE 'VALID' END AS status,
      CASE WHEN violations = 0 THEN 0.0 WHEN chain_breaks > 0 OR v5 THEN least(1.0, round(0.9 + 0.05 * (violations - 1), 4))
        WHEN scale > 0 AND residual >= scale * 0.1::DOUBLE THEN 0.4 ELSE 0.3 END::DOUBLE AS suspicion FROM statement"""


@query("ru_04_completeness_abstain", f"SELECT status, count(*) AS documents FROM ({_GRADE}) GROUP BY 1", ("statement",))
def ru_04(spark, d):
    return S.grade(S.violations(*statements(spark, d), A.ledger_keys(spark, d))).groupBy("status").agg(F.count(F.lit(1)).alias("documents"))


@query("ru_05_failure_grading", f"SELECT doc_id, status, CASE WHEN status = 'VALID' THEN suspicion ELSE -1.0 END AS suspicion FROM ({_GRADE})", ("statement",))
def ru_05(spark, d):
    return S.grade(S.violations(*statements(spark, d), A.ledger_keys(spark, d))).select(
        "doc_id", "status", F.coalesce("suspicion", F.lit(-1.0)).alias("suspicion"))


@query("ru_06_misfiled_columns", "SELECT doc_id, idx::INT AS index FROM misfiled", ("misfiled",))
def ru_06(spark, d):
    return R.misfiled_rows(bank_view(spark, d)[0], A.ledger_keys(spark, d))


@query("ru_07_swap_explanation", """
    SELECT doc_id, idx::INT AS index FROM chain WHERE broken AND x IS NULL AND (cr IS NOT NULL OR dr IS NOT NULL)
      AND abs(expected - 2 * (coalesce(cr, 0) - coalesce(dr, 0)) - bal) <= 100""", ("chain",))
def ru_07(spark, d):
    from docassay.operators.checks import linear_balance

    t, s = bank(spark, d)
    return R.swap_rows(linear_balance(R.chain_rows(t, s), ["doc_id"], A.ledger_keys(spark, d)).filter("broken"))


cte("claim_signal", """
    WITH v AS (SELECT doc_id, abs(b) AS b FROM (SELECT doc_id, bal AS b FROM trusted UNION ALL SELECT doc_id, opening_p FROM totals
        UNION ALL SELECT doc_id, closing_p FROM totals) WHERE b IS NOT NULL AND b <> 0),
    sc AS (SELECT doc_id, median(b) AS scale FROM v GROUP BY 1),
    g AS (SELECT doc_id, count_if(status = 'FAIL') AS failed, count_if(status = 'PASS') AS passed,
        count_if(status = 'FAIL' AND rule_id IN ('F1', 'F2', 'F3', 'F4')) AS arith, count_if(status = 'FAIL' AND rule_id = 'F1') AS ch,
        max(CASE rule_id WHEN 'F5' THEN 0.45 WHEN 'F7' THEN 0.6 ELSE 0.9 END) FILTER (status = 'FAIL') AS worst,
        max(abs(printed - expected)) FILTER (status = 'FAIL' AND rule_id IN ('F2', 'F3', 'F4')) AS residual FROM financial GROUP BY 1)
    SELECT g.doc_id, CASE WHEN failed = 0 AND passed = 0 THEN 'NOT_EVALUATED' ELSE 'VALID' END AS status,
      CASE WHEN failed = 0 AND passed = 0 THEN -1.0 WHEN failed = 0 THEN 0.0
        WHEN ch = 0 AND arith = failed THEN CASE WHEN coalesce(scale, 0) > 0 AND residual * 100 >= scale * 0.1::DOUBLE THEN 0.4 ELSE 0.3 END
        ELSE worst END::DOUBLE AS suspicion,
      failed::BIGINT AS rules_failed, passed::BIGINT AS rules_passed
    FROM g LEFT JOIN sc ON g.doc_id = sc.doc_id""", "trusted", "totals", "financial")


def claim_signal(spark, d, claims=None, view=None):
    claims = durable(A.claims(spark, d)) if claims is None else claims
    keys = A.ledger_keys(spark, d)
    view = view or R.statement_view(claims)
    return R.consistency_signal(R.evaluate_financial(claims, keys, view), R.claim_scale(*view, keys))


@query("ru_08_consistency_signal", "SELECT * FROM claim_signal", ("claim_signal",))
def ru_08(spark, d):
    return claim_signal(spark, d).select("doc_id", "status", F.coalesce("suspicion", F.lit(-1.0)).alias("suspicion"),
                                         "rules_failed", "rules_passed")


@query("ru_09_edit_grid", """
    WITH RECURSIVE f AS (SELECT unnest(['credit', 'debit', 'balance']) AS field), dl AS (SELECT unnest([5000, 250000, -150000]) AS delta),
    base AS (SELECT acct, n, opening + c1 - d1 AS b0, c1, d1, opening FROM (SELECT c_custkey AS acct, abs(CAST(round(c_acctbal * 100) AS BIGINT)) + 1000000 AS opening,
        500000 AS c1, 200000 AS d1, 3 AS n FROM customer))
    SELECT field, delta::BIGINT AS delta, count(*) AS variants, count(*) AS caught FROM base, f, dl, (SELECT unnest([0, 1, 2]) AS r)
    WHERE field = 'balance' OR (field = 'credit' AND r <> 1) OR (field = 'debit' AND r = 1) GROUP BY 1, 2""")
def ru_09(spark, d):
    c = spread(table(spark, d, "customer").select("c_custkey", "c_acctbal")).select(
        F.col("c_custkey").cast("string").alias("doc_id"),
        (F.abs(F.round(F.col("c_acctbal") * 100)) + 1000000).cast("bigint").alias("opening_p"))
    rows = F.array(
        F.struct(F.lit(0).alias("idx"), F.lit(500000).cast("bigint").alias("credit_p"), F.lit(None).cast("bigint").alias("debit_p"),
                 (F.col("opening_p") + 500000).alias("balance_p")),
        F.struct(F.lit(1).alias("idx"), F.lit(None).cast("bigint").alias("credit_p"), F.lit(200000).cast("bigint").alias("debit_p"),
                 (F.col("opening_p") + 300000).alias("balance_p")),
        F.struct(F.lit(2).alias("idx"), F.lit(100000).cast("bigint").alias("credit_p"), F.lit(None).cast("bigint").alias("debit_p"),
                 (F.col("opening_p") + 400000).alias("balance_p")))
    txns = c.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")
    zero = F.lit(0).cast("bigint")
    stmts = c.select("doc_id", "opening_p", (F.col("opening_p") + 400000).alias("closing_p"),
                     F.lit(200000).cast("bigint").alias("total_debits_p"), F.lit(600000).cast("bigint").alias("total_credits_p"),
                     zero.alias("interest_p"), zero.alias("charges_p"), F.lit(0).alias("uncaptured"))
    heads, edited = S.edit_grid(stmts, txns)
    v = S.violations(heads.drop("field"), edited, base=stmts)
    parts = F.split("doc_id", r"\|")
    return v.select(F.regexp_replace(F.get(parts, F.lit(2)), "_p$", "").alias("field"),
                    F.get(parts, F.lit(3)).cast("bigint").alias("delta"), "violations").groupBy("field", "delta").agg(
        F.count(F.lit(1)).alias("variants"), F.count_if(F.col("violations") > 0).alias("caught"))


# -- anomalies ------------------------------------------------------------------------------------------------------
cte("salary", r"""SELECT *, regexp_matches(narration, '(?i)\b(sal(ary)?|payroll|wages|remuneration|stipend)\b') AND cr IS NOT NULL AS sal FROM trusted""", "trusted")
cte("anomalies", """
    SELECT doc_id, 'A_FIN_1' AS anomaly_id, n >= 3 AS evaluated, n >= 3 AND r / n >= 0.6 AS triggered, CASE WHEN n >= 3 THEN round(r / n, 6) ELSE -1.0 END AS measure
    FROM (SELECT doc_id, count_if(sal)::DOUBLE AS n, count_if(sal AND cr % 500000 = 0)::DOUBLE AS r FROM salary GROUP BY 1)
    UNION ALL
    SELECT d.doc_id, 'A_FIN_2', coalesce(m, 0) >= 2, coalesce(m, 0) >= 2 AND coalesce(w, 0) > 2, CASE WHEN coalesce(m, 0) >= 2 THEN round(coalesce(w, 0), 6) ELSE -1.0 END
    FROM (SELECT DISTINCT doc_id FROM ledger) d LEFT JOIN (
      SELECT doc_id, count(*) AS m, max(CASE WHEN a > 0 THEN greatest(t / a, a / t) END) AS w FROM (
        SELECT doc_id, t::DOUBLE AS t, lag(t::DOUBLE) OVER (PARTITION BY doc_id ORDER BY mon) AS a FROM (
          SELECT doc_id, date_trunc('month', posted) AS mon, sum(cr) AS t FROM salary WHERE sal GROUP BY 1, 2)) GROUP BY 1) USING (doc_id)
    UNION ALL
    SELECT doc_id, 'A_FIN_3', true, period_end - period_start BETWEEN 0 AND 59, (period_end - period_start)::DOUBLE FROM summary
    """, "salary", "ledger", "summary")


def findings(spark, d, claims=None, txns=None):
    c = (A.claims(spark, d) if claims is None else claims).filter(F.col("doc_type") == "BANK_STATEMENT")
    t = durable(K.transactions(c)) if txns is None else txns  # written once: two detectors read it, one of them twice
    p = K.scalars(c, ["period_start", "period_end"]).select(
        "doc_id", F.to_date("period_start").alias("period_start"), F.to_date("period_end").alias("period_end"))
    return N.round_salary(t), N.salary_jump(t, A.ledger_keys(spark, d)), N.short_window(p)


for _i, _name in enumerate(("round_salary", "salary_jump", "short_window")):
    query(f"an_0{_i + 1}_{_name}", f"SELECT * FROM anomalies WHERE anomaly_id = 'A_FIN_{_i + 1}'", ("anomalies",))(
        lambda spark, d, i=_i: findings(spark, d)[i])


@query("an_04_dormant_revival", """
    WITH h AS (SELECT doc_id, posted AS day, coalesce(sum(credit_p), 0)::BIGINT AS c FROM ledger GROUP BY 1, 2),
    w AS (SELECT *, day - lag(day) OVER o AS gap, (sum(c) OVER o - c)::BIGINT AS prior FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY day)),
    g AS (SELECT doc_id, count(*) AS days, sum(c) AS al, arg_max([gap, prior], gap * 100000 - (day - DATE '1970-01-01')) FILTER (gap IS NOT NULL) AS x FROM w GROUP BY 1)
    SELECT doc_id, 'A_FIN_4' AS anomaly_id, days >= 2 AS evaluated, coalesce(days >= 2 AND x[1] >= 180 AND al - x[2] >= 2 * x[2] AND al - x[2] > 0, false) AS triggered,
      coalesce(x[1], -1)::DOUBLE AS measure FROM g""", ("ledger",))
def an_04(spark, d):
    from docassay.sources.tables import rupees

    h = A.ledger(spark, d).select("doc_id", F.col("posted").alias("day"), rupees("credit_p").alias("credit"))
    return N.dormant_revival(h, base=A.ledger_keys(spark, d))


@query("an_05_rapid_resale", """
    SELECT parcel, count(*) AS transfers, coalesce(min(executed - prev), -1)::INT AS shortest_gap, count(*) >= 2 AS evaluated, coalesce(min(executed - prev) <= 30, false) AS triggered
    FROM (SELECT *, lag(executed) OVER (PARTITION BY parcel ORDER BY executed, deed_id, consideration_p) AS prev FROM deeds) GROUP BY 1""", ("deeds",))
def an_05(spark, d):
    return D.rapid_resale(A.deeds(spark, d)).withColumn("triggered", F.coalesce("triggered", F.lit(False)))


@query("an_06_guidance_value", """
    SELECT bundle_id, round(consideration_p / guidance_p, 6) AS ratio, true AS evaluated, NOT (consideration_p / guidance_p BETWEEN 0.5 AND 2.0) AS triggered FROM land""", ("land",))
def an_06(spark, d):
    return D.value_far_from_guidance(L.land_bundles(spark, d))


@query("an_07_reused_property", "SELECT parcel, count(DISTINCT applicant) AS applicants FROM deeds GROUP BY 1 HAVING count(DISTINCT applicant) > 1", ("deeds",))
def an_07(spark, d):
    return D.reused_property(A.deeds(spark, d))


@query("an_08_reused_agreement", """
    SELECT sha256(parties || '|' || amt) AS digest, count(DISTINCT applicant) AS applicants FROM (
      SELECT applicant, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (k % 26)::INT + 1, 1) AS parties, consideration_p AS amt FROM agreements) GROUP BY 1 HAVING count(DISTINCT applicant) > 1""", ("agreements",))
def an_08(spark, d):
    from docassay.sources.tables import letter

    a = L.agreements(spark, d).select("applicant", letter(F.col("k")).alias("parties"), F.col("consideration_p").alias("amount_p"))
    return N.reused_agreement(a)


@query("an_09_missing_blocks", r"""
    WITH h AS (SELECT DISTINCT trim(regexp_replace(lower(l), '\s+', ' ', 'g')) AS heading FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM benchmark)),
    n AS (SELECT count(*) AS n FROM h),
    p AS (SELECT doc_id, count(DISTINCT x) AS present FROM (SELECT doc_id, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '\s+', ' ', 'g')) AS x FROM documents) WHERE x IN (SELECT heading FROM h) GROUP BY 1)
    SELECT 'D' || d.doc_id AS doc_id, 'A_LEGAL_2' AS anomaly_id, true AS evaluated, (n - coalesce(present, 0)) / n > 0.5 AS triggered, round((n - coalesce(present, 0)) / n, 6) AS measure
    FROM documents d CROSS JOIN n LEFT JOIN p USING (doc_id)""")
def an_09(spark, d):
    b = table(spark, d, "benchmark").select(F.explode(F.split("text", "\n")).alias("l"))
    h = b.select(F.trim(F.regexp_replace(F.lower("l"), r"\s+", " ")).alias("heading")).distinct()
    docs = table(spark, d, "documents").select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    return N.missing_blocks(docs, h)


@query("an_10_anomaly_signal", """
    SELECT doc_id, 'anomaly_intelligence' AS name, CASE WHEN bool_or(evaluated) THEN 'VALID' ELSE 'NOT_EVALUATED' END AS status,
      CASE WHEN NOT bool_or(evaluated) THEN -1.0 WHEN bool_or(triggered) THEN 0.4 ELSE 0.0 END::DOUBLE AS suspicion,
      count_if(evaluated)::BIGINT AS evaluated, count_if(triggered)::BIGINT AS triggered FROM anomalies GROUP BY 1""", ("anomalies",))
def an_10(spark, d):
    a, b, c = findings(spark, d)
    return N.anomaly_signal(a.unionByName(b).unionByName(c))


# -- land bridge -----------------------------------------------------------------------------------------------------
@query("co09_title_chain", f"""
    SELECT bundle_id, CASE WHEN k % 9 = 4 OR coalesce(df + nf, 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM land LEFT JOIN (
      SELECT parcel, count_if(df) AS df, count_if(nf) AS nf FROM {_LINKS} GROUP BY 1) ON parcel = bundle_id""", ("land", "deeds"))
def co09(spark, d):
    wide = A.deeds(spark, d)
    for c in ("seller", "buyer"):
        wide = wide.withColumn(c, F.regexp_replace(c, "^ASHA (.)OWNER$", "ASHA $1$1$1OWNER"))
    chain = D.chain_result(wide).select(F.col("parcel").alias("bundle_id"), "status")
    return D.title_chain(L.land_bundles(spark, d), chain)


@query("co10_collateral_match", "SELECT bundle_id, 'P0' AS property_id FROM land WHERE k % 6 = 4", ("land",))
def co10(spark, d):
    b = L.land_bundles(spark, d)
    loans = b.select("bundle_id", F.col("loan_property").alias("property_id"))
    return D.collateral_mismatch(loans, b.select("bundle_id", F.col("deed_property").alias("property_id")))


@query("co12_consideration_agreement", """
    SELECT bundle_id, true AS evaluated, g <= 100 AS passed, g AS gap_p FROM (SELECT bundle_id, greatest(agreement_p, consideration_p, paid_p) - least(agreement_p, consideration_p, paid_p) AS g FROM land)""", ("land",))
def co12(spark, d):
    return D.consideration_agreement(L.land_bundles(spark, d))
