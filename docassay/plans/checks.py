"""Queries over the check catalogue (inventory CK)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.functions.identity import verhoeff_ok
from docassay.functions.names import text_ratio
from docassay.functions.numwords import words_to_decimal
from docassay.operators import checks as C
from docassay.plans.oracle_inputs import _digit
from docassay.plans.registry import query
from docassay.sources import adapters as A
from docassay.sources import adapters_legal as L
from docassay.sources.tables import rupees, table


def flat(df, keys, col="k"):
    """Outcome struct to columns, without nulls."""
    c = F.col(col)
    return df.select(*keys, c["evaluated"].alias("evaluated"), c["passed"].alias("passed"))


@query("ck01_regex_validate", """
    SELECT bundle_id, ord::INT AS ord, true AS evaluated, regexp_full_match(pan, '[A-Z]{5}[0-9]{4}[A-Z]') AS passed FROM entities""", ("entities",))
def ck01(spark, d):
    e = A.entities(spark, d).withColumn("k", C.regex_validate(F.col("pan"), "^[A-Z]{5}[0-9]{4}[A-Z]$"))
    return flat(e, ["bundle_id", F.col("ord").cast("int").alias("ord")])


@query("ck02_checksum", f"""
    SELECT bundle_id, ord::INT AS ord, {_digit('aadhaar', 0)} = 0 AS passed FROM entities, vtab WHERE aadhaar IS NOT NULL""",
       ("entities", "vtab"))
def ck02(spark, d):
    e = A.entities(spark, d).filter(F.col("aadhaar").isNotNull())
    return e.select("bundle_id", F.col("ord").cast("int").alias("ord"), verhoeff_ok(F.col("aadhaar")).alias("passed"))


@query("ck03_equation", """
    SELECT cust, true AS evaluated, abs(gross_p - deductions_p - net_p) <= 100 AS passed FROM income""", ("income",))
def ck03(spark, d):
    i = A.income(spark, d)
    i = i.withColumn("k", C.equation([(1, rupees("gross_p")), (-1, rupees("deductions_p"))], rupees("net_p")))
    return flat(i, ["cust"])


def ledger_rows(spark, d):
    """Trusted ledger rows straight from the ledger (no claim pivot)."""
    led = A.ledger(spark, d)
    move = (F.col("conf") >= 0.55) & F.col("move_agree")
    bal = (F.col("conf") >= 0.55) & F.col("bal_agree")
    return led.select(
        "doc_id", F.col("idx").alias("index"), F.when(move, rupees("credit_p")).alias("credit"),
        F.when(move, rupees("debit_p")).alias("debit"), F.when(bal, rupees("balance_p")).alias("printed"),
        rupees("opening_p").alias("anchor"), F.when(F.col("conf") >= 0.55, F.col("posted")).alias("posted"))


@query("ck04_linear_balance", """
    SELECT doc_id, idx::INT AS index, expected / 100.0 AS expected, bal / 100.0 AS printed, unread::BIGINT AS unread
    FROM chain WHERE broken""", ("chain",))
def ck04(spark, d):
    rows = C.linear_balance(ledger_rows(spark, d), ["doc_id"], A.ledger_keys(spark, d)).filter("broken")
    return rows.select("doc_id", "index", F.col("expected").cast("double").alias("expected"),
                       F.col("printed").cast("double").alias("printed"), "unread")


@query("ck05_sum_equals", """
    SELECT s.doc_id, abs(coalesce(c, 0) - s.total_credits_p) <= 100 AS passed FROM summary s
    LEFT JOIN (SELECT doc_id, sum(credit_p) AS c FROM ledger GROUP BY 1) t ON s.doc_id = t.doc_id""", ("summary",))
def ck05(spark, d):
    led = A.ledger(spark, d)
    stated = A.summary(led).select("doc_id", rupees("total_credits_p").alias("stated"))
    out = C.sum_equals(led.select("doc_id", rupees("credit_p").alias("credit")), stated, ["doc_id"], "credit")
    return out.select("doc_id", F.col("check.passed").alias("passed"))


@query("ck06_comparison", """
    SELECT cust, taxable_p <= annual_gross_p AS le, taxable_p > annual_gross_p AS gt, taxable_p <> annual_gross_p AS ne FROM income""", ("income",))
def ck06(spark, d):
    i = A.income(spark, d)
    t, g = rupees("taxable_p"), rupees("annual_gross_p")
    return i.select("cust", *[C.comparison(t, op, g)["passed"].alias(n) for op, n in (("<=", "le"), (">", "gt"), ("!=", "ne"))])


@query("ck07_range", """
    SELECT l_orderkey, l_linenumber, count_if(l_discount BETWEEN 0.02 AND 0.08)::BIGINT AS inside, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def ck07(spark, d):
    li = table(spark, d, "lineitem").withColumn("k", C.in_range(F.col("l_discount"), 0.02, 0.08))
    return li.groupBy("l_orderkey", "l_linenumber").agg(
        F.count_if(F.col("k.passed")).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("ck08_date_order", """
    SELECT deed_id, count_if(executed <= registered)::BIGINT AS in_order, count(*) AS n FROM deeds GROUP BY 1""", ("deeds",))
def ck08(spark, d):
    k = A.deeds(spark, d).withColumn("k", C.date_order(F.col("executed"), "<=", F.col("registered")))
    return k.groupBy("deed_id").agg(F.count_if(F.col("k.passed")).alias("in_order"), F.count(F.lit(1)).alias("n"))


@query("ck09_date_within", """
    SELECT deed_id, count_if(registered BETWEEN executed AND (executed + INTERVAL 4 MONTH)::DATE)::BIGINT AS inside, count(*) AS n
    FROM deeds GROUP BY 1""", ("deeds",))
def ck09(spark, d):
    k = A.deeds(spark, d).withColumn("k", C.date_within(F.col("registered"), F.col("executed"), 4))
    return k.groupBy("deed_id").agg(F.count_if(F.col("k.passed")).alias("inside"), F.count(F.lit(1)).alias("n"))


@query("ck10_date_offset", "SELECT doc_id, abs(end_date - due_date) <= 1 AS passed FROM agreements", ("agreements",))
def ck10(spark, d):
    a = L.agreements(spark, d)
    k = C.date_offset_equals(F.col("effective"), F.col("term"), F.col("end_date"), 1)
    return a.select("doc_id", k["passed"].alias("passed"))


@query("ck11_monotonic", """
    SELECT doc_id, count(*) >= 2 AS evaluated, coalesce(count_if(day < prev), 0)::BIGINT AS breaks, coalesce(min(idx) FILTER (day < prev), -1)::INT AS first_break
    FROM (SELECT *, lag(day) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM trusted WHERE day IS NOT NULL) GROUP BY 1""", ("trusted",))
def ck11(spark, d):
    m = C.monotonic_outcome(ledger_rows(spark, d), ["doc_id"], "index", "posted", base=A.ledger_keys(spark, d))
    return m.withColumn("first_break", F.coalesce("first_break", F.lit(-1)))


@query("ck11_strict", """
    SELECT user_id, count(*) >= 2 AS evaluated, count_if(v <= prev)::BIGINT AS breaks
    FROM (SELECT user_id, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events) GROUP BY 1""")
def ck11_strict(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return C.monotonic_outcome(e, ["user_id"], "event_id", "value", strict=True).drop("first_break")


@query("ck12_words_equal_figures", """
    SELECT doc_id, NOT unreadable OR paise = 50 AS evaluated, NOT unreadable AND abs(whole * 100 + paise - consideration_p) <= 100 AS passed
    FROM agreements""", ("agreements",))
def ck12(spark, d):
    a = L.agreements(spark, d)
    return flat(a.withColumn("k", C.words_equal_figures(F.col("words"), rupees("consideration_p"))), ["doc_id"])


RATIO = """CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0
  ELSE 1.0 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)) END"""


@query("ck13_fuzzy_match", f"""
    SELECT cust, round({RATIO}, 6) AS ratio, {RATIO} >= 0.85 AS passed FROM (SELECT cust,
      trim(regexp_replace(lower(employer), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(employer_proof), '[^a-z0-9]+', ' ', 'g')) AS b
      FROM income)""", ("income",))
def ck13(spark, d):
    i = A.income(spark, d)
    a, b = F.col("employer"), F.col("employer_proof")
    return i.select("cust", F.round(text_ratio(a, b), 6).alias("ratio"),
                    C.fuzzy_match(a, b, 0.85)["passed"].alias("passed"))


def party_names(spark, d):
    c = L.agreement_claims(spark, d)
    return c.filter(F.col("subject").startswith("party_") & (F.col("predicate") == "name"))


@query("ck14_all_equal_fuzzy", """
    SELECT doc_id, 'party_1' AS subject, true AS evaluated, k % 21 <> 8 AS passed,
      CASE WHEN k % 21 = 8 THEN 'Asha ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', (k % 26)::INT + 1, 1) || 'rao' ELSE '' END AS left_name,
      CASE WHEN k % 21 = 8 THEN 'Meera Nair' ELSE '' END AS right_name FROM agreements
    UNION ALL SELECT doc_id, 'party_2', true, true, '', '' FROM agreements""", ("agreements",))
def ck14(spark, d):
    return C.all_equal_fuzzy(party_names(spark, d), ["doc_id", "subject"], "ord", "value")


_ENC = """WITH c AS (SELECT DISTINCT l_partkey AS bundle_id, 'R' || l_orderkey AS ref FROM lineitem),
    e AS (SELECT DISTINCT l_partkey AS bundle_id, CASE WHEN l_orderkey % 29 = 4 THEN 'none' ELSE 'R' || l_orderkey END AS ref FROM lineitem),
    m AS (SELECT bundle_id, count(*) AS missing, min(ref) AS first_missing FROM c ANTI JOIN e USING (bundle_id, ref) GROUP BY 1)
    SELECT p_partkey AS bundle_id, b.bundle_id IS NOT NULL AS evaluated, b.bundle_id IS NOT NULL AND missing IS NULL AS passed,
      coalesce(missing, 0) AS missing, coalesce(first_missing, '') AS first_missing
    FROM part LEFT JOIN (SELECT DISTINCT bundle_id FROM e) b ON p_partkey = b.bundle_id LEFT JOIN m ON p_partkey = m.bundle_id"""


@query("ck15_set_subset", _ENC)
def ck15(spark, d):
    cert, deed = L.encumbrances(spark, d)
    universe = table(spark, d, "part").select(F.col("p_partkey").alias("bundle_id"))
    return C.set_subset(cert, deed, ["bundle_id"], "ref", universe)


@query("ck16_references_resolve", """
    SELECT doc_id, 2::BIGINT AS references, CASE WHEN k % 15 = 2 THEN 1 ELSE 0 END::BIGINT AS unresolved,
      CASE WHEN k % 15 = 2 THEN ' schedule B ' ELSE '' END AS first_unresolved FROM agreements""", ("agreements",))
def ck16(spark, d):
    c = L.agreement_claims(spark, d)
    return C.references_resolve(c.filter(F.col("predicate") == "refers_to"), c.filter(F.col("predicate") == "label"),
                                ["doc_id"], "value", "value")


@query("ck17_presence_count", """
    SELECT l_orderkey AS doc_id, count(*) >= 2 AS at_least_two, count(*) >= 1 AND count(*) = 3 AS exactly_three FROM lineitem GROUP BY 1""")
def ck17(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("doc_id", C.presence_count(F.col("n"), 2)["passed"].alias("at_least_two"),
                    C.presence_count(F.col("n"), 1, 3)["passed"].alias("exactly_three"))


@query("ck18_sequence_complete", """
    WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS num, count(*) AS k FROM lineitem GROUP BY 1, 2),
    e AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT doc_id, true AS evaluated, greatest(n - i, 0) = 0 AND r = 0 AND s = 0 AS passed, greatest(n - i, 0)::BIGINT AS missing,
      r::BIGINT AS repeated, s::BIGINT AS stray
    FROM (SELECT e.doc_id, e.n, count_if(num BETWEEN 1 AND e.n) AS i, count_if(k > 1) AS r, count_if(num NOT BETWEEN 1 AND e.n) AS s
          FROM e JOIN n ON e.doc_id = n.doc_id GROUP BY 1, 2)""")
def ck18(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("num"))
    expected = li.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return C.sequence_complete(li, expected, ["doc_id"], "num", "n")


@query("ck19_quantity_equal", """
    SELECT bundle_id, unit_known AS evaluated, unit_known AND abs(deed_extent - record_sqm) <= 0.5 AS passed FROM land""", ("land",))
def ck19(spark, d):
    b = L.land_bundles(spark, d)
    k = C.quantity_equal(b, ("deed_extent", "deed_unit"), ("record_extent", "record_unit"), "area", 0.5)
    return flat(k, ["bundle_id"], "check")


def survey_values(spark, d):
    b = L.land_bundles(spark, d)
    return b.select("bundle_id", F.explode(F.array("deed_survey", "record_survey", "certificate_survey")).alias("survey"))


@query("ck20_consistency_across", """
    SELECT bundle_id, CASE WHEN k % 10 <> 7 THEN 3 ELSE 2 END::BIGINT AS present, true AS evaluated, k % 11 <> 6 AS passed FROM land""", ("land",))
def ck20(spark, d):
    return C.consistency_across(survey_values(spark, d), ["bundle_id"], F.col("survey"))


@query("ck21_table_lookup", "SELECT bundle_id, coalesce(rate_pct, -1)::INT AS rate_pct, rate_pct IS NOT NULL AS evaluated FROM land", ("land",))
def ck21(spark, d):
    j = C.table_lookup(L.land_bundles(spark, d), L.duty_rates(spark, d), ["state"])
    return j.select("bundle_id", F.coalesce("rate_pct", F.lit(-1)).alias("rate_pct"),
                    F.col("rate_pct").isNotNull().alias("evaluated"))


@query("ck22_instalment", "SELECT doc_id, abs(emi_shift) <= 1 AS passed, round(emi_true, 2) AS computed FROM agreements", ("agreements",))
def ck22(spark, d):
    a = L.agreements(spark, d)
    p = F.col("principal_p") / 100
    k = C.formula_instalment(p, F.col("rate"), F.col("term"), F.col("emi"))
    return a.select("doc_id", k["passed"].alias("passed"), F.round(k["expected"], 2).alias("computed"))


@query("nj05_amounts_in_words", """
    SELECT doc_id, CASE WHEN unreadable THEN CASE WHEN paise = 50 THEN 0.5 ELSE -1.0 END
      ELSE (whole * 100 + paise) / 100.0 END::DOUBLE AS amount FROM agreements""", ("agreements",))
def nj05(spark, d):
    a = L.agreements(spark, d)
    return a.select("doc_id", F.coalesce(words_to_decimal(F.col("words")).cast("double"), F.lit(-1.0)).alias("amount"))
