"""Queries over normalisation jobs and word geometry (inventory NJ, WN, OR)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.functions import extract as X
from docassay.functions.dates import date_shape, parse_date, parse_pdf_date
from docassay.functions.hashing import hash_words, salted
from docassay.functions.money import numbers_in, parse_money
from docassay.functions.names import names_match
from docassay.operators import checks as C
from docassay.operators import layout as W
from docassay.operators import network as G
from docassay.operators import profiles as P
from docassay.plans import decide as DQ
from docassay.plans import network as NQ
from docassay.plans.oracle_inputs import _digit, cte
from docassay.plans.registry import query
from docassay.rulebook import TYPE_KEYWORDS
from docassay.sources import adapters as A
from docassay.sources import adapters_legal as L
from docassay.sources.tables import paise, rupees, table


def amount_texts(spark, d):
    """Order prices printed in several ways, some unreadable."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), paise("o_totalprice").alias("p"))
    plain, k = rupees("p").cast("string"), F.col("k") % 6
    return o.select("k", F.when(k == 0, plain).when(k == 1, F.concat(F.lit("₹ "), F.format_number(F.col("p") / 100, 2))).when(
        k == 2, F.concat(F.lit("Rs. "), plain, F.lit(" Cr"))).when(k == 3, F.concat(plain, F.lit(" DR."))).when(
        k == 4, F.concat(F.lit("about "), plain, F.lit(" or 12,345.50"))).otherwise(F.lit("n/a")).alias("text"), k.alias("style"))


@query("nj01_money_cleansing", """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 >= 4 THEN -1.0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) / 100.0 END AS amount,
      CASE o_orderkey % 6 WHEN 5 THEN 0 WHEN 4 THEN 2 ELSE 1 END::INT AS numbers FROM orders""")
def nj01(spark, d):
    t = amount_texts(spark, d)
    return t.select("k", F.coalesce(parse_money(F.col("text")).cast("double"), F.lit(-1.0)).alias("amount"),
                    F.size(numbers_in(F.col("text"))).alias("numbers"))


@query("nj02_date_standardisation", """
    SELECT o_orderkey AS k, CASE WHEN o_orderkey % 8 >= 6 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day,
      ['dd/mm/yyyy', 'dd-mm-yyyy', 'yyyy-mm-dd', 'dd mon yyyy', CASE WHEN month(o_orderdate) = 5 THEN 'dd mon yyyy' ELSE 'dd month yyyy' END, 'dd.mm.yyyy', 'rejected', 'rejected'][o_orderkey % 8 + 1] AS shape FROM orders""")
def nj02(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    s = F.col("k") % 8
    fmts = ["dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd", "dd MMM yyyy", "dd MMMM yyyy", "dd.MM.yyyy"]
    text = F.when(s == 6, "31/02/2020").when(s == 7, "soon")
    for i, f in enumerate(fmts):
        text = text.when(s == i, F.date_format("day", f))
    t = o.select("k", text.alias("t"))
    return t.select("k", F.coalesce(parse_date(F.col("t")).cast("string"), F.lit("")).alias("day"), date_shape(F.col("t")).alias("shape"))


@query("nj02_pdf_dates", """
    SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 10:15:30' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' WHEN 2 THEN strftime(o_orderdate, '%Y-%m') || '-01 00:00:00' ELSE '' END AS at FROM orders""")
def nj02_pdf(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    s = F.col("k") % 4
    text = F.when(s == 0, F.concat(F.lit("D:"), F.date_format("day", "yyyyMMdd"), F.lit("101530+05'30'"))).when(
        s == 1, F.concat(F.lit("D:"), F.date_format("day", "yyyyMMdd"))).when(s == 2, F.concat(F.lit(" D:"), F.date_format("day", "yyyyMM"), F.lit("00"))).otherwise("someday")
    return o.select("k", F.coalesce(F.date_format(parse_pdf_date(text), "yyyy-MM-dd HH:mm:ss"), F.lit("")).alias("at"))


@query("nj12_salted_hash_words", """
    SELECT doc_id, printf('%016x', xor(('0x' || substr(sha256(text), 1, 16))::UBIGINT, 81985529216486895::UBIGINT)) AS w0, printf('%016x', xor(('0x' || substr(sha256(text), 49, 16))::UBIGINT, 7::UBIGINT)) AS w3 FROM documents""")
def nj12_salted(spark, d):
    x = table(spark, d, "documents").select("doc_id", salted(hash_words(F.sha2("text", 256)), [81985529216486895, 1, 0, 7]).alias("w"))
    return x.select("doc_id", *[F.lower(F.lpad(F.hex(F.get("w", F.lit(i))), 16, "0")).alias(f"w{i}") for i in (0, 3)])


_AAD = f"{_digit('aadhaar', 0)} = 0"


@query("nj03_identity_extraction", f"""
    SELECT doc_label || '-' || bundle_id AS doc_id, CASE WHEN pan LIKE '%#' THEN '' ELSE pan END AS pan,
      CASE WHEN aadhaar IS NOT NULL AND bundle_id % 3 <> 2 AND {_AAD} THEN aadhaar ELSE '' END AS aadhaar,
      CASE WHEN aadhaar IS NOT NULL AND bundle_id % 3 <> 2 AND NOT {_AAD} THEN aadhaar ELSE '' END AS aadhaar_invalid,
      CASE WHEN bundle_id % 4 <> 1 THEN coalesce(ifsc, '') ELSE '' END AS ifsc, coalesce(account_number, '') AS account_number, name, coalesce(dob, '') AS dob
    FROM entities, vtab""", ("entities", "vtab"))
def nj03(spark, d):
    t = A.kyc_text(spark, d)
    e = t.select("doc_id", *X.identity_fields(F.col("text")))
    return e.select("doc_id", *[F.coalesce(c, F.lit("")).alias(c) for c in e.columns if c != "doc_id"])


@query("de08_invalid_checksum_signal", f"""
    SELECT bundle_id, count_if(aadhaar IS NOT NULL AND bundle_id % 3 <> 2 AND NOT {_AAD})::BIGINT AS failing FROM entities, vtab GROUP BY 1""", ("entities", "vtab"))
def de08(spark, d):
    t = A.kyc_text(spark, d)
    e = t.select("bundle_id", *X.identity_fields(F.col("text")))
    s = e.withColumn("suspicion", F.when(F.col("aadhaar_invalid").isNotNull(), 0.40)).withColumn("weight", F.lit(0.35))
    return s.groupBy("bundle_id").agg(F.count("suspicion").alias("failing"))


@query("nj04_name_matching", "SELECT bundle_id, off FROM name_off", ("name_off",))
def nj04(spark, d):
    e = A.entities(spark, d).select("bundle_id", "ord", "name")
    head = e.filter(F.col("ord") == 0).select("bundle_id", F.col("name").alias("head"))
    return e.join(head, "bundle_id").groupBy("bundle_id").agg(
        F.count_if(~names_match(F.col("head"), F.col("name"))).alias("off"))


@query("nj06_script_profile", """
    SELECT doc_id, CASE WHEN i > l THEN 'indic' WHEN i + l = 0 THEN 'unknown' ELSE 'latin' END AS family, CASE WHEN i > l THEN 'Devanagari' WHEN i + l = 0 THEN '' ELSE 'Latin' END AS script FROM (
      SELECT doc_id, length(regexp_replace(t, '[^\\x{0900}-\\x{097F}]', '', 'g')) AS i, length(regexp_replace(t, '[^A-Za-z\\x{00C0}-\\x{024F}]', '', 'g')) AS l FROM (
        SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN repeat('कखग', (doc_id % 700)::INT) ELSE '' END AS t FROM documents))""")
def nj06(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.concat("text", F.when(
        F.col("doc_id") % 5 == 0, F.expr("repeat('कखग', cast(doc_id % 700 as int))")).otherwise("")).alias("t"))
    c = x.select("doc_id", *X.script_counts(F.col("t")))
    fam, script = X.script_family({n: F.col(n) for n in ["Latin", *X.SCRIPTS]})
    return c.select("doc_id", fam.alias("family"), script.alias("script"))


_SCORES = ", ".join(
    f"{{'s': {' + '.join(f'contains(n, {chr(39)}{k}{chr(39)})::INT' for k in ks)}, 'f': '{fam}'}}" for fam, ks in TYPE_KEYWORDS.items())
cte("doc_types", f"""
    SELECT doc_id, text, CASE WHEN b > 0 AND len(w) = 1 THEN w[1].f ELSE 'UNKNOWN' END AS doc_type FROM (
      SELECT doc_id, text, list_max(list_transform(a, lambda x: x.s)) AS b, list_filter(a, lambda x: x.s = list_max(list_transform(a, lambda y: y.s))) AS w FROM (
        SELECT doc_id, text, [{_SCORES}] AS a FROM (SELECT doc_id, text, regexp_replace(lower(text), chr(92) || 's+', ' ', 'g') AS n FROM kyc_text)))""", "kyc_text")


@query("nj07_document_type", "SELECT doc_id, doc_type FROM doc_types", ("doc_types",))
def nj07(spark, d):
    return A.kyc_text(spark, d).select("doc_id", X.document_type(F.col("text")).alias("doc_type"))


@query("nj08_sufficiency", """
    SELECT quality, achievable, count(*) AS documents FROM (SELECT CASE WHEN length(trim(text, ' ')) >= 200 THEN 'digital_native' ELSE 'scanned' END AS quality,
      CASE WHEN doc_id % 13 = 2 THEN 'high' WHEN doc_id % 3 <> 0 AND length(trim(text, ' ')) >= 200 THEN 'moderate' ELSE 'low' END AS achievable FROM documents) GROUP BY 1, 2""")
def nj08(spark, d):
    x = table(spark, d, "documents")
    t = F.when(F.col("doc_id") % 3 != 0, "ITR").otherwise("UNKNOWN")
    return x.select(*X.sufficiency(F.col("text"), t, F.col("doc_id") % 13 == 2)).groupBy("quality", "achievable").agg(
        F.count(F.lit(1)).alias("documents"))


cte("issuers", """
    SELECT doc_label || '-' || bundle_id AS doc_id, bundle_id, CASE WHEN bundle_id % 4 <> 1 AND ifsc IS NOT NULL THEN CASE substr(ifsc, 1, 4) WHEN 'SBIN' THEN 'sbi' WHEN 'HDFC' THEN 'hdfc' WHEN 'ICIC' THEN 'icici'
      WHEN 'UTIB' THEN 'axis' WHEN 'CNRB' THEN 'canara' WHEN 'PUNB' THEN 'pnb' ELSE 'kotak' END WHEN bundle_id % 4 = 1 THEN 'canara' WHEN bundle_id % 4 = 3 THEN 'axis' ELSE '' END AS issuer FROM entities""", "entities")


@query("nj09_issuer", "SELECT doc_id, issuer FROM issuers", ("issuers",))
def nj09(spark, d):
    return A.kyc_text(spark, d).select("doc_id", F.coalesce(X.issuer(F.col("text")), F.lit("")).alias("issuer"))


@query("nj10_source_avoidance", """
    SELECT issuer, count_if(issuer <> '' AND bundle_id % 6 <> 2)::BIGINT AS avoided, count(*) AS documents,
      round(count_if(issuer <> '' AND bundle_id % 6 <> 2) * 0.55 * 0.10, 6)::DOUBLE AS weighted FROM issuers GROUP BY 1""", ("issuers",))
def nj10(spark, d):
    t = A.kyc_text(spark, d).select("doc_id", X.issuer(F.col("text")).alias("issuer"), (F.col("bundle_id") % 6 == 2).alias("signed"))
    s = P.source_avoidance(t)
    part = (F.col("suspicion") * F.col("weight")).cast("decimal(12,6)")
    return s.groupBy(F.coalesce("issuer", F.lit("")).alias("issuer")).agg(
        F.count_if(F.col("red_flag").isNotNull()).alias("avoided"), F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum(part), F.lit(0)).cast("double").alias("weighted"))


@query("nj11_pan_structure", """
    SELECT holder, status, count(*) AS n FROM (SELECT CASE WHEN pan LIKE '%#' THEN '' ELSE 'Individual' END AS holder,
      CASE WHEN pan LIKE '%#' OR bundle_id % 4 = 3 THEN 'NOT_VERIFIED' WHEN bundle_id % 4 = 1 OR bundle_id % 5 = 2 THEN 'INVALID' ELSE 'VERIFIED' END AS status FROM entities) GROUP BY 1, 2""", ("entities",))
def nj11(spark, d):
    e = A.entities(spark, d)
    k = F.col("bundle_id")
    answer = F.when(k % 4 == 3, None).when(k % 4 == 1, "INVALID pan").otherwise("Existing and Active")
    p = e.select("bundle_id", *X.pan_structure(F.col("pan")))
    return p.select("holder", X.source_status(answer, k % 5 != 2, F.col("valid")).alias("status")).groupBy("holder", "status").agg(
        F.count(F.lit(1)).alias("n"))


@query("nj13_metadata_profile", """
    SELECT k AS doc_id, legit AS legitimate, ed AS editing_tool, af::INT AS updates_after, least(1.0, round(CASE WHEN ed THEN 0.55 ELSE 0 END + CASE WHEN af > 0 THEN 0.4 + 0.1 * (af - 1) ELSE 0 END
      + CASE WHEN k % 5 = 1 THEN 0.6 WHEN k % 5 = 2 THEN 0.2 ELSE 0 END + CASE WHEN k % 6 = 5 THEN 0.15 ELSE 0 END, 6))::DOUBLE AS suspicion
    FROM (SELECT o_orderkey AS k, o_orderkey % 6 IN (0, 3) AS legit, o_orderkey % 6 IN (1, 4) AS ed, greatest(0, o_orderkey % 4 - CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END) AS af FROM orders)""")
def nj13(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    prod = F.get(F.array(*[F.lit(x) for x in ("iText 7", "Adobe Photoshop CC", "Core Ledger", "Microsoft: Print To PDF", "Canva", "")]), (k % 6).cast("int"))
    meta = o.select(
        k.alias("doc_id"), prod.alias("producer"), F.lit(None).cast("string").alias("creator"), (k % 4 + 1).cast("int").alias("eof_marks"),
        F.lit(1).alias("startxref_marks"), (k % 3 == 0).alias("signed"), F.col("o_orderdate").cast("timestamp").alias("created"),
        F.when(k % 5 == 1, F.col("o_orderdate") - F.expr("interval 1 day")).when(k % 5 == 2, F.col("o_orderdate") + F.expr("interval 40 days"))
        .otherwise(F.col("o_orderdate")).cast("timestamp").alias("modified"))
    return P.metadata_profile(meta).select("doc_id", "legitimate", "editing_tool", "updates_after", "suspicion")


@query("nj14_font_consistency", """
    WITH s AS (SELECT l_orderkey AS doc_id, 'Face' || l_linenumber % 2 AS base, CASE WHEN l_orderkey % 5 = 2 AND l_linenumber > 3 THEN 'ZZZZZZ' WHEN l_orderkey % 7 = 3 THEN '' ELSE 'ABCDEF' END AS tag FROM lineitem),
    b AS (SELECT doc_id, count_if(t > 1) AS bad FROM (SELECT doc_id, base, count(DISTINCT tag) AS t FROM s GROUP BY 1, 2) GROUP BY 1), n AS (SELECT doc_id, count(*) AS spans FROM s GROUP BY 1)
    SELECT doc_id, spans, bad::BIGINT AS inconsistent, CASE WHEN spans < 8 THEN -1.0 WHEN bad = 0 THEN 0.0 ELSE 0.45 + 0.1 * (bad - 1) END::DOUBLE AS suspicion FROM n JOIN b USING (doc_id)""")
def nj14(spark, d):
    li = table(spark, d, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    tag = F.when((k % 5 == 2) & (n > 3), "ZZZZZZ+").when(k % 7 == 3, "").otherwise("ABCDEF+")
    spans = li.select(k.alias("doc_id"), F.concat(tag, F.lit("Face"), (n % 2).cast("string")).alias("font"))
    return P.font_consistency(spans).select("doc_id", "spans", "inconsistent", "suspicion")


@query("nj15_unit_normalisation", "SELECT bundle_id, CASE WHEN unit_known THEN round(record_sqm, 4) ELSE -1.0 END AS square_metres FROM land", ("land",))
def nj15(spark, d):
    b = C.to_canonical(L.land_bundles(spark, d), "record_extent", "record_unit", "v", "area")
    return b.select("bundle_id", F.round(F.coalesce("v", F.lit(-1.0)), 4).alias("square_metres"))


# -- word geometry ---------------------------------------------------------------------------------------------------
def statement_words(spark, d):
    """A printed page per account: header, opening row, one row per movement, charges, totals, closing."""
    led = A.ledger(spark, d)

    def word(text, left, top, width=40):
        return F.struct(text.cast("string").alias("text"), left.cast("int").alias("left"), top.cast("int").alias("top"), F.lit(width).alias("width"))

    at = F.lit(60) + F.col("idx") * 20
    body = led.select("doc_id", F.explode(F.array(
        word(F.date_format("posted", "dd/MM/yyyy"), F.lit(20), at), word(F.regexp_replace("narration", " .*", ""), F.lit(200), at + 1),
        word(rupees("debit_p"), F.lit(400), at), word(rupees("credit_p"), F.lit(550), at), word(rupees("balance_p"), F.lit(700), at + 1))).alias("w"))
    s = A.summary(led).join(led.groupBy("doc_id").agg(F.max("idx").alias("n")), "doc_id")
    end = F.lit(80) + F.col("n") * 20
    heads = s.select("doc_id", F.explode(F.array(
        word(F.lit("Date"), F.lit(20), F.lit(0)), word(F.lit("Particulars"), F.lit(200), F.lit(1)), word(F.lit("Withdrawal"), F.lit(400), F.lit(0)),
        word(F.lit("Deposit"), F.lit(550), F.lit(0)), word(F.lit("Balance"), F.lit(700), F.lit(1)),
        word(F.lit("Opening"), F.lit(200), F.lit(30)), word(rupees("opening_p"), F.lit(700), F.lit(30)),
        word(F.lit("Total"), F.lit(200), end), word(rupees("total_debits_p"), F.lit(400), end), word(rupees("total_credits_p"), F.lit(550), end),
        word(F.lit("Charges"), F.lit(200), end + 20), word(F.lit("12.50"), F.lit(400), end + 20),
        word(F.lit("Closing"), F.lit(200), end + 40), word(rupees("closing_p"), F.lit(700), end + 40),
        word(F.when(F.col("acct") % 4 == 1, F.lit("1,250.00")), F.lit(990), end))).alias("w"))
    w = body.unionByName(heads).select("doc_id", F.lit(0).alias("page"), "w.*").filter(F.col("text").isNotNull())
    return w.withColumn("height", F.lit(12)).withColumn("conf", F.lit(0.9))


def page_words(spark, d):
    from docassay.session import durable

    w = durable(statement_words(spark, d))
    return w, durable(W.detect_columns(w, W.PAGE))


@query("wn01_row_clustering", """
    SELECT doc_id, count(DISTINCT row_id) AS rows, count(*) AS words FROM (SELECT doc_id, sum(CASE WHEN cy - prev > band THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY cy) AS row_id FROM (
      SELECT w.doc_id, top + height / 2 AS cy, lag(top + height / 2) OVER (PARTITION BY w.doc_id ORDER BY top + height / 2) AS prev, band FROM words w JOIN (
        SELECT doc_id, greatest(median(height) * 0.8, 6) AS band FROM words GROUP BY 1) b ON w.doc_id = b.doc_id)) GROUP BY 1""", ("words",))
def wn01(spark, d):
    w = W.cluster_rows(A.words(spark, d), W.PAGE)
    return w.groupBy("doc_id").agg(F.count_distinct("row_id").alias("rows"), F.count(F.lit(1)).alias("words"))


@query("wn02_column_detection", """
    SELECT doc_id, label, x_left, x_right FROM (SELECT DISTINCT doc_id FROM ledger), (VALUES ('date', -1e9::DOUBLE, 130.0::DOUBLE), ('description', 130.0, 320.0), ('debit', 320.0, 495.0), ('credit', 495.0, 645.0), ('balance', 645.0, 1e9)) t(label, x_left, x_right)""", ("ledger",))
def wn02(spark, d):
    return page_words(spark, d)[1].select("doc_id", "label", "x_left", "x_right")


@query("wn03_statement_reconstruction", """
    SELECT s.doc_id, opening_p / 100.0 AS opening, closing_p / 100.0 AS closing, 12.5::DOUBLE AS charges,
      CASE WHEN acct % 4 = 1 THEN -1.0 ELSE total_debits_p / 100.0 END::DOUBLE AS total_debits,
      n + CASE WHEN acct % 4 = 1 THEN 1 ELSE 0 END AS txns
    FROM summary s JOIN (SELECT doc_id, count(*) AS n FROM ledger GROUP BY 1) USING (doc_id)""", ("summary", "ledger"))
def wn03(spark, d):
    w, cols = page_words(spark, d)
    s = W.statements(W.reconstruct(w, cols, W.PAGE), W.PAGE)
    # a stray amount in the balance column turns the totals row of those pages into a movement
    return s.select("doc_id", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in ("opening", "closing", "total_debits", "charges")], "txns")


@query("wn04_uncaptured_money", "SELECT doc_id, CASE WHEN acct % 4 = 1 THEN 1 ELSE 0 END::BIGINT AS uncaptured FROM summary", ("summary",))
def wn04(spark, d):
    w, cols = page_words(spark, d)
    # a page with a printed right margin: columns end there
    ended = cols.withColumn("x_right", F.least("x_right", F.lit(900.0)))
    return W.uncaptured_money(w, ended, W.PAGE).select("doc_id", "uncaptured")


@query("wn05_page_boundaries", """
    SELECT doc_id, page, closing, next_open FROM (SELECT o_custkey AS doc_id, month(o_orderdate) AS page, max(o_orderkey) AS closing, lead(min(o_orderkey)) OVER (PARTITION BY o_custkey ORDER BY month(o_orderdate)) AS next_open FROM orders GROUP BY 1, 2) WHERE next_open IS NOT NULL""")
def wn05(spark, d):
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("doc_id"), F.month("o_orderdate").cast("bigint").alias("page")).agg(
        F.max("o_orderkey").alias("closing"), F.min("o_orderkey").alias("opening"))
    return C.page_zipper(o, ["doc_id"]).select("doc_id", "page", "closing", "next_open")


cte("outliers", """
    WITH w AS (SELECT doc_id, line, pos, (top + height)::DOUBLE AS b, height::DOUBLE AS h, round(stroke * 1000000) AS s FROM words WHERE length(trim(text)) >= 3 AND conf >= 0.5),
    m AS (SELECT doc_id, line, count(*) AS n, median(b) AS mb, median(h) AS mh, median(s) AS ms FROM w GROUP BY 1, 2 HAVING count(*) >= 4),
    j AS (SELECT * FROM w JOIN m USING (doc_id, line)),
    q AS (SELECT doc_id, line, median(abs(b - mb)) AS qb, median(abs(h - mh)) AS qh, median(abs(s - ms)) AS qs FROM j GROUP BY 1, 2),
    z AS (SELECT j.*, greatest(abs(b - mb) / greatest(1.4826::DOUBLE * qb, 0.2::DOUBLE * mh), abs(h - mh) / greatest(1.4826::DOUBLE * qh, 0.2::DOUBLE * mh), abs(s - ms) / greatest(1.4826::DOUBLE * qs, 20000)) AS z FROM j JOIN q USING (doc_id, line)),
    c AS (SELECT *, count_if(z >= 3) OVER (PARTITION BY doc_id, line) AS hits FROM z)
    SELECT doc_id, line, pos, z, z >= 3 AND hits * 2 < n AS flagged FROM c""", "words")


def outliers(spark, d):
    w = A.words(spark, d)
    return w, W.line_outliers(w, ["doc_id", "page", "line"])


@query("wn06_line_outliers", "SELECT doc_id, line::INT AS line, pos::INT AS pos, round(z, 6) AS z FROM outliers WHERE flagged", ("outliers",))
def wn06(spark, d):
    return outliers(spark, d)[1].filter("flagged").select("doc_id", "line", "pos", F.round("z", 6).alias("z"))


@query("wn07_confidence_gate", "SELECT doc_id, count(*) AS words, round(avg(conf), 6) AS mean_conf, avg(conf) >= 0.45 AS readable FROM words GROUP BY 1", ("words",))
def wn07(spark, d):
    return W.confidence_gate(A.words(spark, d)).withColumn("mean_conf", F.round("mean_conf", 6))


@query("wn08_line_texts", "SELECT doc_id, line::INT AS line, string_agg(text, ' ' ORDER BY pos) AS line_text FROM words GROUP BY 1, 2", ("words",))
def wn08(spark, d):
    return W.line_texts(A.words(spark, d, together=True), ["doc_id", "line"])


@query("wn08_document_texts", """
    SELECT doc_id, count(*) AS lines, sha256(string_agg(line_text, chr(10) ORDER BY line)) AS text_sha256 FROM (
      SELECT doc_id, line, string_agg(text, ' ' ORDER BY pos) AS line_text FROM words GROUP BY 1, 2) GROUP BY 1""", ("words",))
def wn08_documents(spark, d):
    t = W.document_texts(A.words(spark, d, together=True), ["doc_id"], ["line"])
    return t.select("doc_id", "lines", F.sha2("text", 256).alias("text_sha256"))


@query("or02_worst_disagreement", """
    SELECT bundle_id, arg_max(field, (severity, field)) AS field, max(severity) AS severity FROM identity_cmp WHERE status <> 'agree' GROUP BY 1""", ("identity_cmp",))
def or02(spark, d):
    c = DQ.identity_comparisons(spark, d).filter(F.col("status") != "agree")
    return c.groupBy("bundle_id").agg(F.max_by("field", F.struct("severity", "field")).alias("field"), F.max("severity").alias("severity"))


@query("or03_ranked_rings", "SELECT component, strength, members FROM rings ORDER BY strength DESC, component", ("rings",))
def or03(spark, d):
    t = NQ.tokens(spark, d)
    return G.rings(t, NQ.comp(spark, d, t)).select("component", "strength", "members").orderBy(F.desc("strength"), "component")
