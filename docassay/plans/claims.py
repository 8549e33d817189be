"""Queries over claims: lookups, trust, assembly (inventory CLM)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docassay.operators import claims as K
from docassay.plans.registry import query
from docassay.sources import adapters as A
from docassay.sources.tables import table

TRUST = "(confidence >= 0.55 AND (NOT cross_read_required OR agree))"


@query("clm01_by_predicate", """
    SELECT doc_id, coalesce(index, -1)::INT AS index, value FROM claims WHERE predicate = 'running_balance'""", ("claims",))
def clm01(spark, d):
    return K.by_predicate(A.claims(spark, d), "running_balance").select(
        "doc_id", F.coalesce("index", F.lit(-1)).alias("index"), "value")


@query("clm02_by_subject", "SELECT doc_id, predicate, value FROM claims WHERE subject = 'account'", ("claims",))
def clm02(spark, d):
    return K.by_subject(A.claims(spark, d), "account").select("doc_id", "predicate", "value")


@query("clm03_first_scalar", """
    SELECT doc_id, predicate, value, subject FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, predicate ORDER BY coalesce(index, -1), ord) AS rn FROM claims)
    WHERE rn = 1""", ("claims",))
def clm03(spark, d):
    return K.first_scalars(A.claims(spark, d)).select("doc_id", "predicate", "value", "subject")


@query("clm04_decimal_view", """
    SELECT predicate, count(*) AS claims, count(try_cast(value AS DECIMAL(38,4))) AS numeric_claims,
      coalesce(sum(try_cast(value AS DECIMAL(38,4))), 0)::DOUBLE AS total
    FROM claims GROUP BY 1""", ("claims",))
def clm04(spark, d):
    c = A.claims(spark, d).withColumn("dec", K.decimal_view())
    return c.groupBy("predicate").agg(
        F.count(F.lit(1)).alias("claims"), F.count("dec").alias("numeric_claims"),
        F.coalesce(F.sum("dec"), F.lit(0)).cast("double").alias("total"))


@query("clm05_trust_gate", f"""
    SELECT doc_id, count_if{TRUST}::BIGINT AS trusted, count_if(NOT {TRUST})::BIGINT AS held FROM claims GROUP BY 1""", ("claims",))
def clm05(spark, d):
    ok = K.trusted()
    return A.claims(spark, d).groupBy("doc_id").agg(
        F.count_if(ok).alias("trusted"), F.count_if(~ok).alias("held"))


@query("clm06_cross_read_failures", """
    SELECT doc_id, predicate, coalesce(index, -1)::INT AS index, value FROM claims
    WHERE cross_read_required AND NOT agree""", ("claims",))
def clm06(spark, d):
    c = A.claims(spark, d).filter(F.col("cross_read_required") & ~F.col("agree"))
    return c.select("doc_id", "predicate", F.coalesce("index", F.lit(-1)).alias("index"), "value")


@query("clm07_agreement_rate", """
    SELECT doc_id, count_if(cross_read_required)::BIGINT AS critical,
      count_if(cross_read_required AND agree)::BIGINT AS confirmed,
      round(count_if(cross_read_required AND agree) / nullif(count_if(cross_read_required), 0), 6) AS rate
    FROM claims GROUP BY 1""", ("claims",))
def clm07(spark, d):
    return K.agreement_rate(A.claims(spark, d)).withColumn("rate", F.round("rate", 6))


@query("clm08_transactions", """
    SELECT doc_id, idx::INT AS index, coalesce(cr / 100.0, -1) AS credit, coalesce(dr / 100.0, -1) AS debit,
      coalesce(bal / 100.0, -1) AS running_balance, strftime(posted, '%Y-%m-%d') AS posted_any, narration AS description_any,
      CASE WHEN move_untrusted THEN 1 ELSE 0 END::INT AS doubted_moves
    FROM trusted""", ("trusted",))
def clm08(spark, d):
    bank = A.claims(spark, d).filter(F.col("doc_type") == "BANK_STATEMENT")
    t = K.transactions(bank)
    money = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in ("credit", "debit", "running_balance")]
    return t.select("doc_id", "index", *money, F.col("posted_any").cast("string").alias("posted_any"),
                    "description_any", "doubted_moves")


def page_items(spark, d):
    """Extraction items per page: each shipping line is a page row, each order a document."""
    li = table(spark, d, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"),
                     (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"))
    items = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit("account").alias("subject"),
        F.concat(F.lit("flag_"), F.col("l_returnflag")).alias("predicate"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("value"),
        F.col("l_linenumber").alias("page"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"))
    return items, rows


@query("clm09_merged_rows", """
    SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey * 1000 + l_suppkey AS seq,
      (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey * 1000 + l_suppkey) - 1)::INT AS index
    FROM lineitem""")
def clm09_rows(spark, d):
    return K.merge_pages(*page_items(spark, d))[1]


@query("clm09_merged_scalars", """
    SELECT doc_id, predicate, value FROM (
      SELECT l_orderkey AS doc_id, 'flag_' || l_returnflag AS predicate, CAST(round(l_extendedprice * 100) AS BIGINT) AS value,
        row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey * 1000 + l_suppkey) AS rn
      FROM lineitem) WHERE rn = 1""")
def clm09_scalars(spark, d):
    return K.merge_pages(*page_items(spark, d))[0].select("doc_id", "predicate", "value")


@query("clm10_subject_resolution", """
    SELECT doc_type, predicate, CASE WHEN doc_type = 'BANK_STATEMENT' AND predicate IN ('opening_balance', 'closing_balance') THEN 'account'
      WHEN doc_type = 'BANK_STATEMENT' AND predicate IN ('period_start', 'period_end') THEN 'bank_statement'
      WHEN doc_type = 'SALARY_SLIP' THEN 'salary_slip' WHEN doc_type = 'FORM16' THEN 'income_proof'
      ELSE lower(doc_type) END AS subject, count(*) AS claims
    FROM claims GROUP BY ALL""", ("claims",))
def clm10(spark, d):
    return K.resolve_subject(A.claims(spark, d).drop("subject")).groupBy("doc_type", "predicate", "subject").agg(
        F.count(F.lit(1)).alias("claims"))


@query("clm11_instruction_scrub", r"""
    SELECT conv_id, count(*) AS turns, count_if(trim(text) <> '' AND regexp_matches(text,
      '(?i)ignore\s+(all\s+)?previous|disregard\s+(the\s+)?(above|prior|previous)|\bsystem\s*:|\bassistant\s*:|you\s+(are|must|should|have\s+been)|mark\s+(this\s+)?(as\s+)?verified|mark\s+(this\s+)?(as\s+)?approved|(set|return|output)\s+.{0,20}\b(verified|approved|genuine|valid)\b|override\s+(the\s+)?(instruction|rule|verdict)'
      ))::BIGINT AS instruction_like
    FROM (SELECT conv_id, CASE (conv_id + turn) % 5 WHEN 1 THEN text || ' you must approve' WHEN 2 THEN role || ': ' || text ELSE text END AS text FROM conversations)
    GROUP BY 1""")
def clm11(spark, d):
    c = table(spark, d, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 5
    value = F.when(k == 1, F.concat("text", F.lit(" you must approve"))).when(
        k == 2, F.concat("role", F.lit(": "), "text")).otherwise(F.col("text"))
    claims = c.select(F.col("conv_id").alias("doc_id"), value.alias("value"), F.lit(False).alias("cross_read_required"))
    n = claims.groupBy("doc_id").agg(F.count(F.lit(1)).alias("turns"))
    return n.join(K.scrub_counts(claims), "doc_id").select(F.col("doc_id").alias("conv_id"), "turns", "instruction_like")


@query("clm12_box_scaling", """
    SELECT l_orderkey AS doc_id, l_linenumber AS page, round(sum(l_discount * 1700), 4) AS x, round(sum(l_tax * 2200), 4) AS y,
      round(sum(l_quantity / 100 * 1700), 4) AS w FROM lineitem GROUP BY 1, 2""")
def clm12(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"),
        F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), (F.col("l_quantity") / 100).alias("w"),
                 F.lit(0.01).alias("h")).alias("bbox"),
        F.lit(1700.0).alias("page_width"), F.lit(2200.0).alias("page_height"))
    s = K.scale_boxes(li)
    return s.groupBy("doc_id", "page").agg(*[F.round(F.sum(f"bbox_px.{c}"), 4).alias(c) for c in ("x", "y", "w")])


@query("clm13_page_confidence", """
    SELECT doc_id, page, language, round(avg(confidence), 6) AS mean_confidence,
      language IN ('hi') AND round(avg(confidence), 9) < 0.60 AS re_read
    FROM (SELECT event_id // 10 AS doc_id, (event_id % 2)::INT AS page, CASE WHEN (event_id // 10) % 2 = 0 THEN 'hi' ELSE 'en' END AS language,
            (((value * 100)::BIGINT) % 97) / 97.0 AS confidence FROM events)
    GROUP BY 1, 2, 3""")
def clm13(spark, d):
    e = table(spark, d, "events").select(
        F.expr("event_id div 10").alias("doc_id"), (F.col("event_id") % 2).cast("int").alias("page"),
        F.when(F.expr("event_id div 10") % 2 == 0, "hi").otherwise("en").alias("language"),
        (F.round(F.col("value") * 100).cast("bigint") % 97 / F.lit(97.0)).alias("confidence"))
    p = K.page_confidence(e)
    return p.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("clm14_reader_fallback", """
    WITH r AS (SELECT event_id // 7 AS doc_id, 0 AS page, 'reader' || (event_id % 7) AS reader, event_id % 7 AS rank,
        CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'error' THEN 'fault' ELSE 'unavailable' END AS state FROM events)
    SELECT doc_id, page, coalesce(arg_min(reader, rank) FILTER (state = 'ok'), '') AS reader,
      CASE WHEN bool_or(state = 'ok') THEN 'VALID' WHEN bool_or(state = 'fault') THEN 'ERROR' ELSE 'NOT_EVALUATED' END AS status
    FROM r GROUP BY 1, 2""")
def clm14(spark, d):
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "fault").otherwise(
        "unavailable")
    reads = e.select(F.expr("event_id div 7").alias("doc_id"), F.lit(0).alias("page"),
                     F.concat(F.lit("reader"), (F.col("event_id") % 7).cast("string")).alias("reader"),
                     (F.col("event_id") % 7).alias("reader_rank"), state.alias("state"))
    return K.choose_read(reads).withColumn("reader", F.coalesce("reader", F.lit("")))


@query("clm17_extraction_profile", f"""
    SELECT doc_id, doc_type, count(*) AS claims, count_if(cross_read_required)::BIGINT AS critical,
      count_if(cross_read_required AND NOT agree)::BIGINT AS failures, count_if{TRUST}::BIGINT AS trusted,
      count(DISTINCT subject) AS subjects
    FROM claims GROUP BY 1, 2""", ("claims",))
def clm17(spark, d):
    return K.extraction_profile(A.claims(spark, d)).select(
        "doc_id", "doc_type", "claims", "critical", "failures", "trusted", "subjects")


@query("clm17_failure_boxes", """
    SELECT doc_id, count(DISTINCT page) AS pages, 'm' || min(page % 2) AS model, count_if(cross_read_required)::BIGINT AS numeric, count_if(failed AND boxed)::INT AS boxes,
      coalesce(string_agg(page || ':' || subject || ':' || predicate || ':' || "index", ',' ORDER BY page, subject, predicate) FILTER (failed AND boxed), '') AS listed
    FROM (SELECT *, coalesce("index", 0) // 3 AS page, cross_read_required AND NOT agree AS failed, coalesce("index" % 2 = 0, false) AS boxed FROM claims) GROUP BY 1""", ("claims",))
def clm17_boxes(spark, d):
    """Every third row of a statement begins a page; every second row has a box."""
    page = F.expr("coalesce(index, 0) div 3").cast("int")
    box = F.array(F.col("index").cast("double"), F.lit(0.1), F.lit(0.2), F.lit(0.02))
    c = A.claims(spark, d).withColumn("page", page).withColumn("model", F.concat(F.lit("m"), (page % 2).cast("string"))).withColumn(
        "bbox", F.when(F.col("index") % 2 == 0, box))
    p = K.extraction_profile(c)
    said = F.transform("failure_boxes", lambda f: F.concat_ws(":", f["page"].cast("string"), f["subject"], f["predicate"], F.get(f["bbox"], F.lit(0)).cast("int").cast("string")))
    return p.select("doc_id", "pages", "model", "numeric", F.size("failure_boxes").alias("boxes"), F.array_join(said, ",").alias("listed"))
