"""Agreements, land bundles and page-level tables derived from the provided star schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.numwords import UNITS
from docassay.operators.checks import instalment
from docassay.sources.tables import apart, letter, paise, rupees, table

# Number words used in generated amounts.
TENS_WORDS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def _pick(words: list[str], i: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), i.cast("int"))


def agreements(spark: SparkSession, folder: str) -> DataFrame:
    """One loan agreement per order, wide."""
    o = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("applicant"),
        F.to_date("o_orderdate").alias("effective"),
    )
    k = F.col("k")
    o = o.repartition(apart(o), F.concat(F.lit("A"), k.cast("string")))  # one split of the file would make all claims of its agreements
    a, b, c, t = k % 19 + 1, F.expr("k div 19") % 19 + 1, F.expr("k div 7") % 9 + 1, F.expr("k div 3") % 8
    whole = a * 100000 + b * 1000 + c * 100 + (t + 2) * 10
    words = F.concat(
        F.lit("Rupees "), _pick(UNITS, a), F.lit(" lakh "), _pick(UNITS, b), F.lit(" thousand "), _pick(UNITS, c),
        F.when(k % 25 == 3, F.lit(" zillion and ")).otherwise(F.lit(" hundred and ")), _pick(TENS_WORDS, t),
        F.when(k % 6 == 1, F.lit(" and fifty paise only")).otherwise(F.lit(" only")),
    )
    term = (k % 36 + 1).cast("int")
    end = F.add_months("effective", term)
    df = o.select(
        F.concat(F.lit("A"), k.cast("string")).alias("doc_id"),
        "k",
        "applicant",
        "effective",
        (F.when(k % 12 == 5, whole + 1000).otherwise(whole) * 100).alias("consideration_p"),
        words.alias("words"),
        term.alias("term"),
        F.when(k % 14 == 3, F.date_add(end, 5)).otherwise(end).alias("end_date"),
        (k % 4 + 2).cast("int").alias("pages"),
        (9 + k % 5).cast("int").alias("rate"),
        (k % 18 != 4).alias("both_signed"),
        (k % 18 != 9).alias("both_witnessed"),
        F.when(k % 18 != 13, F.date_add("effective", -3)).alias("execution_date"),
        (whole * 100).alias("principal_p"),
    )
    emi = F.round(instalment(F.col("principal_p") / 100, F.col("rate"), F.col("term")), 2)
    return df.withColumn("emi", F.when(k % 13 == 6, emi + 100).otherwise(emi))


def agreement_claims(spark: SparkSession, folder: str, wide: DataFrame | None = None) -> DataFrame:
    """Claims of the agreements, long; repeated entities included."""
    d = agreements(spark, folder) if wide is None else wide
    k = F.col("k")
    own = F.concat(F.lit("Asha "), letter(k), F.lit("rao"))

    def item(subject: str | Column, predicate: str, value: Column, critical: bool, n: int | Column, idx=None) -> Column:
        return F.struct(
            (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"),
            F.lit(predicate).alias("predicate"),
            value.cast("string").alias("value"),
            F.lit(critical).alias("cross_read_required"),
            (F.lit(None) if idx is None else idx).cast("int").alias("index"),
            (F.lit(n) if isinstance(n, int) else n).cast("bigint").alias("ord"),
        )

    page = F.transform(
        F.filter(
            F.concat(F.sequence(F.lit(1), F.col("pages")), F.when(k % 16 == 9, F.array(F.lit(1))).otherwise(
                F.array().cast("array<int>"))),
            lambda p: ~((k % 16 == 7) & (p == 2)),
        ),
        lambda p: item("agreement", "printed_page_number", p, True, p + 100, p),
    )
    fixed = F.array(
        item("agreement", "consideration", rupees("consideration_p"), True, 0),
        item("agreement", "consideration_in_words", F.col("words"), False, 1),
        item("agreement", "effective_date", F.date_format("effective", "dd-MM-yyyy"), False, 2),
        item("agreement", "term", F.col("term"), True, 3),
        item("agreement", "end_date", F.date_format("end_date", "dd.MM.yyyy"), False, 4),
        item("agreement", "printed_page_count", F.col("pages"), True, 5),
        item("agreement", "execution_date", F.date_format("execution_date", "dd MMM yyyy"), False, 6),
        item("party_1", "name", own, False, 10),
        item("party_1", "name", F.concat(F.lit("A "), letter(k), F.lit("rao")), False, 11),
        item("party_1", "name", F.when(k % 21 == 8, F.lit("Meera Nair")).otherwise(own), False, 12),
        item("party_2", "name", F.lit("First Lending Ltd"), False, 13),
        item("party_2", "name", F.lit("FIRST LENDING LTD."), False, 14),
        item("execution", "signature", F.lit("signed 1"), False, 20),
        item("execution", "signature", F.when(F.col("both_signed"), F.lit("signed 2")), False, 21),
        item("execution", "witness", F.lit("witness 1"), False, 22),
        item("execution", "witness", F.when(F.col("both_witnessed"), F.lit("witness 2")), False, 23),
        item("clause_1", "refers_to", F.lit("Schedule A"), False, 30),
        item("clause_2", "refers_to", F.lit(" schedule B "), False, 31),
        item("schedule_1", "label", F.lit("SCHEDULE A"), False, 32),
        item("schedule_2", "label", F.when(k % 15 != 2, F.lit("Schedule B")), False, 33),
    )
    return (
        d.select("doc_id", F.explode(F.concat(fixed, page)).alias("c"))
        .select("doc_id", F.lit("LOAN_AGREEMENT").alias("doc_type"), "c.*", F.lit(True).alias("agree"),
                F.lit(0.9).alias("confidence"), F.lit(None).cast("double").alias("x"))
        .filter(F.col("value").isNotNull())
    )


def land_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """A sale deed with its record of rights and encumbrance certificate, one bundle per part."""
    p = table(spark, folder, "part").select(F.col("p_partkey").alias("k"), paise("p_retailprice").alias("price_p"),
                                            F.col("p_size").alias("size"))
    k = F.col("k")
    units = F.array(*[F.lit(u) for u in ("sqm", "sqft", "acre", "cent", "bigha")])
    factor = F.get(F.array(*[F.lit(v) for v in (1.0, 0.092903, 4046.8564, 40.4686, 1.0)]), (k % 5).cast("int"))
    return p.select(
        k.alias("bundle_id"),
        F.concat(F.lit("ASHA "), letter(k), F.lit("OWNER")).alias("seller"),
        F.when(k % 9 == 4, F.lit("KIRAN DOSHI")).when(k % 9 == 5, F.concat(F.lit("A "), letter(k), F.lit("OWNERS")))
        .otherwise(F.concat(F.lit("ASHA "), letter(k), F.lit("OWNER"))).alias("owner"),
        F.concat((k % 900).cast("string"), F.lit("/2A")).alias("deed_survey"),
        F.when(k % 11 == 6, F.lit("999/1")).otherwise(F.concat((k % 900).cast("string"), F.lit(" /2a")))
        .alias("record_survey"),
        F.when(k % 10 != 7, F.concat((k % 900).cast("string"), F.lit("/2A"))).alias("certificate_survey"),
        (F.col("size") * 100.0).alias("deed_extent"),
        F.lit("sqm").alias("deed_unit"),
        F.when(k % 8 == 3, F.col("size") * 100.0 / factor + 40).otherwise(F.col("size") * 100.0 / factor)
        .alias("record_extent"),
        F.get(units, (k % 5).cast("int")).alias("record_unit"),
        F.concat(F.lit("ST"), (k % 30).cast("string")).alias("state"),
        (F.col("price_p") * 1000).alias("consideration_p"),
        F.when(k % 4 == 1, F.col("price_p") * 1500).otherwise(F.col("price_p") * 700).alias("guidance_p"),
        F.when(k % 7 == 2, F.expr("price_p * 30")).otherwise(
            F.expr("price_p * (if(k % 4 = 1, 1500, 1000)) * (4 + k % 6) div 100")).alias("duty_p"),
        F.when(k % 6 == 4, F.lit("P0")).otherwise(F.concat(F.lit("P"), k.cast("string"))).alias("loan_property"),
        F.concat(F.lit("P"), k.cast("string")).alias("deed_property"),
        F.when(k % 14 == 3, F.col("price_p") * 1000 + 5000).otherwise(F.col("price_p") * 1000).alias("agreement_p"),
        F.when(k % 15 == 8, F.col("price_p") * 999).otherwise(F.col("price_p") * 1000).alias("paid_p"),
    )


def duty_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Duty rate per state, from the nation table; five states have none."""
    n = table(spark, folder, "nation")
    return n.select(F.concat(F.lit("ST"), F.col("n_nationkey").cast("string")).alias("state"),
                    (4 + F.col("n_nationkey") % 6).cast("int").alias("rate_pct"))


def encumbrances(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(listed on the certificate, disclosed in the deed) per part; some are not disclosed."""
    li = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("bundle_id"), "l_orderkey")
    k = F.col("l_orderkey")
    ref = F.concat(F.lit("R"), k.cast("string"))
    # dealt out by the pair before it is made distinct, so that no task holds the pairs of a whole split of the file; the
    # references of distinct keys are distinct, and only "none" stands for several
    li = li.repartition("bundle_id", "l_orderkey").distinct()
    hidden = F.coalesce(k % 29 == 4, F.lit(False))
    none = li.filter(hidden).select("bundle_id").distinct().select("bundle_id", F.lit("none").alias("ref"))
    certificate = li.select("bundle_id", ref.alias("ref"))
    return certificate, li.filter(~hidden).select("bundle_id", ref.alias("ref")).unionByName(none)
