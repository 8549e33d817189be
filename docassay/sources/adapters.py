"""Document tables derived from the provided star schema.

The provided tables are generic; the operators work on ledgers, claims, identities, applications, words and so on.
Each adapter derives one such table from whole input tables, deterministically and with exact integer money. A
tampering is chosen by a remainder of a key inside ``when`` (all rows stay).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.functions.identity import verhoeff_digit
from docassay.operators.scan import ordered
from docassay.session import by_key
from docassay.sources.tables import apart, letter, paise, rupees, spread, table


TEXTS_TOGETHER = 10_000  # texts of a partition whose words are put together in it


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """One row per posted movement of an account statement, in paise, with the printed running balance."""
    o = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("acct"),
        F.col("o_orderkey").alias("okey"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.to_date("o_orderdate").alias("day"),
        paise("o_totalprice").alias("amount_p"),
    )
    cust = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("acct"), paise("c_acctbal").alias("opening_p")
    )
    o = o.withColumn("credit_p", F.when(F.col("status") == "F", F.col("amount_p"))).withColumn(
        "debit_p", F.when(F.col("status") != "F", F.col("amount_p"))
    )
    moved = F.coalesce("credit_p", F.lit(0)) - F.coalesce("debit_p", F.lit(0))
    o = ordered(o, ["acct"], ["day", "okey"],
                sums={"moved": moved, "pos": F.lit(1).cast("bigint")}, parts=apart(table(spark, folder, "orders")))
    o = o.join(by_key(cust), "acct")
    k, a = F.col("okey"), F.col("acct")
    idx = (F.col("pos") - 1).cast("int")
    true_balance = F.col("opening_p") + F.col("moved")
    move = F.coalesce("credit_p", F.lit(0)) - F.coalesce("debit_p", F.lit(0))
    printed = (
        F.when(k % 13 == 6, None)
        .when(k % 23 == 9, F.lit(100).cast("bigint"))
        .when(k % 62 == 4, true_balance - move * 2)
        .when((a % 7 == 3) & (idx == 2), true_balance + 100000)
        .otherwise(true_balance)
    )
    credit_x, debit_x = F.lit(850.0) + (k % 5), F.lit(700.0) + (k % 5)
    is_credit = F.col("credit_p").isNotNull()
    x = (
        F.when(k % 31 == 4, None)
        .when(k % 29 == 3, F.when(is_credit, debit_x).otherwise(credit_x))
        .otherwise(F.when(is_credit, credit_x).otherwise(debit_x))
    )
    posted = F.when(k % 101 == 7, F.date_sub("day", 40)).otherwise(F.col("day"))
    return o.select(
        F.concat(F.lit("S"), a.cast("string")).alias("doc_id"),
        "acct",
        "okey",
        idx.alias("idx"),
        posted.alias("posted"),
        "credit_p",
        "debit_p",
        printed.alias("balance_p"),
        "opening_p",
        F.when(F.col("priority") == "1-URGENT", F.lit("NEFT SALARY CREDIT"))
        .when(F.col("priority") == "2-HIGH", F.lit("IMPS/SAL/ACME"))
        .otherwise(F.lit("UPI WHOLESALE"))
        .alias("narration"),
        (k % 17 != 4).alias("move_agree"),
        (k % 11 != 5).alias("bal_agree"),
        F.when(k % 19 == 7, F.lit(0.5)).otherwise(F.lit(0.9)).alias("conf"),
        x.alias("x"),
    )


def ledger_keys(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of the ledger rows, straight from the scan: what the heavy-key count reads."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("S"), F.col("o_custkey").cast("string")).alias("doc_id"))


def summary(led: DataFrame) -> DataFrame:
    """Stated totals and closing balance of each statement, some of them edited."""
    a = F.col("acct")
    dr, cr = F.coalesce(F.sum("debit_p"), F.lit(0)), F.coalesce(F.sum("credit_p"), F.lit(0))
    g = led.groupBy("doc_id", "acct").agg(
        F.max("opening_p").alias("opening_p"),
        dr.alias("dr"),
        cr.alias("cr"),
        F.min("posted").alias("period_start"),
        F.max("posted").alias("period_end"),
    )
    return g.select(
        "doc_id",
        "acct",
        "opening_p",
        F.when(a % 13 == 4, F.col("opening_p") + F.col("cr") - F.col("dr") + 50000)
        .otherwise(F.col("opening_p") + F.col("cr") - F.col("dr"))
        .alias("closing_p"),
        F.col("dr").alias("total_debits_p"),
        F.when(a % 13 == 5, F.col("cr") + 25000).otherwise(F.col("cr")).alias("total_credits_p"),
        "period_start",
        "period_end",
    )


def _text(c: Column) -> Column:
    return c.cast("string")


def claims(spark: SparkSession, folder: str, led: DataFrame | None = None) -> DataFrame:
    """Claims of one bank statement, one salary slip and one income proof per customer."""
    led = ledger(spark, folder) if led is None else led
    subject = F.concat(F.lit("transaction_"), _text(F.col("idx")))
    date_text = F.date_format("posted", "dd/MM/yyyy")

    def cell(pred: str, value: Column, vtype: str, critical: bool, agree: Column, n: int) -> Column:
        return F.struct(
            F.lit(pred).alias("predicate"),
            value.alias("value"),
            F.lit(vtype).alias("value_type"),
            F.lit(critical).alias("cross_read_required"),
            agree.alias("agree"),
            (F.col("idx").cast("bigint") * 8 + n).alias("ord"),
        )

    cells = F.array(
        cell("posted_on", date_text, "Date", False, F.lit(False), 0),
        cell("description", F.col("narration"), "Text", False, F.lit(False), 1),
        cell("debit", _text(rupees("debit_p")), "Money", True, F.col("move_agree"), 2),
        cell("credit", _text(rupees("credit_p")), "Money", True, F.col("move_agree"), 3),
        cell("running_balance", _text(rupees("balance_p")), "Money", True, F.col("bal_agree"), 4),
    )
    txn = (
        led.select("doc_id", "idx", "conf", "x", F.explode(cells).alias("c"), subject.alias("subject"))
        .filter(F.col("c.value").isNotNull())
        .select(
            "doc_id",
            F.lit("BANK_STATEMENT").alias("doc_type"),
            "subject",
            "c.predicate",
            "c.value",
            "c.value_type",
            F.col("idx").alias("index"),
            "c.ord",
            "c.cross_read_required",
            "c.agree",
            F.col("conf").alias("confidence"),
            F.when(F.col("c.predicate").isin("debit", "credit"), F.col("x")).alias("x"),
        )
    )
    s = summary(led)

    def scalar(pred: str, value: Column, vtype: str, critical: bool, n: int, agree: Column | None = None) -> Column:
        return F.struct(
            F.lit(pred).alias("predicate"),
            value.alias("value"),
            F.lit(vtype).alias("value_type"),
            F.lit(critical).alias("cross_read_required"),
            (agree if agree is not None else F.lit(True)).alias("agree"),
            F.lit(n).cast("bigint").alias("ord"),
        )

    def scalars(df: DataFrame, doc_type: str, subj: Column, items: Column) -> DataFrame:
        return (
            df.select("doc_id", F.explode(items).alias("c"), subj.alias("subject"))
            .filter(F.col("c.value").isNotNull())
            .select(
                "doc_id",
                F.lit(doc_type).alias("doc_type"),
                "subject",
                "c.predicate",
                "c.value",
                "c.value_type",
                F.lit(None).cast("int").alias("index"),
                "c.ord",
                "c.cross_read_required",
                "c.agree",
                F.lit(0.9).alias("confidence"),
                F.lit(None).cast("double").alias("x"),
            )
        )

    bank = scalars(
        s,
        "BANK_STATEMENT",
        F.lit("account"),
        F.array(
            scalar("opening_balance", _text(rupees("opening_p")), "Money", True, -6),
            scalar("closing_balance", _text(rupees("closing_p")), "Money", True, -5,
                   F.col("acct") % 19 != 3),
            scalar("total_debits", _text(rupees("total_debits_p")), "Money", True, -4),
            scalar("total_credits", _text(rupees("total_credits_p")), "Money", True, -3),
            scalar("period_start", F.date_format("period_start", "yyyy-MM-dd"), "Date", False, -2),
            scalar("period_end", F.date_format("period_end", "yyyy-MM-dd"), "Date", False, -1),
        ),
    )
    inc = income(spark, folder)
    slip = scalars(
        inc.withColumn("doc_id", F.concat(F.lit("P"), _text(F.col("cust")))),
        "SALARY_SLIP",
        F.lit("salary_slip"),
        F.array(
            scalar("gross_earnings", _text(rupees("gross_p")), "Money", True, 0),
            scalar("total_deductions", _text(rupees("deductions_p")), "Money", True, 1),
            scalar("net_pay", _text(rupees("net_p")), "Money", True, 2),
            scalar("employer", F.col("employer"), "OrgName", False, 3),
        ),
    )
    proof = scalars(
        inc.withColumn("doc_id", F.concat(F.lit("I"), _text(F.col("cust")))),
        "FORM16",
        F.lit("income_proof"),
        F.array(
            scalar("gross_income", _text(rupees("annual_gross_p")), "Money", True, 0),
            scalar("taxable_income", _text(rupees("taxable_p")), "Money", True, 1, F.col("cust") % 23 != 5),
            scalar("employer", F.col("employer_proof"), "OrgName", False, 2),
        ),
    )
    return txn.unionByName(bank).unionByName(slip).unionByName(proof)


def income(spark: SparkSession, folder: str) -> DataFrame:
    """Payslip and income-proof figures per customer."""
    c = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("cust"), F.abs(paise("c_acctbal")).alias("base_p"), F.col("c_mktsegment").alias("seg")
    )
    k = F.col("cust")
    gross = F.col("base_p") + 5000000
    ded = F.expr("base_p div 10") + 100000
    net = gross - ded
    annual = net * 12
    return c.select(
        "cust",
        gross.alias("gross_p"),
        ded.alias("deductions_p"),
        F.when(k % 11 == 4, net + 500000).otherwise(net).alias("net_p"),
        F.when(k % 9 == 2, F.expr("(base_p + 5000000 - base_p div 10 - 100000) * 6"))
        .otherwise(annual + 6000000)
        .alias("annual_gross_p"),
        F.when(k % 10 == 3, annual + 7000000).otherwise(annual - 1000000).alias("taxable_p"),
        F.concat(F.col("seg"), F.lit(" MILLS PVT LTD")).alias("employer"),
        F.when(k % 8 == 5, F.lit("NORTHWIND TRADERS"))
        .when(k % 8 == 6, F.concat(F.col("seg"), F.lit(" MILS LIMITED")))
        .otherwise(F.concat(F.col("seg"), F.lit(" Mills Private Limited")))
        .alias("employer_proof"),
    )


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Identity fields as read from four documents of each applicant."""
    k = F.col("cust")
    c = spread(table(spark, folder, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_nationkey").alias("nation")))
    pan = F.concat(
        letter(k), letter(F.expr("cust div 26")), letter(F.expr("cust div 676")), F.lit("P"),
        letter(F.expr("cust div 7")), F.lpad(_text(k % 10000), 4, "0"), letter(F.expr("cust div 3")),
    )
    eleven = F.concat(F.lit("3"), F.lpad(_text(k), 10, "0"))
    ifsc = F.concat(
        F.element_at(F.array(*[F.lit(p) for p in ("SBIN", "HDFC", "ICIC", "UTIB", "CNRB", "PUNB", "KKBK")]),
                     (F.col("nation") % 7 + 1).cast("int")),
        F.lit("0"), F.lpad(_text(k % 1000000), 6, "0"),
    )
    docs = F.array(*[F.lit(x) for x in ("statement", "payslip", "pan_card", "aadhaar_card")])
    c = c.select(
        "cust", "nation", pan.alias("pan0"), F.concat(eleven, _text(verhoeff_digit(eleven))).alias("aad0"),
        ifsc.alias("ifsc0"), F.posexplode(docs).alias("d", "doc_label"),
    )
    d = F.col("d")
    two, five = (k % 17 == 2) & (d == 1), (k % 17 == 5) & (d == 2)
    name = F.concat(F.lit("RAVI "), letter(k), F.lit("UMAR "), F.lit("SHARMA"))
    return c.select(
        F.col("cust").alias("bundle_id"),
        d.alias("ord"),
        "doc_label",
        F.when(two, F.concat(F.substring("pan0", 1, 9), F.lit("#"))).when(five, F.lit("ZZZPZ9999Z"))
        .otherwise(F.col("pan0")).alias("pan"),
        F.when(d.isin(0, 1), None).when((k % 19 == 4) & (d == 3), F.lit("300000000000"))
        .otherwise(F.col("aad0")).alias("aadhaar"),
        F.when(d == 0, F.col("ifsc0")).when((d == 1) & (k % 29 != 6), F.col("ifsc0"))
        .when(d == 1, F.lit("SBIN0999999")).alias("ifsc"),
        F.when(d <= 1, F.lpad(_text(k * 7 + 100000000), 12, "0")).alias("account_number"),
        F.when((k % 23 == 7) & (d == 3), F.lit("ANIL KUMAR VERMA"))
        .when(d == 1, F.concat(F.lit("R "), letter(k), F.lit(" SHARMA")))
        .when((d == 2) & (k % 5 == 1), F.concat(F.lit("RAVI "), letter(k), F.lit("UMAR SHARMAA")))
        .otherwise(name).alias("name"),
        F.when(d >= 2, F.concat(_text(1960 + k % 40), F.lit("-0"), _text(1 + k % 9), F.lit("-1"), _text(k % 10)))
        .alias("dob"),
    )


def kyc_text(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled identity text per document; issuer names are mixed in."""
    e = entities(spark, folder)
    k = F.col("bundle_id")
    spaced = F.concat_ws(" ", F.substring("aadhaar", 1, 4), F.substring("aadhaar", 5, 4), F.substring("aadhaar", 9, 4))
    aad = F.when(F.col("aadhaar").isNull(), F.lit("")).when(
        k % 3 == 0, F.concat(F.lit("Aadhaar No: "), F.col("aadhaar"), F.lit("\n"))
    ).when(k % 3 == 1, F.concat(F.lit("ID "), spaced, F.lit("\n"))).otherwise(
        F.concat(F.lit("Reference "), F.col("aadhaar"), F.lit("\n"))
    )
    born = F.when(
        F.col("dob").isNotNull(),
        F.concat(F.lit("Date of Birth: "),
                 F.when(k % 2 == 0, F.date_format(F.to_date("dob"), "dd/MM/yyyy")).otherwise(F.col("dob")),
                 F.lit("\n")),
    ).otherwise(F.lit(""))
    account = F.when(
        F.col("account_number").isNotNull(), F.concat(F.lit("A/c No: "), F.col("account_number"), F.lit("\n"))
    ).otherwise(F.lit(""))
    ifsc = F.when(
        F.col("ifsc").isNotNull() & (k % 4 != 1), F.concat(F.lit("IFSC "), F.col("ifsc"), F.lit("\n"))
    ).otherwise(F.lit(""))
    bank = F.when(k % 4 == 1, F.lit("Statement of Account\nCanara Bank and HDFC Bank\n")).when(
        k % 4 == 2, F.lit("Opening balance and closing balance\n")
    ).when(k % 4 == 3, F.lit("Salary slip net pay for axis\n")).otherwise(F.lit("Permanent Account Number\n"))
    return e.select(
        F.concat(F.col("doc_label"), F.lit("-"), _text(k)).alias("doc_id"),
        k.alias("bundle_id"),
        F.concat(
            bank, F.lit("Customer Name: Mr. "), F.initcap("name"), F.lit("\nPAN "), F.col("pan"), F.lit("\n"), aad,
            born, account, ifsc,
        ).alias("text"),
    )


def applications(spark: SparkSession, folder: str) -> DataFrame:
    """Identifiers of loan applications, one row per (case, kind); sparse sharing so that rings stay small."""
    c = spread(table(spark, folder, "customer").select("c_custkey", "c_nationkey")).select(
        F.col("c_custkey").alias("cust"), F.concat(F.lit("bank"), _text(F.col("c_nationkey"))).alias("bank_id")
    )
    k = F.col("cust")
    group = F.expr("cust div 20")
    items = F.array(
        F.struct(
            F.lit("payout_account").alias("kind"),
            F.when(k % 20 < 5, F.concat(F.lit("77-"), F.lpad(_text(group), 8, "0")))
            .otherwise(F.concat(F.lit("88-"), F.lpad(_text(k), 8, "0"))).alias("value"),
        ),
        F.struct(
            F.lit("device").alias("kind"),
            F.when((k % 20).between(4, 8), F.concat(F.lit("dev g"), _text(group)))
            .otherwise(F.concat(F.lit("dev  "), _text(k))).alias("value"),
        ),
        F.struct(
            F.lit("employer").alias("kind"),
            F.when((k % 20).between(12, 15), F.concat(F.lit("emp g"), _text(group)))
            .otherwise(F.concat(F.lit("emp "), _text(k))).alias("value"),
        ),
        F.struct(F.lit("phone").alias("kind"), F.concat(F.lit("+91 9"), F.lpad(_text(k), 9, "0")).alias("value")),
    )
    return c.select(
        F.concat(F.lit("C"), F.lpad(_text(k), 12, "0")).alias("case_id"), "bank_id", F.explode(items).alias("i")
    ).select("case_id", "bank_id", "i.kind", "i.value")


def _mask_hex(base: Column, start: int, bits: Column) -> Column:
    """Flip the lowest ``bits`` bits of the 32-bit word that starts at hex digit ``start``."""
    word = F.conv(F.substring(base, start, 8), 16, 10).cast("bigint")
    mask = (F.pow(F.lit(2.0), bits) - 1).cast("bigint")
    flipped = F.lpad(F.lower(F.hex(word.bitwiseXOR(mask))), 8, "0")
    return F.concat(F.substring(base, 1, start - 1), flipped, F.substring(base, start + 8, 64))


def fraud_store(spark: SparkSession, folder: str) -> DataFrame:
    """Stored 256-bit hashes: groups of five documents share a hash up to 0, 3, 6, 9 or 12 bits."""
    d = table(spark, folder, "documents").select("doc_id", "source")
    base = F.sha2(F.expr("cast(doc_id div 5 as string)").cast("binary"), 256)
    return d.select(
        F.col("doc_id").alias("entry_id"),
        F.col("source").alias("label"),
        _mask_hex(base, 57, (F.col("doc_id") % 5) * 3).alias("hash_hex"),
    )


def query_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes of newly submitted documents, up to 3 bits away from their group in another word."""
    x = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    base = F.sha2(F.expr("cast(doc_id div 5 as string)").cast("binary"), 256)
    return x.select(
        F.col("doc_id").alias("query_id"),
        _mask_hex(base, 1, F.col("quality") * 2 + F.col("toxic")).alias("hash_hex"),
    )


def words(spark: SparkSession, folder: str, together: bool = False) -> DataFrame:
    """Printed words of every document with geometry; whole texts. ``together``: texts are dealt out by document before they
    become words, so that what is grouped by document or line afterwards need not move again."""
    d = table(spark, folder, "documents").select("doc_id", "text")
    if together:
        d = d.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-d.count() // TEXTS_TOGETHER)), "doc_id")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    w = lines.select("doc_id", "line", F.posexplode(F.split("line_text", " ")).alias("pos", "text"))
    w = w.filter(F.col("text") != "")
    k = F.col("doc_id") + F.col("line") + F.col("pos")
    return w.select(
        "doc_id",
        F.lit(0).alias("page"),
        F.lit(0).alias("block"),
        "line",
        "pos",
        "text",
        (F.col("pos") * 60).alias("left"),
        (F.col("line") * 20 + F.when(k % 97 == 0, 9).otherwise((k % 2).cast("int"))).alias("top"),
        (F.length("text") * 8).alias("width"),
        F.when(k % 89 == 5, 22).otherwise(12).alias("height"),
        F.when(k % 83 == 2, F.lit(0.2)).otherwise(F.lit(0.1)).alias("stroke"),
        (F.lit(30.0) + (k % 70)).alias("conf100"),
    ).withColumn("conf", F.col("conf100") / 100).drop("conf100")


def deeds(spark: SparkSession, folder: str) -> DataFrame:
    """Title deeds: one per line item; the parcel is the part."""
    li = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_partkey").alias("parcel"), "l_suppkey",
        F.to_date("l_shipdate").alias("executed"), paise("l_extendedprice").alias("consideration_p"),
        F.round(F.col("l_tax") * 100).cast("int").alias("tax_pct"),
        F.round(F.col("l_discount") * 100).cast("int").alias("disc_pct"),
        F.col("l_quantity").cast("int").alias("qty"),
    )
    k = F.col("l_orderkey")
    p = F.col("parcel") % 7
    return li.select(
        (k * 8 + F.col("l_linenumber")).alias("deed_id"),
        "parcel",
        F.col("l_suppkey").alias("applicant"),
        "executed",
        "consideration_p",
        "qty",
        "tax_pct",
        "disc_pct",
        F.concat(F.lit("ASHA "), letter(F.when(k % 5 == 0, p + 1).otherwise(p)), F.lit("OWNER")).alias("seller"),
        F.concat(F.lit("ASHA "), letter(p), F.lit("OWNER")).alias("buyer"),
        F.when(k % 9 == 4, F.date_add("executed", 200)).otherwise(F.date_add("executed", 30)).alias("registered"),
    )


def labelled_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled cases: document features with a fraud flag."""
    lab = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    d = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(d, "doc_id").select(
        F.col("doc_id").alias("case_no"), F.col("n_chars").cast("double").alias("n_chars"),
        F.col("toxic").cast("double").alias("toxic"), "lang", "source", (F.col("quality") == 0).alias("is_fraud"),
    )


def audit_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events to be chained, one chain per user."""
    e = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select(
        F.concat(F.lit("u"), _text(F.col("user_id"))).alias("chain_id"),
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        F.concat(F.lit('{"event":'), _text(F.col("event_id")), F.lit(',"kind":"'), F.col("event_type"), F.lit('"}'))
        .alias("payload"),
    )


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Analyzer signals per document: one per (order, line) with statuses, weights and flags that vary by key."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_suppkey")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    pick = (n - 1).cast("int")
    names = ["financial_consistency", "cross_document_consistency", "font_layout", "anomaly_intelligence",
             "signature", "pdf_only_red_flag", "phash_resubmission"]
    weights = [0.40, 0.50, 0.10, 0.10, 0.0, 0.10, 0.15]
    arr = F.array(*[F.lit(x) for x in names])
    warr = F.array(*[F.lit(x) for x in weights])
    base = F.round(F.col("l_discount") * 4, 2)
    status = (
        F.when((k + n) % 37 == 1, "ERROR").when((k + n * 3) % 6 == 1, "NOT_EVALUATED").otherwise("VALID")
    )
    return li.select(
        k.alias("doc_id"),
        n.cast("int").alias("ord"),
        F.element_at(arr, pick + 1).alias("name"),
        F.when(pick.isin(4, 5), 1).otherwise(3).alias("layer"),
        status.alias("status"),
        F.when(
            status == "VALID",
            F.when(pick == 1, F.when(k % 4 == 0, F.lit(0.4)).otherwise(F.lit(0.04))).when(
                k % 3 == 0, base).otherwise(F.lit(0.0)),
        ).alias("suspicion"),
        F.element_at(warr, pick + 1).alias("weight"),
        ((pick == 6) & (k % 41 == 3)).alias("hard_reject"),
        (pick == 3).alias("review_only"),
        F.when(pick == 4, F.when(k % 31 == 5, "tampered").when(k % 7 == 2, "verified").otherwise("absent"))
        .alias("provenance"),
        F.when((pick == 5) & (k % 5 == 1), F.lit("pdf_only_when_pullable")).alias("red_flag"),
    )
