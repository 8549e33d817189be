"""Intake: binary documents behind guards, nested extractions, JSON-lines results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docassay.operators.claims import vocabulary
from docassay.rulebook import MAX_FILE_BYTES, SUMMARY_KINDS
from docassay.session import durable

# Accepted types and the first bytes that identify them, in hex.
MAGIC = {"application/pdf": "255044462D", "image/png": "89504E470D0A1A0A", "image/jpeg": "FFD8FF"}


def binary_files(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """Files as path, length and first bytes. Oversized files are listed without being read.

    Spark's file source plans no split for an empty file, so an empty file never shows up in its rows. Where the
    upload list (path, length) is known, pass it as ``manifest``: its entries stay whole, empty ones included.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= MAX_FILE_BYTES).select("path", "length", F.substring("content", 1, 16).alias("head"))
    large = files.filter(F.col("length") > MAX_FILE_BYTES).select("path", "length", F.lit(None).cast("binary").alias("head"))
    seen = small.unionByName(large)
    if manifest is None:
        return seen
    return manifest.select("path", "length").join(seen.select("path", "head"), "path", "left")


def guard(files: DataFrame, mime: Column | None = None) -> DataFrame:
    """Add ``reason``: empty string for accepted files. ``files``: length, head; the declared type is optional."""
    start = F.hex("head")
    kind = F.lit(None).cast("string")
    for m, magic in MAGIC.items():
        kind = F.when(start.startswith(magic), F.lit(m)).otherwise(kind)
    declared = mime if mime is not None else kind
    reason = (
        F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_FILE_BYTES, "too_large")
        .when(F.coalesce(~declared.isin(*MAGIC), F.lit(True)), "type_not_allowed")
        .when(F.coalesce(kind != declared, F.lit(True)), "magic_mismatch").otherwise(""))
    return files.withColumn("reason", reason)


BOX = "array<double>"
VALUE = f"struct<value: string, bbox: {BOX}, confidence: double>"
EXTRACTION = (
    f"doc_type string, primary_language string, fields array<struct<predicate: string, value: string, bbox: {BOX}, confidence: double>>, "
    f"transactions array<struct<seq: int, posted_on: {VALUE}, description: {VALUE}, debit: {VALUE}, credit: {VALUE}, running_balance: {VALUE}>>, "
    f"summary_rows array<struct<kind: string, amount: {VALUE}>>")


def unit_box(b: Column) -> Column:
    """A box inside the page, else null."""
    x, y, w, h = (F.get(b, F.lit(i)) for i in range(4))
    inside = F.forall(b, lambda c: c.between(0.0, 1.0)) & (F.size(b) == 4) & (w > 0) & (h > 0) & (x + w <= 1.000001) & (y + h <= 1.000001)
    return F.when(inside, b)


#: Cells of a transaction.
CELLS = ("posted_on", "description", "debit", "credit", "running_balance")


def page_types(pages: DataFrame) -> DataFrame:
    """``doc_id, page, doc_type, primary_language`` of readable pages; OTHER and en where a page does not say."""
    x = F.from_json("json", EXTRACTION, {"mode": "PERMISSIVE"})
    p = pages.withColumn("x", x).filter("x is not null")
    return p.select("doc_id", "page", F.coalesce(F.nullif("x.doc_type", F.lit("")), F.lit("OTHER")).alias("doc_type"),
                    F.substring(F.coalesce(F.nullif("x.primary_language", F.lit("")), F.lit("en")), 1, 12).alias("primary_language"))


def extraction_items(pages: DataFrame) -> DataFrame:
    """JSON pages (doc_id, page, json) to items with ``reject``: empty for kept ones.

    Lenient by item: a bad item is marked, the page survives. Every cell of every transaction is an item with the
    transaction's ``seq``. An unparseable page gives one rejected row; a page without a type is kept (see ``page_types``).
    """
    # written once: each kind of item reads it, and filters on a parsed page would parse it again, before any shuffle
    p = durable(pages.select("doc_id", "page", F.col("json").isNotNull().alias("given"), F.from_json("json", EXTRACTION, {"mode": "PERMISSIVE"}).alias("x")))
    fields = p.select("doc_id", "page", F.explode("x.fields").alias("i")).select(
        "doc_id", "page", F.lit("field").alias("part"), "i.predicate", "i.value", "i.bbox", "i.confidence")
    rows = p.select("doc_id", "page", F.explode("x.summary_rows").alias("i")).select(
        "doc_id", "page", F.lit("summary").alias("part"), F.col("i.kind").alias("predicate"), "i.amount.value", "i.amount.bbox",
        "i.amount.confidence")
    line = p.select("doc_id", "page", F.explode("x.transactions").alias("t"))
    cells = F.array(*[F.struct(F.lit(c).alias("predicate"), F.col(f"t.{c}").alias("v")) for c in CELLS])
    moves = line.select("doc_id", "page", F.explode(F.filter(cells, lambda c: c["v"].isNotNull())).alias("i"), F.col("t.seq").alias("seq")).select(
        "doc_id", "page", F.lit("transaction").alias("part"), "i.predicate", "i.v.value", "i.v.bbox", "i.v.confidence", "seq")
    broken = p.filter(F.col("x").isNull() | (F.col("given") & F.forall(F.array(*[F.col(f"x.{c}") for c in ("doc_type", "primary_language")]), lambda c: c.isNull())
                                             & F.col("x.fields").isNull() & F.col("x.transactions").isNull() & F.col("x.summary_rows").isNull())).select(
        "doc_id", "page", F.lit("page").alias("part"), F.lit("").alias("predicate"), F.lit("").alias("value"),
        F.lit(None).cast(BOX).alias("bbox"), F.lit(None).cast("double").alias("confidence"))
    items = fields.unionByName(rows).unionByName(broken).withColumn("seq", F.lit(None).cast("int")).unionByName(moves)
    vocab = F.broadcast(vocabulary(pages.sparkSession).withColumn("known", F.lit(True)))  # fixed vocabulary
    j = items.join(vocab, "predicate", "left")
    bad_conf = ~F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    known = F.when(F.col("part") == "transaction", F.lit(True)).when(F.col("part") == "summary", F.col("predicate").isin(*SUMMARY_KINDS)).otherwise(F.coalesce("known", F.lit(False)))
    reject = (
        F.when(F.col("part") == "page", "unreadable_page").when(F.col("value").isNull() | bad_conf, "malformed")
        .when(~known, "unknown_predicate").otherwise(""))
    return j.select("doc_id", "page", "part", "seq", "predicate", "value", unit_box(F.col("bbox")).alias("bbox"), "confidence",
                    F.coalesce("value_type", F.when(F.col("part") == "summary", F.lit("Money")), F.when(F.col("part") == "transaction", F.when(
                        F.col("predicate") == "posted_on", "Date").when(F.col("predicate") == "description", "Text").otherwise("Money"))).alias("value_type"), reject.alias("reject"))


RESULTS = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("category", T.StringType()), T.StructField("is_genuine", T.BooleanType()),
    T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("key_signal", T.StringType())])


def results(spark: SparkSession, path: str) -> DataFrame:
    """Run results from JSON lines, with an explicit schema."""
    return spark.read.schema(RESULTS).json(path)
