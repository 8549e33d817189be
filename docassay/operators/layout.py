"""Word geometry: rows, columns, statement tables, line outliers, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.functions.money import currency_like, parse_money
from docassay.operators.scan import exact_median, exact_medians, ordered
from docassay.rulebook import (
    HEADER_SYNONYMS, HETEROGENEITY_FRACTION, HETEROGENEITY_MIN_WORDS, LINE_FLOOR, LINE_MIN_CHARS, LINE_MIN_CONF,
    LINE_MIN_WORDS, LINE_SLOPE, LINE_STROKE_FLOOR, LINE_SUSPICION, LINE_Z, OCR_MIN_CONFIDENCE, ROW_LABELS,
)

PAGE = ["doc_id", "page"]


def center_y() -> Column:
    return F.col("top") + F.col("height") / 2.0


def cluster_rows(words: DataFrame, keys: list[str], out: str = "row_id", base: DataFrame | None = None) -> DataFrame:
    """Gaps and islands over vertical centres: a new row where the step exceeds max(0.8 x median height, 6).

    Words of one height share a centre, so the islands are found on distinct centres and joined back.
    """
    med = exact_median(words, keys, "height", base=base).select(*keys, F.greatest(F.col("median") * 0.8, F.lit(6.0)).alias("band"))
    w = words.withColumn("y2", F.col("top") * 2 + F.col("height"))
    ys = w.select(*keys, "y2").distinct()
    ys = ordered(ys, keys, ["y2"], lasts={"before": F.col("y2")}, base=base if base is not None else words)
    ys = ys.join(med, keys)
    new = F.coalesce(((F.col("y2") - F.col("before")) / 2.0 > F.col("band")).cast("int"), F.lit(0)).cast("bigint")
    ys = ordered(ys, keys, ["y2"], sums={out: new}, base=base if base is not None else words)
    return w.join(ys.select(*keys, "y2", out), [*keys, "y2"]).drop("y2")


def detect_columns(words: DataFrame, keys: list[str]) -> DataFrame:
    """Column ranges of each page: the row with most distinct header words, cut at the midpoints between them.

    Needs a balance column and a debit or credit column. At most five labels per page, so the windows are tiny.
    """
    spark = words.sparkSession
    syn = spark.createDataFrame([(w, c) for c, ws in HEADER_SYNONYMS.items() for w in ws], "token string, label string")
    # a fixed vocabulary; a word takes the first label that lists it
    hits = words.withColumn("token", F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")).join(F.broadcast(syn), "token")
    rows = cluster_rows(hits, keys)
    per = rows.groupBy(*keys, "row_id").agg(
        F.count_distinct("label").alias("labels"), F.max(F.col("top") + F.col("height")).alias("bottom"))
    best = per.groupBy(*keys).agg(F.max_by(F.struct("row_id", "bottom"), F.struct("labels", -F.col("row_id"))).alias("b"))
    best = best.select(*keys, "b.row_id", F.col("b.bottom").alias("header_bottom"))
    h = rows.join(best, [*keys, "row_id"]).groupBy(*keys, "header_bottom", "label").agg(
        F.min_by(F.col("left") + F.col("width") / 2.0, "left").alias("cx"))
    ok = h.groupBy(*keys).agg(F.max(F.col("label") == "balance").alias("b"), F.max(F.col("label").isin("debit", "credit")).alias("m"))
    h = h.join(ok.filter("b AND m").select(*keys), keys, "left_semi")
    w = Window.partitionBy(*keys).orderBy("cx")
    low = (F.lag("cx").over(w) + F.col("cx")) / 2.0
    high = (F.lead("cx").over(w) + F.col("cx")) / 2.0
    return h.select(*keys, "header_bottom", "label", F.coalesce(low, F.lit(-1e9)).alias("x_left"),
                    F.coalesce(high, F.lit(1e9)).alias("x_right"))


def _has(label: Column, kind: str) -> Column:
    hit = F.lit(False)
    for t in ROW_LABELS[kind]:
        hit = hit | F.contains(label, F.lit(t))
    return hit


def reconstruct(words: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Printed rows under the header with their kind (opening, closing, charge, interest, total, txn) and amounts."""
    cx = F.col("left") + F.col("width") / 2.0
    head = columns.select(*keys, "header_bottom").distinct()
    body = words.join(head, keys).filter(center_y() > F.col("header_bottom")).drop("header_bottom")
    body = cluster_rows(body, keys)
    cells = body.withColumn("cx", cx).join(columns.select(*keys, "label", "x_left", "x_right"), keys).filter(
        (F.col("cx") >= F.col("x_left")) & (F.col("cx") < F.col("x_right")))
    # words of one printed row
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    last = F.max_by(F.when(parse_money(F.col("text")).isNotNull(), parse_money(F.col("text"))),
                    F.when(parse_money(F.col("text")).isNotNull(), F.col("left")))
    cell = cells.groupBy(*keys, "row_id", "label").agg(text.alias("cell"), last.alias("last_money"))
    cell = cell.withColumn("money", F.coalesce(parse_money(F.col("cell")), F.col("last_money")))

    def pick(label: str, col: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col(col)))

    per = cell.groupBy(*keys, "row_id").agg(
        pick("balance", "money").alias("balance"), pick("debit", "money").alias("debit"),
        pick("credit", "money").alias("credit"), pick("date", "cell").alias("date"),
        pick("description", "cell").alias("description"))
    label = body.groupBy(*keys, "row_id").agg(F.regexp_replace(F.lower(text), "[^a-z0-9]", "").alias("row_label"))
    r = per.join(label, [*keys, "row_id"])
    l, no_bal = F.col("row_label"), F.col("balance").isNull()
    no_move = F.col("debit").isNull() & F.col("credit").isNull()
    kind = (
        F.when(_has(l, "opening") & ~no_bal & no_move, "opening").when(_has(l, "closing") & ~no_bal & no_move, "closing")
        .when(_has(l, "charge") & no_bal & ~no_move, "charge").when(_has(l, "interest") & no_bal & ~no_move, "interest")
        .when(_has(l, "total") & no_bal & ~no_move, "total").when(no_bal & no_move, "none").otherwise("txn"))
    return r.withColumn("kind", kind).drop("row_label")


def statements(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Header figures of each reconstructed statement."""
    k = F.col("kind")
    at = F.col("row_id")

    def latest(kind: str, col: str) -> Column:
        return F.max_by(F.col(col), F.when((k == kind) & F.col(col).isNotNull(), at))

    return rows.groupBy(*keys).agg(
        latest("opening", "balance").alias("opening"), latest("closing", "balance").alias("closing"),
        latest("total", "debit").alias("total_debits"), latest("total", "credit").alias("total_credits"),
        F.sum(F.when(k == "charge", F.coalesce("debit", "credit"))).alias("charges"),
        F.sum(F.when(k == "interest", F.coalesce("credit", "debit"))).alias("interest"),
        F.count_if(k == "txn").alias("txns")).filter("txns > 0")


def uncaptured_money(words: DataFrame, columns: DataFrame, keys: list[str]) -> DataFrame:
    """Currency-shaped words below the header outside every column, per page."""
    head = columns.groupBy(*keys).agg(F.max("header_bottom").alias("header_bottom"))
    w = words.join(head, keys).filter((center_y() > F.col("header_bottom")) & currency_like(F.col("text")))
    w = w.withColumn("cx", F.col("left") + F.col("width") / 2.0).withColumn("_w", F.monotonically_increasing_id())
    inside = (F.col("cx") >= F.col("x_left")) & (F.col("cx") < F.col("x_right"))
    j = w.join(columns.select(*keys, "x_left", "x_right"), keys)  # at most five column rows per page
    out = j.groupBy(*keys, "left", "top", "text").agg(F.max(inside).alias("inside"))
    n = out.filter(~F.col("inside")).groupBy(*keys).agg(F.count(F.lit(1)).alias("uncaptured"))
    return head.join(n, keys, "left").select(*keys, F.coalesce("uncaptured", F.lit(0)).alias("uncaptured"))


def line_outliers(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words whose baseline, height or stroke is a robust outlier of their line.

    ``keys`` identify a line. Medians of integers are exact; baselines, heights and strokes are scaled to integers.
    """
    w = words.filter((F.length(F.trim("text")) >= LINE_MIN_CHARS) & (F.col("conf") >= LINE_MIN_CONF)).select(
        *keys, "pos", "text", (F.col("top") + F.col("height")).cast("bigint").alias("baseline"),
        F.col("height").cast("bigint").alias("height"), F.round(F.col("stroke") * 1000000).cast("bigint").alias("stroke"))
    n = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("stroke") > 0).alias("inked")).filter(
        F.col("n") >= LINE_MIN_WORDS)
    j = w.join(n, keys)
    measures = ("baseline", "height", "stroke")
    j = j.join(exact_medians(w, keys, {c: f"m_{c}" for c in measures}, words), keys)
    for c in ("baseline", "height", "stroke"):
        j = j.withColumn(f"d_{c}", F.round(F.abs(F.col(c) - F.col(f"m_{c}")) * 2).cast("bigint"))
    j = j.join(exact_medians(j, keys, {f"d_{c}": f"q_{c}" for c in measures}, words), keys)
    floor = LINE_FLOOR * F.when(F.col("m_height") == 0, 1.0).otherwise(F.col("m_height"))

    def z(c: str, low: Column) -> Column:
        return (F.col(c) - F.col(f"m_{c}")) / F.greatest(1.4826 * F.col(f"q_{c}") / 2.0, low)

    j = j.withColumn("z_baseline", z("baseline", floor)).withColumn("z_height", z("height", floor)).withColumn(
        "z_stroke", F.when(F.col("inked"), z("stroke", F.lit(LINE_STROKE_FLOOR * 1000000))).otherwise(0.0))
    worst = F.greatest(F.abs("z_baseline"), F.abs("z_height"), F.abs("z_stroke"))
    j = j.withColumn("z", worst).withColumn("hit", worst >= LINE_Z)
    per = j.groupBy(*keys).agg(F.count_if("hit").alias("hits"))
    return j.join(per, keys).withColumn("flagged", F.col("hit") & (F.col("hits") * 2 < F.col("n"))).select(
        *keys, "pos", "text", "z", "flagged")


def layout_signal(words: DataFrame, outliers: DataFrame) -> DataFrame:
    """Suspicion from the flagged words of a document; mixed typography is left pending."""
    usable = (F.length(F.trim("text")) >= LINE_MIN_CHARS) & (F.col("conf") >= LINE_MIN_CONF)
    n = words.groupBy("doc_id").agg(F.count_if(usable).alias("words"))
    g = outliers.groupBy("doc_id").agg(
        F.count_if("flagged").alias("flagged"), F.max(F.when(F.col("flagged"), F.col("z"))).alias("z"))
    j = n.join(g, "doc_id", "left")
    mixed = (F.col("words") >= HETEROGENEITY_MIN_WORDS) & (F.col("flagged") / F.col("words") > HETEROGENEITY_FRACTION)
    status = F.when(F.col("flagged").isNull() | mixed, "NOT_EVALUATED").otherwise("VALID")
    susp = F.when(F.col("flagged") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.round(
        LINE_SUSPICION + LINE_SLOPE * F.greatest(F.lit(0.0), F.col("z") - LINE_Z) + 0.1 * (F.col("flagged") - 1), 6)))
    return j.select("doc_id", status.alias("status"), F.coalesce(F.when(status == "VALID", susp), F.lit(-1.0)).alias("suspicion"),
                    F.coalesce("flagged", F.lit(0)).alias("flagged"))


def confidence_gate(words: DataFrame) -> DataFrame:
    """Mean word confidence per document; below the gate the document is unreadable."""
    g = words.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.avg("conf").alias("mean_conf"))
    return g.withColumn("readable", F.col("mean_conf") >= OCR_MIN_CONFIDENCE)


def line_texts(words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a printed line in reading order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("left", "text"))), lambda x: x["text"]), " ")
    return words.filter(F.col("text") != "").groupBy(*keys).agg(text.alias("line_text"))


def document_texts(words: DataFrame, keys: list[str], line: list[str]) -> DataFrame:
    """Text of each document from its words: lines in order, joined by line feeds; ``lines`` counts them.

    A document's lines meet in one row, since its text is one value.
    """
    each = line_texts(words, [*keys, *line])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*line, "line_text"))), lambda x: x["line_text"]), "\n")
    return each.groupBy(*keys).agg(F.count(F.lit(1)).alias("lines"), text.alias("text"))
