"""Joins by position and line: cross-read of boxes, reader consensus, line differences, page confirmation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docassay.functions.money import numbers_in
from docassay.rulebook import REGION_PAD


def text_layer_cross_read(claims: DataFrame, words: DataFrame, tol: str = "1.0", pad: float = REGION_PAD) -> DataFrame:
    """Confirm a claimed number by the words printed in its box, else anywhere on its page.

    ``claims``: claim_id, doc_id, page, claimed DECIMAL, x, y, w, h (null box = ungrounded). ``words``: doc_id, page, x,
    y, w, h, text. A box meets its words by page and grid cell, so a crowded page splits over its cells; the page
    question is an equi join on the rounded amount, never page x claims.
    """
    strip = 0.05
    n = words.select("doc_id", "page", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"),
                     F.explode(numbers_in(F.col("text"))).alias("n"))
    box = claims.filter(F.col("x").isNotNull())

    def span(at: str, size: str):
        return F.sequence(F.floor((F.col(at) - pad) / strip).cast("int"), F.floor((F.col(at) + F.col(size) + pad) / strip).cast("int"))

    b = box.withColumn("gx", F.explode(span("x", "w"))).withColumn("gy", F.explode(span("y", "h")))
    cells = n.withColumn("gx", F.floor(F.col("cx") / strip).cast("int")).withColumn("gy", F.floor(F.col("cy") / strip).cast("int"))
    inside = (
        F.col("cx").between(F.col("x") - pad, F.col("x") + F.col("w") + pad)
        & F.col("cy").between(F.col("y") - pad, F.col("y") + F.col("h") + pad))
    near = F.abs(F.col("n") - F.col("claimed")) <= F.lit(tol).cast("decimal(10,4)")
    cell = b.join(cells, ["doc_id", "page", "gx", "gy"]).filter(inside)
    cell = cell.groupBy("claim_id").agg(F.count(F.lit(1)).alias("in_cell"), F.max(near).alias("cell_ok"))
    # page presence: an amount within tolerance lies in one of three neighbouring whole-unit buckets
    pages = n.select("doc_id", "page", "n").distinct()
    pages = pages.withColumn("bucket", F.floor(F.col("n") / F.lit(tol).cast("decimal(10,4)")).cast("bigint"))
    base = F.floor(F.col("claimed") / F.lit(tol).cast("decimal(10,4)")).cast("bigint")
    asked = box.withColumn("bucket", F.explode(F.array(base - 1, base, base + 1)))
    page_hit = asked.join(pages, ["doc_id", "page", "bucket"]).filter(near).select("claim_id").distinct().withColumn(
        "on_page", F.lit(True))
    j = claims.join(cell, "claim_id", "left").join(page_hit, "claim_id", "left")
    outcome = (
        F.when(F.col("x").isNull(), "ungrounded").when(F.col("cell_ok"), "confirmed_cell")
        .when(F.col("in_cell") > 0, "other_figure").when(F.col("on_page"), "confirmed_page").otherwise("not_printed"))
    return j.select("claim_id", outcome.alias("outcome"), outcome.isin("confirmed_cell", "confirmed_page").alias("agree"))


def reader_consensus(reads: DataFrame, keys: list[str], tol: float = 1.0) -> DataFrame:
    """At least one reader matches and none contradicts. ``reads``: keys, reader, claimed, read (null = nothing read)."""
    has, match = F.col("read").isNotNull(), F.abs(F.col("read") - F.col("claimed")) <= tol
    g = reads.groupBy(*keys).agg(F.count_if(has & match).alias("matching"), F.count_if(has & ~match).alias("contradicting"))
    return g.withColumn("agree", (F.col("matching") >= 1) & (F.col("contradicting") == 0))


def printed_on_page(claims: DataFrame, pages: DataFrame, keys: list[str], value: str, shape: str) -> DataFrame:
    """The value has its shape and stands on its page, spaces ignored."""
    needle = F.upper(F.regexp_replace(value, r"\s", ""))
    hay = F.upper(F.regexp_replace("text", r"\s", ""))
    j = claims.join(pages, keys, "left")
    ok = needle.rlike(shape) & F.contains(hay, needle)
    return j.withColumn("confirmed", F.coalesce(ok, F.lit(False))).drop("text")


def line_diff(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Lines that differ by position between two texts of a pair; a missing side is marked."""
    la = a.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "left_line"))
    lb = b.select(key, F.posexplode(F.split("text", "\n")).alias("pos", "right_line"))
    j = la.join(lb, [key, "pos"], "full").filter(~F.col("left_line").eqNullSafe(F.col("right_line")))
    return j.select(key, "pos", F.coalesce("left_line", F.lit("<missing>")).alias("left_line"),
                    F.coalesce("right_line", F.lit("<missing>")).alias("right_line"))


def route_providers(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """First applicable provider in preference order; a consent for another class is refused.

    ``providers``: provider, doc_class, preference.
    """
    j = requests.join(providers, "doc_class", "left")
    g = j.groupBy("request_id", "doc_class", "consent_class").agg(F.min_by("provider", "preference").alias("provider"))
    status = F.when(F.col("consent_class") != F.col("doc_class"), "NOT_VERIFIED").when(
        F.col("provider").isNull(), "NO_PROVIDER").otherwise("ROUTED")
    return g.select("request_id", F.coalesce("provider", F.lit("")).alias("provider"), status.alias("status"))
