"""Rules over title deeds and the documents around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.names import names_agree
from docassay.operators import checks as C
from docassay.operators.scan import ordered


def _out(df: DataFrame, key: str, rule: str, ok: Column) -> DataFrame:
    """Rule result of a bundle from a three-valued condition."""
    return df.select(
        key, F.lit(rule).alias("rule_id"),
        F.when(ok.isNull(), "NOT_EVALUATED").when(ok, "PASS").otherwise("FAIL").alias("status"),
    )


def seller_is_owner(b: DataFrame) -> DataFrame:
    return _out(b, "bundle_id", "L1", names_agree(F.col("seller"), F.col("owner")))


def registration_window(deeds: DataFrame, months: int = 4) -> DataFrame:
    k = C.date_within(F.col("registered"), F.col("executed"), months)
    return deeds.withColumn("k", k)


def property_identity(values: DataFrame) -> DataFrame:
    """``values``: (bundle_id, survey) rows of the deed, the record and the certificate."""
    c = C.consistency_across(values, ["bundle_id"], F.col("survey"))
    return _out(c, "bundle_id", "L3", F.when(F.col("evaluated"), F.col("passed")))


def extent_agreement(b: DataFrame) -> DataFrame:
    k = C.quantity_equal(b, ("deed_extent", "deed_unit"), ("record_extent", "record_unit"), "area", 0.5)
    return _out(k, "bundle_id", "L4", F.when(F.col("check.evaluated"), F.col("check.passed")))


def stamp_duty(b: DataFrame, rates: DataFrame) -> DataFrame:
    """Paid duty against rate times the larger of price and guidance value, within five percent."""
    j = C.table_lookup(b, rates, ["state"])
    due = F.col("rate_pct") * F.greatest("consideration_p", "guidance_p")  # hundredths of paise
    ok = F.abs(F.col("duty_p") * 100 - due) * 20 <= due
    return _out(j, "bundle_id", "L5", ok)


def encumbrance_disclosure(listed: DataFrame, disclosed: DataFrame, universe: DataFrame) -> DataFrame:
    return C.set_subset(listed, disclosed, ["bundle_id"], "ref", universe)


def chain_of_title(deeds: DataFrame) -> DataFrame:
    """Along a parcel: dates rise strictly and the seller is the buyer before. Links with their fault."""
    d = ordered(deeds, ["parcel"], ["executed", "deed_id", "consideration_p"],
                lasts={"prior": F.struct("buyer", "executed")}, base=deeds)
    link = F.col("prior").isNotNull()
    return d.filter(link).select(
        "parcel", "deed_id", "executed",
        (F.col("executed") <= F.col("prior.executed")).alias("date_fault"),
        (~names_agree(F.col("seller"), F.col("prior.buyer"))).alias("name_fault"),
    )


def chain_result(deeds: DataFrame) -> DataFrame:
    links = chain_of_title(deeds)
    g = links.groupBy("parcel").agg(
        F.count(F.lit(1)).alias("links"), F.count_if("date_fault").alias("date_faults"),
        F.count_if("name_fault").alias("name_faults"))
    return g.withColumn("status", F.when((F.col("date_faults") == 0) & (F.col("name_faults") == 0), "PASS").otherwise(
        "FAIL"))


def rapid_resale(deeds: DataFrame, days: int = 30) -> DataFrame:
    """Shortest gap between two transfers of a parcel; flagged within ``days``."""
    d = ordered(deeds, ["parcel"], ["executed", "deed_id", "consideration_p"],
                lasts={"before": F.col("executed")}, base=deeds)
    g = d.groupBy("parcel").agg(
        F.count(F.lit(1)).alias("transfers"), F.min(F.datediff("executed", "before")).alias("shortest_gap"))
    ev = F.col("transfers") >= 2
    return g.select("parcel", "transfers", F.coalesce("shortest_gap", F.lit(-1)).alias("shortest_gap"),
                    ev.alias("evaluated"), (ev & (F.col("shortest_gap") <= days)).alias("triggered"))


def value_far_from_guidance(b: DataFrame) -> DataFrame:
    ratio = F.try_divide(F.col("consideration_p").cast("double"), F.col("guidance_p").cast("double"))
    return b.select("bundle_id", F.round(ratio, 6).alias("ratio"), ratio.isNotNull().alias("evaluated"),
                    F.coalesce(~ratio.between(0.5, 2.0), F.lit(False)).alias("triggered"))


def reused_property(deeds: DataFrame) -> DataFrame:
    """Parcels under several applicants; distinct pairs first, so a hot parcel is counted in two steps."""
    pairs = deeds.select("parcel", "applicant").distinct()
    g = pairs.groupBy("parcel").agg(F.count(F.lit(1)).alias("applicants"))
    return g.filter(F.col("applicants") > 1)


def title_chain(bundles: DataFrame, chain: DataFrame) -> DataFrame:
    """Seller is the recorded owner and the chain of the parcel holds. ``chain``: bundle_id, status."""
    a = seller_is_owner(bundles).select("bundle_id", F.col("status").alias("owner_status"))
    j = a.join(chain.select("bundle_id", F.col("status").alias("chain_status")), "bundle_id", "left")
    bad = (F.col("owner_status") == "FAIL") | (F.col("chain_status") == "FAIL")
    return j.select("bundle_id", F.when(F.coalesce(bad, F.lit(False)), "FAIL").otherwise("PASS").alias("status"))


def collateral_mismatch(loans: DataFrame, deeds: DataFrame) -> DataFrame:
    """Loans whose property is in no deed of their bundle: a rejection."""
    norm = F.upper(F.regexp_replace("property_id", r"\s", ""))
    return loans.withColumn("_p", norm).join(deeds.select("bundle_id", norm.alias("_p")), ["bundle_id", "_p"], "left_anti").drop("_p")


def consideration_agreement(b: DataFrame, tol_p: int = 100) -> DataFrame:
    """Agreement, deed and payment state one amount."""
    amounts = [F.col(c) for c in ("agreement_p", "consideration_p", "paid_p")]
    some = amounts[0].isNotNull() & amounts[1].isNotNull() & amounts[2].isNotNull()
    gap = F.greatest(*amounts) - F.least(*amounts)
    return b.select("bundle_id", some.alias("evaluated"), F.coalesce(some & (gap <= tol_p), F.lit(False)).alias("passed"),
                    F.coalesce(gap, F.lit(-1)).alias("gap_p"))
