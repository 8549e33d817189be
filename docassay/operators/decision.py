"""Signals to verdicts, and verdicts to evidence packs.

Sums of suspicion times weight run on exact decimals, so a verdict does not depend on the order rows arrive in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.rulebook import (
    ADVISORY_REVIEW_AT, APPROVE_AT, BYTE_LEVEL_SIGNALS, CORROBORATION_AGREEMENT_MAX, CORROBORATION_SIGNALS,
    RED_FLAG, REJECT_SCORE, REVIEW_AT, SUBSTANTIVE_SIGNALS,
)
from docassay.session import by_key

# What to do with a document, per verdict.
ACTIONS = {
    "APPROVED": "Accept the document: nothing speaks against its integrity.",
    "REVIEW": "Have a person look at it: a check is open, weak or suspicious.",
    "REJECTED": "Do not accept it, and hand it to the fraud desk.",
}


def invalid_signals(signals: DataFrame) -> DataFrame:
    """Signals that break the contract: VALID needs a suspicion in [0, 1], other states must have none."""
    s = F.col("suspicion")
    valid = F.col("status") == "VALID"
    fault = (
        F.when(~F.col("status").isin("VALID", "NOT_EVALUATED", "ERROR"), "unknown_status")
        .when(valid & s.isNull(), "missing_suspicion").when(valid & ~s.between(0.0, 1.0), "out_of_range")
        .when(~valid & s.isNotNull(), "unexpected_suspicion")
    )
    return signals.withColumn("fault", fault).filter(F.col("fault").isNotNull())


def _dec(c: Column) -> Column:
    return c.cast("decimal(9,6)")


def _weighted(cond: Column | None, name: str) -> list[Column]:
    ok = (F.col("status") == "VALID") & (F.col("weight") > 0) & F.col("suspicion").isNotNull()
    if cond is not None:
        ok = ok & cond
    num = F.sum(F.when(ok, _dec(F.col("suspicion")) * _dec(F.col("weight"))))
    return [num.cast("double").alias(f"{name}_num"), F.sum(F.when(ok, _dec(F.col("weight")))).cast("double").alias(
        f"{name}_den")]


def weighted_suspicion(signals: DataFrame, keys: list[str]) -> DataFrame:
    g = signals.groupBy(*keys).agg(*_weighted(None, "w"))
    den = F.coalesce("w_den", F.lit(0.0))
    return g.select(*keys, F.coalesce(F.try_divide("w_num", "w_den"), F.lit(0.0)).alias("mean"), den.alias("weight"))


def provenance(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Tampered beats verified beats absent, over the layer-one signals that state it."""
    rank = F.when(F.col("provenance") == "tampered", 2).when(F.col("provenance") == "verified", 1).otherwise(0)
    hit = (F.col("layer") == 1) & F.col("provenance").isNotNull()
    g = signals.groupBy(*keys).agg(F.max(F.when(hit, rank)).alias("r"))
    return g.select(*keys, F.when(F.col("r") == 2, "tampered").when(F.col("r") == 1, "verified").otherwise("absent").alias(
        "provenance"))


def band(score: Column) -> Column:
    return F.when(score >= APPROVE_AT, "APPROVED").when(score >= REVIEW_AT, "REVIEW").otherwise("REJECTED")


def verdicts(signals: DataFrame, keys: list[str], camera: Column | None = None) -> DataFrame:
    """One aggregate per document, then the guards in order.

    tampered or hard reject; verified floor; nothing evaluated; error cap; review-only guard; corroboration gate.
    """
    name, valid = F.col("name"), F.col("status") == "VALID"
    review_only = F.coalesce("review_only", F.lit(False))
    red = F.coalesce(F.col("red_flag") == RED_FLAG, F.lit(False))
    prov = F.when((F.col("layer") == 1) & F.col("provenance").isNotNull(), F.col("provenance"))
    contra = F.col("provenance").isNull() & ~red & ~review_only & ~name.isin(*BYTE_LEVEL_SIGNALS)
    g = signals.groupBy(*keys).agg(
        *_weighted(None, "all"), *_weighted(~review_only, "firm"), *_weighted(contra, "contra"),
        F.max(prov == "tampered").alias("tampered"), F.max(prov == "verified").alias("verified"),
        F.max(valid & F.coalesce("hard_reject", F.lit(False))).alias("hard"),
        F.max(F.col("status") == "ERROR").alias("error"), F.max(red).alias("red"),
        F.max(valid & name.isin(*SUBSTANTIVE_SIGNALS)).alias("substantive"),
        F.max(valid & name.isin(*CORROBORATION_SIGNALS) & (F.col("suspicion") <= CORROBORATION_AGREEMENT_MAX)).alias("agrees"),
        F.max(camera if camera is not None else F.lit(False)).alias("camera"),
    )

    def score_of(n: str) -> Column:
        return F.bround(100.0 * (1.0 - F.coalesce(F.try_divide(f"{n}_num", f"{n}_den"), F.lit(0.0))), 2)

    for c in ("tampered", "verified", "hard", "error", "red", "substantive", "agrees", "camera"):
        g = g.withColumn(c, F.coalesce(c, F.lit(False)))
    g = g.withColumn("s_all", score_of("all")).withColumn("s_firm", score_of("firm"))
    floor = F.lit(99.0) - F.when(F.col("red"), 15.0).otherwise(0.0)
    contra_score = F.when(F.coalesce("contra_den", F.lit(0.0)) > 0, score_of("contra")).otherwise(floor)
    g = g.withColumn("s_ver", F.least(floor, contra_score))
    only_soft = (F.coalesce("firm_den", F.lit(0.0)) == 0) | (F.col("s_firm") >= REVIEW_AT)

    ver_reject = ~F.col("error") & (band(F.col("s_ver")) == "REJECTED") & only_soft
    ver_verdict = F.when(F.col("error"), "REVIEW").when(ver_reject, "REVIEW").otherwise(band(F.col("s_ver")))
    ver_score = F.when(ver_reject, F.greatest(F.col("s_ver"), F.lit(REVIEW_AT))).otherwise(F.col("s_ver"))

    capped = F.col("error") & (band(F.col("s_all")) == "APPROVED")
    s = F.when(capped, F.least(F.col("s_all"), F.lit(APPROVE_AT - 1))).otherwise(F.col("s_all"))
    v = F.when(capped, "REVIEW").otherwise(band(F.col("s_all")))
    soft_reject = (v == "REJECTED") & only_soft
    backed = F.col("substantive") & (F.col("camera") | F.col("agrees"))
    thin = (v == "APPROVED") & ~backed
    none = F.coalesce("all_den", F.lit(0.0)) == 0

    dead = F.col("tampered") | F.col("hard")
    score = (
        F.when(dead, REJECT_SCORE).when(F.col("verified"), ver_score).when(none, REVIEW_AT)
        .when(soft_reject, F.greatest(s, F.lit(REVIEW_AT))).when(thin, F.least(s, F.lit(REVIEW_AT))).otherwise(s)
    )
    verdict = (
        F.when(dead, "REJECTED").when(F.col("verified"), ver_verdict).when(none, "REVIEW")
        .when(soft_reject | thin, "REVIEW").otherwise(v)
    )
    closed = (
        F.when(dead, True).when(F.col("verified"), F.col("error")).when(none | soft_reject | thin, True).otherwise(
            F.col("error"))
    )
    tier = F.when(F.col("tampered") | (~F.col("hard") & F.col("verified")), "source-verified").when(
        F.col("camera"), "in-person-capture").otherwise("forensic-fallback")
    return g.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(score, 2))).alias("score"),
                    verdict.alias("verdict"), tier.alias("tier"), closed.alias("fail_closed"))


def attach_advisories(verdict: DataFrame, advisories: DataFrame, keys: list[str]) -> DataFrame:
    """An admissible advisory can only raise APPROVED to REVIEW; the score stays."""
    ok = F.trim(F.coalesce("explanation", F.lit(""))) != ""
    a = advisories.filter(ok).groupBy(*keys).agg(F.max("suspicion").alias("_a"), F.count(F.lit(1)).alias("advisories"))
    j = verdict.join(a, keys, "left")
    raised = (F.col("verdict") == "APPROVED") & (F.col("_a") >= ADVISORY_REVIEW_AT)
    return j.withColumn("verdict", F.when(raised, "REVIEW").otherwise(F.col("verdict"))).withColumn(
        "advisories", F.coalesce("advisories", F.lit(0))).drop("_a")


_RANK = {"APPROVED": 0, "REVIEW": 1, "REJECTED": 2}


def _rank(c: Column) -> Column:
    return F.when(c == "REJECTED", 2).when(c == "REVIEW", 1).otherwise(0)


def bundle_verdicts(documents: DataFrame, identity: DataFrame, income: DataFrame, key: str) -> DataFrame:
    """Worst document and both cross-checks bind; each cross-check sets a floor of its own.

    ``documents``: key, score, verdict, fail_closed. ``identity``: status, suspicion, hard_reject, disagreeing.
    ``income``: status, suspicion, disagreeing.
    """
    d = documents.groupBy(key).agg(
        F.count(F.lit(1)).alias("documents"), F.min("score").alias("low"), F.max(_rank(F.col("verdict"))).alias("worst"),
        F.max("fail_closed").alias("closed"))
    i = identity.select(key, F.col("status").alias("i_st"), F.col("suspicion").alias("i_s"),
                        F.col("hard_reject").alias("i_h"), F.col("disagreeing").alias("i_d"))
    c = income.select(key, F.col("status").alias("c_st"), F.col("suspicion").alias("c_s"),
                      F.col("disagreeing").alias("c_d"))
    j = d.join(by_key(i), key, "left").join(by_key(c), key, "left")

    def cross(st: str, s: str) -> Column:
        return F.when((F.col(st) == "VALID") & F.col(s).isNotNull(), 100.0 * (1.0 - F.col(s))).otherwise(100.0)

    i_bad = F.coalesce((F.col("i_st") == "VALID") & (F.col("i_d") > 0), F.lit(False))
    c_bad = F.coalesce((F.col("c_st") == "VALID") & (F.col("c_d") > 0), F.lit(False))
    score = F.greatest(F.lit(0.0), F.least("low", cross("i_st", "i_s"), cross("c_st", "c_s")))
    floor = F.when(F.coalesce("i_h", F.lit(False)), 2).when(i_bad | c_bad, 1).otherwise(0)
    rank = F.greatest(_rank(band(score)), F.col("worst"), floor)
    err = F.coalesce(F.col("i_st") == "ERROR", F.lit(False)) | F.coalesce(F.col("c_st") == "ERROR", F.lit(False))
    return j.select(
        key, "documents", F.bround(score, 2).alias("bundle_score"),
        F.when(rank == 2, "REJECTED").when(rank == 1, "REVIEW").otherwise("APPROVED").alias("bundle_verdict"),
        (i_bad | c_bad | err | F.col("closed")).alias("fail_closed"))


def evidence_packs(signals: DataFrame, verdict: DataFrame, keys: list[str]) -> DataFrame:
    """One nested record per document.

    Every signal of a document goes in, those of user-defined detectors included. A detector that reports more than
    once counts with its most suspicious signal, so a pack has one entry per detector.
    """
    s = signals
    pick = F.struct(F.coalesce("suspicion", F.lit(-1.0)), F.col("status"), -F.col("ord"))
    one = s.groupBy(*keys, "name").agg(F.max_by(F.struct("status", "suspicion", "weight"), pick).alias("s"))
    one = one.select(*keys, F.struct("name", "s.status", "s.suspicion", "s.weight").alias("signal"))
    packs = one.groupBy(*keys).agg(F.array_sort(F.collect_list("signal")).alias("signals"))

    def named(cond) -> Column:
        return F.transform(F.filter("signals", cond), lambda x: x["name"])

    action = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    p = packs.join(verdict, keys)
    return p.select(
        *keys, "score", "verdict", "tier", "fail_closed", "signals",
        named(lambda x: (x["status"] == "VALID") & (x["suspicion"] > 0)).alias("flagged"),
        named(lambda x: x["status"] == "NOT_EVALUATED").alias("pending"),
        named(lambda x: x["status"] == "ERROR").alias("errored"),
        F.try_element_at(action, F.col("verdict")).alias("recommended_action"))


def signal_detail(packs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One signal of each pack, null when the pack lacks it."""
    hit = F.get(F.filter("signals", lambda x: x["name"] == name), F.lit(0))
    return packs.select(*keys, hit.alias("signal"))


def resolve_label(requests: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Document by label: exact first, then trimmed and in lower case."""
    l = labels.select(key, "label", F.lower("label").alias("_n"))
    j = requests.withColumn("_n", F.lower(F.trim("requested"))).join(l, [key, "_n"], "left")
    exact = F.col("label") == F.col("requested")
    return j.groupBy(key, "requested").agg(
        F.min_by("label", F.when(F.col("label").isNotNull(), F.struct((~exact).cast("int"), "label"))).alias("label"))


def contradiction_filter(df: DataFrame, action: str = "action_text", fallback: str = "fallback") -> DataFrame:
    """Replace narratives whose action contradicts the verdict."""
    low = F.lower(action)
    bad = ((F.col("verdict") == "REJECTED") & low.rlike("approve|proceed")) | (
        (F.col("verdict") == "APPROVED") & low.rlike("reject|decline"))
    return df.withColumn("replaced", bad).withColumn("narrative", F.when(bad, F.col(fallback)).otherwise(F.col(action)))
