"""Rule mining from labelled cases, and scoring with approved rules.

Mining is a sequence of joins and grouped counts. Cases that satisfy the same atomic predicates are one profile with its
number of cases and of fraud among them; atoms, profiles and rules in progress are tables, and so is the result. Each step
counts, for every open rule and every atom of another feature, the profiles that hold both, and picks the best by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.operators.scan import ordered
from docassay.session import durable

THIN_TO = 12

Atom = tuple[str, str, object]  # feature, op, value


def numeric_features(df: DataFrame, features: list[str]) -> list[str]:
    kinds = dict(df.dtypes)
    return [f for f in features if kinds[f] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[f].startswith("decimal")]


def midpoints(cases: DataFrame, features: list[str]) -> DataFrame:
    """Thinned midpoints of the sorted distinct values of each numeric feature: (feature, i, mid).

    A feature is one huge ordered group, so the numbering runs chunked.
    """
    long = cases.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x"))
    d = long.select("x.*").filter(F.col("v").isNotNull()).distinct()
    d = ordered(d, ["feature"], ["v"], sums={"pos": F.lit(1).cast("bigint")}, lasts={"before": F.col("v")})
    m = d.filter(F.col("before").isNotNull()).select("feature", (F.col("pos") - 2).alias("i"), ((F.col("before") + F.col("v")) / 2).alias("mid"))
    n = m.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    picks = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(THIN_TO - 1)))).select(
        "feature", F.floor(F.col("j") * (F.col("n") / float(THIN_TO))).alias("i")).distinct()
    many = n.filter(F.col("n") > THIN_TO).select("feature")
    thin = m.join(F.broadcast(many), "feature", "left_semi").join(F.broadcast(picks), ["feature", "i"], "left_semi")  # 12 per feature
    return thin.unionByName(m.join(F.broadcast(many), "feature", "left_anti"))


def atoms(cases: DataFrame, features: list[str]) -> DataFrame:
    """Atomic predicates, (feature, op, bound, text): ``ge`` and ``lt`` at the midpoints of numeric features, ``eq`` for
    each text of the others. ``bound`` is null for texts."""
    num = numeric_features(cases, features)
    kinds = "feature string, op string, bound double, text string"
    out = cases.sparkSession.createDataFrame([], kinds)
    if num:
        both = F.explode(F.array(F.lit("ge"), F.lit("lt"))).alias("op")
        out = out.unionByName(midpoints(cases, num).select("feature", both, F.col("mid").alias("bound"), F.col("mid").cast("string").alias("text")))
    other = [f for f in features if f not in num]
    if other:
        out = out.unionByName(_long(cases, other, "string").filter("v is not null").distinct().select(
            "feature", F.lit("eq").alias("op"), F.lit(None).cast("double").alias("bound"), F.col("v").alias("text")))
    return out


def _long(cases: DataFrame, features: list[str], kind: str, *keep: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast(kind).alias("v")) for f in features])
    return cases.select(*keep, F.explode(pairs).alias("x")).select(*keep, "x.*")


def predicate(p: Atom) -> Column:
    """A predicate as a condition; an absent feature or a wrong type is false."""
    f, op, v = p
    c = F.col(f)
    if op == "in":
        cond = c.isin(*v)
    else:
        cond = {"lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v, "eq": c == v, "ne": c != v}[op] if op in (
            "lt", "le", "gt", "ge", "eq", "ne") else F.lit(False)
    return F.coalesce(cond, F.lit(False))


def rule_metrics(cases: DataFrame, by: list[str], target: str) -> DataFrame:
    """Matching cases, matching fraud, support and confidence of every conjunction of one value for each column of ``by``."""
    fraud = cases.agg(F.count_if(F.col(target)).alias("all_fraud"))
    g = cases.groupBy(*by).agg(F.count(F.lit(1)).alias("n_match"), F.count_if(F.col(target)).alias("n_fraud"))
    return g.join(F.broadcast(fraud), F.lit(True)).select(  # one row
        *by, "n_match", "n_fraud", F.round(F.col("n_fraud") / F.col("all_fraud"), 6).alias("support"), F.round(F.col("n_fraud") / F.col("n_match"), 6).alias("confidence"))


def profiles(cases: DataFrame, every: DataFrame, features: list[str], target: str) -> DataFrame:
    """``held`` (atom ids), ``n``, ``f``: cases and fraud by the set of atoms they satisfy.

    A numeric feature has two dozen atoms at most, which join on the feature; texts join on feature and text.
    """
    num = numeric_features(cases, features)
    keyed = durable(cases.select(F.monotonically_increasing_id().alias("_case"), F.coalesce(F.col(target), F.lit(False)).alias("_fraud"), *features))
    met = None
    if num:
        bounds = every.filter("op <> 'eq'").select("atom", F.col("feature").alias("of"), "op", "bound")
        v = _long(keyed, num, "double", "_case")
        holds = F.when(F.col("op") == "ge", F.col("v") >= F.col("bound")).otherwise(F.col("v") < F.col("bound"))
        met = v.join(bounds, (F.col("feature") == F.col("of")) & holds).select("_case", "atom")
    other = [f for f in features if f not in num]
    if other:
        texts = every.filter("op = 'eq'").select("atom", "feature", F.col("text").alias("v"))
        eq = _long(keyed, other, "string", "_case").join(texts, ["feature", "v"]).select("_case", "atom")
        met = eq if met is None else met.unionByName(eq)
    held = met.groupBy("_case").agg(F.sort_array(F.collect_list("atom")).alias("held"))
    return keyed.select("_case", "_fraud").join(held, "_case").groupBy("held").agg(F.count(F.lit(1)).alias("n"), F.count_if("_fraud").alias("f"))


def _measured(df: DataFrame, total: int, fraud: int) -> DataFrame:
    return df.withColumn("confidence", F.col("f") / F.col("n")).withColumn("support", F.col("f") / F.lit(fraud)).withColumn(
        "lift", F.col("confidence") / F.lit(fraud / total))


def mine(cases: DataFrame, features: list[str], target: str = "is_fraud", min_support: float = 0.1, min_confidence: float = 0.8,
         max_predicates: int = 3, top_k: int = 10) -> DataFrame:
    """``rule_id, predicates, confidence, support, lift, suspicion`` of the best conjunctions; ``predicates`` is an array of
    (feature, op, bound, text).

    Every atom with a lift above 1 seeds a rule. A rule takes, step by step, the atom of a new feature that raises its
    confidence most at enough support, and closes when none does. Atoms are placed by lift, confidence, feature, operator
    and text; the earlier place wins ties among atoms, and among rules with equal figures.
    """
    t = cases.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(target)).alias("f")).first()
    total, fraud = t["n"], t["f"]
    kinds = ("rule_id string, predicates array<struct<feature:string,op:string,bound:double,text:string>>, confidence double, support double, "
             "lift double, suspicion double")
    if not total or not fraud:
        return cases.sparkSession.createDataFrame([], kinds)
    every = durable(atoms(cases, features).withColumn("atom", F.monotonically_increasing_id()))
    prof = durable(profiles(cases, every, features, target).withColumn("profile", F.monotonically_increasing_id()))
    holds = prof.select("profile", "n", "f", F.explode("held").alias("atom"))
    single = _measured(holds.groupBy("atom").agg(F.sum("n").alias("n"), F.sum("f").alias("f")), total, fraud).filter("lift > 1")
    falling = single.join(every, "atom").withColumn("_all", F.lit(0)).withColumn("_lift", -F.col("lift")).withColumn("_confidence", -F.col("confidence"))
    # atoms of a text feature are as many as its values: they are numbered in ranges where they are very many
    useful = durable(ordered(durable(falling), ["_all"], ["_lift", "_confidence", "feature", "op", "text"], sums={"place": F.lit(1).cast("bigint")}).drop(
        "_all", "_lift", "_confidence").withColumn("place", F.col("place").cast("int")))
    met = durable(holds.join(useful.select("atom", "place", "feature"), "atom").select("profile", "n", "f", "place", "feature"))
    rules = useful.select(F.col("place").alias("seed"), F.array("place").alias("taken"), F.array("feature").alias("used"), "confidence", "support", "lift", F.lit(True).alias("open"))
    for _ in range(max_predicates - 1):
        rules = durable(rules)
        growing = rules.filter("open").select("seed", "taken", "used", F.col("confidence").alias("now"))
        # profiles that hold all of a rule's atoms, then the atoms they hold besides
        within = growing.select("seed", F.size("taken").alias("parts"), F.explode("taken").alias("place")).join(met, "place").groupBy(
            "seed", "parts", "profile").agg(F.count(F.lit(1)).alias("c")).filter("c = parts").select("seed", "profile")
        longer = _measured(within.join(met, "profile").groupBy("seed", "place", "feature").agg(F.sum("n").alias("n"), F.sum("f").alias("f")), total, fraud)
        better = longer.join(growing, "seed").filter(~F.array_contains("used", F.col("feature")) & (F.col("confidence") > F.col("now")) & (F.col("support") >= min_support))
        pick = better.groupBy("seed").agg(F.max_by(F.struct("place", "feature", "confidence", "support", "lift"), F.struct("confidence", -F.col("place"))).alias("p"))
        j = rules.join(pick, "seed", "left")
        grown = F.col("p").isNotNull()
        rules = j.select("seed", F.when(grown, F.concat("taken", F.array("p.place"))).otherwise(F.col("taken")).alias("taken"),
                         F.when(grown, F.concat("used", F.array("p.feature"))).otherwise(F.col("used")).alias("used"),
                         *[F.when(grown, F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in ("confidence", "support", "lift")], grown.alias("open"))
    good = rules.filter((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence))
    sets = good.groupBy(F.sort_array("taken").alias("taken")).agg(F.min("seed").alias("seed"), *[F.max(c).alias(c) for c in ("confidence", "support", "lift")])
    order = [F.desc("confidence"), F.desc("support"), F.desc("lift"), F.asc("seed")]
    top = sets.orderBy(*order).limit(top_k)
    best = top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))  # of top_k rows
    named = best.withColumn("place", F.explode("taken")).join(useful.select("place", "feature", "op", "bound", "text"), "place")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("feature", "op", "text", "bound"))), lambda p: F.struct(p["feature"].alias("feature"), p["op"].alias("op"), p["bound"].alias("bound"), p["text"].alias("text")))
    return named.groupBy("rank", "confidence", "support", "lift").agg(listed.alias("predicates")).select(
        F.format_string("R-%03d", "rank").alias("rule_id"), "predicates", F.round("confidence", 3).alias("confidence"), F.round("support", 3).alias("support"),
        F.round("lift", 3).alias("lift"), F.round(F.least(F.lit(0.9), F.col("confidence")), 2).alias("suspicion"))


def rules_list(mined: DataFrame) -> list[dict]:
    """The mined rules, ``top_k`` at most, in the form that scoring takes."""
    return [{"rule_id": r["rule_id"], "predicates": [(p["feature"], p["op"], p["text"] if p["bound"] is None else p["bound"]) for p in r["predicates"]],
             "confidence": r["confidence"], "support": r["support"], "lift": r["lift"], "suspicion": r["suspicion"]} for r in mined.orderBy("rule_id").collect()]


def rules_frame(mined: DataFrame) -> DataFrame:
    """The mined rules with their predicates as one text."""
    said = F.array_join(F.transform("predicates", lambda p: F.concat_ws(" ", p["feature"], p["op"], p["text"])), " AND ")
    return mined.withColumn("predicates", said)


def current_rules(rules: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules with their latest state, decisions on unknown rules). ``decisions``: rule_id, status, decided_by, ts."""
    last = decisions.groupBy("rule_id").agg(F.max_by(F.struct("status", "decided_by", "ts"), "ts").alias("d"))
    state = rules.join(last, "rule_id", "left").withColumn("status", F.coalesce("d.status", F.lit("CANDIDATE"))).withColumn(
        "decided_by", F.col("d.decided_by")).drop("d")
    return state, decisions.join(rules.select("rule_id"), "rule_id", "left_anti")


def score(cases: DataFrame, rules: list[dict], keys: list[str]) -> DataFrame:
    """Strongest fired rule per case; the rule set is a short approved list, so it becomes column expressions."""
    if not rules:
        return cases.select(*keys, F.lit("NOT_EVALUATED").alias("status"), F.lit(-1.0).alias("suspicion"), F.lit("").alias("rule_id"), F.lit(0).alias("fired"))
    hits = []
    for i, r in enumerate(rules):
        cond = F.lit(bool(r["predicates"]))
        for p in r["predicates"]:
            cond = cond & predicate(p)
        hits.append(F.when(cond, F.struct(F.lit(float(r["suspicion"])).alias("s"), F.lit(-i).alias("o"), F.lit(r["rule_id"]).alias("rule_id"))))
    fired = F.array_compact(F.array(*hits))
    c = cases.select(*keys, fired.alias("f"))
    top = F.array_max("f")
    return c.select(*keys, F.lit("VALID").alias("status"), F.coalesce(top["s"], F.lit(0.0)).alias("suspicion"),
                    F.coalesce(top["rule_id"], F.lit("")).alias("rule_id"), F.size("f").alias("fired"))
