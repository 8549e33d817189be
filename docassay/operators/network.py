"""Consortium registry and the graph of shared identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.functions.hashing import hamming, hash_words
from docassay.operators.match import hash_matches
from docassay.rulebook import HAMMING_THRESHOLD, RING_DEFAULT_WEIGHT, RING_KIND_WEIGHT, RING_MIN_SIZE, RING_MIN_WEIGHT
from docassay.session import by_key, durable, release


def registry_entries(reports: DataFrame) -> DataFrame:
    """Reports with one hash are one entry: first label kept, banks and reports counted.

    ``reports``: report_id (in time order), label, threat_class, bank_id, hash_hex (nullable). A report without a hash
    is always an entry of its own, keyed by its id, so hash-less reports spread over all tasks.
    """
    key = F.when(F.col("hash_hex").isNull(), F.concat(F.lit("r"), F.col("report_id").cast("string"))).otherwise(
        F.col("hash_hex"))
    r = reports.withColumn("entry_key", key)
    banks = r.select("entry_key", "bank_id").distinct().groupBy("entry_key").agg(F.count(F.lit(1)).alias("banks"))
    g = r.groupBy("entry_key").agg(
        F.min("report_id").alias("entry_id"), F.min_by("label", "report_id").alias("label"),
        F.min_by("threat_class", "report_id").alias("threat_class"), F.max("hash_hex").alias("hash_hex"),
        F.count(F.lit(1)).alias("seen_count"))
    return g.join(banks, "entry_key")


def registry_tokens(reports: DataFrame, tokens: DataFrame) -> DataFrame:
    """Tokens of an entry, last report wins per kind. ``tokens``: report_id, kind, token."""
    key = F.when(F.col("hash_hex").isNull(), F.concat(F.lit("r"), F.col("report_id").cast("string"))).otherwise(
        F.col("hash_hex"))
    t = tokens.join(reports.select("report_id", key.alias("entry_key")), "report_id")
    return t.groupBy("entry_key", "kind").agg(F.max_by("token", "report_id").alias("token"))


def query_registry(entries: DataFrame, entry_tokens: DataFrame, queries: DataFrame, query_tokens: DataFrame,
                   threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """Entries that match by hash or by any token, with strength; nothing else of the registry is returned.

    ``queries``: query_id, hash_hex (nullable); ``query_tokens``: query_id, token. Token equality ignores the kind of
    the query: the kind is mixed into the token.
    """
    e = entries.filter(F.col("hash_hex").isNotNull())
    q = queries.filter(F.col("hash_hex").isNotNull())
    near = hash_matches(q, e, threshold)
    by_hash = (
        q.select("query_id", F.col("hash_hex").alias("q_hex")).join(near, "q_hex")
        .join(e.select("entry_key", F.col("hash_hex").alias("s_hex")), "s_hex")
        .groupBy("query_id", "entry_key").agg(F.min("distance").alias("distance")))
    by_token = (
        query_tokens.select("query_id", "token").distinct().join(entry_tokens, "token")
        .select("query_id", "entry_key", "kind").distinct()
        .groupBy("query_id", "entry_key").agg(F.sort_array(F.collect_set("kind")).alias("kinds")))  # few kinds exist
    m = by_hash.join(by_token, ["query_id", "entry_key"], "full").join(
        entries.select("entry_key", "entry_id", "label", "threat_class", "banks", "seen_count"), "entry_key")
    kinds = F.coalesce(F.size("kinds"), F.lit(0))
    kinds = F.when(F.col("kinds").isNull(), 0).otherwise(kinds)
    s = F.coalesce(1.0 - F.col("distance") / 16.0, F.lit(0.0)) + 0.15 * kinds + 0.05 * F.greatest(F.lit(0), F.col("banks") - 1)
    return m.withColumn("strength", F.least(F.lit(1.0), F.round(s, 6))).withColumn(
        "kinds", F.coalesce(F.array_join("kinds", ","), F.lit(""))).withColumn("distance", F.coalesce("distance", F.lit(-1)))


def best_match(matches: DataFrame) -> DataFrame:
    """Strongest match of a query; the earliest entry wins ties."""
    pick = F.struct("entry_id", "label", "threat_class", "distance", "kinds", "banks", "seen_count", "strength")
    return matches.groupBy("query_id").agg(F.max_by(pick, F.struct("strength", -F.col("entry_id"))).alias("m")).select(
        "query_id", "m.*")


#: A query with more tokens than this has its matches listed instead of looked up by subsets.
SUBSET_TOKENS = 8


def _token_sets(df: DataFrame, tokens: str, empty: bool) -> DataFrame:
    """One row per subset of the sorted array ``tokens``: ``set_key`` and its size ``n``; the empty one only if asked for."""
    subsets = F.expr(f"transform(sequence({0 if empty else 1}, cast(shiftleft(1, size({tokens})) as int) - 1), "
                     f"m -> filter({tokens}, (t, i) -> shiftright(m, i) % 2 = 1))")
    none = F.array().cast("array<array<string>>")
    subsets = F.when(F.size(tokens) > 0, subsets).otherwise(F.array(F.array().cast("array<string>")) if empty else none)
    each = df.withColumn("_set", F.explode(subsets))
    return each.withColumn("set_key", F.sha2(F.array_join("_set", ","), 256)).withColumn("n", F.size("_set")).drop("_set", tokens)


def _strongest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The winner of each key from ``base`` (strength without tokens), ``n`` and ``entry_id``: strengths are cut at 1, so
    of entries beyond it the earliest wins."""
    full = F.round(F.col("base") + 0.15 * F.col("n"), 6)
    g = df.withColumn("full", full).groupBy(*keys).agg(
        F.max(F.struct(F.col("full").alias("s"), (-F.col("entry_id")).alias("e"))).alias("top"), F.min(F.when(F.col("full") >= 1.0, F.col("entry_id"))).alias("cut"))
    return g.select(*keys, F.least(F.lit(1.0), F.col("top.s")).alias("strength"), F.coalesce("cut", -F.col("top.e")).alias("entry_id"))


def best_matches(entries: DataFrame, entry_tokens: DataFrame, queries: DataFrame, query_tokens: DataFrame,
                 threshold: int = HAMMING_THRESHOLD) -> DataFrame:
    """``best_match(query_registry(...))`` without a list of matches.

    An entry has one token of each of few kinds. For every subset of its tokens it competes once; of each subset only the
    winner stays, and likewise of each subset together with each near hash. The entry that matches a query best matches it
    in some subset of the query's tokens and is, or ties with, that subset's winner, whose strength cannot be less than
    stated. So a query reads one row per subset, however many entries share its tokens or its hash.
    """
    e = entries.select("entry_key", "entry_id", "hash_hex", "banks")
    held = entry_tokens.groupBy("entry_key").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    e = durable(e.join(held, "entry_key", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))))
    asked = query_tokens.groupBy("query_id").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    q = queries.join(asked, "query_id", "full").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    q = durable(q.select("query_id", "hash_hex", "tokens"))
    wide = q.filter(F.size("tokens") > SUBSET_TOKENS)
    q = q.filter(F.size("tokens") <= SUBSET_TOKENS)

    peers = 0.05 * F.greatest(F.lit(0), F.col("banks") - 1)
    by_token = _strongest(_token_sets(e.select("entry_id", "tokens", peers.alias("base")), "tokens", False), ["set_key", "n"])
    near = hash_matches(q.filter("hash_hex is not null").select("hash_hex"), e.filter("hash_hex is not null").select("hash_hex"), threshold)
    close = near.join(e, F.col("s_hex") == F.col("hash_hex")).select("q_hex", "entry_id", "tokens", (1.0 - F.col("distance") / 16.0 + peers).alias("base"))
    by_hash = _strongest(_token_sets(close, "tokens", True), ["q_hex", "set_key", "n"])

    wanted = _token_sets(q, "tokens", True)
    found = wanted.join(by_token.drop("n"), "set_key").select("query_id", "strength", "entry_id").unionByName(
        wanted.join(by_hash.drop("n"), (wanted["set_key"] == by_hash["set_key"]) & (wanted["hash_hex"] == by_hash["q_hex"])).select("query_id", "strength", "entry_id"))
    best = found.groupBy("query_id").agg(F.max(F.struct("strength", (-F.col("entry_id")).alias("e"))).alias("m")).select(
        "query_id", (-F.col("m.e")).alias("entry_id"), F.col("m.strength").alias("strength"))
    # the details of the one winner
    own = e.select("entry_id", F.col("hash_hex").alias("s_hex"), F.col("tokens").alias("entry_tokens"), "entry_key")
    best = best.join(own, "entry_id").join(q, "query_id")
    d = hamming(hash_words(F.col("hash_hex")), hash_words(F.col("s_hex")))
    best = best.withColumn("distance", F.when(F.coalesce(d <= threshold, F.lit(False)), d).otherwise(F.lit(-1)).cast("int"))
    kinds = best.select("query_id", "entry_key", F.explode(F.array_intersect("tokens", "entry_tokens")).alias("token")).join(
        entry_tokens, ["entry_key", "token"]).groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"))
    out = best.join(kinds, "query_id", "left").join(entries.select("entry_id", "label", "threat_class", "banks", "seen_count"), "entry_id").select(
        "query_id", "entry_id", "label", "threat_class", "distance", F.coalesce("kinds", F.lit("")).alias("kinds"), "banks", "seen_count", "strength")
    if wide.isEmpty():
        return out
    listed = query_registry(entries, entry_tokens, wide.select("query_id", "hash_hex"), query_tokens.join(wide.select("query_id"), "query_id", "left_semi"), threshold)
    return out.unionByName(best_match(listed).select(*out.columns).withColumn("distance", F.col("distance").cast("int")))


def registry_advisory(best: DataFrame) -> DataFrame:
    return best.select(
        "query_id", F.lit("fraud_registry").alias("source"), "entry_id",
        F.round(F.least(F.lit(0.97), 0.60 + 0.4 * F.col("strength")), 6).alias("suspicion"),
        F.round(F.least(F.lit(1.0), 0.7 + 0.1 * F.col("banks")), 6).alias("confidence"),
        F.concat(F.lit("matches a document flagged at a peer bank, threat class "), F.col("threat_class")).alias("explanation"))


def token_edges(apps: DataFrame) -> DataFrame:
    """Star edges: every case of a (kind, token) points to the smallest case that has it. ``apps``: case_id, kind, token."""
    t = apps.filter(F.coalesce("token", F.lit("")) != "").select("case_id", "kind", "token").distinct()
    hub = t.groupBy("kind", "token").agg(F.min("case_id").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return t.join(by_key(hub.select("kind", "token", "hub")), ["kind", "token"]).filter(F.col("case_id") != F.col("hub")).select(
        F.col("case_id").alias("a"), F.col("hub").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest member as component of every node, by alternating large-star and small-star rounds.

    Neighbour minima are partial aggregations, so a hub with a third of the edges is no hot task; the join that
    redirects its edges goes by key, with skew splitting, and never through the driver. Every round is a written table, and the loop ends when the
    edge set is a fixed point. ``nodes``: case_id; ``edges``: a, b.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
                e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        j = both.join(by_key(low), "u")
        if large:
            out = j.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = j.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
                j.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.filter(F.col("a") != F.col("b")).distinct()

    e = durable(edges.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(x: DataFrame):
        r = x.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        return r["n"], r["h"]

    last, settled = mark(e), False
    while not settled:
        before, e = e, durable(star(star(e, True), False))
        release(before)
        now = mark(e)
        last, settled = now, now == last
    return nodes.join(by_key(e.select(F.col("a").alias("case_id"), F.col("b").alias("component"))), "case_id", "left").withColumn(
        "component", F.coalesce("component", "case_id"))


def rings(apps: DataFrame, comp: DataFrame) -> DataFrame:
    """Components of at least three cases whose shared kinds weigh one or more, with strength.

    ``apps``: case_id, bank_id, kind, token; ``comp``: case_id, component.
    """
    a = apps.filter(F.coalesce("token", F.lit("")) != "").join(by_key(comp), "case_id")
    shared = a.select("component", "kind", "token", "case_id").distinct().groupBy("component", "kind", "token").agg(
        F.count(F.lit(1)).alias("n")).filter("n >= 2")
    kinds = shared.groupBy("component", "kind").agg(F.max("n").alias("n"))
    weight = F.create_map(*[x for k, w in RING_KIND_WEIGHT.items() for x in (F.lit(k), F.lit(w).cast("decimal(4,2)"))])
    w = F.coalesce(F.try_element_at(weight, F.col("kind")), F.lit(RING_DEFAULT_WEIGHT).cast("decimal(4,2)"))
    per = kinds.groupBy("component").agg(
        F.sum(w).cast("double").alias("weight"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", F.col("n").cast("string")))), ",").alias("shared"))
    size = comp.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    banks = apps.select("case_id", "bank_id").distinct().join(by_key(comp), "case_id").select("component", "bank_id").distinct().groupBy(
        "component").agg(F.count(F.lit(1)).alias("banks"))
    r = per.join(by_key(size), "component").join(by_key(banks), "component").filter(
        (F.col("members") >= RING_MIN_SIZE) & (F.col("weight") >= RING_MIN_WEIGHT))
    s = F.col("weight") / 2.0 + 0.08 * (F.col("members") - RING_MIN_SIZE) + 0.05 * (F.col("banks") - 1)
    return r.withColumn("strength", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)), 3))


def ring_advisories(ring: DataFrame, comp: DataFrame) -> DataFrame:
    """One advisory per case in a ring."""
    return comp.join(by_key(ring), "component").select(
        "case_id", F.lit("ring_evidence").alias("source"), "component",
        F.round(F.least(F.lit(0.97), 0.65 + 0.3 * F.col("strength")), 6).alias("suspicion"),
        F.round(F.least(F.lit(1.0), 0.6 + 0.08 * F.col("banks")), 6).alias("confidence"))


def shared(df: DataFrame) -> Column:
    return F.col("shared")
