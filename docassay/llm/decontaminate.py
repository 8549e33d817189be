"""Benchmark decontamination over a positional inverted index, in DataFrame operations only.

Test items become windows of words. Corpus counts of the test terms order each window's terms by rarity. The postings
(term, document, position) of the two rarest terms of every window are stored; shifted by the term's place in the window
they name where the window would begin, and the two lists are intersected on that place. What is left is confirmed word
by word against the document, which is the forward form of the remaining lists. So only postings of rare terms are ever
shuffled, and a common word costs nothing unless a window has no rarer one.

Small dictionaries (test terms, anchors, ids of documents with candidates) are broadcast only after they are counted and
found below ``SMALL``; beyond it they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docassay.session import durable

#: Whatever separates words, after lower-casing A to Z: ASCII other than letters and digits.
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a window, and rows up to which a dictionary is broadcast (under 64 MB as rows of one short word or id).
WINDOW, SMALL = 10, 500_000


def words(text: Column) -> Column:
    """Array of the words of a text; null text gives an empty array."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.array_remove(F.split(lower, SEPARATOR), ""), F.array().cast("array<string>"))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``item_id, phrase, terms``: all runs of ``size`` words of an item, or all its words if it has fewer (but some)."""
    w = items.select("item_id", words(F.col("text").cast("string")).alias("w")).filter(F.size("w") > 0)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (size - 1))), lambda i: F.slice("w", i, size))
    return w.select("item_id", F.explode(F.array_distinct(cut)).alias("terms")).withColumn("phrase", F.array_join("terms", " "))


def _small(df: DataFrame) -> DataFrame:
    """A written table, with a broadcast hint if its counted size allows."""
    cut = durable(df)
    return F.broadcast(cut) if cut.count() <= SMALL else cut


def _keyed(docs: DataFrame) -> DataFrame:
    """A document's key is its id with a hash of id and text, so rows that share an id, or have none, stay apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("tid"),
                       F.col("text").cast("string").alias("text"))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``term, n``: how often each term of the vocabulary occurs in all documents."""
    return docs.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, id, tid, pos`` of every occurrence of the terms, positions counted in words from 0."""
    return docs.select("id", "tid", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(terms, "term").select("term", "id", "tid", "pos")


def anchors(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """``phrase, term, place, rank`` of the two rarest terms of every phrase of which all terms occur."""
    each = phrases.select("phrase", F.posexplode("terms").alias("place", "term")).join(counts, "term", "left")
    per = Window.partitionBy("phrase")
    ranked = each.withColumn("missing", F.sum(F.col("n").isNull().cast("int")).over(per)).filter("missing = 0").withColumn(
        "rank", F.row_number().over(per.orderBy("n", "place")))
    return ranked.filter("rank <= 2").select("phrase", "term", "place", "rank")


def _candidates(index: DataFrame, anchor: DataFrame) -> DataFrame:
    """``phrase, id, tid, start``: where both rarest terms stand as in the phrase (one term: where it stands)."""
    def shifted(rank: int) -> DataFrame:
        a = anchor.filter(F.col("rank") == rank).select("phrase", "term", "place")
        a = F.broadcast(a) if a.count() <= SMALL else a
        return index.join(a, "term").withColumn("start", F.col("pos") - F.col("place")).filter("start >= 0").select("phrase", "id", "tid", "start")

    pairs = anchor.filter("rank = 2").select("phrase")
    single = anchor.join(pairs, "phrase", "left_anti").filter("rank = 1").select("phrase").withColumn("alone", F.lit(True))
    first = shifted(1).join(single, "phrase", "left")
    both = first.filter("alone is null").join(shifted(2), ["phrase", "id", "tid", "start"], "left_semi")
    return both.drop("alone").unionByName(first.filter("alone").drop("alone")).distinct()


def occurrences(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``phrase, id, tid, start, length`` of every exact occurrence. ``phrases``: phrase, terms, distinct."""
    keyed = _keyed(docs)
    vocabulary = _small(phrases.select(F.explode("terms").alias("term")).distinct())
    counts = durable(term_counts(keyed, vocabulary))
    anchor = durable(anchors(phrases, counts))
    index = durable(postings(keyed, _small(anchor.select("term").distinct())))
    found = durable(_candidates(index, anchor))
    ids = _small(found.select("id", "tid").distinct())
    forward = keyed.join(ids, ["id", "tid"], "left_semi").distinct()
    w = words(F.col("text"))
    confirmed = found.join(phrases, "phrase").join(forward, ["id", "tid"]).filter(
        F.slice(w, F.col("start") + 1, F.size("terms")) == F.col("terms"))
    return confirmed.select("phrase", "id", "tid", "start", F.size("terms").alias("length"))


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` for every row of ``docs`` (doc_id, text).

    Defined cases: null texts have no words and no hits; items without words have no window; items with a null id are
    left out; repeated items and documents count once each; the digest of no items is that of the empty string; empty
    tables on either side give rows without hits, or no rows.
    """
    win = durable(windows(items.filter("item_id is not null"), size))
    phrases = durable(win.groupBy("phrase").agg(F.first("terms").alias("terms")))
    occ = durable(occurrences(docs, phrases))
    hit = occ.select("id", "tid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos")).distinct().groupBy(
        "id", "tid").agg(F.count(F.lit(1)).alias("n_hit"))
    of_item = win.select("phrase", F.col("item_id").cast("string").alias("item")).distinct()
    named = occ.select("id", "tid", "phrase").distinct().join(of_item, "phrase").select("id", "tid", "item").distinct().groupBy("id", "tid").agg(
        F.sort_array(F.collect_list("item")).alias("items"))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)).alias("id"), F.xxhash64("doc_id", "text").alias("tid"),
                       F.size(words(F.col("text").cast("string"))).cast("bigint").alias("n_words"))
    out = base.join(hit.join(named, ["id", "tid"]), ["id", "tid"], "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
                      F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def proximity(docs: DataFrame, phrases: DataFrame, slack: int) -> DataFrame:
    """``phrase, id, tid, start, span``: places where all terms of a phrase stand in order with up to ``slack`` other
    words between them in all; ``span`` is the number of words from the first term to the last.

    The postings of the rarest term name where to look. From there the other terms are followed outwards through the
    words of the document, each at its nearest place, which gives the shortest span through that occurrence.
    """
    keyed = _keyed(docs)
    counts = durable(term_counts(keyed, _small(phrases.select(F.explode("terms").alias("term")).distinct())))
    first = anchors(phrases, counts).filter("rank = 1").select("phrase", "term", "place")
    index = durable(postings(keyed, _small(first.select("term").distinct())))
    near = index.join(first, "term").join(phrases, "phrase").join(keyed.distinct(), ["id", "tid"]).withColumn("w", words(F.col("text")))

    def follow(terms: Column, ahead: bool) -> Column:
        # the position of each next term: the nearest one beyond the last; null once a term is missing
        def step(at: Column, term: Column) -> Column:
            rest = F.slice("w", at + 2, F.lit(slack + 1)) if ahead else F.reverse(F.slice("w", F.greatest(at - slack, F.lit(1)), F.least(at, F.lit(slack + 1))))
            gap = F.array_position(rest, term).cast("int")
            return F.when(gap > 0, at + gap if ahead else at - gap)

        return F.aggregate(terms, F.col("pos").cast("int"), step)

    last = follow(F.slice("terms", F.col("place") + 2, F.size("terms")), True)
    begin = follow(F.reverse(F.slice("terms", F.lit(1), F.col("place"))), False)
    out = near.withColumn("start", begin).withColumn("last", last).withColumn("span", F.col("last") - F.col("start") + 1)
    return out.filter(F.col("span") <= F.size("terms") + slack).select("phrase", "id", "tid", "start", "span").distinct()


#: The contamination of all documents in SQL, for checking: plain runs of words, no index.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
runs AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
         FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
occ AS (SELECT DISTINCT r.doc_id, r.s, r.n, x.item_id FROM runs r JOIN win x ON r.phrase = x.phrase AND r.n = x.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
