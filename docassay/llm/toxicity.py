"""A toxicity classifier with counterfactual regularisation.

The model is logistic and sparse over words and word beginnings: a document's logit is the intercept plus, for each of its
distinct words, the weights of the word and of its first four, five and six letters. Since words add up, swapping the
identity term ``t`` of a sentence for ``u`` changes its logit by ``g(t) - g(u)``, with ``g`` a word's weight. Training adds
the mean square of these changes, over all labelled documents that mention an identity term and all terms of its group, to
the logistic loss. A group of terms holds a neutral one, so a term that only keeps bad company in the labelled rows ends
near the weight of "person", and neutral mentions of a group do not raise the score.

Features are exact strings, not hashes, so no word inherits another's weight. Training rows are a bounded sample, taken in
order of a hash of the id; features, their selection and scoring run in Spark, and only the chosen features of the sample
reach the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docassay.llm.tokens import settled
from docassay.session import durable

#: Labelled rows used for training at most, and features kept at most (those that separate the labels best).
SAMPLE, FEATURES = 8000, 6000
#: Least number of documents with a feature, least separation in standard errors, weight of the absolute penalty, weight
#: of the counterfactual penalty.
LEAST, SEPARATION, SPARSE, COUNTERFACTUAL = 3, 2.5, 5e-4, 1.0
#: Share of the absolute penalty that the second fit keeps.
REFIT = 0.05
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")
CACHE = 100_000
#: Documents of which the features are held as Python objects at once.
ROWS = 64
#: Identity terms by group; the first of each group is the neutral one.
IDENTITY = {
    "gender": ["person", "woman", "women", "man", "men", "girl", "boy", "female", "male", "transgender"],
    "faith": ["people", "muslim", "muslims", "christian", "christians", "jewish", "jew", "jews", "hindu", "buddhist", "atheist"],
    "origin": ["citizen", "african", "asian", "european", "american", "mexican", "arab", "turkish", "chinese", "immigrant", "refugee"],
    "orientation": ["couple", "gay", "lesbian", "bisexual", "straight", "queer", "homosexual"],
    "ability": ["neighbour", "blind", "deaf", "disabled", "autistic"],
    "gender_de": ["mensch", "frau", "frauen", "mann", "männer"],
    "gender_fr": ["personne", "femme", "femmes", "homme", "hommes"],
    "gender_es": ["persona", "mujer", "mujeres", "hombre", "hombres"],
}


def features(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]


def distinct_words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


@dataclass
class Model:
    intercept: float
    weights: dict[str, float]

    def word(self, w: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(w))

    def score(self, text: str | None) -> float:
        return _squash(self.intercept + math.fsum(self.word(w) for w in distinct_words(text)))


def _squash(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def fit(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, y: np.ndarray, n_features: int,
        swaps: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], sparse: float = SPARSE, counterfactual: float = COUNTERFACTUAL,
        rounds: int = 500, balanced: bool = True) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps.

    ``rows, cols, vals``: the sample's features as coordinates. ``swaps``: coordinates of the feature changes of each swap
    (swap, feature, change) and the share of each swap.
    """
    n = max(len(y), 1)
    s_row, s_col, s_val, share = swaps
    square = np.bincount(rows, weights=vals * vals, minlength=n)  # the weights of the labels average one
    # the largest curvature of either part, bounded by row sums of squares
    steep = 0.25 * (square.mean() * 4 + 1) + (2 * counterfactual * float((np.bincount(s_row, weights=s_val * s_val, minlength=len(share)) * share).sum()) if len(share) else 0)
    # either label weighs half of the sum, so the score of a rare label is not held down by its rarity
    each = np.where(y > 0, 0.5 * n / max(y.sum(), 1), 0.5 * n / max(n - y.sum(), 1)) if balanced else np.ones(n)
    w, b = np.zeros(n_features), 0.0 if balanced else math.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    v, c, t = w.copy(), b, 1.0
    last = math.inf
    for _ in range(rounds):
        z = c + np.bincount(rows, weights=vals * v[cols], minlength=n)
        r = each * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y)
        grad = np.bincount(cols, weights=vals * r[rows], minlength=n_features) / n
        if len(share):
            change = np.bincount(s_row, weights=s_val * v[s_col], minlength=len(share))
            grad += 2 * counterfactual * np.bincount(s_col, weights=s_val * (share * change)[s_row], minlength=n_features)
        loss = float((each * np.logaddexp(0, np.where(y > 0, -z, z))).mean())
        if loss > last + 1e-9:  # the step was too long, or the momentum overshot
            steep, v, c, t = steep * 1.3, w.copy(), b, 1.0
            last = math.inf
            continue
        last = loss
        new = v - grad / steep
        new = np.sign(new) * np.maximum(np.abs(new) - sparse / steep, 0)
        new_b = c - float(r.mean()) / steep
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return b, w


def train(labelled: DataFrame, identity: dict[str, list[str]] = IDENTITY, counterfactual: float = COUNTERFACTUAL, sample: int = SAMPLE) -> Model:
    """A model from ``doc_id, text, toxic``; at most ``sample`` rows, by hash of the id. Rows with a null label are left
    out. Without rows of both labels every score is the share of label 1 (0 without rows)."""
    terms = {t for group in identity.values() for t in group}
    known = labelled.filter("toxic is not null").select(
        "doc_id", F.col("text").cast("string").alias("text"), (F.col("toxic") == 1).cast("int").alias("toxic"))
    # ids are chosen first: a limit on whole rows would gather their texts in one task
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = durable(known.join(F.broadcast(ids), "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, counts = batch.slice(at, ROWS), []
                for text in part.column(1).to_pylist():
                    found: dict[str, int] = {}
                    for w in distinct_words(text):
                        for f in features(w):
                            found[f] = found.get(f, 0) + 1
                    counts.append(list(found.items()))
                yield pa.record_batch([part.column(0), part.column(2), pa.array(counts, pa.map_(pa.string(), pa.int32()))], ["doc_id", "toxic", "features"])

    bags = durable(chosen.mapInArrow(settled(run), "doc_id bigint, toxic int, features map<string,int>"))
    totals = {r["toxic"]: r["n"] for r in bags.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return Model(math.log(share / (1 - share)) if 0 < share < 1 else (800.0 if share else -800.0), {})
    each = bags.select("toxic", F.explode("features").alias("feature", "n"))
    rate = F.col("df") / F.lit(n0 + n1)
    gap = F.abs(F.col("pos") / F.lit(n1) - (F.col("df") - F.col("pos")) / F.lit(n0)) / F.sqrt(rate * (1 - rate + 1e-9) * F.lit(1 / n0 + 1 / n1))
    named = F.col("feature").isin(sorted({f for t in terms for f in features(t)}))
    vocabulary = each.groupBy("feature").agg(F.count(F.lit(1)).alias("df"), F.sum("toxic").alias("pos")).withColumn("gap", gap).filter(
        named | (F.col("df") >= LEAST) & (F.col("gap") >= SEPARATION)).orderBy(named.desc(), F.desc("gap"), "feature").limit(FEATURES)
    names = [r["feature"] for r in vocabulary.select("feature").collect()]
    place, spoken = {f: i for i, f in enumerate(names)}, {"=" + t for t in terms}

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part, cols, vals, said = batch.slice(at, ROWS), [], [], []
                for bag in part.column(1).to_pylist():
                    here = [(place[f], n) for f, n in bag if f in place]
                    cols.append([c for c, _ in here])
                    vals.append([v for _, v in here])
                    said.append([f[1:] for f, _ in bag if f in spoken])
                yield pa.record_batch([part.column(0), pa.array(cols, pa.list_(pa.int32())), pa.array(vals, pa.list_(pa.int32())), pa.array(said, pa.list_(pa.string()))],
                                      ["toxic", "cols", "vals", "said"])

    table = bags.select("toxic", "features").mapInArrow(pick, "toxic int, cols array<int>, vals array<int>, said array<string>").toArrow()
    lists = table.column("cols").combine_chunks()
    size = np.array([len(x) for x in lists], dtype=np.int64)
    rows = np.repeat(np.arange(len(size)), size)
    cols = np.array(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    vals = np.array(table.column("vals").combine_chunks().flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    y = table.column("toxic").to_numpy().astype(np.float64)
    swaps = swap_changes(table.column("said").to_pylist(), identity, place)
    _, chosen_w = fit(rows, cols, vals, y, len(names), swaps, counterfactual=counterfactual)
    # the penalty that chooses features also shrinks them; the chosen ones are fitted once more with little of it
    kept = chosen_w != 0
    on, change = kept[cols], kept[swaps[1]] if len(swaps[1]) else np.zeros(0, dtype=bool)
    b, w = fit(rows[on], cols[on], vals[on], y, len(names), (swaps[0][change], swaps[1][change], swaps[2][change], swaps[3]), SPARSE * REFIT, counterfactual)
    return Model(float(b), {f: float(x) for f, x in zip(names, w) if x != 0})


def swap_changes(said: list[list[str]], identity: dict[str, list[str]], place: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The counterfactuals of the sample: for each identity term a document says, a swap with every other of its group."""
    mentions: dict[tuple[str, str], int] = {}
    for terms in said:
        for t in terms:
            for group in identity.values():
                for u in group:
                    if t in group and u != t:
                        mentions[t, u] = mentions.get((t, u), 0) + 1
    rows, cols, vals, share = [], [], [], []
    total = sum(mentions.values())
    for k, ((t, u), n) in enumerate(sorted(mentions.items())):
        for word, sign in ((t, 1.0), (u, -1.0)):
            for f in features(word):
                if f in place:
                    rows.append(k)
                    cols.append(place[f])
                    vals.append(sign)
        share.append(n / total)
    return np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64), np.array(vals), np.array(share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) as ``doc_id, score, predicted``; a null or empty text scores what the intercept gives."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                z = []
                for w in distinct_words(text):
                    g = seen.get(w)
                    if g is None:
                        if len(seen) >= CACHE:
                            seen.clear()
                        g = seen[w] = model.word(w)
                    if g:
                        z.append(g)
                out.append(_squash(model.intercept + math.fsum(z)))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32())], ["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        settled(run), "doc_id bigint, score double, predicted int")


def held_out() -> Column:
    """The fold that no label is learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows to learn from: labels outside the held-out fold, with their texts. Labels repeated for one id count once
    (1 if any says so)."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")


def toxicity(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    model = train(labelled_rows(docs, labels), **how)
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
