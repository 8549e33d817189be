"""The registered queries of the operators, and the SQL that checks them where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docassay.llm import decontaminate, lines, mixing, negatives, periodic
from docassay.llm.chunks import repeated_passages
from docassay.llm.minhash import near_duplicates
from docassay.llm.orc_tokens import index, write_tokens
from docassay.llm.packing import packed
from docassay.llm.pii import surrogates
from docassay.llm.secrets import secrets
from docassay.llm.toxicity import toxicity
from docassay.llm.vectors import near_vectors
from docassay.session import shared_dir
from docassay.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add(fn) if fn else add


@query
def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by a classifier learnt from the labels outside the held-out fold."""
    return toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query(sql=mixing.SQL)
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of every document, by systematic sampling to the sources' targets."""
    m = mixing.mix(table(spark, folder, "documents").select("doc_id", "text", "source"), with_text=False)
    return m.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query(sql=lines.SQL)
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line that repeats an earlier one, or is within one edit of it."""
    return lines.dropped_lines(table(spark, folder, "documents"))


@query
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity 0.85."""
    return near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query
def op5_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.95."""
    return near_vectors(table(spark, folder, "embeddings"))


@query
def op6_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Token places and checksums of all documents, read back from the ORC files they were written to."""
    import public_tokenizers

    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return index(spark, path)


@query
def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all documents that one with a smaller id holds as well."""
    return repeated_passages(table(spark, folder, "documents"))


@query(sql=decontaminate.SQL)
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows of ten words that occur in the documents."""
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of all documents: the base formats, and what inferred grammars add."""
    return secrets(table(spark, folder, "documents"))


@query
def op10_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """All documents with surrogates in place of personal data, and what was replaced."""
    return surrogates(table(spark, folder, "documents").select("doc_id", "text"), "k1")


@query(sql=negatives.SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by integer inner products; every seventh label is moved by one first."""
    v = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(v.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of all documents, after the contract's periods are put into every tenth one."""
    docs = table(spark, folder, "documents")
    made = docs.select("doc_id", periodic.planted(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.digests(periodic.periodic_runs(made))


@query
def op13_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as pieces of at most 2048 tokens, packed into sequences."""
    import public_tokenizers

    p = packed(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return p.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    return corpus_pipeline.run(spark, folder)
