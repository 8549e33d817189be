"""The corpus pipeline: toxicity, near-dedup, decontamination, mixing, token files.

``STAGES`` lists (name, function); each function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as Parquet and reread as the next one's ``docs``. Every stage but the last keeps the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.llm.decontaminate import contamination
from docassay.llm.minhash import near_duplicates
from docassay.llm.mixing import emitted
from docassay.llm.orc_tokens import index, write_tokens
from docassay.llm.toxicity import labelled_rows, scored, train
from docassay.session import durable, shared_dir
from docassay.sources.tables import table

#: Shingle words and similarity in percent of the near-dedup stage.
WORDS, PERCENT = 5, 80


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, written so that the numbers stay, and the number's column: ids may be null or
    shared."""
    row = "_row"
    while row in docs.columns:
        row = f"_{row}"
    return durable(docs.withColumn(row, F.monotonically_increasing_id())), row


def _texts(rows: DataFrame, row: str) -> DataFrame:
    """The texts of numbered rows, the number in place of the id."""
    return rows.select(F.col(row).alias("doc_id"), "text")


def _without(docs: DataFrame, decided: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``docs`` but for the rows whose text is among the ones that ``decided`` returns. It is given the texts under the hash
    of each as its id, so that rows are told by their texts and not by ids."""
    of, name = F.xxhash64("text"), "_gone"
    while name in docs.columns:
        name = f"_{name}"
    gone = decided(docs.select(of.alias("doc_id"), "text")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, of == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Defined cases: every row is judged by its own text, whatever its id; null and empty texts get the intercept's score;
    texts are scored whole; repeated rows are judged alike; a score of exactly the threshold rejects; without labels of
    both kinds the score is the share of toxic ones; an empty table stays empty; other columns are carried on.
    """
    model = train(labelled_rows(docs, table(spark, sf_dir, "labels")))
    return _without(docs, lambda texts: scored(texts, model).filter("predicted = 1"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id, null ids last.

    Defined cases: rows are compared by text, so of rows that repeat, or share an id and have near texts, one stays; rows
    with a null id are compared like others; texts without words are near to nothing and all stay; texts are compared
    whole; of equal ids in a component the row written first stays; an empty table stays empty; other columns are carried on.
    """
    rows, row = _numbered(docs)
    found = near_duplicates(_texts(rows, row), WORDS, PERCENT).select(F.col("doc_id").alias(row), F.col("component_id").alias("of"))
    place = F.struct(F.col("id").isNull(), F.col("id"), F.col(row))
    keep = rows.select(row, F.col("doc_id").alias("id")).join(found, row).groupBy("of").agg(F.min_by(row, place).alias(row))
    return rows.join(keep.select(row), row, "left_semi").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Defined cases: every row is judged by its own text; null and empty texts stay; texts are searched whole; repeated rows
    are judged alike; items without words or id match nothing; empty tables on either side leave ``docs`` as it is; other
    columns are carried on.
    """
    benchmark = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda texts: contamination(texts, benchmark).filter("contaminated"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: every document as often as the sources' targets ask for.

    Defined cases: a null source is one of its own; a text without words has no size, and is taken as often as others of
    its source; rows are separate whatever their ids; ties go by id, size and a hash of the text; an empty table stays
    empty; other columns are carried on, whatever their names.
    """
    return emitted(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of every document's ids, from the token files written in the shared folder.

    Defined cases: null and empty texts are the end id alone; null ids come first, rows with one id follow each other by
    text; texts are encoded whole; an empty table gives an empty one; other columns are ignored.
    """
    path = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return index(spark, path)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("mixing", mixed), ("token_files", token_files)]

#: Classifier, similarity components and tokenizer are beyond SQL; a brute-force version checks the stages in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}-{name}")
    return docs
