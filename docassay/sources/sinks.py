"""Sinks: appended tables, evidence packs, keys of the extraction cache."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.session import files_open, shared_dir

CACHE_VERSION = "1"


def table_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one table below the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("append")
    if partition:
        w = w.partitionBy(*partition)
    w.parquet(path)


def write_packs(packs: DataFrame, path: str) -> None:
    """Evidence packs as JSON, one folder per verdict."""
    with files_open(packs.sparkSession, 8):  # verdicts are few, and packs wide
        packs.write.mode("append").partitionBy("verdict").json(path)


def write_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def content_key(content: Column, hint: Column, reader: Column) -> Column:
    """Digest of page bytes, type hint, reader and cache version, separated by a zero byte."""
    zero = F.unhex(F.lit("00"))
    return F.sha2(F.concat(content, zero, F.encode(F.coalesce(hint, F.lit("")), "UTF-8"), zero, F.encode(reader, "UTF-8"), zero,
                           F.encode(F.lit(CACHE_VERSION), "UTF-8")), 256)
