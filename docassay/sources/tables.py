"""Readers of the parquet inputs. Column pruning and filters reach the scan through Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


ROWS_SPREAD = 20_000  # rows of a partition on each of which costly work is done


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out over all cores, and over more tasks as the table grows: a narrow table lies in one split of its file, and
    few bytes of it are one partition after a shuffle, however much is made of each row. The cores that are known may be
    fewer than those that come, so the rows count as well."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_SPREAD)), *df.columns)


ROWS_APART = 100_000  # narrow rows of a partition of which many wide ones are made


def apart(df: DataFrame) -> int:
    """Partitions for the rows of a table as it lies in its file (a count of them reads only the file's foot): one a core at
    least, and more as the table grows, so that what a task makes of its rows stays bounded."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_APART))


def paise(column: str) -> Column:
    """Money as exact integer paise."""
    return F.round(F.col(column) * 100).cast("bigint")


def rupees(column: Column | str) -> Column:
    """Integer paise as an exact decimal."""
    c = F.col(column) if isinstance(column, str) else column
    return (c.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def letter(expr: Column) -> Column:
    """A to Z by remainder."""
    return F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (expr % 26).cast("int") + 1, F.lit(1))
