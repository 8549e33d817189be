"""Session construction and durable lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docassay", master: str | None = None, shuffle: int | None = None,
                  shared: str | None = None) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE with skew handling, Arrow); ``shared``: the folder
    for checkpoints and intermediate tables."""
    b = SparkSession.builder.appName(app)
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    if master:
        b = b.master(master)
    b = (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if shuffle:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, seen by the driver and all executors.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset, a folder of this application below the
    warehouse takes its place and is deleted when the driver ends; a warehouse on a machine's own disk is refused on
    a cluster, since other executors would not see it.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return os.path.dirname(current.rstrip("/"))
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not sc.master.startswith("local") and re.match(r"(file:|/|\w+$)", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"{warehouse}/run-{sc.applicationId}"
    if made not in _OWN:
        _OWN.add(made)
        atexit.register(_leave, spark, made)
    return made


#: Folders of this process that end with it.
_OWN: set[str] = set()


def _leave(spark: SparkSession, path: str) -> None:
    # the session may have ended before the interpreter; a local folder can still be removed
    if path.startswith("file:") or path.startswith("/"):
        shutil.rmtree(re.sub(r"^file:/+", "/", path), ignore_errors=True)
    elif spark.sparkContext._jsc is not None:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data through Spark's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder, so that a lost executor loses no work.

    A written table runs the plan once and reads back column by column; an RDD checkpoint would run the last stage
    twice and keep whole rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


@contextlib.contextmanager
def files_open(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes to folders or buckets keep up to ``most`` files of a task open; rows of more than these are sorted first, as
    all rows are otherwise."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most + 1))  # at this number Spark starts to sort
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(df: DataFrame, keys: str | list[str], parts: int) -> DataFrame:
    """As :func:`durable`, with the rows of a key in one of ``parts`` buckets: what groups or joins by ``keys`` reads them
    where they lie, and nothing is shuffled. The rows should be in as many partitions by the keys; others make many files.
    A value of the keys stays in one task, so it is for keys of few rows."""
    spark = df.sparkSession
    name = f"dealt_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tables/{name}"
    with files_open(spark, 1):
        df.write.option("compression", "zstd").option("path", path).bucketBy(parts, *([keys] if isinstance(keys, str) else keys)).saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.buckets = path, parts
    return out


def by_key(df: DataFrame) -> DataFrame:
    """One side of a join between tables that both grow with the input: rows meet by key in tasks.

    Without it Spark goes by file sizes, and a compressed or exploded table can be a hundred times as large in memory as
    it estimates; it would pass whole through the driver to be broadcast.
    """
    return df.hint("merge")


def release(*cuts: DataFrame | None) -> None:
    """Delete the tables behind ``durable`` frames that nothing reads any more (the turns of a loop)."""
    for df in cuts:
        if df is not None:
            remove(df.sparkSession, df.written_to)
