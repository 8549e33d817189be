"""Versioned state tables for micro-batches.

A state table is a folder of written tables and one small manifest per committed batch. The manifest of batch n names the
tables that make up the state after it: a snapshot and the changes of a few batches since. A batch reads what the newest
earlier manifest names and nothing else, writes its own change, and commits by creating its manifest with one rename. A
repeated batch finds its manifest and changes nothing; one that failed before the rename starts again from the same
state. Every ``COMPACT`` batches the state becomes a new snapshot, so a batch never reads more than that many tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.session import remove

#: Changes after which the state is written anew as one snapshot.
COMPACT = 8


def _path(spark: SparkSession, at: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, at: str, text: str) -> bool:
    """Create a small file by a rename, whole or not at all; False if it exists already."""
    path, fs = _path(spark, at)
    if fs.exists(path):
        return False
    draft, _ = _path(spark, f"{at}.{spark._jvm.java.util.UUID.randomUUID().toString()}.draft")
    fs.mkdirs(path.getParent())
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    if fs.rename(draft, path):
        return True
    fs.delete(draft, False)
    return False


def read_text(spark: SparkSession, at: str) -> str:
    path, fs = _path(spark, at)
    stream = fs.open(path)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the finished files in a folder."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in found if not n.endswith(".draft") and not n.startswith("."))


class StateTable:
    """State by ``key``: the last row of each key (``replace``), or all rows that batches have added (``add``)."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, mode: str = "replace", compact: int = COMPACT):
        if mode not in ("replace", "add"):
            raise ValueError(f"unknown mode {mode}")
        self.spark, self.folder, self.schema, self.key, self.mode, self.compact = spark, folder, schema, key, mode, compact

    def versions(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in names(self.spark, f"{self.folder}/manifests"))

    def committed(self, batch_id: int) -> bool:
        return batch_id in self.versions()

    def _tables(self, version: int | None) -> list[str]:
        if version is None:
            return []
        return json.loads(read_text(self.spark, f"{self.folder}/manifests/{version:012d}.json"))["tables"]

    def _last(self, before: int | None) -> int | None:
        return max((v for v in self.versions() if before is None or v < before), default=None)

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The state after the last batch (before batch ``before``), of all keys or of those in ``keys``."""
        return self._merged(self._tables(self._last(before)), keys)

    def _merged(self, tables: list[str], keys: DataFrame | None = None) -> DataFrame:
        if not tables:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.folder}/{t}").withColumn("_order", F.lit(i)) for i, t in enumerate(tables)]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionByName(p)
        if keys is not None:
            df = df.join(keys.select(self.key).distinct(), self.key, "left_semi")
        columns = [c for c in df.columns if c != "_order"]
        if self.mode == "add":
            return df.select(*columns)
        rest = [c for c in columns if c != self.key]
        return df.groupBy(self.key).agg(F.max_by(F.struct(*rest), "_order").alias("s")).select(self.key, "s.*").select(*columns)

    def commit(self, batch_id: int, change: DataFrame) -> bool:
        """Write what batch ``batch_id`` changes and make it the newest version; False if that has been done before."""
        if self.committed(batch_id):
            return False
        tables = self._tables(self._last(batch_id))
        # a name of its own, so that of two writers of one batch only the one whose manifest counts is read
        name = change_name = f"changes/batch-{batch_id:012d}-{uuid.uuid4().hex}"
        change.write.parquet(f"{self.folder}/{name}")
        tables = [*tables, name]
        if len(tables) > self.compact:
            name = f"snapshots/batch-{batch_id:012d}-{uuid.uuid4().hex}"
            self._merged(tables).write.parquet(f"{self.folder}/{name}")
            tables = [name]
        content = json.dumps({"batch": batch_id, "change": change_name, "tables": tables})
        return write_text(self.spark, f"{self.folder}/manifests/{batch_id:012d}.json", content)

    def history(self) -> DataFrame:
        """Every change of every version, with the column ``version``."""
        out = self.spark.createDataFrame([], self.schema).withColumn("version", F.lit(0).cast("bigint"))
        for v in self.versions():
            name = json.loads(read_text(self.spark, f"{self.folder}/manifests/{v:012d}.json"))["change"]
            out = out.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.folder}/{name}").withColumn("version", F.lit(v).cast("bigint")))
        return out

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest ``keep`` versions and the tables that only older ones name."""
        versions = self.versions()
        used = {t for v in versions[-keep:] for t in self._tables(v)}
        gone = {t for v in versions[:-keep] for t in self._tables(v)} - used
        for v in versions[:-keep]:
            remove(self.spark, f"{self.folder}/manifests/{v:012d}.json")
        for t in sorted(gone):
            remove(self.spark, f"{self.folder}/{t}")
