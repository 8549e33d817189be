"""The two-tier extraction cache as snapshots of an append-only manifest.

A manifest row says that a version put an entry into a tier, or removed it. What a tier holds is the last row of each key,
if that is not a removal. Versions are claimed one at a time (``streaming.state.StateTable``): a writer that finds its
version taken takes the next one, so writers at the same time all get through, and two promotions of one key leave one
entry. Reads of pages go to ``staging``; only promotion, or a direct save, puts them into ``saved``, and only ``saved``
answers for a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docassay.session import durable
from docassay.streaming.state import StateTable

ENTRY = ["key", "reader", "model", "doc_type", "page_index", "cached_at", "content"]
MANIFEST = ("entry string, key string, tier string, removed boolean, reader string, model string, doc_type string, page_index int, "
            "cached_at string, content string")
STAGING, SAVED = "staging", "saved"


class ExtractionCache:
    """``entries`` given to it have the columns of ``ENTRY``; of rows with one key the last by ``cached_at`` counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.table = StateTable(spark, folder, MANIFEST, "entry")

    def _append(self, rows: DataFrame, tier: str, removed: bool) -> int:
        """Append manifest rows as one version, and return it."""
        rows = durable(rows.select(F.concat_ws("/", F.lit(tier), "key").alias("entry"), "key", F.lit(tier).alias("tier"), F.lit(removed).alias("removed"),
                                   *[c for c in ENTRY if c != "key"]))
        version = max(self.table.versions(), default=-1) + 1
        while not self.table.commit(version, rows):
            version += 1
        return version

    def alive(self, tier: str) -> DataFrame:
        """The entries of a tier, with their content."""
        return self.table.read().filter((F.col("tier") == tier) & ~F.col("removed")).select(*ENTRY)

    def _put(self, entries: DataFrame, tier: str) -> int:
        rest = [c for c in ENTRY if c != "key"]
        last = entries.groupBy("key").agg(F.max_by(F.struct(*rest), F.struct("cached_at", "content")).alias("e")).select("key", "e.*")
        return self._append(last, tier, False)

    def stage(self, entries: DataFrame) -> int:
        return self._put(entries, STAGING)

    def save(self, entries: DataFrame) -> int:
        """Direct saves, without a stage in between."""
        return self._put(entries, SAVED)

    def promote(self, keys: DataFrame | None = None) -> int:
        """Save staged entries (of ``keys``, or all); saved ones stay as they are, and the stage keeps its own."""
        staged = self.alive(STAGING)
        if keys is not None:
            staged = staged.join(keys.select("key").distinct(), "key", "left_semi")
        return self._append(staged.join(self.alive(SAVED).select("key"), "key", "left_anti"), SAVED, False)

    def _remove(self, tier: str, keys: DataFrame | None) -> int:
        gone = self.alive(tier)
        if keys is not None:
            gone = gone.join(keys.select("key").distinct(), "key", "left_semi")
        return self._append(gone.withColumn("content", F.lit(None).cast("string")), tier, True)

    def discard(self, keys: DataFrame) -> int:
        return self._remove(STAGING, keys)

    def clear(self) -> int:
        """Empty the stage; saved entries are not touched."""
        return self._remove(STAGING, None)

    def delete(self, keys: DataFrame) -> int:
        return self._remove(SAVED, keys)

    def listing(self, tier: str) -> DataFrame:
        """What a tier holds, without content, newest first."""
        return self.alive(tier).drop("content").orderBy(F.desc("cached_at"), "key")

    def replay(self, pages: DataFrame) -> DataFrame:
        """``pages`` (key, ...) with the saved ``content``, null where a page has to be read."""
        return pages.join(self.alive(SAVED).select("key", "content"), "key", "left")

    def history(self) -> DataFrame:
        return self.table.history().select("version", "key", "tier", "removed")
