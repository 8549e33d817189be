"""Incremental versions of the operators on Structured Streaming.

Stateless and windowed ones are DataFrame functions that work on batch and stream alike; the balance monitor keeps its
state in Spark's state store, with timers in event time. Those that keep tables use ``foreachBatch`` and write each
micro-batch to a folder named after its id, so that a replayed batch overwrites itself; what they carry from batch to batch
are versioned state tables (``streaming/state.py``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docassay.operators import audit as U
from docassay.operators import corroborate as CO
from docassay.operators.match import BandStore
from docassay.operators.network import registry_entries
from docassay.rulebook import SESSION_IDLE_SECONDS
from docassay.session import durable, release, shared_dir
from docassay.streaming.state import StateTable

TOL_P = 100
BALANCE_OUT = "doc_id string, idx int, kind string, expected_p bigint, printed_p bigint, unread int, at_ms bigint"
BALANCE_ROW = Row("doc_id", "idx", "kind", "expected_p", "printed_p", "unread", "at_ms")
BALANCE_CARRY = "running bigint, unread int, last_ms bigint"
BALANCE_WAITING = "at_ms bigint, idx int, opening_p bigint, credit_p bigint, debit_p bigint, balance_p bigint"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A statement without a row for so long (in event time) is forgotten.
FORGET_MS = 366 * 24 * 3600 * 1000


def run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"


def drain(df: DataFrame, folder: str, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process everything available and stop."""
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(batch)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def write_batch(folder: str) -> Callable[[DataFrame, int], None]:
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    return write


def read_out(spark: SparkSession, folder: str, name: str = "out") -> DataFrame:
    return spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")


class BalanceMonitor(StatefulProcessor):
    """Running balance of one statement in event time.

    Rows wait in a list until the watermark has passed them; then they are applied in order of (time, idx), whatever order
    they arrived in. A row that arrives behind the watermark is handed on as ``late`` and not applied. The state carried is
    three numbers; a statement without a row for ``forget_ms`` gives a ``closed`` row and leaves no state behind, so that
    time must be longer than any silence within a statement.

    Statements are many and their rows of a batch few, so rows come and go one by one: a frame for each statement and batch
    would cost more than its rows. Each call of the state is a trip to the store and back, and is made only where it changes
    something.
    """

    def __init__(self, forget_ms: int = FORGET_MS):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.carry = handle.getValueState("carry", BALANCE_CARRY)
        self.waiting = handle.getListState("waiting", BALANCE_WAITING)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = []
        for r in rows:
            if r["at_ms"] <= watermark:
                yield BALANCE_ROW(key[0], r["idx"], "late", None, r["balance_p"], 0, r["at_ms"])
            else:
                held.append((r["at_ms"], r["idx"], r["opening_p"], r["credit_p"], r["debit_p"], r["balance_p"]))
        if held:
            self.waiting.appendList(held)
            self.handle.registerTimer(min(r[0] for r in held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due, left = [], []
        for row in self.waiting.get():
            (due if row[0] <= watermark else left).append(row)
        if left and not due:  # an earlier timer has done what was due, and set the next one
            return
        running, unread, last = self.carry.get() or (None, 0, -1)
        for at, idx, opening, credit, debit, printed in sorted(due, key=lambda r: r[:2]):
            running = (opening if running is None else running) + (credit or 0) - (debit or 0)
            if printed is None:
                unread += 1
            else:
                if abs(running - printed) > TOL_P:
                    yield BALANCE_ROW(key[0], idx, "break", running, printed, unread, at)
                running, unread = printed, 0
            last = at
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(min(r[0] for r in left))
        elif due:
            self.waiting.clear()
        if not left and running is not None and last + self.forget_ms <= watermark:
            yield BALANCE_ROW(key[0], None, "closed", running, None, unread, last)
            self.carry.clear()
        elif due:
            if not left:
                self.handle.registerTimer(last + self.forget_ms)
            self.carry.update((running, unread, last))

    def close(self) -> None:
        pass


def balance_monitor(rows: DataFrame, late: str = "0 seconds", forget_ms: int = FORGET_MS) -> DataFrame:
    """Breaks of the running balance as rows arrive per statement, rows behind the watermark, and closed statements.

    ``rows``: doc_id, idx, at (event time), opening_p, credit_p, debit_p, balance_p. Column ``kind`` tells the three apart.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # the plain number keeps rows behind the watermark in the input; a watermarked column would drop them
    timed = rows.withWatermark("at", late).select(
        "doc_id", "idx", F.unix_millis("at").alias("at_ms"), "opening_p", "credit_p", "debit_p", "balance_p")
    return timed.groupBy("doc_id").transformWithState(BalanceMonitor(forget_ms), BALANCE_OUT, "Append", "EventTime")


def balance_tables(rows: DataFrame, folder: str, late: str = "0 seconds", forget_ms: int = FORGET_MS) -> None:
    """Run the monitor over everything available: breaks go to ``breaks``, late rows to ``late``, closed ones to ``closed``."""
    def batch(df: DataFrame, batch_id: int) -> None:
        df = durable(df)  # three tables from one run of the operator
        for kind, name in (("break", "breaks"), ("late", "late"), ("closed", "closed")):
            df.filter(F.col("kind") == kind).drop("kind").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
        release(df)

    drain(balance_monitor(rows, late, forget_ms), folder, batch)


def sessions(events: DataFrame, key: str, ts: str = "ts", idle: int = SESSION_IDLE_SECONDS, late: str = "10 minutes") -> DataFrame:
    """Sessions that end after ``idle`` seconds without activity; works on batch and stream."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(key, F.session_window(ts, f"{idle} seconds").alias("w")).agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "events")


def activity(events: DataFrame, by: str, width: str = "1 hour", slide: str = "15 minutes", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Sliding counts per kind of event."""
    e = events.withWatermark(ts, late) if events.isStreaming else events
    return e.groupBy(F.window(ts, width, slide).alias("w"), by).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("started"), by, "events")


def resubmissions(queries: DataFrame, store: BandStore, folder: str) -> None:
    """Each arriving document against the stored band index."""
    drain(queries, folder, lambda df, i: write_batch(folder)(store.nearest(df), i))


def case_accrual(values: DataFrame, folder: str, key: str) -> StateTable:
    """Identity signal of every case a batch touches, over all values that the case has so far.

    The values are a state table that batches add to; a batch reads those of its own cases, as of the version before it.
    """
    spark = values.sparkSession
    state = StateTable(spark, f"{folder}/values", ", ".join(f"{c} {t}" for c, t in values.dtypes), key, "add")

    def batch(df: DataFrame, batch_id: int) -> None:
        if state.committed(batch_id):
            return
        df = durable(df)
        touched = df.select(key).distinct()
        seen = durable(state.read(before=batch_id, keys=touched).unionByName(df))
        sig = CO.identity_signal(CO.identity_comparison(seen, [key]), [key], touched)
        sig.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        state.commit(batch_id, df)
        release(df, seen)

    drain(values, folder, batch)
    return state


def latest(df: DataFrame, key: str) -> DataFrame:
    """Last state per key over the batches."""
    rest = [c for c in df.columns if c not in (key, "batch")]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("s")).select(key, "s.*")


HEADS = "chain_id string, count bigint, head_hash string"


def audit_append(events: DataFrame, folder: str, order: list[str]) -> StateTable:
    """Append to the chains. A batch continues them from a state table of heads, as of the version before it."""
    state = StateTable(events.sparkSession, f"{folder}/heads", HEADS, "chain_id")

    def batch(df: DataFrame, batch_id: int) -> None:
        if state.committed(batch_id):
            return
        heads = state.read(before=batch_id, keys=df)
        U.append_chain(df, order, heads).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        added = df.sparkSession.read.schema(U.LEDGER).parquet(f"{folder}/out/batch={batch_id}")
        state.commit(batch_id, added.groupBy("chain_id").agg((F.max("seq") + 1).alias("count"), F.max_by("this_hash", "seq").alias("head_hash")))

    drain(events, folder, batch)
    return state


def registry_upsert(reports: DataFrame, folder: str) -> None:
    """Registry partials per batch: of each entry and bank the count and the first report with its label and class; of each
    entry and kind of token (``tokens``: array of kind, token) the last one reported."""
    def batch(df: DataFrame, batch_id: int) -> None:
        key = F.when(F.col("hash_hex").isNull(), F.concat(F.lit("r"), F.col("report_id").cast("string"))).otherwise(F.col("hash_hex"))
        df = durable(df.withColumn("entry_key", key))
        part = df.groupBy("entry_key", "bank_id").agg(
            F.count(F.lit(1)).alias("seen"), F.min("report_id").alias("entry_id"), *[F.min_by(c, "report_id").alias(c) for c in ("label", "threat_class")])
        part.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
        tokens = df.select("entry_key", "report_id", F.explode("tokens").alias("t")).groupBy("entry_key", F.col("t.kind").alias("kind")).agg(
            F.max_by(F.col("t.token"), "report_id").alias("token"), F.max("report_id").alias("report_id"))
        tokens.write.mode("overwrite").parquet(f"{folder}/tokens/batch={batch_id}")
        release(df)

    drain(reports, folder, batch)


def registry_state(partials: DataFrame) -> DataFrame:
    """Entries from the partials of all batches."""
    banks = partials.select("entry_key", "bank_id").distinct().groupBy("entry_key").agg(F.count(F.lit(1)).alias("banks"))
    g = partials.groupBy("entry_key").agg(F.min("entry_id").alias("entry_id"), F.sum("seen").alias("seen_count"),
                                          *[F.min_by(c, "entry_id").alias(c) for c in ("label", "threat_class")])
    return g.join(banks, "entry_key")


def registry_tokens(partials: DataFrame) -> DataFrame:
    """``entry_key, kind, token``: the last token of each kind over the batches."""
    return partials.groupBy("entry_key", "kind").agg(F.max_by("token", "report_id").alias("token"))


__all__ = ["activity", "balance_tables", "audit_append", "balance_monitor", "case_accrual", "drain", "latest", "registry_entries", "registry_state", "registry_tokens",
           "registry_upsert", "resubmissions", "sessions", "Column"]
