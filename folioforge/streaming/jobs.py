"""Structured Streaming forms of the service loops: windowed metrics, first-seen paths, micro-batch upserts."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioforge.operators import metrics
from folioforge.operators.buckets import BucketTable


def events_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    """The events of a folder of Parquet files, as a stream shaped like api_events."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.select("event_id", F.col("event_type").alias("api"), (F.col("event_type") != "error").alias("success"), F.col("value").alias("response_time"), F.col("ts").cast("timestamp").alias("ts"), "user_id")


def hourly_metrics(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Hourly metrics with a watermark: state is dropped once an hour can get no more events."""
    return metrics.hourly(events, late)


def first_seen(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each key, within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run_now(df: DataFrame, mode: str, folder: str) -> DataFrame:
    """Run a stream over all there is and return what it put out, as Parquet under a folder that the cluster shares. A batch that runs again replaces what it wrote."""
    spark, out = df.sparkSession, f"{folder}/out"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else number}")

    df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out).select(*df.columns)


def upserted(spark: SparkSession, folder: str, keys: list[str] | None = None) -> tuple[int, DataFrame] | None:
    """The table that upsert_batches() keeps, and its version; None if there is none."""
    table = BucketTable(spark, folder, keys or [])
    held = table.manifest()
    return None if held is None else (held["version"], table.read())


def upsert_batches(events: DataFrame, folder: str, keys: list[str], checkpoint: str):
    """Each micro-batch replaces the rows of its keys (the latest of each, by ts), in the buckets that it touches only. A new checkpoint
    goes on from the table as it is, and a batch that runs again changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        BucketTable(batch.sparkSession, folder, keys).upsert(batch, [F.desc("ts")], checkpoint, number)
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def trailing(events: DataFrame, late: str | None = None, width: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    """Calls, errors and mean latency by API over the trailing `width`, every `slide`; `late`: the watermark of a stream, which gives a window
    once it can get no more events and drops events that come later than that."""
    if late:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", width, slide).alias("w"), "api").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("errors"), F.avg("response_time").alias("mean"))
    return rows.select(F.col("w.end").alias("until"), "api", "calls", "errors", F.round("mean", 6).alias("mean_latency"))


def alerts(events: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, late: str = "10 minutes", slow: float = 90.0):
    """Calls back with the alerts of each micro-batch: hours of an API with errors, or slower than `slow` on average, as they then stand. A batch may
    come again after a failure; its number tells."""
    found = metrics.hourly(events, late).filter((F.col("errors") > 0) | (F.col("mean_latency") > slow))

    def tell(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            callback(batch, number)

    return found.writeStream.foreachBatch(tell).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Breaker(StatefulProcessor):
    """The circuit breaker of one user: events wait in state until the watermark has passed them, then count in the order of their
    times, whatever the order in which they came. State holds the number of failures and the events within the watermark's delay.

    A call to the state costs more than an event, so a batch's events of a user are put there at once, with one timer for the earliest;
    a timer takes out all that are due, and leaves one for the earliest of the others."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.failures = handle.getValueState("failures", "n long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, success boolean")

    def wake(self, events) -> None:
        self.handle.registerTimer(-(-min(at for at, _, _ in events) // 1000))

    def handleInputRows(self, key, rows, timerValues):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        came = [(r.at, r.event_id, r.success) for r in rows if r.at > passed]  # what comes later is dropped: its place in the order is gone
        if came:
            self.waiting.appendList(came)
            self.wake(came)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = {(at, event_id): success for at, event_id, success in self.waiting.get()}  # of an event that came twice, the last
        due = sorted(k for k in held if k[0] <= until)
        if not due:
            return
        n = self.failures.get()[0] if self.failures.exists() else 0
        for k in due:
            success = held.pop(k)
            n += not success
            yield Row(user_id=key[0], event_id=k[1], failures=n, cooldown=0.0 if success else float(min(600, 30 * 2 ** (min(6, n) - 1))))
        self.failures.update((n,))
        left = [(*k, success) for k, success in held.items()]
        if left:
            self.waiting.put(left)
            self.wake(left)
        else:
            self.waiting.clear()

    def close(self) -> None:
        pass


def breaker(events: DataFrame, late: str) -> DataFrame:
    """user_id, event_id, failures and cooldown of each event that the watermark has passed, as metrics.breaker() gives them. Needs
    the RocksDB state store (with_rocksdb())."""
    rows = events.withWatermark("ts", late).select("user_id", "event_id", "success", "ts", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").transformWithState(Breaker(), "user_id bigint, event_id bigint, failures bigint, cooldown double", "Append", "EventTime")


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
