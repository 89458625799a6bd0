"""Streaming queries (inventory 2.11): each runs over all files at hand and returns what the stream put out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.buckets import BucketTable
from folioforge.operators.tables import shared_folder
from folioforge.sources import derived as D
from folioforge.streaming import jobs

from .registry import query


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return jobs.events_stream(spark, f"{path}*", spark.read.parquet(path).schema)


@query(D.over(D.API_EVENTS) + "SELECT date_trunc('hour', ts) AS hour, api, count(*) AS calls, count(*) FILTER (NOT success) AS errors, round(avg(response_time), 6) AS mean_latency FROM api_events GROUP BY ALL")
def x1_stream_hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly metrics as a stream: the same rows as the batch form."""
    return jobs.run_now(jobs.hourly_metrics(_events(spark, sf_dir)), "complete", shared_folder(spark))


@query("SELECT DISTINCT user_id FROM events")
def x8_stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys seen for the first time, kept once across micro-batches."""
    return jobs.run_now(jobs.first_seen(_events(spark, sf_dir), ["user_id"], "3650 days").select("user_id"), "append", shared_folder(spark))


_HOUR_SQL = """WITH ends AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE AS first_end FROM (SELECT event_type AS api, event_type <> 'error' AS success, value AS response_time, ts FROM events)),
slid AS (SELECT *, first_end + k * INTERVAL 10 MINUTE AS until FROM ends CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS k))
SELECT until, api, count(*) AS calls, count(*) FILTER (NOT success) AS errors, round(avg(response_time), 6) AS mean_latency FROM slid"""


@query(_HOUR_SQL + " GROUP BY until, api")
def x3_trailing_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the trailing hour, every ten minutes, in batch."""
    return jobs.trailing(D.api_events(spark, sf_dir))


@query(_HOUR_SQL + " WHERE epoch_ms(until) <= (SELECT epoch_ms(max(ts)) - 600000 FROM events) GROUP BY until, api")
def x3_stream_trailing_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream: windows that the watermark has closed."""
    return jobs.run_now(jobs.trailing(_events(spark, sf_dir), "10 minutes"), "append", shared_folder(spark))


@query(
    D.over(D.API_EVENTS)
    + """SELECT event_id, failures, cooldown FROM (SELECT event_id, ts, failures, CASE WHEN success THEN 0.0 ELSE least(600.0, 30.0 * 2 ** (least(6, failures) - 1)) END::DOUBLE AS cooldown
FROM (SELECT *, CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS failures FROM api_events))
WHERE epoch_us(ts) <= (SELECT (epoch_ms(max(ts)) - 3600000) * 1000 FROM events)"""
)
def w9_stream_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circuit breaker as keyed state of a stream: what the watermark, an hour behind, has passed."""
    with jobs.with_rocksdb(spark):
        return jobs.run_now(jobs.breaker(_events(spark, sf_dir), "1 hour"), "append", shared_folder(spark)).select("event_id", "failures", "cooldown")


@query(D.over(D.BOOKS) + "SELECT id, title, confidence FROM (SELECT id, title, CASE WHEN id % 10 = 0 THEN 0.99 ELSE confidence END::DOUBLE AS confidence FROM books)")
def k4_bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue as a keyed table: written once, then a tenth of its records upserted into the buckets that they fall in."""
    table = BucketTable(spark, shared_folder(spark), ["id"])
    b = D.books(spark, sf_dir).select("id", "title", F.col("confidence").cast("double").alias("confidence"))
    table.upsert(b)
    table.upsert(b.filter("id % 10 = 0").withColumn("confidence", F.lit(0.99)), source="fixes", batch=0)
    table.upsert(b.limit(0).withColumn("confidence", F.lit(0.0)), source="fixes", batch=0)
    return table.read()
