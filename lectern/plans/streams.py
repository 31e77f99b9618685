"""Streaming queries, run over what is there and compared with the batch form in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.registry import query
from lectern.session import scratch_path
from lectern.sources import tables as t
from lectern.streaming import streams


def _run(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    return streams.run_available(df, mode, scratch_path(spark, "stream"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    # A pattern, as a file source takes a path without one for a folder.
    return streams.events_stream(spark, f"{d}/event[s].parquet", t.table(spark, d, "events").schema)


@query(f"SELECT user_id, count(*) AS uses, round((1 + count(*))::DOUBLE / (2 + count(*)) * pow(2::DOUBLE, -greatest(0, (epoch_us(TIMESTAMP '{t.AS_OF}') - epoch_us(max(ts))) / 86400000000::DOUBLE) / 30), 9) AS hotness FROM events GROUP BY 1")
def stream_hotness(spark: SparkSession, d: str) -> DataFrame:
    """Counts and last use kept as streaming state; the decay is applied when it is read."""
    s = _run(spark, streams.usage_state(_events(spark, d)), "complete")
    age = (F.unix_micros(F.lit(t.AS_OF).cast("timestamp")) - F.unix_micros("last_used")) / F.lit(86_400_000_000.0)
    hot = (1 + F.col("uses")) / (2 + F.col("uses")) * F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), age) / 30)
    return s.select("user_id", "uses", F.round(hot, 9).alias("hotness"))


@query("SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of the windows that the watermark has closed."""
    s = _run(spark, streams.windowed_counts(_events(spark, d)), "append")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id, last_ts AS ts, n FROM (SELECT user_id, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s) WHERE last_ts + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 MINUTE FROM events)")
def stream_debounce(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user, an hour apart, that the watermark has closed."""
    s = _run(spark, streams.debounced(_events(spark, d), "user_id", "1 hour"), "append")
    return s.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "n")


@query("SELECT u.user_id AS key, u.ts AS used_at, s.ts AS searched_at FROM events u JOIN events s ON u.user_id = s.user_id AND u.event_type = 'click' AND s.event_type = 'view' AND s.ts BETWEEN u.ts - INTERVAL 30 MINUTE AND u.ts")
def stream_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Clicks and the views of the same user in the half hour before, joined as two streams."""
    e = _events(spark, d)
    side = lambda kind, at: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.lit("page").alias("path"), F.col("ts").alias(at))
    s = _run(spark, streams.attributed(side("click", "used_at"), side("view", "searched_at")), "append")
    return s.select("key", F.col("used_at").cast("timestamp_ntz").alias("used_at"), F.col("searched_at").cast("timestamp_ntz").alias("searched_at"))


@query(
    """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM events WHERE event_type = 'error'),
    lim AS (SELECT user_id, ts, nth FROM e WHERE nth = 1 UNION ALL SELECT user_id, ts, nth FROM (
      SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY e.nth) AS k FROM lim JOIN e ON e.user_id = lim.user_id AND e.nth > lim.nth AND e.ts >= lim.ts + INTERVAL 1 HOUR) WHERE k = 1)
    SELECT user_id AS key, ts FROM lim"""
)
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Errors under the limit of one an hour per user, with one time of state per user."""
    s = _run(spark, streams.rate_limited(_events(spark, d).where("event_type = 'error'"), "user_id"), "append")
    return s.select("key", F.col("ts").cast("timestamp_ntz").alias("ts"))
