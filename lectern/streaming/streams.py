"""Streaming forms: hotness, debouncing, rate limits, attribution, incremental indexing, event windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def events_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of Parquet files; times become instants, as watermarks need."""
    s = spark.readStream.schema(schema).parquet(path)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def usage_state(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """key, uses, last_used: the state from which hotness is computed at any later time. Update or complete mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last_used"))


def debounced(stream: DataFrame, key: str, gap: str = "2 seconds", late: str = "1 minute") -> DataFrame:
    """One row per burst of a key: its last event. Append mode; a burst closes when the watermark passes its gap."""
    s = stream.withWatermark("ts", late)
    return s.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("n"), F.max_by("event_type", "ts").alias("event_type")).select(key, "ts", "n", "event_type")


def windowed_counts(stream: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, event_type, n over tumbling or sliding windows; later rows than `late` are dropped. Append mode."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def attributed(uses: DataFrame, searches: DataFrame, within: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join: every search of the key that showed the path within the window before the use.

    The latest search of each use is chosen by the sink or a batch over the result (one row per pair comes out).
    """
    u = uses.withWatermark("used_at", late).alias("u")
    s = searches.withWatermark("searched_at", late).alias("s")
    cond = (F.col("u.key") == F.col("s.key")) & (F.col("u.path") == F.col("s.path")) & (F.col("s.searched_at") <= F.col("u.used_at")) & (F.col("s.searched_at") >= F.col("u.used_at") - F.expr(f"INTERVAL {within}"))
    return u.join(s, cond).select(F.col("u.key").alias("key"), F.col("u.path").alias("path"), "used_at", "searched_at")


def rate_limited(stream: DataFrame, key: str, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """key, ts of the events that count: one, then none until `seconds` have passed since. State per key is one time."""
    micros = seconds * 1_000_000

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("us")
        out = []
        for us in rows["us"].tolist():
            if last is None or us - last >= micros:
                last = us
                out.append(us)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]] * len(out), "us": out})

    s = stream.withWatermark("ts", late).select(F.col(key).alias("key"), "ts", F.unix_micros("ts").alias("us")).groupBy("key")
    return s.applyInPandasWithState(step, "key long, us long", "last long", "append", GroupStateTimeout.EventTimeTimeout).select("key", F.timestamp_micros("us").alias("ts"))


def deduplicated(stream: DataFrame, keys: list[str], within: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def incremental_index(current: DataFrame, changed: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Notes after a micro-batch: unchanged hashes are no-ops, status and date of known notes stay, deleted paths go. Columns: path, content_hash, status, date_added."""
    c = changed.select("path", F.col("content_hash").alias("new_hash"), F.col("date_added").alias("new_date"), F.lit(True).alias("hit"))
    j = current.join(c, "path", "full")
    out = j.select("path", F.coalesce("new_hash", "content_hash").alias("content_hash"), F.coalesce("status", F.lit("active")).alias("status"), F.coalesce("date_added", "new_date").alias("date_added"))
    return out if deleted is None else out.join(deleted.select("path"), "path", "left_anti")


def reconcile(indexed: DataFrame, on_disk: DataFrame) -> DataFrame:
    """Paths to remove: indexed, but not on disk. An empty scan removes nothing, as it is more likely a failed mount than an empty folder."""
    seen = on_disk.agg((F.count(F.lit(1)) > 0).alias("any"))
    return indexed.select("path").join(on_disk.select("path"), "path", "left_anti").crossJoin(F.broadcast(seen)).where("any").select("path")


def run_available(df: DataFrame, mode: str, out: str) -> DataFrame:
    """Process what is there, then stop; the result as files below `out`, none of it on the driver.

    Append mode uses the exactly-once file sink; complete mode writes each batch's whole result under its number, and the last one counts.
    """
    spark, check = df.sparkSession, f"{out}/checkpoint"
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/rows")
    last = [0]

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        last[0] = number

    df.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/batch={last[0]}")


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """foreachBatch over what is there; `each` must be idempotent by batch number."""
    df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
