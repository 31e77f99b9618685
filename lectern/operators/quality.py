"""Usage, errors, feedback, snapshots, evaluation and budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.sequence import numbered


def rate_limited(errors: DataFrame, seconds: int = 3600) -> DataFrame:
    """Errors that are logged: per note and type, one until an hour has passed since the last logged one.

    Which row counts depends on the one that counted before, so each key's sorted times are walked with the last one that counted; nothing else is held.
    """
    keys = ["note_path", "error_type"]
    rows = errors.select(*keys, F.unix_micros(F.col("detected_at").cast("timestamp")).alias("us")).repartition(*keys).sortWithinPartitions(*keys, "us")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, gap = None, None, seconds * 1_000_000
        for b in batches:
            keep = []
            for at, row in enumerate(zip(*(b.column(c).to_pylist() for c in (*keys, "us")))):
                if row[:2] != key:
                    key, last = row[:2], None
                if row[2] is not None and (last is None or row[2] - last >= gap):
                    last = row[2]
                    keep.append(at)
            yield b.take(pa.array(keep, pa.int64()))

    kept = rows.mapInArrow(walk, "note_path string, error_type string, us long")
    return kept.select(*keys, F.timestamp_micros("us").cast("timestamp_ntz").alias("detected_at"))


def error_report(errors: DataFrame, least: int = 2) -> DataFrame:
    g = errors.groupBy("note_path", "error_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("cosine_distance").alias("avg_distance"), F.max("cosine_distance").alias("max_distance"), F.min("detected_at").alias("first_seen"), F.max("detected_at").alias("last_seen")
    )
    return g.where(F.col("n") >= least)


def classify_error(similarity: Column, in_context: Column, has_context: Column) -> Column:
    """low_overlap under 0.38; contextual_mismatch under 0.45 for a note outside a given context."""
    return F.when(similarity < 0.38, "low_overlap").when(has_context & ~in_context & (similarity < 0.45), "contextual_mismatch")


def dormancy(notes: DataFrame, hot: DataFrame, as_of: Column, threshold: float = 0.05, never_days: int = 90) -> DataFrame:
    """path, hotness, state: active, dormant (below the threshold), or never (unused and older than never_days)."""
    j = notes.select("path", "updated_at").join(hot.select(F.col("note_path").alias("path"), "hotness"), "path", "left")
    old = F.coalesce(F.col("updated_at") < F.timestamp_add("DAY", F.lit(-never_days), as_of), F.lit(True))
    state = F.when(F.col("hotness") >= threshold, "active").when(F.col("hotness").isNotNull(), "dormant").when(old, "never").otherwise("new")
    return j.select("path", F.coalesce("hotness", F.lit(0.0)).alias("hotness"), state.alias("state"))


def attribute(uses: DataFrame, searches: DataFrame, window_seconds: int = 1800) -> DataFrame:
    """key, path, used_at, searched_at, rank: each distinct use and the latest search within the window that showed its path.

    uses: key, path, used_at; searches: key, shown (array of paths), searched_at. The as-of join is an
    equi-join on key, path and time bucket (the use's bucket and the one before), then the greatest search time.
    """
    w = F.lit(window_seconds * 1_000_000)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    shown = searches.select("key", "searched_at", F.posexplode("shown").alias("at", "path"), F.floor(us("searched_at") / w).alias("bucket"))
    use = uses.select("key", "path", "used_at").distinct().withColumn("b", F.floor(us("used_at") / w)).withColumn("bucket", F.explode(F.array(F.col("b"), F.col("b") - 1)))
    hits = use.join(shown, ["key", "path", "bucket"]).where((F.col("searched_at") <= F.col("used_at")) & (us("used_at") - us("searched_at") <= w))
    return hits.groupBy("key", "path", "used_at").agg(F.max(F.struct("searched_at", (-F.col("at")).alias("neg"))).alias("m")).select("key", "path", "used_at", F.col("m.searched_at").alias("searched_at"), (1 - F.col("m.neg")).cast("long").alias("rank"))


def snapshot_diff(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """path, change: added, deleted or modified against a baseline (path, content_hash)."""
    b = baseline.select("path", F.col("content_hash").alias("was"), F.lit(True).alias("b"))
    j = current.select("path", "content_hash", F.lit(True).alias("c")).join(b, "path", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "deleted").when(~F.col("content_hash").eqNullSafe(F.col("was")), "modified")
    return j.select("path", change.alias("change")).where("change IS NOT NULL")


def within_budget(entries: DataFrame, budget: int, key: str = "query_id", order: str = "place", cost: str = "cost") -> DataFrame:
    """The leading entries of each key whose running cost stays within the budget; the first is always kept."""
    w = Window.partitionBy(key).orderBy(order)
    run = F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("running", run).withColumn("nth", F.row_number().over(w)).where((F.col("running") <= budget) | (F.col("nth") == 1)).drop("nth")


def matches(path, target) -> Column:
    """A path is relevant if it contains the target, case and a closing slash aside."""
    return F.contains(F.lower(path), F.rtrim(F.lower(target), F.lit("/")))


def metrics(ranked: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """query_id, recall, mrr, ndcg. ranked: query_id, path, place (1-based); labels: query_id, target. Each target scores once, at its first hit."""
    want = labels.select("query_id", "target").distinct()
    n = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    first = want.join(ranked, "query_id").where(matches(F.col("path"), F.col("target"))).groupBy("query_id", "target").agg(F.min("place").alias("place"))
    gain = F.when(F.col("place") <= k, 1 / F.log2(F.col("place") + 1)).otherwise(0.0)
    hits = first.groupBy("query_id").agg(F.sum(F.when(F.col("place") <= k, 1).otherwise(0)).alias("hits"), F.min("place").alias("best"), F.sum(gain).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    j = n.join(hits, "query_id", "left")
    return j.select("query_id", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"), F.coalesce(1 / F.col("best"), F.lit(0.0)).alias("mrr"), (F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"))


def interleaved(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """Adds fold: in the order of the key, even rows (from 0) are fold 0, odd ones fold 1."""
    return numbered(rows, None, key).withColumn("fold", F.pmod(F.col("nth") - 1, F.lit(2)).cast("int")).drop("nth")


def folder_rollup(paths: DataFrame) -> DataFrame:
    """folder, n_notes: each note counts once in its folder and in every folder above."""
    from lectern.functions.text import ancestors

    return paths.where(F.contains("path", F.lit("/"))).select(F.explode(ancestors(F.col("path"))).alias("folder"), "path").groupBy("folder").agg(F.countDistinct("path").alias("n_notes"))


def retry_due(failures: DataFrame, as_of: Column) -> DataFrame:
    """Adds next_retry_at by attempts (1, 6, 24, 72, then 168 hours after the last) and keeps what is due."""
    hours = F.element_at(F.array(*[F.lit(h) for h in (1, 6, 24, 72, 168)]), F.least(F.col("attempts"), F.lit(5)).cast("int"))
    return failures.withColumn("next_retry_at", F.timestamp_add("HOUR", hours, F.col("last_attempt_at"))).where(F.col("next_retry_at") <= as_of)
