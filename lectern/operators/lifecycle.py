"""What use leaves behind and what it needs next: usage and search logs, summaries, sessions, drift and error rows, harvest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, mean_vector
from lectern.session import materialize


def recorded(log: DataFrame, new: DataFrame) -> DataFrame:
    """A log with new rows appended; a row that is there already isn't added again."""
    return log.unionByName(new.select(*log.columns)).distinct()


def newest(log: DataFrame, keep: int, *order: Column | str) -> DataFrame:
    """Retention: the `keep` first rows in the given order, by partial top-k in each partition."""
    return log.orderBy(*order).limit(keep)


def closed(rows: DataFrame, which: Column, at: Column) -> DataFrame:
    """Open rows (resolved_at null) for which `which` holds get resolved_at; the rest stay."""
    return rows.withColumn("resolved_at", F.when(F.col("resolved_at").isNull() & F.coalesce(which, F.lit(False)), at).otherwise(F.col("resolved_at")))


def reported(drift: DataFrame, memories: DataFrame, limit: int = 20) -> DataFrame:
    """Drift rows with the memory they are about, greatest distance first. drift: memory_id, note_path, cosine_distance."""
    return drift.join(memories, "memory_id").orderBy(F.desc("cosine_distance"), "memory_id", "note_path").limit(limit)


def missing_summaries(notes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Notes without a summary."""
    return notes.join(summaries.select("path"), "path", "left_anti")


def stale_summaries(notes: DataFrame, summaries: DataFrame) -> DataFrame:
    """path, was, is: summaries made from another content than the note has now."""
    both = notes.select("path", F.col("content_hash").alias("is")).join(summaries.select("path", F.col("content_hash").alias("was")), "path")
    return both.where(~F.col("is").eqNullSafe(F.col("was"))).select("path", "was", "is")


def looked_up(paths: DataFrame, notes: DataFrame, summaries: DataFrame) -> DataFrame:
    """path, text, source: the summary of each path asked for, else its title, else nothing ('missing')."""
    j = paths.select("path").distinct().join(summaries.select("path", "summary"), "path", "left").join(notes.select("path", "title", F.lit(True).alias("known")), "path", "left")
    source = F.when(F.col("summary").isNotNull(), "summary").when(F.col("known") & F.col("title").isNotNull(), "title").otherwise("missing")
    return j.select("path", F.coalesce("summary", F.when(F.col("known"), F.col("title"))).alias("text"), source.alias("source"))


def session_counts(sessions: DataFrame, memories: DataFrame, limit: int = 20) -> DataFrame:
    """The latest sessions with the number of memories of their project, counted before the join. sessions: session_id, project, started_at, ended_at; memories: project."""
    n = memories.groupBy("project").agg(F.count(F.lit(1)).alias("n_memories"))
    j = sessions.join(n, "project", "left").withColumn("n_memories", F.coalesce("n_memories", F.lit(0)))
    return j.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(limit)


def started(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Sessions with new ones begun; one that is known already isn't begun again."""
    return sessions.unionByName(new.withColumn("ended_at", F.lit(None).cast("timestamp_ntz")).select(*sessions.columns).join(sessions.select("session_id"), "session_id", "left_anti").select(*sessions.columns))


def ended(sessions: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Sessions with those of `ids` (session_id) ended; an end that is there stays."""
    mark = ids.select("session_id").distinct().withColumn("now", F.lit(True))
    j = sessions.join(mark, "session_id", "left")
    return j.withColumn("ended_at", F.when(F.col("now") & F.col("ended_at").isNull(), at).otherwise(F.col("ended_at"))).select(*sessions.columns)


def harvest_due(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files (key, mtime) never harvested, or changed since. state: key, harvested."""
    j = files.join(state, "key", "left")
    return j.where(F.col("harvested").isNull() | (F.col("mtime") > F.col("harvested"))).select("key", "mtime")


def rebuild_due(notes: DataFrame, built_at: Column, least: int = 1, share: float = 0.1) -> DataFrame:
    """n, changed, due: whether enough notes changed since a build, one row. No notes: nothing is due."""
    changed = F.count_if(F.coalesce(F.col("updated_at") > built_at, F.lit(True)))
    row = notes.agg(F.count(F.lit(1)).alias("n"), changed.alias("changed"))
    return row.withColumn("due", (F.col("changed") >= least) & (F.col("changed") >= share * F.col("n")) & (F.col("n") > 0))


def follow_notes(facts: DataFrame, ranked: DataFrame) -> DataFrame:
    """Facts in the order of the merged ranking of their notes; those of other notes come last, and equal ones keep their order. facts: query_id, note_path, pos; ranked: query_id, note_path, place."""
    j = facts.join(ranked.select("query_id", "note_path", "place"), ["query_id", "note_path"], "left")
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("place"), "pos"))
    return j.withColumn("at", at).drop("place")


def near_folders(vectors: DataFrame, queries: DataFrame, least: float = 0.55, max_folders: int = 100_000) -> DataFrame:
    """query_id, folder, similarity: folders whose mean vector is close to a context's vector. Folders are counted, then broadcast; queries are a stated set."""
    folder = F.regexp_extract("note_path", r"^(.*)/[^/]*$", 1)
    means = vectors.where(F.contains("note_path", F.lit("/"))).groupBy(folder.alias("folder")).agg(mean_vector(F.col("vec")).alias("mean"))
    means = materialize(means, "folder-means")
    if means.count() > max_folders:
        raise ValueError(f"more than {max_folders} folders")
    both = queries.select("query_id", "qvec").join(F.broadcast(means), F.lit(True), "inner")
    return both.select("query_id", "folder", cosine(F.col("qvec"), F.col("mean")).alias("similarity")).where(F.col("similarity") > least)


def community_listing(assigned: DataFrame, limit: int = 20) -> DataFrame:
    """community, size, first_path: the largest communities first. assigned: path, community."""
    g = assigned.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("path").alias("first_path"))
    return g.orderBy(F.desc("size"), "community").limit(limit)
