"""Time-limited memories as an event-sourced table: saving, editing, merging, search, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import path_tags, wiki_links
from lectern.functions.vectors import cosine
from lectern.operators.bm25 import best, query_terms
from lectern.operators.graph import resolve_links

# Types by how specific they are.
PRIORITY = {"bug": 6, "decision": 5, "convention": 4, "learning": 3, "observation": 2, "context": 1}
DRIFT_DISTANCE = 0.40


def workspace(w) -> Column:
    """A workspace without slashes at its ends; empty becomes null."""
    t = F.btrim(w, F.lit("/"))
    return F.when(F.length(t) > 0, t)


def in_workspace(column, name: str) -> Column:
    """Equal to the workspace or below it."""
    return F.coalesce((workspace(column) == name) | workspace(column).startswith(name + "/"), F.lit(False))


def valid(as_of: Column) -> Column:
    """Not expired: no limit, or one after as_of."""
    return F.col("expires_at").isNull() | (F.col("expires_at") > as_of)


def priority(kind) -> Column:
    pairs = [F.lit(x) for kv in PRIORITY.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(0))


def current(events: DataFrame) -> DataFrame:
    """The present state of an event log: the row of the greatest seq per memory, those deleted left out. events: the row's columns, seq, deleted."""
    nth = F.row_number().over(Window.partitionBy("memory_id").orderBy(F.desc("seq")))
    return events.withColumn("nth", nth).where("nth = 1 AND NOT deleted").drop("nth", "seq", "deleted")


def update(rows: DataFrame, edits: DataFrame, as_of: Column) -> DataFrame:
    """Rows after edits (memory_id, content, tags, add_tags, remove_tags, entity_type, ttl_hours; null leaves a field).

    Tags are replaced, then added, then removed; a ttl of 0 makes a memory permanent; the revision goes up by one.
    """
    e = edits.select("memory_id", *[F.col(c).alias(f"new_{c}") for c in ("content", "tags", "add_tags", "remove_tags", "entity_type", "ttl_hours")], F.lit(True).alias("hit"))
    j = rows.join(e, "memory_id", "left")
    empty = F.array().cast("array<string>")
    tags = F.array_except(F.array_union(F.coalesce("new_tags", "tags", empty), F.coalesce("new_add_tags", empty)), F.coalesce("new_remove_tags", empty))
    expires = F.when(F.col("new_ttl_hours") == 0, F.lit(None)).when(F.col("new_ttl_hours").isNotNull(), F.timestamp_add("SECOND", (F.col("new_ttl_hours") * 3600).cast("int"), as_of)).otherwise(F.col("expires_at"))
    hit = F.coalesce("hit", F.lit(False))
    changed = {
        "content": F.coalesce("new_content", "content"),
        "tags": F.when(hit, tags).otherwise(F.col("tags")),
        "entity_type": F.coalesce("new_entity_type", "entity_type"),
        "expires_at": expires,
        "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        "revision_count": F.col("revision_count") + hit.cast("int"),
    }
    return j.withColumns(changed).select(*rows.columns)


def merge(target: str = "t", source: str = "s") -> dict[str, Column]:
    """Merged fields of a joined pair of structs: the source's content only if over 1.2 times as long, tags united, the more specific type, counters added."""
    a, b = F.col(target), F.col(source)
    empty = F.array().cast("array<string>")
    none = F.array().cast("array<bigint>")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return {
        "content": F.when(F.length(b["content"]) > F.length(a["content"]) * 1.2, b["content"]).otherwise(a["content"]),
        "tags": F.array_union(F.coalesce(a["tags"], empty), F.coalesce(b["tags"], empty)),
        "entity_type": F.when(priority(b["entity_type"]) > priority(a["entity_type"]), b["entity_type"]).otherwise(a["entity_type"]),
        "merge_count": zero(a["merge_count"]) + zero(b["merge_count"]) + 1,
        "merged_from": F.concat(F.coalesce(a["merged_from"], none), F.array(b["memory_id"])),
        "revision_count": zero(a["revision_count"]) + 1,
    }


def prune(rows: DataFrame, as_of: Column, older_than_days: int | None = None) -> DataFrame:
    """What is left when expired memories, or those older than a number of days, go."""
    kept = rows.where(valid(as_of))
    return kept if older_than_days is None else kept.where(F.col("created_at") >= F.timestamp_add("DAY", F.lit(-older_than_days), as_of))


def stats(rows: DataFrame, as_of: Column) -> DataFrame:
    """entity_type, total, expired, pending."""
    expired = F.sum(F.when(F.coalesce(F.col("expires_at") <= as_of, F.lit(False)), 1).otherwise(0)).alias("expired")
    return rows.groupBy("entity_type").agg(F.count(F.lit(1)).alias("total"), expired, F.sum(F.coalesce("embed_pending", F.lit(False)).cast("int")).alias("pending"))


def similar_by_text(rows: DataFrame, queries: DataFrame, limit: int = 5, match_all: bool = False) -> DataFrame:
    """query_id, memory_id, rank: keyword candidates from the five longest distinct words of four characters or more."""
    terms = query_terms(queries, min_length=4, longest=5)
    return best(rows, "memory_id", "content", terms, limit, match_all).select("query_id", F.col("doc").alias("memory_id"), "rank")


def suggest_tags(rows: DataFrame, queries: DataFrame, limit: int = 5) -> DataFrame:
    """query_id, tag, weight: tags of similar memories and of paths in the text (known endings count twice)."""
    near = similar_by_text(rows, queries, 10).join(rows.select("memory_id", F.explode("tags").alias("tag")), "memory_id").select("query_id", "tag", F.lit(1).alias("w"))
    paths = queries.select("query_id", F.explode(path_tags(F.col("text"))).alias("tag")).select("query_id", "tag", F.lit(2).alias("w"))
    sums = near.union(paths).groupBy("query_id", "tag").agg(F.sum("w").alias("weight"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("weight"), "tag"))
    return sums.withColumn("nth", nth).where(F.col("nth") <= limit).drop("nth")


def drift(rows: DataFrame, vectors: DataFrame, notes: DataFrame, chunk_vectors: DataFrame, distance: float = DRIFT_DISTANCE) -> DataFrame:
    """memory_id, note_path, cosine_distance: linked notes whose best chunk is farther from the memory than `distance`. vectors: memory_id, mvec."""
    links = rows.where("content IS NOT NULL").select(F.col("memory_id").cast("string").alias("source_path"), F.explode(wiki_links(F.col("content"))).alias("link_text"))
    linked = resolve_links(links, notes).select(F.col("source_path").cast("bigint").alias("memory_id"), F.col("target_path").alias("note_path"))
    best = linked.join(vectors, "memory_id").join(chunk_vectors, "note_path").groupBy("memory_id", "note_path").agg((1 - F.max(cosine(F.col("mvec"), F.col("vec")))).alias("cosine_distance"))
    return best.where(F.col("cosine_distance") > distance)


def drift_log(open_rows: DataFrame, found: DataFrame) -> DataFrame:
    """Open drift rows after a detection: one per memory and note, replaced only by a greater distance."""
    return open_rows.unionByName(found).groupBy("memory_id", "note_path").agg(F.max("cosine_distance").alias("cosine_distance"))
