"""Operators that put others together: answers, context, community search, saving and harvesting memories, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.models import embed
from lectern.functions.text import classify, first_sentence, path_tags, snippet
from lectern.functions.vectors import cosine
from lectern.operators import memory, quality
from lectern.operators.bm25 import bm25

# Shares of a context's budget.
SECTIONS = (("memories", 0.4), ("facts", 0.2), ("notes", 0.3), ("session", 0.1))


def present(hits: DataFrame, chunks: DataFrame, notes: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """Display rows of ranked hits (query_id, chunk_id, note_path, score, place): title or path, summary or '', a snippet."""
    n = notes.select(F.col("path").alias("note_path"), "title")
    j = hits.join(chunks.select("chunk_id", "heading_path", "content"), "chunk_id").join(n, "note_path", "left")
    if summaries is not None:
        j = j.join(summaries.select("note_path", "summary"), "note_path", "left")
    else:
        j = j.withColumn("summary", F.lit(None).cast("string"))
    return j.select("query_id", "place", "note_path", F.coalesce("title", "note_path").alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), "heading_path", snippet(F.col("content")).alias("snippet"), "score")


def sources(hits: DataFrame, chunks: DataFrame, excerpt: int = 2000) -> DataFrame:
    """query_id, prompt, cited: the numbered source blocks from which an answer is generated (a few hits a query)."""
    j = hits.join(chunks.select("chunk_id", "content"), "chunk_id")
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "note_path", F.lit("\n"), F.substring("content", 1, excerpt))
    g = j.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", block.alias("b"), "note_path"))).alias("s"))
    return g.select("query_id", F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("prompt"), F.array_distinct(F.transform("s", lambda x: x["note_path"])).alias("cited"))


def context(sections: dict[str, DataFrame], budget: int = 2000) -> DataFrame:
    """section, place, text within the token budget. sections: name -> (place, text). What a section leaves unused goes to the next."""
    out, carry = None, 0
    for name, share in SECTIONS:
        if name not in sections:
            continue
        room = int(budget * share) + carry
        rows = sections[name].select(F.lit(0).alias("query_id"), "place", "text", F.floor(F.length("text") / 4).alias("cost"))
        kept = quality.within_budget(rows, room)
        used = kept.agg(F.sum("cost")).first()[0] or 0
        carry = max(0, room - used)
        part = kept.select(F.lit(name).alias("section"), "place", "text")
        out = part if out is None else out.unionByName(part)
    return out


def communities(summaries: DataFrame, queries: DataFrame, top_k: int = 6, level: int | None = 0, members: DataFrame | None = None, workspace: str | None = None, floor: float = 0.15) -> DataFrame:
    """query_id, community_id, score, place: summaries most similar to each query, at least `floor`. summaries: community_id, level, summary, vec.

    A workspace keeps communities with a member below it; a level without summaries falls back to all levels.
    """
    s = summaries
    if level is not None:
        chosen = s.where(F.col("level") == level)
        any_ = chosen.agg((F.count(F.lit(1)) > 0).alias("any"))
        s = s.crossJoin(F.broadcast(any_)).where((F.col("level") == level) | ~F.col("any")).drop("any")
    if workspace is not None:
        s = s.join(members.where(F.lower("note_path").startswith(workspace.strip("/").lower() + "/")).select("community_id"), "community_id", "left_semi")
    # Communities are few beside notes; the stated queries meet each of them.
    scored = s.crossJoin(queries.select("query_id", "qvec")).select("query_id", "community_id", cosine(F.col("qvec"), F.col("vec")).alias("score")).where(F.col("score") >= floor)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "community_id"))
    return scored.withColumn("place", place).where(F.col("place") <= top_k)


def community_context(members: DataFrame, triples: DataFrame, entities: int = 30, sample: int = 30, seed: int = 0) -> DataFrame:
    """community, entities, facts: the most frequent entities of each community and a seeded sample of its facts."""
    t = members.select("community", "note_path").join(triples, "note_path")
    names = t.select("community", F.explode(F.array("subject", "object")).alias("entity")).groupBy("community", "entity").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "entity"))
    top = names.withColumn("nth", nth).where(F.col("nth") <= entities).groupBy("community").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "entity"))), lambda x: x["entity"]).alias("entities"))
    pick = F.row_number().over(Window.partitionBy("community").orderBy(F.xxhash64("triple_id", F.lit(seed)), "triple_id"))
    fact = F.concat_ws(" | ", "subject", "predicate", "object")
    some = t.withColumn("nth", pick).where(F.col("nth") <= sample).groupBy("community").agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    return top.join(some, "community")


def save_memories(new: DataFrame, existing: DataFrame, as_of: Column, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(rows to append, near duplicates). new: memory_id, content, tags, entity_type, workspace, ttl_hours, mvec; existing with mvec.

    Unknown types are refused. Near duplicates are keyword candidates of the same type at the cosine threshold; they are reported, not dropped.
    """
    known = new.where(F.col("entity_type").isin(*memory.PRIORITY))
    until = F.when(F.col("ttl_hours") > 0, F.timestamp_add("SECOND", (F.col("ttl_hours") * 3600).cast("int"), as_of))
    rows = known.select("memory_id", "content", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "entity_type", memory.workspace(F.col("workspace")).alias("workspace"), as_of.alias("created_at"), until.alias("expires_at"), "mvec", F.col("mvec").isNull().alias("embed_pending"))
    near = memory.similar_by_text(existing, known.select(F.col("memory_id").alias("query_id"), F.col("content").alias("text")), 15)
    a = known.select(F.col("memory_id").alias("query_id"), F.col("entity_type").alias("kind"), F.col("mvec").alias("x"))
    b = existing.select("memory_id", "entity_type", F.col("mvec").alias("y"))
    dup = near.join(a, "query_id").join(b, "memory_id").where("kind = entity_type").withColumn("similarity", cosine(F.col("x"), F.col("y"))).where(F.col("similarity") >= threshold)
    return rows, dup.select("query_id", "memory_id", "similarity")


def search_memories(rows: DataFrame, queries: DataFrame, as_of: Column, limit: int = 20) -> DataFrame:
    """query_id, memory_id, score: keyword hits with all words, blended with the cosine; queries without a hit go by cosine alone. queries: query_id, text, qvec."""
    live = rows.where(memory.valid(as_of))
    hits = bm25(live, "memory_id", "content", queries.select("query_id", "text"), limit * 3, match_all=True)
    v = live.select(F.col("memory_id").alias("doc"), "mvec")
    blended = hits.join(v, "doc").join(queries.select("query_id", "qvec"), "query_id").select("query_id", "doc", (0.3 / (1 + F.abs("rank")) + 0.7 * F.coalesce(cosine(F.col("qvec"), F.col("mvec")), F.lit(0.0))).alias("score"))
    rest = queries.select("query_id", "qvec").join(hits.select("query_id").distinct(), "query_id", "left_anti")
    alone = rest.crossJoin(v.where("mvec IS NOT NULL")).select("query_id", "doc", cosine(F.col("qvec"), F.col("mvec")).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc"))
    return blended.unionByName(alone).withColumn("place", place).where(F.col("place") <= limit).select("query_id", F.col("doc").alias("memory_id"), "score", "place")


def harvest(messages: DataFrame, existing: DataFrame) -> DataFrame:
    """session, pos, entity_type, summary, tags, duplicate: memory candidates of transcripts (session, pos, role, text).

    Long or markup messages of users are skipped; a candidate is a duplicate if a stored
    memory of its type holds all its five longest words. existing: memory_id, content, entity_type.
    """
    kept = messages.where(~((F.col("role") == "user") & ((F.length("text") > 1000) | F.col("text").startswith("<"))))
    found = kept.select("session", "pos", "text", classify(F.col("text"), F.col("role")).alias("entity_type")).where("entity_type IS NOT NULL")
    named = found.withColumn("summary", first_sentence(F.col("text"))).withColumn("tags", path_tags(F.col("text"))).withColumn("query_id", F.xxhash64("session", "pos"))
    same = memory.similar_by_text(existing, named.select("query_id", F.col("summary").alias("text")), 3, match_all=True).join(existing.select("memory_id", F.col("entity_type").alias("kind")), "memory_id")
    dup = named.join(same.select("query_id", "kind"), "query_id").where("entity_type = kind").select("query_id").distinct().withColumn("duplicate", F.lit(True))
    return named.join(dup, "query_id", "left").select("session", "pos", "entity_type", "summary", "tags", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))


def auto_labels(notes: DataFrame, summaries: DataFrame, n: int = 150, seed: int = 0) -> DataFrame:
    """query, target: a seeded sample of notes, each asked for by the first sentence of its summary, else by its title."""
    j = notes.select("path", "title").join(summaries.select(F.col("note_path").alias("path"), "summary"), "path", "left")
    text = F.when(F.length("summary") > 0, first_sentence(F.col("summary"))).otherwise(F.col("title"))
    asked = j.select("path", text.alias("query")).where("length(query) > 0")
    return asked.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(n).select("query", F.col("path").alias("target"))


def fill_vectors(rows: DataFrame, text: str = "content", vec: str = "mvec", model=None) -> DataFrame:
    """Rows whose vector is missing or pending get one; the others keep theirs."""
    todo = F.col(vec).isNull() | F.coalesce(F.col("embed_pending"), F.lit(False))
    new = embed(rows.where(todo).drop(vec), text, vec, model).withColumn("embed_pending", F.lit(False))
    return rows.where(~todo).unionByName(new)
