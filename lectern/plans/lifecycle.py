"""Queries of fact search by vectors, summaries, sessions, logs and states.

What the stored tables lack is derived from them: a fact's vector is that of the chunk with its number; a note's
summary is its first fact, made from the content hash stored with its facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine
from lectern.operators import bm25 as text_rank
from lectern.operators import graph, lifecycle
from lectern.operators.vectors import vector_topk
from lectern.plans import evaluation, graphs, memories
from lectern.plans import retrieval as r
from lectern.registry import query
from lectern.session import materialize
from lectern.sources import tables as t
from lectern.sources.tables import sql

NOW = memories.NOW
_FACT = {"fv": "SELECT triple_id, min(vec) AS vec FROM (SELECT DISTINCT triple_id FROM v_triples) JOIN v_vectors ON chunk_id = triple_id GROUP BY 1"}
_SUMMARY = {"summ": "SELECT note_path AS path, min(triple_text) AS summary, max(content_hash) AS content_hash FROM triples WHERE note_path IS NOT NULL AND triple_text IS NOT NULL GROUP BY 1"}


def fact_vectors(spark: SparkSession, d: str) -> DataFrame:
    """triple_id, vec."""
    v = t.chunk_vectors(spark, d).select(F.col("chunk_id").alias("triple_id"), "vec")
    return t.triples(spark, d).select("triple_id").distinct().join(v, "triple_id").groupBy("triple_id").agg(F.min("vec").alias("vec"))


def summaries(spark: SparkSession, d: str) -> DataFrame:
    """path, summary, content_hash."""
    src = t.table(spark, d, "triples").where("note_path IS NOT NULL AND triple_text IS NOT NULL")
    return src.groupBy(F.col("note_path").alias("path")).agg(F.min("triple_text").alias("summary"), F.max("content_hash").alias("content_hash"))


@query(sql(f"SELECT query_id, triple_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, triple_id) AS nth FROM (SELECT query_id, triple_id, round({r._COS.format('qvec', 'vec')}, 6) AS similarity FROM v_questions CROSS JOIN fv)) WHERE nth <= 30", **_FACT))
def triple_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Semantic search of facts: the 30 nearest of every query."""
    found = vector_topk(fact_vectors(spark, d).withColumnRenamed("triple_id", "chunk_id"), t.questions(spark, d), 30)
    return found.withColumnRenamed("chunk_id", "triple_id")


def _keyword_facts(spark: SparkSession, d: str) -> DataFrame:
    return text_rank.bm25(t.triples(spark, d), "triple_id", "triple_text", t.questions(spark, d).select("query_id", "text"), 30)


_HITS = text_rank.sql_ctes("SELECT triple_id AS doc, triple_text AS body FROM v_triples", r._QS, 30)


@query(
    sql(
        f"""SELECT query_id, triple_id, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, triple_id) AS place FROM (
        SELECT query_id, doc AS triple_id, 0.3::DOUBLE / (1 + abs(rank)) + 0.7::DOUBLE * coalesce({r._COS.format('qvec', 'vec')}, 0) AS score FROM bm JOIN v_questions USING (query_id) LEFT JOIN fv ON triple_id = doc)) WHERE place <= 10""",
        **_HITS,
        **_FACT,
    )
)
def triples_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search of facts: the 30 keyword hits of every query by 0.3 keyword + 0.7 cosine, the 10 best."""
    hits = materialize(_keyword_facts(spark, d).withColumnRenamed("doc", "triple_id"), "fact-hits")
    vec = fact_vectors(spark, d).join(hits.select("triple_id").distinct(), "triple_id", "left_semi")
    j = hits.join(vec, "triple_id", "left").join(t.questions(spark, d).select("query_id", "qvec"), "query_id")
    scored = j.withColumn("score", 0.3 / (1 + F.abs("rank")) + 0.7 * F.coalesce(cosine(F.col("qvec"), F.col("vec")), F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "triple_id"))
    return scored.withColumn("place", place).where("place <= 10").select("query_id", "triple_id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(
    sql(
        """SELECT query_id, triple_id, row_number() OVER (PARTITION BY query_id ORDER BY place NULLS LAST, pos) AS place FROM (
        SELECT query_id, b.doc AS triple_id, b.pos, m.place FROM tbm b JOIN (SELECT triple_id, min(note_path) AS note_path FROM v_triples GROUP BY 1) n ON n.triple_id = b.doc
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_path) AS place FROM mg QUALIFY place <= 5) m USING (query_id, note_path))""",
        **evaluation._facts_sql(),
        **evaluation._TRI,
    )
)
def facts_in_note_order(spark: SparkSession, d: str) -> DataFrame:
    """The keyword facts of every query, those of the best merged notes first."""
    merged = evaluation.tiered_merge(spark, d)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "note_path"))
    notes = t.triples(spark, d).groupBy(F.col("triple_id").alias("doc")).agg(F.min("note_path").alias("note_path"))
    facts = _keyword_facts(spark, d).join(notes, "doc")
    return lifecycle.follow_notes(facts, merged.withColumn("place", place)).select("query_id", F.col("doc").alias("triple_id"), F.col("at").cast("long").alias("place"))


@query(
    sql(
        f"SELECT chunk_id, folder, round(similarity, 6) AS similarity FROM (SELECT chunk_id, folder, {r._COS.format('vec', 'mean')} AS similarity FROM v_vectors CROSS JOIN fm WHERE chunk_id % 20 = 0) WHERE similarity > 0.55",
        fm="SELECT folder, list(m ORDER BY i) AS mean FROM (SELECT regexp_extract(note_path, '^(.*)/[^/]*$', 1) AS folder, i, avg(vec[i]) AS m FROM v_vectors, range(1, 65) r(i) WHERE contains(note_path, '/') GROUP BY 1, 2) GROUP BY 1",
    )
)
def context_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders close to a context's vector, whose notes it brings in; the chunks with a number divisible by 20 are the contexts."""
    v = t.chunk_vectors(spark, d)
    near = lifecycle.near_folders(v, v.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec")))
    return near.select(F.col("query_id").alias("chunk_id"), "folder", F.round("similarity", 6).alias("similarity"))


@query(sql("SELECT path, title FROM v_notes WHERE path NOT IN (SELECT path FROM summ)", **_SUMMARY))
def missing_summaries(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.missing_summaries(t.notes(spark, d).select("path", "title"), summaries(spark, d))


@query(sql("SELECT path, s.content_hash AS was, n.content_hash AS is FROM v_notes n JOIN summ s USING (path) WHERE n.content_hash IS DISTINCT FROM s.content_hash", **_SUMMARY))
def stale_summaries(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.stale_summaries(t.notes(spark, d), summaries(spark, d))


@query(
    sql(
        """SELECT a.path, coalesce(s.summary, n.title) AS text, CASE WHEN s.summary IS NOT NULL THEN 'summary' WHEN n.title IS NOT NULL THEN 'title' ELSE 'missing' END AS source
        FROM (SELECT DISTINCT note_path AS path FROM v_chunks WHERE note_path IS NOT NULL) a LEFT JOIN summ s USING (path) LEFT JOIN v_notes n ON n.path = a.path""",
        **_SUMMARY,
    )
)
def summary_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Summary, else title, of every note that has chunks."""
    asked = t.chunks(spark, d).where("note_path IS NOT NULL").select(F.col("note_path").alias("path"))
    return lifecycle.looked_up(asked, t.notes(spark, d), summaries(spark, d))


_SESS = {"sess": "SELECT session_id, max(project) AS project, min(first_ts) AS started_at, max(last_ts) AS ended_at FROM sessions WHERE session_id IS NOT NULL GROUP BY 1"}


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    g = t.table(spark, d, "sessions").where("session_id IS NOT NULL").groupBy("session_id")
    return g.agg(F.max("project").alias("project"), F.min("first_ts").alias("started_at"), F.max("last_ts").alias("ended_at"))


@query(
    sql(
        "SELECT session_id, project, started_at, ended_at, coalesce(n, 0) AS n_memories FROM sess LEFT JOIN (SELECT regexp_extract(workspace, '([^/]+)/*$', 1) AS project, count(*) AS n FROM v_memories WHERE workspace IS NOT NULL GROUP BY 1) USING (project) ORDER BY started_at DESC NULLS LAST, session_id LIMIT 20",
        **_SESS,
    )
)
def memory_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The 20 sessions begun last with the memories of their project."""
    m = t.memories(spark, d).where("workspace IS NOT NULL").select(F.regexp_extract("workspace", r"([^/]+)/*$", 1).alias("project"))
    return lifecycle.session_counts(_sessions(spark, d), m).select("session_id", "project", "started_at", "ended_at", "n_memories")


@query(sql(f"SELECT session_id, project, started_at, coalesce(ended_at, TIMESTAMP '{NOW}') AS ended_at FROM sess WHERE session_id IN (SELECT session_id FROM messages) OR ended_at IS NOT NULL UNION ALL SELECT session_id, project, started_at, ended_at FROM sess WHERE session_id NOT IN (SELECT session_id FROM messages WHERE session_id IS NOT NULL) AND ended_at IS NULL UNION ALL SELECT DISTINCT session_id, NULL, TIMESTAMP '{NOW}', TIMESTAMP '{NOW}' FROM messages WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM sess)", **_SESS))
def session_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """Sessions known by their messages only are begun, then all sessions with messages are ended."""
    now = F.lit(NOW).cast("timestamp_ntz")
    seen = t.table(spark, d, "messages").where("session_id IS NOT NULL").select("session_id").distinct()
    begun = lifecycle.started(_sessions(spark, d), seen.select("session_id", F.lit(None).cast("string").alias("project"), now.alias("started_at")))
    return lifecycle.ended(begun, seen, now).select("session_id", "project", "started_at", "ended_at")


@query(sql("SELECT note_path, error_type, detected_at, CASE WHEN note_path LIKE 'work/%' THEN detected_at END AS resolved_at FROM v_errors"))
def errors_resolved(spark: SparkSession, d: str) -> DataFrame:
    """The errors of one workspace resolved as they are found."""
    rows = t.errors(spark, d).select("note_path", "error_type", "detected_at").withColumn("resolved_at", F.lit(None).cast("timestamp_ntz"))
    return lifecycle.closed(rows, F.col("note_path").startswith("work/"), F.col("detected_at"))


@query(memories.DRIFT_SQL.replace("SELECT memory_id, note_path, round(distance, 6) AS cosine_distance", "SELECT memory_id, note_path, round(distance, 6) AS cosine_distance, entity_type", 1).replace("WHERE distance > 0.4", "JOIN (SELECT memory_id, max(entity_type) AS entity_type FROM v_memories GROUP BY 1) USING (memory_id) WHERE distance > 0.4 ORDER BY round(distance, 6) DESC, memory_id, note_path LIMIT 20", 1))
def drift_report(spark: SparkSession, d: str) -> DataFrame:
    """The 20 greatest drifts with the type of their memory."""
    kinds = t.memories(spark, d).groupBy("memory_id").agg(F.max("entity_type").alias("entity_type"))
    return lifecycle.reported(memories.memory_drift(spark, d), kinds).select("memory_id", "note_path", "cosine_distance", "entity_type")


@query("SELECT coalesce(category, 'none') AS category, count(DISTINCT item_id) AS n FROM benchmark GROUP BY 1")
def label_categories(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "benchmark").groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.countDistinct("item_id").alias("n"))


@query(sql(f"SELECT note_path, used_at FROM (SELECT note_path, used_at FROM v_usage UNION SELECT path, TIMESTAMP '{t.AS_OF}' FROM v_notes) ORDER BY used_at DESC, note_path LIMIT 500"))
def usage_append(spark: SparkSession, d: str) -> DataFrame:
    """A use of every note recorded, then the newest 500 uses kept."""
    new = t.notes(spark, d).select(F.col("path").alias("note_path"), F.lit(t.AS_OF).cast("timestamp_ntz").alias("used_at"))
    return lifecycle.newest(lifecycle.recorded(t.usage(spark, d), new), 500, F.desc("used_at"), "note_path")


@query(sql("SELECT component AS community, count(*) AS size, min(path) AS first_path FROM (SELECT v AS path, min(s) AS component FROM reach GROUP BY 1) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", known=graphs._KNOWN, adj=graphs._ADJ, reach=graphs._REACH))
def community_listing(spark: SparkSession, d: str) -> DataFrame:
    """The 20 largest groups of linked notes."""
    c = graph.components(graphs._nodes(spark, d), graphs._adjacency(spark, d))
    return lifecycle.community_listing(c.withColumnRenamed("component", "community"))


@query("SELECT session_id AS key, round(mtime, 3) AS mtime FROM (SELECT session_id, max(file_mtime) AS mtime, max(epoch_us(last_ts)) / 1e6 AS harvested FROM sessions WHERE session_id IS NOT NULL GROUP BY 1) WHERE mtime IS NOT NULL AND (harvested IS NULL OR mtime > harvested)")
def harvest_due(spark: SparkSession, d: str) -> DataFrame:
    """Session files to read: never harvested, or changed since (the end of a session stands for its harvest)."""
    s = t.table(spark, d, "sessions").where("session_id IS NOT NULL").groupBy(F.col("session_id").alias("key"))
    files = s.agg(F.max("file_mtime").alias("mtime")).where("mtime IS NOT NULL")
    state = s.agg((F.unix_micros(F.max("last_ts").cast("timestamp")) / 1e6).alias("harvested"))
    return lifecycle.harvest_due(files, state).withColumn("mtime", F.round("mtime", 3))


@query(sql(f"SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(updated_at > TIMESTAMP '{NOW}', true)) AS changed, count(*) FILTER (WHERE coalesce(updated_at > TIMESTAMP '{NOW}', true)) >= greatest(1, 0.1 * count(*)) AS due FROM v_notes"))
def rebuild_due(spark: SparkSession, d: str) -> DataFrame:
    """Whether the communities need to be built anew."""
    return lifecycle.rebuild_due(t.notes(spark, d), F.lit(NOW).cast("timestamp_ntz"))
