"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as x
from lectern.operators import quality
from lectern.registry import query
from lectern.sources import tables as t
from lectern.sources.tables import sql


@query("SELECT chunk_id, round(CASE WHEN length(content) > 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(content, '\\[\\[[^\\]]+\\]\\]'), lambda x: length(x))), 0)::DOUBLE / length(content) ELSE 0 END, 9) AS density FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_id IS NOT NULL)")
def link_density(spark: SparkSession, d: str) -> DataFrame:
    return t.chunks(spark, d).select("chunk_id", "content").distinct().select("chunk_id", F.round(x.link_density(F.col("content")), 9).alias("density"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS content_hash FROM documents WHERE text IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", x.content_hash(F.col("text")).alias("content_hash"))


@query(sql("SELECT chunk_id, CASE WHEN length(content) > 300 THEN substr(content, 1, 300) || '...' ELSE content END AS snippet, coalesce(title, note_path) AS title FROM v_chunks LEFT JOIN v_notes ON path = note_path"))
def snippet(spark: SparkSession, d: str) -> DataFrame:
    """Display form of every chunk: 300 characters and the note's title, else its path."""
    n = t.notes(spark, d).select(F.col("path").alias("note_path"), "title")
    return t.chunks(spark, d).join(n, "note_path", "left").select("chunk_id", x.snippet(F.col("content")).alias("snippet"), F.coalesce("title", "note_path").alias("title"))


@query("SELECT doc_id, i AS piece, substr(text, i * 2000 + 1, 2000) AS content FROM (SELECT doc_id, text, unnest(range((length(text) + 1999) // 2000)) AS i FROM documents WHERE text IS NOT NULL)")
def hard_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts cut every 2,000 characters."""
    docs = t.table(spark, d, "documents").where("length(text) > 0")
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / 2000))).alias("piece")
    return docs.select("doc_id", "text", i).select("doc_id", "piece", F.substring("text", (F.col("piece") * 2000 + 1).cast("int"), F.lit(2000)).alias("content"))


@query()
def heading_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Notes split at their headings, with the trail of headings of each chunk."""
    docs = t.table(spark, d, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.explode(x.heading_chunks("text")).alias("c")).select("doc_id", "c.heading_path", "c.content", "c.position")


@query()
def frontmatter(spark: SparkSession, d: str) -> DataFrame:
    return t.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", x.frontmatter_json("text").alias("frontmatter"))


_ROLE = "lower(trim(role))"


def _case() -> str:
    return " ".join(f"WHEN regexp_matches(content, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in x.CLASSES)


@query(f"SELECT id, CASE WHEN length(content) < 40 THEN NULL WHEN {_ROLE} = 'user' AND regexp_matches(content, '{x.CORRECTION.replace(chr(39), chr(39) * 2)}') THEN 'convention' {_case()} END AS kind FROM (SELECT DISTINCT id, role, content FROM messages WHERE content IS NOT NULL)")
def prefilter_classify(spark: SparkSession, d: str) -> DataFrame:
    """The class that a message's wording suggests, if any."""
    m = t.table(spark, d, "messages").where("content IS NOT NULL").select("id", "role", "content").distinct()
    return m.select("id", x.classify(F.col("content"), F.lower(F.trim("role"))).alias("kind"))


@query(
    """SELECT id, list_sort(list_distinct(list_concat(
      list_filter(list_transform(p, lambda y: lower(list_extract(string_split(y, '.'), -1))), lambda e: e IN ('py', 'ts', 'js', 'rs', 'go', 'md', 'toml', 'yaml', 'yml', 'json')),
      list_transform(list_filter(list_transform(p, lambda y: string_split(y, '/')), lambda s: len(s) > 1), lambda s: CASE WHEN s[-2] <> '' THEN s[-2] ELSE s[1] END))))[1:5] AS tags
    FROM (SELECT id, regexp_extract_all(content, '[\\w/.-]+\\.\\w{1,10}') AS p FROM (SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL)) WHERE len(p) > 0"""
)
def tag_extract(spark: SparkSession, d: str) -> DataFrame:
    """Tags from the file paths that messages name; messages without any path are left out."""
    m = t.table(spark, d, "messages").where("content IS NOT NULL").select("id", "content").distinct()
    return m.where(F.col("content").rlike(r"[\w/.-]+\.\w{1,10}")).select("id", x.path_tags(F.col("content")).alias("tags"))


@query(
    """SELECT memory_id, CASE WHEN length(hit) > 0 AND length(hit) <= 200 THEN hit WHEN length(flat) > 200 THEN substr(flat, 1, 197) || '...' ELSE flat END AS summary
    FROM (SELECT memory_id, flat, regexp_extract(flat, '^(.{20,}?[.!?])[ ]', 1) AS hit FROM (SELECT memory_id, regexp_replace(trim(content, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\r\\n]+', ' ', 'g') AS flat FROM (SELECT DISTINCT memory_id, content FROM memories WHERE content IS NOT NULL)))"""
)
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    m = t.table(spark, d, "memories").where("content IS NOT NULL").select("memory_id", "content").distinct()
    return m.select("memory_id", x.first_sentence(F.col("content")).alias("summary"))


@query(sql("SELECT folder, count(DISTINCT path) AS n_notes FROM (SELECT path, unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS folder FROM (SELECT path, string_split(path, '/') AS p FROM v_notes)) GROUP BY 1"))
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    return quality.folder_rollup(t.notes(spark, d))


@query(sql("SELECT path, len(list_filter(string_split(path, '/'), lambda s: s = '' OR starts_with(s, '.'))) > 0 OR NOT ends_with(path, '.md') AS unsafe FROM v_notes"))
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    return t.notes(spark, d).select("path", x.unsafe_path(F.col("path")).alias("unsafe"))


@query(sql("SELECT note_path, chunk_id, running FROM (SELECT note_path, chunk_id, sum(cost) OVER w AS running, row_number() OVER w AS nth FROM (SELECT *, length(content) // 4 AS cost FROM v_chunks WHERE content IS NOT NULL AND note_path IS NOT NULL) WINDOW w AS (PARTITION BY note_path ORDER BY chunk_id ROWS UNBOUNDED PRECEDING)) WHERE running <= 500 OR nth = 1").replace("sum(cost) OVER w AS running", "(sum(cost) OVER w)::BIGINT AS running"))
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    """The leading chunks of each note within 500 tokens."""
    c = t.chunks(spark, d).where("content IS NOT NULL AND note_path IS NOT NULL").withColumn("cost", x.token_estimate(F.length("content")))
    return quality.within_budget(c, 500, "note_path", "chunk_id").select("note_path", "chunk_id", "running")


@query(sql("SELECT path, array_to_string(json_extract_string(frontmatter, '$.tags[*]'), ',') AS tags, frontmatter ->> '$.status' AS status, frontmatter ->> '$.type' AS note_type FROM v_notes WHERE json_valid(frontmatter)"))
def note_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Tags, status and type from front matter that can be read."""
    fm = F.try_parse_json("frontmatter")
    n = t.notes(spark, d).where(fm.isNotNull())
    tags = F.from_json("frontmatter", "tags array<string>")["tags"]
    return n.select("path", F.coalesce(F.array_join(tags, ","), F.lit("")).alias("tags"), F.get_json_object("frontmatter", "$.status").alias("status"), F.get_json_object("frontmatter", "$.type").alias("note_type"))


@query(
    sql(
        """SELECT c.chunk_id, concat('Note: ', coalesce(n.title, c.note_path), CASE WHEN c.heading_path IS NOT NULL THEN ' | Section: ' || c.heading_path ELSE '' END, chr(10), '---', chr(10), c.content) AS context
        FROM v_chunks c JOIN v_notes n ON n.path = c.note_path WHERE c.content IS NOT NULL"""
    )
)
def embedding_context(spark: SparkSession, d: str) -> DataFrame:
    """The text that an embedder gets for each chunk."""
    n = t.notes(spark, d).select(F.col("path").alias("note_path"), "title")
    j = t.chunks(spark, d).where("content IS NOT NULL").join(n, "note_path")
    section = F.when(F.col("heading_path").isNotNull(), F.concat(F.lit(" | Section: "), "heading_path")).otherwise("")
    return j.select("chunk_id", F.concat(F.lit("Note: "), F.coalesce("title", "note_path"), section, F.lit("\n---\n"), "content").alias("context"))


@query()
def transcript_search(spark: SparkSession, d: str) -> DataFrame:
    """Messages by BM25 over stems, the 20 best with hits marked, for one query."""
    from lectern.operators.transcripts import search

    return search(t.table(spark, d, "messages"), "deployments archived sessions", limit=20)


@query(sql("SELECT triple_id, subject || ' | ' || predicate || ' | ' || object AS fact FROM v_triples WHERE predicate IS NOT NULL"))
def fact_text(spark: SparkSession, d: str) -> DataFrame:
    return t.triples(spark, d).where("predicate IS NOT NULL").select("triple_id", F.concat_ws(" | ", "subject", "predicate", "object").alias("fact"))


@query(sql("SELECT entity, n FROM (SELECT entity, count(*) AS n FROM (SELECT subject AS entity FROM v_triples UNION ALL SELECT object FROM v_triples) GROUP BY 1) ORDER BY n DESC, entity LIMIT 30"))
def top_entities(spark: SparkSession, d: str) -> DataFrame:
    tr = t.triples(spark, d)
    e = tr.select(F.col("subject").alias("entity")).union(tr.select("object")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.desc("n"), "entity").limit(30)
