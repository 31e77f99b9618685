"""The stored tables as the operators want them: repeated rows removed, late revisions resolved, names normalised.

Each view has the same definition in SQL (VIEWS), which the queries' SQL puts in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, d: str) -> DataFrame:
    """The latest revision of each path."""
    last = F.max(F.struct("updated_at", "content_hash", "title", "frontmatter")).alias("r")
    return table(spark, d, "notes").where("path IS NOT NULL").groupBy("path").agg(last).select("path", "r.title", "r.frontmatter", "r.content_hash", "r.updated_at")


def chunks(spark: SparkSession, d: str, by_id: bool = False) -> DataFrame:
    """Distinct chunks. by_id: shuffled once, by id, so that aggregates by chunk need no shuffle of their own."""
    rows = table(spark, d, "chunks").select("chunk_id", "note_path", "heading_path", "content", "position").where("chunk_id IS NOT NULL")
    return (rows.repartition("chunk_id") if by_id else rows).distinct()


def usable(e: Column, dim: int = 64) -> Column:
    """A vector of `dim` finite numbers, not all zero."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(e) == dim) & finite & F.exists(e, lambda x: x != 0)


def chunk_vectors(spark: SparkSession, d: str, by_note: bool = False) -> DataFrame:
    """chunk_id, note_path, vec (doubles) of every usable embedding. by_note: shuffled once, by note, so that aggregates by note need no shuffle of their own."""
    src = table(spark, d, "chunks").where("chunk_id IS NOT NULL AND note_path IS NOT NULL").where(usable(F.col("embedding")))
    rows = src.select("chunk_id", "note_path", "embedding")
    return (rows.repartition("note_path") if by_note else rows).distinct().select("chunk_id", "note_path", F.col("embedding").cast("array<double>").alias("vec"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Distinct facts with normalised names; those without note, subject or object are left out."""
    clean = lambda c: F.lower(F.trim(c))
    src = table(spark, d, "triples").select("triple_id", "note_path", clean("subject").alias("subject"), "predicate", clean("object").alias("object"), "triple_text")
    return src.where("note_path IS NOT NULL AND length(subject) > 0 AND length(object) > 0").distinct()


def pair_state(spark: SparkSession, d: str) -> DataFrame:
    """entity_a < entity_b, weight, reinforcement: pairs stored in both orders are joined, nulls are 0."""
    a, b = F.least("entity_a", "entity_b"), F.greatest("entity_a", "entity_b")
    src = table(spark, d, "entity_cooccurrence").where("entity_a IS NOT NULL AND entity_b IS NOT NULL AND entity_a <> entity_b")
    zero = lambda c: F.max(F.coalesce(c, F.lit(0.0))).alias(c)
    return src.groupBy(a.alias("entity_a"), b.alias("entity_b")).agg(zero("weight"), zero("reinforcement"))


def memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories").drop("near_duplicates").where("memory_id IS NOT NULL").distinct()


def usage(spark: SparkSession, d: str) -> DataFrame:
    """note_path, used_at: every event other than an error counts as a use of the note whose chunk the user's number names."""
    return _events(spark, d).where("event_type <> 'error'").select("note_path", F.col("ts").alias("used_at"))


def errors(spark: SparkSession, d: str) -> DataFrame:
    """note_path, detected_at, cosine_distance, error_type of each error event."""
    kind = F.when(F.col("value") % 2 < 1, "low_overlap").otherwise("contextual_mismatch")
    return _events(spark, d).where("event_type = 'error'").select("note_path", F.col("ts").alias("detected_at"), (F.col("value") / 500).alias("cosine_distance"), kind.alias("error_type"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "chunks").where("note_path IS NOT NULL").groupBy(F.col("chunk_id").alias("user_id")).agg(F.min("note_path").alias("note_path"))
    return table(spark, d, "events").join(names, "user_id")


def note_edges(spark: SparkSession, d: str) -> DataFrame:
    """source_path, target_path: an object names the first note of which it is the subject."""
    t = triples(spark, d)
    index = t.groupBy(F.col("subject").alias("object")).agg(F.min("note_path").alias("target_path"))
    return t.select(F.col("note_path").alias("source_path"), "object").distinct().join(index, "object").where("source_path <> target_path").select("source_path", "target_path").distinct()


def questions(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text, qvec: held-out passages as queries, each with the stored vector of its number."""
    q = table(spark, d, "benchmark").where("text IS NOT NULL").select(F.col("item_id").alias("query_id"), "text").distinct()
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("qvec"))
    return q.join(v, "query_id")


#: The same views in SQL, in an order in which each uses earlier ones only.
VIEWS = {
    "v_notes": """SELECT path, title, frontmatter, content_hash, updated_at FROM (SELECT *, row_number() OVER (PARTITION BY path
        ORDER BY updated_at DESC NULLS LAST, content_hash DESC NULLS LAST, title DESC NULLS LAST, frontmatter DESC NULLS LAST) AS nth
        FROM notes WHERE path IS NOT NULL) WHERE nth = 1""",
    "v_chunks": "SELECT DISTINCT chunk_id, note_path, heading_path, content, position FROM chunks WHERE chunk_id IS NOT NULL",
    "v_vectors": """SELECT DISTINCT chunk_id, note_path, embedding::DOUBLE[] AS vec FROM chunks
        WHERE chunk_id IS NOT NULL AND note_path IS NOT NULL AND len(embedding) = 64
          AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0""",
    "v_triples": """SELECT DISTINCT triple_id, note_path, lower(trim(subject)) AS subject, predicate, lower(trim(object)) AS object, triple_text
        FROM triples WHERE note_path IS NOT NULL AND length(trim(subject)) > 0 AND length(trim(object)) > 0""",
    "v_pairs": """SELECT least(entity_a, entity_b) AS entity_a, greatest(entity_a, entity_b) AS entity_b,
        max(coalesce(weight, 0)) AS weight, max(coalesce(reinforcement, 0)) AS reinforcement
        FROM entity_cooccurrence WHERE entity_a <> entity_b GROUP BY 1, 2""",
    "v_memories": "SELECT DISTINCT * EXCLUDE (near_duplicates) FROM memories WHERE memory_id IS NOT NULL",
    "v_events": """SELECT e.*, c.note_path FROM events e JOIN
        (SELECT chunk_id, min(note_path) AS note_path FROM chunks WHERE note_path IS NOT NULL GROUP BY chunk_id) c ON c.chunk_id = e.user_id""",
    "v_usage": "SELECT note_path, ts AS used_at FROM v_events WHERE event_type <> 'error'",
    "v_errors": """SELECT note_path, ts AS detected_at, value / 500 AS cosine_distance,
        CASE WHEN value % 2 < 1 THEN 'low_overlap' ELSE 'contextual_mismatch' END AS error_type FROM v_events WHERE event_type = 'error'""",
    "v_index": "SELECT subject AS object, min(note_path) AS target_path FROM v_triples GROUP BY subject",
    "v_edges": """SELECT DISTINCT note_path AS source_path, target_path FROM v_triples JOIN v_index USING (object) WHERE note_path <> target_path""",
    "v_questions": """SELECT b.query_id, b.text, e.embedding::DOUBLE[] AS qvec
        FROM (SELECT DISTINCT item_id AS query_id, text FROM benchmark WHERE text IS NOT NULL) b JOIN embeddings e ON e.vec_id = b.query_id""",
}
_USES = {"v_usage": ["v_events"], "v_errors": ["v_events"], "v_index": ["v_triples"], "v_edges": ["v_triples", "v_index"]}


def sql(body: str, **ctes: str) -> str:
    """`body` behind the views it names (and those they use) and further CTEs in the order given."""
    text = " ".join([body, *ctes.values()])
    need = {v for v in VIEWS if v in text}
    for v in list(need):
        need |= set(_USES.get(v, []))
    every = [(v, VIEWS[v]) for v in VIEWS if v in need] + list(ctes.items())
    return ("WITH RECURSIVE " + ",\n".join(f"{k} AS ({q})" for k, q in every) + "\n" if every else "") + body
