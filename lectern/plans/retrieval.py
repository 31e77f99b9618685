"""Queries of the retrieval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import cosine, mean_vector
from lectern.operators import bm25 as text_rank
from lectern.operators import rank
from lectern.operators.vectors import vector_topk
from lectern.registry import query
from lectern.session import materialize
from lectern.sources import tables as t
from lectern.sources.tables import sql

_DOCS = "SELECT chunk_id AS doc, content AS body FROM v_chunks"
_QS = "SELECT query_id, text FROM v_questions"
_BM = text_rank.sql_ctes(_DOCS, _QS)
_COS = "list_dot_product({0}, {1}) / (sqrt(list_dot_product({0}, {0})) * sqrt(list_dot_product({1}, {1})) + 1e-10)"


def _hits(spark: SparkSession, d: str, limit: int | None = 50, **kw) -> DataFrame:
    return text_rank.bm25(t.chunks(spark, d, by_id=True), "chunk_id", "content", t.questions(spark, d).select("query_id", "text"), limit, **kw)


@query(sql("SELECT query_id, doc AS chunk_id, round(rank, 6) AS rank, pos FROM bm", **_BM))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search: the 50 best chunks of every query."""
    return _hits(spark, d).select("query_id", F.col("doc").alias("chunk_id"), F.round("rank", 6).alias("rank"), F.col("pos").cast("long").alias("pos"))


_SHORT = "SELECT memory_id AS query_id, array_to_string(regexp_extract_all(content, '[\\p{L}\\p{N}]+'), ' ') AS text FROM v_memories WHERE content IS NOT NULL"


@query(sql("SELECT query_id, doc AS memory_id, round(rank, 6) AS rank FROM bm JOIN (SELECT query_id, count(*) AS need FROM q_terms GROUP BY 1) USING (query_id) WHERE hits = need", **text_rank.sql_ctes("SELECT memory_id AS doc, content AS body FROM v_memories", _SHORT, None)))
def bm25_match_all(spark: SparkSession, d: str) -> DataFrame:
    """Memory search: all words must occur. Queries are the contents of the memories."""
    m = t.memories(spark, d).where("content IS NOT NULL")
    words = F.regexp_extract_all("content", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    qs = m.select(F.col("memory_id").alias("query_id"), F.array_join(words, " ").alias("text"))
    return text_rank.bm25(m, "memory_id", "content", qs, None, match_all=True).select("query_id", F.col("doc").alias("memory_id"), F.round("rank", 6).alias("rank"))


@query(
    sql(
        "SELECT query_id, doc AS triple_id, round(rank, 6) AS rank, pos FROM bm",
        **text_rank.sql_ctes("SELECT triple_id AS doc, triple_text AS body FROM v_triples", _QS, 30),
    )
)
def triple_keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """Keyword search over facts: the 30 best of every query."""
    hits = text_rank.bm25(t.triples(spark, d), "triple_id", "triple_text", t.questions(spark, d).select("query_id", "text"), 30)
    return hits.select("query_id", F.col("doc").alias("triple_id"), F.round("rank", 6).alias("rank"), F.col("pos").cast("long").alias("pos"))


@query(
    sql(
        """SELECT query_id, doc AS chunk_id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), doc) AS place FROM scored
        WHERE doc IN (SELECT chunk_id FROM v_chunks WHERE lower(note_path) LIKE 'work/%')) WHERE place <= 50""",
        **_BM,
    )
)
def keyword_workspace(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best keyword hits of every query inside one workspace; statistics stay those of the whole corpus."""
    c = t.chunks(spark, d).where(F.lower("note_path").startswith("work/")).select(F.col("chunk_id").alias("doc"))
    return _hits(spark, d, within=c).select("query_id", F.col("doc").alias("chunk_id"), F.round("rank", 6).alias("rank"))


@query(
    sql(
        f"""SELECT query_id, chunk_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS nth
        FROM (SELECT query_id, chunk_id, round({_COS.format('qvec', 'vec')}, 6) AS similarity FROM v_questions CROSS JOIN v_vectors)) WHERE nth <= 50"""
    )
)
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    """Vector search: the 50 most similar chunks of every query."""
    return vector_topk(t.chunk_vectors(spark, d), t.questions(spark, d), 50)


_CENTROID = "SELECT note_path, list(m ORDER BY i) AS centroid, max(n) AS n_chunks FROM (SELECT note_path, i, avg(vec[i]) AS m, count(*) AS n FROM v_vectors, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1"


@query(sql("SELECT note_path, n_chunks, list_transform(centroid, lambda x: round(x, 6)) AS centroid FROM cen", cen=_CENTROID))
def note_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Mean vector of each note."""
    agg = t.chunk_vectors(spark, d).groupBy("note_path").agg(F.count(F.lit(1)).alias("n_chunks"), mean_vector(F.col("vec")).alias("centroid"))
    return agg.select("note_path", "n_chunks", F.transform("centroid", lambda x: F.round(x, 6)).alias("centroid"))


@query(
    sql(
        f"""SELECT query_path, note_path, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_path ORDER BY similarity DESC, note_path) AS nth
        FROM (SELECT a.note_path AS query_path, b.note_path, round({_COS.format('a.centroid', 'b.centroid')}, 4) AS similarity
        FROM cen a JOIN cen b ON a.note_path <> b.note_path JOIN v_edges e ON e.source_path = a.note_path AND e.target_path = b.note_path)) WHERE nth <= 10""",
        cen=_CENTROID,
    )
)
def related_linked(spark: SparkSession, d: str) -> DataFrame:
    """For every note, the 10 linked notes nearest to it by centroid."""
    cen = t.chunk_vectors(spark, d).groupBy("note_path").agg(mean_vector(F.col("vec")).alias("centroid"))
    e = t.note_edges(spark, d)
    a, b = cen.select(F.col("note_path").alias("source_path"), F.col("centroid").alias("x")), cen.select(F.col("note_path").alias("target_path"), F.col("centroid").alias("y"))
    scored = e.join(a, "source_path").join(b, "target_path").select(F.col("source_path").alias("query_path"), F.col("target_path").alias("note_path"), F.round(cosine(F.col("x"), F.col("y")), 4).alias("similarity"))
    nth = F.row_number().over(Window.partitionBy("query_path").orderBy(F.desc("similarity"), "note_path"))
    return scored.withColumn("nth", nth).where("nth <= 10").drop("nth")


def related_notes(vectors: DataFrame, path: str, top_k: int = 10) -> DataFrame:
    """note_path, similarity: the notes nearest to one note by centroid; the source's centroid, one row, is broadcast."""
    cen = vectors.groupBy("note_path").agg(mean_vector(F.col("vec")).alias("centroid"))
    source = cen.where(F.col("note_path") == path).select(F.col("centroid").alias("x"))
    others = cen.where(F.col("note_path") != path).crossJoin(F.broadcast(source))
    return others.select("note_path", F.round(cosine(F.col("x"), F.col("centroid")), 4).alias("similarity")).orderBy(F.desc("similarity"), "note_path").limit(top_k)


_FIRST = "SELECT min(note_path) FROM v_vectors"


@query(
    sql(
        f"SELECT b.note_path, round({_COS.format('a.centroid', 'b.centroid')}, 4) AS similarity FROM cen a JOIN cen b ON a.note_path = ({_FIRST}) AND b.note_path <> a.note_path ORDER BY 2 DESC, 1 LIMIT 10",
        cen=_CENTROID,
    )
)
def related_topk(spark: SparkSession, d: str) -> DataFrame:
    """The notes most related to the first note by path."""
    v = t.chunk_vectors(spark, d)
    return related_notes(v, v.agg(F.min("note_path")).first()[0])


def candidates(spark: SparkSession, d: str, limit: int = 50) -> DataFrame:
    """Keyword hits with their chunks and vectors, those without a usable vector left out."""
    hits = materialize(_hits(spark, d, limit).withColumnRenamed("doc", "chunk_id"), "hits")
    ids = hits.select("chunk_id").distinct()  # filters rows before they are made distinct
    v = t.chunk_vectors(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", "vec", "note_path")
    c = t.chunks(spark, d).join(ids, "chunk_id", "left_semi").select("chunk_id", "heading_path", "content")
    q = t.questions(spark, d).select("query_id", "qvec")
    return hits.join(v, "chunk_id").join(c, "chunk_id").join(q, "query_id")


CONTEXT = "work"


def context_sets(spark: SparkSession, d: str, context: str = CONTEXT) -> tuple[DataFrame, DataFrame]:
    """Notes whose path or tags contain the context, and notes one link from them."""
    tags = F.from_json("frontmatter", "tags array<string>", {"mode": "PERMISSIVE"})["tags"]
    n = t.notes(spark, d)
    direct = n.where(F.contains(F.lower("path"), F.lit(context)) | F.coalesce(F.exists(tags, lambda x: F.contains(F.lower(x), F.lit(context))), F.lit(False))).select(F.col("path").alias("note_path"))
    e = t.note_edges(spark, d)
    out = e.join(direct.withColumnRenamed("note_path", "source_path"), "source_path", "left_semi").select(F.col("target_path").alias("note_path"))
    into = e.join(direct.withColumnRenamed("note_path", "target_path"), "target_path", "left_semi").select(F.col("source_path").alias("note_path"))
    return direct, out.union(into).distinct().join(direct, "note_path", "left_anti")


def evidence(spark: SparkSession, d: str, ablate: frozenset[str] = frozenset()) -> rank.Evidence:
    direct, near = context_sets(spark, d)
    return rank.Evidence(t.chunk_vectors(spark, d), t.usage(spark, d), t.AS_OF, t.triples(spark, d), t.pair_state(spark, d), t.errors(spark, d), direct, near, ablate)


# Fixed values of the stages appear once more in the SQL below.
_CAND = {
    **_BM,
    "cand": f"""SELECT b.query_id, b.doc AS chunk_id, v.note_path, heading_path, content, vec, qvec, rank, pos, {_COS.format('qvec', 'vec')} AS cosine
        FROM bm b JOIN v_vectors v ON v.chunk_id = b.doc JOIN v_chunks c ON c.chunk_id = b.doc JOIN v_questions q ON q.query_id = b.query_id""",
    "s0": "SELECT *, 0.3::DOUBLE / (1 + abs(rank)) + 0.7::DOUBLE * cosine AS score FROM cand",
}
_LINK = {
    "s1d": "SELECT *, CASE WHEN length(content) > 0 THEN list_sum(list_transform(regexp_extract_all(content, '\\[\\[[^\\]]+\\]\\]'), lambda x: length(x)))::DOUBLE / length(content) ELSE 0 END AS dens FROM s0",
    "s1": """SELECT * EXCLUDE (dens) REPLACE (score * CASE WHEN coalesce(dens, 0) >= 0.5 OR (coalesce(dens, 0) >= 0.1 AND regexp_matches(lower(trim(regexp_replace(list_extract(string_split(heading_path, '>'), -1), '^[# ]+', ''))),
        '^(related|see also|see-also|backlinks|links|references|index|contents|table of contents|moc)')) THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS score) FROM s1d""",
}
_CONV = {
    "cen": _CENTROID,
    "spread": f"SELECT query_id, note_path, stddev_pop({_COS.format('qvec', 'v.vec')}) AS sigma FROM (SELECT DISTINCT query_id, note_path, qvec FROM s1) JOIN v_vectors v USING (note_path) GROUP BY 1, 2",
    "s2": f"""SELECT s1.* REPLACE (CASE WHEN n_chunks >= 2 THEN 0.7::DOUBLE * score + 0.3::DOUBLE * ({_COS.format('qvec', 'centroid')}) / (1 + sigma) ELSE score END AS score)
        FROM s1 LEFT JOIN cen USING (note_path) LEFT JOIN spread USING (query_id, note_path)""",
}
_CTX = {
    "direct": """SELECT path AS note_path FROM v_notes WHERE lower(path) LIKE '%work%' OR
        coalesce(len(list_filter(CASE WHEN json_valid(frontmatter) THEN json_extract_string(frontmatter, '$.tags[*]') END, lambda x: lower(x) LIKE '%work%')), 0) > 0""",
    "near": """SELECT note_path FROM (SELECT target_path AS note_path FROM v_edges JOIN direct ON source_path = note_path UNION SELECT source_path FROM v_edges JOIN direct ON target_path = note_path)
        WHERE note_path NOT IN (SELECT note_path FROM direct)""",
    "s3": "SELECT s2.* REPLACE (score * CASE WHEN note_path IN (SELECT note_path FROM direct) THEN 1.4::DOUBLE WHEN note_path IN (SELECT note_path FROM near) THEN 1.2::DOUBLE ELSE 1::DOUBLE END AS score) FROM s2",
}
_HOT = {
    "hot": f"""SELECT note_path, count(*) AS uses, max(used_at) AS last_used, (1 + count(*))::DOUBLE / (2 + count(*)) *
        pow(2::DOUBLE, -greatest(0, (epoch_us(TIMESTAMP '{t.AS_OF}') - epoch_us(max(used_at))) / 86400000000::DOUBLE) / 30) AS hotness FROM v_usage GROUP BY 1""",
    "s4": "SELECT s3.* REPLACE (CASE WHEN hotness > 0 THEN 0.8::DOUBLE * score + 0.2::DOUBLE * hotness ELSE score END AS score) FROM s3 LEFT JOIN hot USING (note_path)",
}
_COOC = {
    "ents": "SELECT subject AS entity FROM v_triples UNION SELECT object FROM v_triples",
    "qw": "SELECT DISTINCT query_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\r\\n]+')) AS word FROM v_questions",
    "hitw": "SELECT word, entity FROM (SELECT DISTINCT word FROM qw WHERE length(word) > 2) JOIN ents ON contains(entity, word)",
    "qe": "SELECT DISTINCT query_id, entity FROM qw JOIN hitw USING (word)",
    "sym": "SELECT entity_a AS entity, entity_b AS other, weight + reinforcement AS w FROM v_pairs UNION ALL SELECT entity_b, entity_a, weight + reinforcement FROM v_pairs",
    "assoc": "SELECT query_id, other AS entity, max(w) AS w FROM qe JOIN sym USING (entity) GROUP BY 1, 2",
    "assoc2": "SELECT * FROM assoc ANTI JOIN qe USING (query_id, entity)",
    "memb": "SELECT note_path, subject AS entity FROM v_triples UNION SELECT note_path, object FROM v_triples",
    "rawb": "SELECT query_id, note_path, sum(w) AS raw FROM assoc2 JOIN memb USING (entity) JOIN (SELECT DISTINCT query_id, note_path FROM s4) USING (query_id, note_path) GROUP BY 1, 2",
    "boost": "SELECT query_id, note_path, 1 + 0.1::DOUBLE * raw / (raw + top) AS boost FROM rawb JOIN (SELECT query_id, max(w) AS top FROM assoc2 GROUP BY 1) USING (query_id) WHERE raw + top > 0",
    "s5": "SELECT s4.* REPLACE (score * coalesce(boost, 1) AS score) FROM s4 LEFT JOIN boost USING (query_id, note_path)",
}
_ERR = {
    "errs": "SELECT note_path, count(*) AS n FROM v_errors GROUP BY 1 HAVING count(*) >= 2",
    "s6": "SELECT s5.* REPLACE (score / (1 + 0.1::DOUBLE * coalesce(n, 0)) AS score) FROM s5 LEFT JOIN errs USING (note_path)",
}


def _last(stage: str) -> dict[str, str]:
    return {
        "best": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, note_path ORDER BY round(score, 9) DESC, pos) AS nth FROM {stage}) WHERE nth = 1",
        "pool": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, pos) AS place FROM best) WHERE place <= 15",
        "most": f"SELECT a.query_id, a.place, max({_COS.format('a.vec', 'b.vec')}) AS most FROM pool a JOIN pool b ON a.query_id = b.query_id AND b.place < a.place GROUP BY 1, 2",
        "s7": "SELECT pool.* REPLACE (score * CASE WHEN most > 0.65 THEN 1 - 0.3::DOUBLE * most ELSE 1::DOUBLE END AS score) FROM pool LEFT JOIN most USING (query_id, place)",
    }


_TOP = "SELECT query_id, chunk_id, note_path, round(score, 6) AS score, final AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS final FROM s7) WHERE final <= 5"
_FULL = {**_CAND, **_LINK, **_CONV, **_CTX, **_HOT, **_COOC, **_ERR, **_last("s6")}


@query(sql(_TOP, **_FULL))
def hybrid_full(spark: SparkSession, d: str) -> DataFrame:
    """All stages of the hybrid ranker for every query: the 5 best notes."""
    q = t.questions(spark, d)
    out = rank.hybrid(materialize(candidates(spark, d), "candidates"), q.select("query_id", "text"), evidence(spark, d))
    return out.select("query_id", "chunk_id", "note_path", F.round("score", 6).alias("score"), "place")


def _stage(sql_stage: str, upto: dict) -> str:
    return sql(f"SELECT query_id, chunk_id, round(score, 6) AS score FROM {sql_stage}", **upto)


def _show(c: DataFrame) -> DataFrame:
    return c.select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@query(_stage("s0", _CAND))
def hybrid_base(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.base_scores(candidates(spark, d)))


@query(_stage("s1", {**_CAND, **_LINK}))
def hybrid_link_section(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.link_stage(rank.base_scores(candidates(spark, d)), rank.Weights()))


@query(_stage("s2", {**_CAND, "s1": "SELECT * FROM s0", **_CONV}))
def hybrid_convergence(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.convergence_stage(rank.base_scores(candidates(spark, d)), t.chunk_vectors(spark, d), rank.Weights()))


@query(_stage("s3", {**_CAND, "s2": "SELECT * FROM s0", **_CTX}))
def hybrid_context(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.context_stage(rank.base_scores(candidates(spark, d)), *context_sets(spark, d)))


@query(_stage("s4", {**_CAND, "s3": "SELECT * FROM s0", **_HOT}))
def hybrid_hotness(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.hotness_stage(rank.base_scores(candidates(spark, d)), t.usage(spark, d), F.lit(t.AS_OF).cast("timestamp_ntz"), rank.Weights()))


@query(_stage("s5", {**_CAND, "s4": "SELECT * FROM s0", **_COOC}))
def hybrid_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    q = t.questions(spark, d).select("query_id", "text")
    return _show(rank.cooccurrence_stage(rank.base_scores(candidates(spark, d)), q, t.triples(spark, d), t.pair_state(spark, d), rank.Weights()))


@query(_stage("s6", {**_CAND, "s5": "SELECT * FROM s0", **_ERR}))
def hybrid_error_demotion(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.error_stage(rank.base_scores(candidates(spark, d)), t.errors(spark, d)))


@query(_stage("pool", {**_CAND, **_last("s0")}))
def best_chunk_per_note(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.best_per_note(rank.base_scores(candidates(spark, d)), 15))


@query(_stage("s7", {**_CAND, **_last("s0")}))
def lateral_inhibition(spark: SparkSession, d: str) -> DataFrame:
    return _show(rank.inhibition_stage(rank.best_per_note(rank.base_scores(candidates(spark, d)), 15), rank.Weights()))


@query(sql("SELECT query_id, entity FROM qe", **{k: _COOC[k] for k in ("ents", "qw", "hitw", "qe")}))
def query_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities that contain a word of the query, by the trigram join."""
    return rank.query_entities(t.questions(spark, d).select("query_id", "text"), t.triples(spark, d))


@query(sql("SELECT note_path, uses, last_used, round(hotness, 9) AS hotness FROM hot", hot=_HOT["hot"]))
def hotness(spark: SparkSession, d: str) -> DataFrame:
    h = rank.hotness(t.usage(spark, d), F.lit(t.AS_OF).cast("timestamp_ntz"))
    return h.select("note_path", "uses", "last_used", F.round("hotness", 9).alias("hotness"))


@query(sql("SELECT note_path, 'direct' AS kind FROM direct UNION ALL SELECT note_path, 'near' FROM near", **{k: _CTX[k] for k in ("direct", "near")}))
def context_notes(spark: SparkSession, d: str) -> DataFrame:
    direct, near = context_sets(spark, d)
    return direct.select("note_path", F.lit("direct").alias("kind")).union(near.select("note_path", F.lit("near")))
