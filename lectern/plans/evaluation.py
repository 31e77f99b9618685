"""Queries of evaluation, tuning, statistics, export and extras over the star schema's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import quality, rank, tune
from lectern.plans import retrieval as r
from lectern.registry import query
from lectern.sources import tables as t
from lectern.sources.tables import sql

# Labels: the note of the chunk with a query's number, and the folder above it.
_LABELS = "SELECT DISTINCT chunk_id AS query_id, note_path AS target FROM v_chunks JOIN v_questions ON query_id = chunk_id WHERE note_path IS NOT NULL UNION SELECT DISTINCT chunk_id, string_split(note_path, '/')[1] FROM v_chunks JOIN v_questions ON query_id = chunk_id WHERE note_path IS NOT NULL"


def labels(spark: SparkSession, d: str) -> DataFrame:
    c = t.chunks(spark, d).where("note_path IS NOT NULL").select(F.col("chunk_id").alias("query_id"), "note_path")
    c = c.join(t.questions(spark, d).select("query_id"), "query_id")
    return c.select("query_id", F.col("note_path").alias("target")).union(c.select("query_id", F.element_at(F.split("note_path", "/"), 1))).distinct()


_METRIC = """SELECT w.query_id, coalesce(hits, 0) / n::DOUBLE AS recall, coalesce(1 / best::DOUBLE, 0) AS mrr, coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg
    FROM (SELECT query_id, count(*) AS n FROM lab GROUP BY 1) w LEFT JOIN (
      SELECT query_id, count(*) FILTER (WHERE place <= 5) AS hits, min(place) AS best, sum(CASE WHEN place <= 5 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg
      FROM (SELECT l.query_id, target, min(place) AS place FROM lab l JOIN ranked USING (query_id) WHERE contains(lower(note_path), rtrim(lower(target), '/')) GROUP BY 1, 2) GROUP BY 1) h ON h.query_id = w.query_id"""


_RANKED = "SELECT query_id, note_path, place FROM (SELECT query_id, note_path, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, place) AS place FROM s7) WHERE place <= 5"


@query(sql("SELECT query_id, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg FROM met", **r._FULL, ranked=_RANKED, lab=_LABELS, met=_METRIC))
def recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the full ranker per query."""
    m = quality.metrics(r.hybrid_full(spark, d).select("query_id", F.col("note_path").alias("path"), "place"), labels(spark, d))
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def _ablations() -> str:
    """The ranker's SQL once for all signals and once without each."""
    import re

    passed = {"link_section": ("s1", "s0"), "convergence": ("s2", "s1"), "context": ("s3", "s2"), "hotness": ("s4", "s3"), "cooccurrence": ("s5", "s4"), "prediction_error": ("s6", "s5"), "lateral_inhibition": ("s7", "pool")}
    own = ("s1d", "s1", "spread", "s2", "s3", "s4", "rawb", "boost", "s5", "s6", "best", "pool", "most", "s7", "ranked", "met")
    every = {**r._FULL, "ranked": _RANKED, "lab": _LABELS, "met": _METRIC}
    ctes = {k: v for k, v in every.items() if k not in own}
    for i, signal in enumerate(("full", *passed)):
        chain = {k: every[k] for k in own}
        if signal in passed:
            stage, before = passed[signal]
            chain[stage] = f"SELECT * FROM {before}"
        for k, v in chain.items():
            ctes[f"{k}_{i}"] = re.sub(rf"\b({'|'.join(sorted(own, key=len, reverse=True))})\b(?= |\.|\)|$|\n)", lambda m: m[1] if m[1] in ("best", "most", "boost") and not re.search(r"(FROM|JOIN) $", v[: m.start()]) else f"{m[1]}_{i}", v)
    runs = " UNION ALL ".join(f"SELECT '{s}' AS config, avg(recall) AS recall, avg(mrr) AS mrr, avg(ndcg) AS ndcg FROM met_{i}" for i, s in enumerate(("full", *passed)))
    return sql("SELECT config, round(recall, 6) AS recall, round(mrr, 6) AS mrr, round(ndcg, 6) AS ndcg, round((SELECT ndcg FROM runs WHERE config = 'full') - ndcg, 6) AS ndcg_loss FROM runs", **ctes, runs=runs)


@query(_ablations())
def ablation_delta(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality of the full ranker and of each one without a signal, with the loss."""
    return tune.ablation(spark, d)


@query()
def weight_search(spark: SparkSession, d: str) -> DataFrame:
    """Coordinate ascent over all ranking weights on the even half, with the held-out half's score."""
    return tune.coordinate_ascent(spark, d)


@query(sql("SELECT query_id, note_path, round(CASE WHEN top > 0 THEN greatest(0, s / top) ELSE 0 END, 6) AS score FROM (SELECT query_id, note_path, max(score) AS s, max(max(score)) OVER (PARTITION BY query_id) AS top FROM s0 GROUP BY 1, 2)", **r._CAND))
def normalize_scores(spark: SparkSession, d: str) -> DataFrame:
    """Best score of each note over the query's best, not below 0."""
    return tune.normalize(rank.base_scores(r.candidates(spark, d))).select("query_id", "note_path", F.round("score", 6).alias("score"))


_TRI = {
    **r._CAND,
    "tb": "SELECT b.query_id, b.triple_id, t.note_path, 1 / (1 + abs(b.rank)) AS s FROM (SELECT query_id, doc AS triple_id, rank FROM tbm) b JOIN v_triples t USING (triple_id)",
    "tn": "SELECT query_id, note_path, s / max(s) OVER (PARTITION BY query_id) AS s FROM (SELECT query_id, note_path, max(s) AS s FROM tb GROUP BY 1, 2)",
    "sn": "SELECT query_id, note_path, CASE WHEN top > 0 THEN greatest(0, s / top) ELSE 0 END AS s FROM (SELECT query_id, note_path, max(score) AS s, max(max(score)) OVER (PARTITION BY query_id) AS top FROM s0 GROUP BY 1, 2)",
    "mg": "SELECT query_id, note_path, coalesce(tn.s, 0) + 0.5::DOUBLE * coalesce(sn.s, 0) AS score FROM tn FULL JOIN sn USING (query_id, note_path)",
}


def _facts_sql() -> dict[str, str]:
    from lectern.operators.bm25 import sql_ctes

    ctes = sql_ctes("SELECT triple_id AS doc, triple_text AS body FROM v_triples", r._QS, 30)
    rename = {k: "t" + k for k in ctes}
    import re

    out = {}
    for k, v in ctes.items():
        for old, new in rename.items():
            v = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {new}", v)
        out[rename[k]] = v
    return out


@query(sql("SELECT query_id, note_path, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, note_path) AS nth FROM mg) WHERE nth <= 5", **_facts_sql(), **_TRI))
def tiered_merge(spark: SparkSession, d: str) -> DataFrame:
    """Notes by their facts and, at half weight, their chunks: the 5 best of each query."""
    return tune.tiered(rank.base_scores(r.candidates(spark, d)), spark, d)


@query(sql("SELECT (SELECT count(*) FROM v_notes) AS n_notes, (SELECT count(*) FROM v_chunks) AS n_chunks, (SELECT count(DISTINCT chunk_id) FROM v_vectors) AS n_embedded, (SELECT count(*) FROM v_triples) AS n_triples, (SELECT count(DISTINCT note_path) FROM v_triples) AS notes_with_facts, (SELECT count(*) FROM v_pairs) AS n_pairs, (SELECT count(*) FROM v_memories) AS n_memories"))
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    count = lambda df, name, e=None: df.agg((F.count(F.lit(1)) if e is None else F.countDistinct(e)).alias(name))
    parts = [count(t.notes(spark, d), "n_notes"), count(t.chunks(spark, d), "n_chunks"), count(t.chunk_vectors(spark, d), "n_embedded", "chunk_id"), t.triples(spark, d).agg(F.count(F.lit(1)).alias("n_triples"), F.countDistinct("note_path").alias("notes_with_facts")), count(t.pair_state(spark, d), "n_pairs"), count(t.memories(spark, d), "n_memories")]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


@query(sql("SELECT path, title, content_hash, coalesce(in_degree, 0) AS in_degree, facts FROM v_notes LEFT JOIN (SELECT target_path AS path, count(*) AS in_degree FROM v_edges GROUP BY 1) USING (path) LEFT JOIN (SELECT note_path AS path, string_agg(triple_id || ':' || subject || '|' || object, ';' ORDER BY triple_id, subject, object) AS facts FROM (SELECT DISTINCT triple_id, note_path, subject, object FROM v_triples) GROUP BY 1) USING (path)"))
def export_notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with in-degree and facts, ready for the JSON sink."""
    deg = t.note_edges(spark, d).groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("in_degree"))
    item = F.struct("triple_id", "subject", "object")
    facts = t.triples(spark, d).select("note_path", "triple_id", "subject", "object").distinct().groupBy(F.col("note_path").alias("path")).agg(F.array_sort(F.collect_list(item)).alias("f"))
    text = F.array_join(F.transform("f", lambda e: F.concat(e["triple_id"].cast("string"), F.lit(":"), e["subject"], F.lit("|"), e["object"])), ";")
    return t.notes(spark, d).join(deg, "path", "left").join(facts, "path", "left").select("path", "title", "content_hash", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), text.alias("facts"))


@query(sql("SELECT query_id, ((row_number() OVER (ORDER BY query_id) - 1) % 2)::INT AS fold FROM v_questions"))
def interleaved_split(spark: SparkSession, d: str) -> DataFrame:
    return quality.interleaved(t.questions(spark, d).select("query_id"))


@query(sql("SELECT path, title, 'recent' AS section FROM (SELECT path, title FROM v_notes ORDER BY updated_at DESC NULLS LAST, path LIMIT 10) UNION ALL SELECT path, title, 'linked' FROM (SELECT path, title FROM v_notes JOIN (SELECT target_path AS path, count(*) AS n FROM v_edges GROUP BY 1) USING (path) ORDER BY n DESC, path LIMIT 5)"))
def brief(spark: SparkSession, d: str) -> DataFrame:
    """The notes of a session brief: ten changed last, five linked most."""
    n = t.notes(spark, d)
    recent = n.orderBy(F.desc_nulls_last("updated_at"), "path").limit(10).select("path", "title", F.lit("recent").alias("section"))
    deg = t.note_edges(spark, d).groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    linked = n.join(deg, "path").orderBy(F.desc("n"), "path").limit(5).select("path", "title", F.lit("linked").alias("section"))
    return recent.unionByName(linked)


# Extras beyond the retrieval engine: grouping sets and windows over the event stream, in batch form.


@query("SELECT event_type, coalesce(user_id, -1) AS user_id, grouping(event_type) + 2 * grouping(events.user_id) AS level, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY CUBE (event_type, events.user_id)")
def events_cube(spark: SparkSession, d: str) -> DataFrame:
    c = t.table(spark, d, "events").cube("event_type", "user_id")
    out = c.agg((F.grouping("event_type") + 2 * F.grouping("user_id")).cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.withColumn("user_id", F.coalesce("user_id", F.lit(-1)))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_hourly(spark: SparkSession, d: str) -> DataFrame:
    g = t.table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s")
def events_sessions(spark: SparkSession, d: str) -> DataFrame:
    g = t.table(spark, d, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return g.select("user_id", "first_ts", "last_ts", "n")
