"""Queries of entity association and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import community, cooccur
from lectern.registry import query
from lectern.sources import tables as t
from lectern.sources.tables import sql

_MEMB = "SELECT note_path, subject AS entity FROM v_triples UNION SELECT note_path, object FROM v_triples"
_PW = "SELECT x.entity AS entity_a, y.entity AS entity_b, count(*)::DOUBLE AS weight FROM memb x JOIN memb y ON x.note_path = y.note_path AND x.entity < y.entity GROUP BY 1, 2"
_REBUILT = "SELECT entity_a, entity_b, coalesce(p.weight, 0) AS weight, coalesce(reinforcement, 0) AS reinforcement FROM pw p FULL JOIN v_pairs s USING (entity_a, entity_b) WHERE coalesce(p.weight, 0) > 0 OR coalesce(reinforcement, 0) > 0"
_OUT = "SELECT entity_a, entity_b, weight, round(reinforcement, 6) AS reinforcement FROM {}"


def _show(df: DataFrame) -> DataFrame:
    return df.select("entity_a", "entity_b", "weight", F.round("reinforcement", 6).alias("reinforcement"))


@query(sql("SELECT entity_a, entity_b, weight FROM pw", memb=_MEMB, pw=_PW))
def cooccurrence_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_weights(t.triples(spark, d))


@query(sql(_OUT.format("built"), memb=_MEMB, pw=_PW, built=_REBUILT))
def cooccurrence_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """The stored pairs after a structural rebuild; learned reinforcement stays."""
    return _show(cooccur.rebuild(t.pair_state(spark, d), t.triples(spark, d)))


_CHANGED = "SELECT DISTINCT note_path FROM triples WHERE updated_at >= TIMESTAMP '2026-01-01' AND note_path IS NOT NULL"
_TOUCHED = "SELECT DISTINCT entity FROM memb JOIN changed USING (note_path)"


@query(
    sql(
        _OUT.format(
            "(SELECT entity_a, entity_b, CASE WHEN entity_a IN (SELECT entity FROM touched) OR entity_b IN (SELECT entity FROM touched) THEN coalesce(p.weight, 0) ELSE s.weight END AS weight, coalesce(reinforcement, 0) AS reinforcement FROM v_pairs s FULL JOIN pw p USING (entity_a, entity_b)) WHERE weight > 0 OR (weight IS NOT NULL AND reinforcement > 0)"
        ),
        memb=_MEMB,
        pw=_PW,
        changed=_CHANGED,
        touched=_TOUCHED,
    )
)
def cooccurrence_incremental(spark: SparkSession, d: str) -> DataFrame:
    """The stored pairs after an update for the notes changed in 2026; other pairs stay as stored."""
    late = t.table(spark, d, "triples").where(F.col("updated_at") >= F.lit("2026-01-01").cast("timestamp_ntz")).where("note_path IS NOT NULL").select("note_path").distinct()
    return _show(cooccur.upsert_notes(t.pair_state(spark, d), t.triples(spark, d), late))


@query(
    sql(
        """SELECT entity_a, entity_b, coalesce(weight, 0) AS weight, round(CASE WHEN u.entity_a IS NULL THEN reinforcement WHEN coalesce(reinforcement, 0) > 0 THEN least(reinforcement * 1.1::DOUBLE, 100) ELSE 1 END, 6) AS reinforcement
        FROM v_pairs FULL JOIN (SELECT DISTINCT least(subject, object) AS entity_a, greatest(subject, object) AS entity_b FROM v_triples WHERE subject <> object) u USING (entity_a, entity_b)""".replace("u.entity_a IS NULL", "hit IS NULL").replace("AS entity_b FROM v_triples", "AS entity_b, true AS hit FROM v_triples")
    )
)
def reinforcement_step(spark: SparkSession, d: str) -> DataFrame:
    """One use of every pair that some fact joins."""
    used = t.triples(spark, d).select(F.col("subject").alias("entity_a"), F.col("object").alias("entity_b"))
    return _show(cooccur.reinforce(t.pair_state(spark, d), used))


@query(sql("SELECT entity_a, entity_b, weight, reinforcement, weight + reinforcement AS total FROM v_pairs ORDER BY round(weight + reinforcement, 9) DESC, 1, 2 LIMIT 20"))
def top_pairs(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.top_pairs(t.pair_state(spark, d))


@query(sql("SELECT count(*) AS pairs, coalesce(sum(CASE WHEN reinforcement > 0 THEN 1 ELSE 0 END), 0)::BIGINT AS reinforced, round(coalesce(sum(weight), 0), 1) AS total_weight, round(coalesce(sum(reinforcement), 0), 1) AS total_reinforcement, coalesce(max(weight), 0) AS max_weight FROM v_pairs"))
def cooccurrence_totals(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.totals(t.pair_state(spark, d))


_NV = "SELECT note_path, list(m / 1 ORDER BY i) AS c FROM (SELECT note_path, i, avg(vec[i]) AS m FROM v_vectors, range(1, 65) r(i) GROUP BY 1, 2) GROUP BY 1"
_SIM = {
    "nv": _NV,
    "cos": "SELECT a.note_path AS a, b.note_path AS b, greatest(0, least(1, list_dot_product(a.c, b.c) / ((sqrt(list_dot_product(a.c, a.c)) + 1e-10) * (sqrt(list_dot_product(b.c, b.c)) + 1e-10)))) AS v FROM nv a JOIN nv b ON a.note_path < b.note_path",
    "cut": "SELECT avg(v) + 0.5::DOUBLE * stddev_pop(v) AS t FROM cos",
    "memb": _MEMB,
    "sh": "SELECT x.note_path AS a, y.note_path AS b, count(*) AS shared, list(x.entity) AS ents FROM memb x JOIN memb y ON x.entity = y.entity AND x.note_path < y.note_path WHERE x.note_path IN (SELECT note_path FROM nv) AND y.note_path IN (SELECT note_path FROM nv) GROUP BY 1, 2 HAVING count(*) >= 2",
    "lw": "SELECT a, b, sum(weight) AS w FROM (SELECT a, b, unnest(ents) AS entity_a, ents FROM sh) s JOIN v_pairs p USING (entity_a) WHERE list_contains(ents, p.entity_b) GROUP BY 1, 2",
    "co": "SELECT a, b, (shared + coalesce(w, 0)) / max(shared + coalesce(w, 0)) OVER () AS v FROM sh LEFT JOIN lw USING (a, b)",
    "sim": """SELECT a, b, sum(v) AS value FROM (
        SELECT a, b, 0.6::DOUBLE * v AS v FROM cos, cut WHERE v >= greatest(t, 1e-12)
        UNION ALL SELECT a, b, 0.25::DOUBLE * v FROM co
        UNION ALL SELECT DISTINCT least(source_path, target_path), greatest(source_path, target_path), 0.15::DOUBLE FROM v_edges WHERE source_path IN (SELECT note_path FROM nv) AND target_path IN (SELECT note_path FROM nv)
        UNION ALL SELECT a.note_path, b.note_path, 0.3::DOUBLE FROM nv a JOIN nv b ON string_split(a.note_path, '/')[1] = string_split(b.note_path, '/')[1] AND a.note_path < b.note_path
        ) GROUP BY 1, 2 HAVING sum(v) > 0""",
}


def _similarity(spark: SparkSession, d: str) -> community.Blend:
    return community.similarity(t.chunk_vectors(spark, d, True), t.triples(spark, d), t.pair_state(spark, d), t.note_edges(spark, d))


@query(sql("SELECT a, b, round(value, 6) AS value FROM sim", **_SIM))
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The blended similarity of notes, each pair once."""
    return _similarity(spark, d).pairs().select("a", "b", F.round("value", 6).alias("value"))


@query(sql("SELECT a, b, round(value, 6) AS value, nth FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(value, 9) DESC, b) AS nth FROM (SELECT a, b, value FROM sim UNION ALL SELECT b, a, value FROM sim)) WHERE nth <= 20", **_SIM))
def row_topk(spark: SparkSession, d: str) -> DataFrame:
    return _similarity(spark, d).row_topk(20).select("a", "b", F.round("value", 6).alias("value"), "nth")


@query()
def attractor_communities(spark: SparkSession, d: str) -> DataFrame:
    members, _ = community.detect(t.chunk_vectors(spark, d, True), t.triples(spark, d), t.pair_state(spark, d), t.note_edges(spark, d))
    return members


@query()
def community_stats(spark: SparkSession, d: str) -> DataFrame:
    _, stats = community.detect(t.chunk_vectors(spark, d, True), t.triples(spark, d), t.pair_state(spark, d), t.note_edges(spark, d))
    return stats.select("level", "n_communities", "min_size", "max_size", F.round("mean_size", 6).alias("mean_size"), F.round("modularity", 6).alias("modularity"))


_FOLDERS = "SELECT note_path, string_split(note_path, '/')[1] AS community FROM nv"


@query(
    sql(
        """SELECT round(sum((coalesce(i, 0) - s * s / m) / m), 9) AS modularity FROM (SELECT ca, sum(value) AS s, sum(CASE WHEN ca = cb THEN value END) AS i FROM ends GROUP BY 1) CROSS JOIN (SELECT sum(value) AS m FROM w2)""",
        **_SIM,
        fol=_FOLDERS,
        w2="SELECT a, b, value FROM sim UNION ALL SELECT b, a, value FROM sim",
        ends="SELECT w2.*, x.community AS ca, y.community AS cb FROM w2 JOIN fol x ON x.note_path = a JOIN fol y ON y.note_path = b",
    )
)
def modularity(spark: SparkSession, d: str) -> DataFrame:
    """Modularity of the partition by top folder."""
    s = _similarity(spark, d)
    q = s.modularity(s.folder)[0]
    return spark.createDataFrame([(round(q, 9),)], "modularity double")


@query(sql("SELECT count(*) AS n_communities, min(n) AS min_size, max(n) AS max_size, avg(n) AS mean_size FROM (SELECT string_split(path, '/')[1] AS c, count(*) AS n FROM v_notes GROUP BY 1)"))
def size_stats(spark: SparkSession, d: str) -> DataFrame:
    return community.size_stats(t.notes(spark, d).select(F.element_at(F.split("path", "/"), 1).alias("community")))


@query(sql("SELECT n_notes, changed, changed / n_notes::DOUBLE AS drift, 14 AS age_days, true AS stale FROM (SELECT count(*) AS n_notes, count(*) FILTER (WHERE updated_at > TIMESTAMP '2026-03-01') AS changed FROM v_notes)"))
def community_staleness(spark: SparkSession, d: str) -> DataFrame:
    at = F.struct(F.lit("2026-03-01").cast("timestamp_ntz").alias("built"), F.lit("2026-03-15").cast("timestamp_ntz").alias("now"))
    return community.build_status(t.notes(spark, d), at)
