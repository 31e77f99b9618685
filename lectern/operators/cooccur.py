"""Entity association: structural weights from facts, learned reinforcement from use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED, GROWTH, CAP = 1.0, 1.1, 100.0


def members(triples: DataFrame) -> DataFrame:
    """note_path, entity: the distinct entities of each note."""
    return triples.select("note_path", F.col("subject").alias("entity")).union(triples.select("note_path", F.col("object"))).distinct()


def pair_weights(triples: DataFrame) -> DataFrame:
    """entity_a < entity_b, weight: the number of notes with both."""
    m = members(triples)
    a, b = m.withColumnRenamed("entity", "entity_a"), m.withColumnRenamed("entity", "entity_b")
    return a.join(b, "note_path").where("entity_a < entity_b").groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def rebuild(state: DataFrame, triples: DataFrame) -> DataFrame:
    """State after a structural rebuild: weights replaced, reinforcement kept, rows with neither dropped."""
    new = pair_weights(triples)
    old = state.select("entity_a", "entity_b", "reinforcement")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return old.join(new, ["entity_a", "entity_b"], "full").select("entity_a", "entity_b", zero("weight"), zero("reinforcement")).where("weight > 0 OR reinforcement > 0")


def upsert_notes(state: DataFrame, triples: DataFrame, notes: DataFrame) -> DataFrame:
    """State after the facts of some notes (column note_path) changed: only pairs that touch an entity of theirs are counted again."""
    touched = members(triples).join(notes, "note_path", "left_semi").select("entity").distinct()
    hit_a = state.join(touched.withColumnRenamed("entity", "entity_a"), "entity_a", "left_semi")
    hit_b = state.join(touched.withColumnRenamed("entity", "entity_b"), "entity_b", "left_semi")
    stale = hit_a.unionByName(hit_b).select("entity_a", "entity_b", "reinforcement").distinct()
    m = members(triples)
    mine = m.join(touched, "entity", "left_semi").withColumnRenamed("entity", "x")
    fresh = mine.join(m.withColumnRenamed("entity", "y"), "note_path").where("x <> y").select(F.least("x", "y").alias("entity_a"), F.greatest("x", "y").alias("entity_b"), "note_path").distinct().groupBy("entity_a", "entity_b").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    again = stale.join(fresh, ["entity_a", "entity_b"], "full").select("entity_a", "entity_b", zero("weight"), zero("reinforcement"))
    rest = state.join(stale, ["entity_a", "entity_b"], "left_anti").select("entity_a", "entity_b", "weight", "reinforcement")
    return rest.unionByName(again).where("weight > 0 OR reinforcement > 0")


def reinforce(state: DataFrame, used: DataFrame) -> DataFrame:
    """State after pairs (entity_a, entity_b, any order) were used together: an unseen pair starts at 1, others grow by a tenth up to 100."""
    pairs = used.where("entity_a <> entity_b").select(F.least("entity_a", "entity_b").alias("entity_a"), F.greatest("entity_a", "entity_b").alias("entity_b"), F.lit(True).alias("hit")).distinct()
    j = state.join(pairs, ["entity_a", "entity_b"], "full")
    grown = F.when(F.coalesce("reinforcement", F.lit(0.0)) > 0, F.least(F.col("reinforcement") * GROWTH, F.lit(CAP))).otherwise(SEED)
    return j.select("entity_a", "entity_b", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.when(F.col("hit"), grown).otherwise(F.col("reinforcement")).alias("reinforcement"))


def top_pairs(state: DataFrame, limit: int = 20) -> DataFrame:
    total = F.col("weight") + F.col("reinforcement")
    return state.select("entity_a", "entity_b", "weight", "reinforcement", total.alias("total")).orderBy(F.round("total", 9).desc(), "entity_a", "entity_b").limit(limit)


def totals(state: DataFrame) -> DataFrame:
    """One row: pairs, reinforced pairs, summed and greatest weights."""
    return state.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.coalesce(F.sum(F.when(F.col("reinforcement") > 0, 1).otherwise(0)), F.lit(0)).alias("reinforced"),
        F.round(F.coalesce(F.sum("weight"), F.lit(0.0)), 1).alias("total_weight"),
        F.round(F.coalesce(F.sum("reinforcement"), F.lit(0.0)), 1).alias("total_reinforcement"),
        F.coalesce(F.max("weight"), F.lit(0.0)).alias("max_weight"),
    )
