"""The hybrid ranker: each stage adds to a table of candidates that carries query_id, so any number of queries run in one plan.

Candidates: query_id, chunk_id, note_path, heading_path, content, vec, rank, pos, qvec.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import is_link_section
from lectern.functions.vectors import cosine, mean_vector

SIGNALS = ("link_section", "convergence", "context", "hotness", "cooccurrence", "prediction_error", "lateral_inhibition")


@dataclass(frozen=True)
class Weights:
    convergence: float = 0.3
    hotness: float = 0.2
    inhibition_threshold: float = 0.65
    inhibition_strength: float = 0.30
    cooccurrence: float = 0.1
    link_penalty: float = 0.5
    link_density: float = 0.5


@dataclass(frozen=True)
class Evidence:
    """What the stages look up; a stage without its table leaves scores alone."""

    vectors: DataFrame | None = None  # chunk_id, note_path, vec
    usage: DataFrame | None = None  # note_path, used_at
    as_of: str = ""
    triples: DataFrame | None = None  # note_path, subject, object
    pairs: DataFrame | None = None  # entity_a, entity_b, weight, reinforcement
    errors: DataFrame | None = None  # note_path, unresolved only
    direct: DataFrame | None = None  # note_path in the context
    near: DataFrame | None = None  # note_path one link away
    ablate: frozenset[str] = field(default_factory=frozenset)


def base_scores(candidates: DataFrame) -> DataFrame:
    """0.3 keyword score + 0.7 cosine. The keyword score 1 / (1 + |rank|) falls as the match gets better; that is the defined behaviour."""
    cos = cosine(F.col("qvec"), F.col("vec"))
    return candidates.withColumn("cosine", cos).withColumn("score", 0.3 / (1 + F.abs("rank")) + 0.7 * F.col("cosine"))


def link_stage(c: DataFrame, w: Weights) -> DataFrame:
    return c.withColumn("score", F.when(is_link_section(F.col("heading_path"), F.col("content"), w.link_density), F.col("score") * w.link_penalty).otherwise(F.col("score")))


def with_value(c: DataFrame, vectors: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Adds value: the cosine to the note's centroid over 1 + the spread of its chunks' cosines; null for single-chunk notes.

    keys: a cheaper table with the candidates' query_id, note_path and qvec, so that earlier stages aren't planned twice.
    """
    asked = (c if keys is None else keys).select("query_id", "note_path", "qvec").dropDuplicates(["query_id", "note_path"])
    vectors = vectors.join(asked.select("note_path").distinct(), "note_path", "left_semi")  # only notes that are candidates
    pairs = asked.join(vectors.select("note_path", "vec"), "note_path")
    centroids = vectors.groupBy("note_path").agg(mean_vector(F.col("vec")).alias("centroid"), F.count(F.lit(1)).alias("chunks")).where("chunks >= 2")
    spread = pairs.groupBy("query_id", "note_path").agg(F.stddev_pop(cosine(F.col("qvec"), F.col("vec"))).alias("sigma"))
    out = c.join(centroids, "note_path", "left").join(spread, ["query_id", "note_path"], "left")
    value = cosine(F.col("qvec"), F.col("centroid")) / (1 + F.col("sigma"))
    return out.withColumn("value", F.when(F.col("centroid").isNotNull(), value)).drop("centroid", "chunks", "sigma")


def convergence_stage(c: DataFrame, vectors: DataFrame, w: Weights, keys: DataFrame | None = None) -> DataFrame:
    """Blend with the note's value; notes without one stay. keys: as in with_value."""
    blended = F.when(F.col("value").isNotNull(), (1 - w.convergence) * F.col("score") + w.convergence * F.col("value")).otherwise(F.col("score"))
    return with_value(c, vectors, keys).withColumn("score", blended).drop("value")


def with_boost(c: DataFrame, direct: DataFrame, near: DataFrame) -> DataFrame:
    """Adds boost: 1.4 for notes in the context, 1.2 for those one link away, 1 for others."""
    boosts = direct.select("note_path", F.lit(1.4).alias("boost")).union(near.select("note_path", F.lit(1.2))).groupBy("note_path").agg(F.max("boost").alias("boost"))
    return c.join(boosts, "note_path", "left").withColumn("boost", F.coalesce("boost", F.lit(1.0)))


def context_stage(c: DataFrame, direct: DataFrame, near: DataFrame) -> DataFrame:
    return with_boost(c, direct, near).withColumn("score", F.col("score") * F.col("boost")).drop("boost")


def hotness(usage: DataFrame, as_of: Column, half_life_days: float = 30.0) -> DataFrame:
    """note_path, hotness = (1 + n) / (2 + n) * 2^(-age / half life), n uses, age in days since the last."""
    agg = usage.groupBy("note_path").agg(F.count(F.lit(1)).alias("uses"), F.max("used_at").alias("last_used"))
    age = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.col("last_used"), as_of) / F.lit(86_400_000_000.0))
    return agg.select("note_path", "uses", "last_used", ((1 + F.col("uses")) / (2 + F.col("uses")) * F.pow(F.lit(2.0), -age / half_life_days)).alias("hotness"))


def with_hotness(c: DataFrame, usage: DataFrame, as_of: Column) -> DataFrame:
    """Adds hotness, null for notes that weren't used."""
    return c.join(hotness(usage, as_of).select("note_path", "hotness"), "note_path", "left")


def hotness_stage(c: DataFrame, usage: DataFrame, as_of: Column, w: Weights) -> DataFrame:
    blended = F.when(F.col("hotness") > 0, (1 - w.hotness) * F.col("score") + w.hotness * F.col("hotness")).otherwise(F.col("score"))
    return with_hotness(c, usage, as_of).withColumn("score", blended).drop("hotness")


def query_entities(queries: DataFrame, triples: DataFrame) -> DataFrame:
    """query_id, entity: entities that contain a word of the query of three characters or more.

    The substring join is an equi-join: every word meets the entities that have its first
    three characters, found in an index of the entities' distinct trigrams, and is then verified.
    """
    word = F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\r\n]+"), lambda w: F.length(w) > 2)))
    words = queries.select("query_id", word.alias("word"))
    names = triples.select("subject").union(triples.select("object")).distinct().toDF("entity").where(F.length("entity") > 2)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("entity") - 2), lambda i: F.substring(F.col("entity"), i, F.lit(3))))
    index = names.select("entity", F.explode(grams).alias("gram"))
    once = words.select("word").distinct().withColumn("gram", F.substring("word", 1, 3))
    hits = once.join(index, "gram").where(F.contains("entity", "word")).select("word", "entity")
    return words.join(hits, "word").select("query_id", "entity").distinct()


def associated(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """query_id, entity, w: the strongest association of each entity that the query doesn't name itself."""
    strength = (F.col("weight") + F.col("reinforcement")).alias("w")
    both = pairs.select(F.col("entity_a").alias("entity"), F.col("entity_b").alias("other"), strength).unionByName(pairs.select(F.col("entity_b").alias("entity"), F.col("entity_a").alias("other"), strength))
    near = entities.join(both, "entity").groupBy("query_id", F.col("other").alias("entity")).agg(F.max("w").alias("w"))
    return near.join(entities, ["query_id", "entity"], "left_anti")


def with_association(c: DataFrame, queries: DataFrame, triples: DataFrame, pairs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Adds raw, the summed association of the note's entities, and top, the query's strongest; null without one. keys: as in with_value."""
    keys = c if keys is None else keys
    near = associated(query_entities(queries, triples), pairs)
    top = near.groupBy("query_id").agg(F.max("w").alias("top"))
    members = triples.select("note_path", F.col("subject").alias("entity")).union(triples.select("note_path", F.col("object"))).distinct()
    wanted = members.join(keys.select("note_path").distinct(), "note_path", "left_semi")
    raw = near.join(wanted, "entity").join(keys.select("query_id", "note_path").distinct(), ["query_id", "note_path"], "left_semi").groupBy("query_id", "note_path").agg(F.sum("w").alias("raw"))
    known = raw.join(top, "query_id").where("raw + top > 0").select("query_id", "note_path", "raw", "top")
    return c.join(known, ["query_id", "note_path"], "left")


def cooccurrence_stage(c: DataFrame, queries: DataFrame, triples: DataFrame, pairs: DataFrame, w: Weights, keys: DataFrame | None = None) -> DataFrame:
    """Multiply by 1 + w * raw / (raw + top). keys: as in with_value."""
    boost = 1 + w.cooccurrence * F.col("raw") / (F.col("raw") + F.col("top"))
    return with_association(c, queries, triples, pairs, keys).withColumn("score", F.col("score") * F.coalesce(boost, F.lit(1.0))).drop("raw", "top")


def with_errors(c: DataFrame, errors: DataFrame, least: int = 2) -> DataFrame:
    """Adds n, the note's errors, 0 if there are fewer than `least`."""
    counts = errors.groupBy("note_path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return c.join(counts, "note_path", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def error_stage(c: DataFrame, errors: DataFrame, least: int = 2) -> DataFrame:
    return with_errors(c, errors, least).withColumn("score", F.col("score") / (1 + 0.1 * F.col("n"))).drop("n")


def by_score(*more: Column):
    return [F.round("score", 9).desc(), *more]


def best_per_note(c: DataFrame, keep: int) -> DataFrame:
    """The best chunk of each note, then the best `keep` notes of each query; place is their order."""
    first = F.row_number().over(Window.partitionBy("query_id", "note_path").orderBy(*by_score(F.col("pos"))))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score(F.col("pos"))))
    return c.withColumn("nth", first).where("nth = 1").drop("nth").withColumn("place", place).where(F.col("place") <= keep)


def inhibition_stage(c: DataFrame, w: Weights) -> DataFrame:
    """Reduce results similar to a higher one. Depends on the order before only; the higher ones are at most 3k rows of the same query, so a frame holds them."""
    higher = F.collect_list("vec").over(Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    most = F.array_max(F.transform(F.col("higher"), lambda y: cosine(F.col("vec"), y)))
    penalty = F.when(F.col("most") > w.inhibition_threshold, 1 - w.inhibition_strength * F.col("most")).otherwise(1.0)
    return c.withColumn("higher", higher).withColumn("most", most).withColumn("score", F.col("score") * penalty).drop("most", "higher")


def hybrid(candidates: DataFrame, queries: DataFrame, e: Evidence, w: Weights = Weights(), top_k: int = 5) -> DataFrame:
    """query_id, chunk_id, note_path, score, place: all stages in order, those named in e.ablate skipped.

    The stages look candidates up more than once: give a table that is cheap to read again.
    """
    c = base_scores(candidates)
    on = lambda name, *needs: name not in e.ablate and all(x is not None for x in needs)
    as_of = F.lit(e.as_of).cast("timestamp_ntz") if e.as_of else None
    if on("link_section"):
        c = link_stage(c, w)
    if on("convergence", e.vectors):
        c = convergence_stage(c, e.vectors, w, candidates)
    if on("context", e.direct, e.near):
        c = context_stage(c, e.direct, e.near)
    if on("hotness", e.usage, as_of):
        c = hotness_stage(c, e.usage, as_of, w)
    if on("cooccurrence", e.triples, e.pairs) and w.cooccurrence > 0:
        c = cooccurrence_stage(c, queries, e.triples, e.pairs, w, candidates)
    if on("prediction_error", e.errors):
        c = error_stage(c, e.errors)
    c = best_per_note(c, 3 * top_k)
    if on("lateral_inhibition"):
        c = inhibition_stage(c, w)
    final = F.row_number().over(Window.partitionBy("query_id").orderBy(*by_score(F.col("place"))))
    return c.withColumn("final", final).where(F.col("final") <= top_k).select("query_id", "chunk_id", "note_path", "score", F.col("final").cast("long").alias("place"))


def signals(candidates: DataFrame, queries: DataFrame, e: Evidence, densities: tuple[float, ...]) -> DataFrame:
    """query_id, note_path, pos, vec and what the stages look up, before any weight: score (the base), links (a flag for each density), value, boost, hotness, raw, top, n."""
    c = base_scores(candidates).withColumn("links", F.array(*[is_link_section(F.col("heading_path"), F.col("content"), x) for x in densities]))
    c = with_value(c.drop("content", "heading_path"), e.vectors, candidates)
    c = with_hotness(with_boost(c, e.direct, e.near), e.usage, F.lit(e.as_of).cast("timestamp_ntz"))
    c = with_errors(with_association(c, queries, e.triples, e.pairs, candidates), e.errors)
    return c.select("query_id", "note_path", "pos", "vec", "score", "links", "value", "boost", "hotness", "raw", "top", "n")
