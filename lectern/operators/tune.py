"""Merging of result tiers, ablation and weight tuning over the hybrid ranker."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import EPS
from lectern.operators import quality, rank
from lectern.session import materialize

# The grids of the tunable weights, in the order in which they are tried.
GRIDS = {
    "convergence": (0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0),
    "inhibition_strength": (0.0, 0.15, 0.3, 0.45),
    "inhibition_threshold": (0.55, 0.65, 0.75, 0.85, 0.95),
    "hotness": (0.0, 0.1, 0.2, 0.3, 0.4),
    "cooccurrence": (0.0, 0.05, 0.1, 0.2),
    "link_penalty": (0.3, 0.5, 0.7, 1.0),
}


def normalize(scored: DataFrame) -> DataFrame:
    """query_id, note_path, score: each note's best score over its query's best; negatives become 0, and all do if the best isn't positive."""
    best = scored.groupBy("query_id", "note_path").agg(F.max("score").alias("s"))
    top = F.max("s").over(Window.partitionBy("query_id"))
    return best.withColumn("top", top).select("query_id", "note_path", F.when(F.col("top") > 0, F.greatest(F.lit(0.0), F.col("s") / F.col("top"))).otherwise(0.0).alias("score"))


def merge_tiers(facts: DataFrame, chunks: DataFrame, chunk_weight: float = 0.5, top_k: int = 5) -> DataFrame:
    """Full outer sum of two normalised score tables; the top_k notes of each query, ties by path."""
    both = facts.withColumnRenamed("score", "f").join(chunks.withColumnRenamed("score", "c"), ["query_id", "note_path"], "full")
    s = both.select("query_id", "note_path", (F.coalesce("f", F.lit(0.0)) + chunk_weight * F.coalesce("c", F.lit(0.0))).alias("score"))
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "note_path"))
    return s.withColumn("nth", nth).where(F.col("nth") <= top_k).drop("nth")


def route(facts: DataFrame, least_notes: int = 2, confidence: float = 0.4) -> DataFrame:
    """query_id, use_facts: whether a query's facts cover enough notes with enough confidence. facts: query_id, note_path, score."""
    g = facts.groupBy("query_id").agg(F.countDistinct("note_path").alias("n"), F.max("score").alias("best"))
    return g.select("query_id", ((F.col("n") >= least_notes) & (F.col("best") > confidence)).alias("use_facts"))


def tiered(scored: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """The tiers of all queries merged: facts by keywords, chunks by their base scores."""
    from lectern.operators import bm25
    from lectern.sources import tables as t

    tr = t.triples(spark, d)
    hits = bm25.bm25(tr, "triple_id", "triple_text", t.questions(spark, d).select("query_id", "text"), 30)
    facts = hits.join(tr.select(F.col("triple_id").alias("doc"), "note_path"), "doc").select("query_id", "note_path", (1 / (1 + F.abs("rank"))).alias("score"))
    return merge_tiers(normalize(facts), normalize(scored)).select("query_id", "note_path", F.round("score", 6).alias("score"))


def _prepared(spark: SparkSession, d: str):
    """Candidates, queries, evidence and labels, written once for the many runs over them."""
    from lectern.plans import evaluation, retrieval
    from lectern.sources import tables as t

    q = t.questions(spark, d).select("query_id", "text")
    e = retrieval.evidence(spark, d)
    # Entity hits don't depend on the weights.
    return materialize(retrieval.candidates(spark, d), "candidates"), q, replace(e, direct=materialize(e.direct, "direct"), near=materialize(e.near, "near"), pairs=materialize(e.pairs, "pairs")), materialize(evaluation.labels(spark, d), "labels")


def _scores(c, q, e, w, labels) -> DataFrame:
    return quality.metrics(rank.hybrid(c, q, e, w).select("query_id", F.col("note_path").alias("path"), "place"), labels)


def ablation(spark: SparkSession, d: str, signals: tuple[str, ...] = rank.SIGNALS) -> DataFrame:
    """config, recall, mrr, ndcg, ndcg_loss: the full ranker and one run without each signal, all in one plan."""
    c, q, e, labels = _prepared(spark, d)
    runs = None
    for name in ("full", *signals):
        m = _scores(c, q, replace(e, ablate=frozenset() if name == "full" else frozenset({name})), rank.Weights(), labels).withColumn("config", F.lit(name))
        runs = m if runs is None else runs.unionByName(m)
    mean = runs.groupBy("config").agg(*[F.avg(x).alias(x) for x in ("recall", "mrr", "ndcg")])
    full = mean.where("config = 'full'").select(F.col("ndcg").alias("full_ndcg"))
    return mean.crossJoin(F.broadcast(full)).select("config", *[F.round(x, 6).alias(x) for x in ("recall", "mrr", "ndcg")], F.round(F.col("full_ndcg") - F.col("ndcg"), 6).alias("ndcg_loss"))


SIGNALS = ("score", "value", "boost", "hotness", "raw", "top", "n")  # columns 1 to 7 of a packed candidate; the note's number is column 0, flags of links follow


def packed(c: DataFrame, q: DataFrame, e: rank.Evidence, labels: DataFrame, fold: DataFrame, densities: tuple[float, ...]) -> DataFrame:
    """One row for each labelled query: what its candidates' scores are made of, as arrays, so that any weights can be tried without another plan.

    query_id, train, held, n (targets), rows (candidates in their order, doubles), near (their cosines to each other), hits (candidates times targets).
    """
    folds = fold.groupBy("query_id").agg(F.max(F.col("fold") == 0).alias("train"), F.max(F.col("fold") == 1).alias("held"))
    want = labels.select("query_id", "target").distinct().groupBy("query_id").agg(F.collect_list("target").alias("targets")).join(folds, "query_id")
    s = rank.signals(c, q, e, densities).join(want.select("query_id", "targets"), "query_id")
    hits = F.transform("targets", lambda x: F.coalesce(quality.matches(F.col("note_path"), x), F.lit(False)).cast("double"))
    signals = F.array(*[F.coalesce(F.col(x).cast("double"), F.lit(float("nan"))) for x in SIGNALS])
    one = F.struct("pos", "note_path", F.col("score").isNull().alias("none"), "vec", F.concat(signals, F.transform("links", lambda x: x.cast("double"))).alias("signals"), hits.alias("hits"))
    every = want.select("query_id", "train", "held", F.size("targets").alias("n")).join(s.groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("rows")), "query_id", "left")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.column("rows"):
                if not r.is_valid or not len(r.values):
                    out.append((b"", b"", b""))
                    continue
                own = r.values
                table = lambda x, own=own: own.field(x).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                v, notes = table("vec"), own.field("note_path").to_pylist()
                numbers = {p: i for i, p in enumerate(dict.fromkeys(notes))}
                dot, square = np.zeros((len(v), len(v))), np.zeros(len(v))
                for x in v.T:  # added up in the order of rank's expressions
                    dot, square = dot + x[:, None] * x[None, :], square + x * x
                near = dot / (np.sqrt(square)[:, None] * np.sqrt(square)[None, :] + EPS)
                rows = np.column_stack([[numbers[p] for p in notes], table("signals")])
                rows[np.asarray(own.field("none").to_pylist(), dtype=bool), 1] = -np.inf
                out.append((rows.tobytes(), near.tobytes(), table("hits").tobytes()))
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("query_id", "train", "held", "n")), *(pa.array(x, pa.binary()) for x in zip(*out))], names=["query_id", "train", "held", "n", "rows", "near", "hits"])

    return every.mapInArrow(pack, "query_id long, train boolean, held boolean, n int, rows binary, near binary, hits binary")


def _keys(s: np.ndarray) -> np.ndarray:
    """Sorts as by_score does: scores to nine places, the greatest (NaN before all) first, missing ones last."""
    return np.where(np.isnan(s), -np.inf, -np.round(s, 9))


def ndcg(rows: np.ndarray, near: np.ndarray, hits: np.ndarray, real: np.ndarray, n: np.ndarray, w: rank.Weights, density: int, top_k: int = 5) -> np.ndarray:
    """What rank.hybrid and quality.metrics give, for packed queries (first axis) whose candidates (second) are padded; real: not padding."""
    score, value, boost, hot, raw, top, errors = (rows[:, :, i] for i in range(1, 8))
    at = np.arange(len(rows))[:, None]
    none = score == -np.inf
    with np.errstate(all="ignore"):
        s = np.where(rows[:, :, 8 + density] > 0, score * w.link_penalty, score)
        s = np.where(np.isnan(value), s, (1 - w.convergence) * s + w.convergence * value) * boost
        s = np.where(hot > 0, (1 - w.hotness) * s + w.hotness * hot, s)
        if w.cooccurrence > 0:
            s = np.where(np.isnan(raw), s, s * (1 + w.cooccurrence * raw / (raw + top)))
        s = np.where(none, -np.inf, s / (1 + 0.1 * errors))
        order = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), _keys(s), ~real), axis=1)
        place = np.argsort(order, axis=1)
        note = rows[:, :, 0].astype(np.int64)
        first = np.full(s.shape, s.shape[1])
        np.minimum.at(first, (np.broadcast_to(at, note.shape)[real], note[real]), place[real])
        best = real & (place == first[at, note])
        pool = np.argsort(np.where(best, place, s.shape[1]), axis=1, kind="stable")[:, : 3 * top_k]
        there, s = best[at, pool], s[at, pool]
        higher = np.tril(np.ones((pool.shape[1], pool.shape[1]), dtype=bool), -1)[None] & there[:, None, :]
        most = np.where(higher, near[at[:, :, None], pool[:, :, None], pool[:, None, :]], -np.inf).max(axis=2, initial=-np.inf)
        s = np.where(s == -np.inf, s, s * np.where(most > w.inhibition_threshold, 1 - w.inhibition_strength * most, 1.0))
        final = np.lexsort((np.broadcast_to(np.arange(s.shape[1]), s.shape), _keys(s), ~there), axis=1)[:, :top_k]
    shown = hits[at, pool[at, final]] & there[at, final][:, :, None]
    gains = 1 / np.log2(np.arange(top_k) + 2)
    dcg = np.where(shown.any(axis=1), gains[shown.argmax(axis=1)] if shown.shape[1] else 0.0, 0.0).sum(axis=1)
    return dcg / np.cumsum(gains)[np.minimum(n, top_k) - 1]


def mean_ndcg(p: DataFrame, ws: list[rank.Weights], densities: tuple[float, ...], part: str) -> list[float]:
    """Mean NDCG of the packed queries of one part (train, held) for each set of weights, 0 without queries."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 256):
                x = b.slice(lo, 256)
                n = x.column("n").to_numpy()
                flat = {c: [np.frombuffer(v) for v in x.column(c).to_pylist()] for c in ("rows", "near", "hits")}
                size = np.array([len(v) // (8 + len(densities)) for v in flat["rows"]])
                most = max(1, size.max(initial=0))
                rows, near, hits = np.zeros((len(x), most, 8 + len(densities))), np.zeros((len(x), most, most)), np.zeros((len(x), most, n.max(initial=1)), dtype=bool)
                for i, k in enumerate(size):
                    rows[i, :k], near[i, :k, :k], hits[i, :k, : n[i]] = flat["rows"][i].reshape(k, -1) if k else 0, flat["near"][i].reshape(k, k), flat["hits"][i].reshape(k, n[i])
                real = np.arange(most)[None, :] < size[:, None]
                sums = [float(ndcg(rows, near, hits, real, n, w, densities.index(w.link_density)).sum()) for w in ws]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(ws)), pa.int32()), pa.array(sums), pa.array([len(x)] * len(ws), pa.int64())], names=["i", "s", "m"])

    got = p.where(part).mapInArrow(score, "i int, s double, m long").groupBy("i").agg((F.sum("s") / F.sum("m")).alias("s")).collect()  # one row per grid value
    by = {r["i"]: r["s"] for r in got}
    return [by.get(i, 0.0) for i in range(len(ws))]


def coordinate_ascent(spark: SparkSession, d: str, rounds: int = 4, grids: dict[str, tuple[float, ...]] | None = None, epsilon: float = 1e-6) -> DataFrame:
    """parameter, initial, tuned, train_ndcg, holdout_ndcg. The ranker's look-ups are planned once; all values of a parameter are scored in one job over them; a step must gain over epsilon."""
    grids = grids or GRIDS
    c, q, e, labels = _prepared(spark, d)
    start = w = rank.Weights()
    densities = tuple(sorted({start.link_density, *grids.get("link_density", ())}))
    p = materialize(packed(c, q, e, labels, quality.interleaved(q.select("query_id")), densities), "packed")
    best = mean_ndcg(p, [w], densities, "train")[0]
    for _ in range(rounds):
        before = best
        for name, grid in grids.items():
            tried = [replace(w, **{name: v}) for v in grid]
            got = mean_ndcg(p, tried, densities, "train")
            i = max(range(len(got)), key=got.__getitem__)
            if got[i] > best + epsilon:
                w, best = tried[i], got[i]
        if best - before <= epsilon:
            break
    final = mean_ndcg(p, [w], densities, "held")[0]
    return spark.createDataFrame([(n, getattr(start, n), getattr(w, n), round(best, 6), round(final, 6)) for n in grids], "parameter string, initial double, tuned double, train_ndcg double, holdout_ndcg double")
