"""Link-graph analytics over edge tables (source_path, target_path)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lectern.functions.text import wiki_links
from lectern.session import materialize, observed


def link_index(paths: DataFrame) -> DataFrame:
    """key, path, exact: lower-case path with and without .md (on a clash the last path), lower-case stem (on a clash the first)."""
    low = F.lower("path")
    bare = F.regexp_replace(low, r"\.md$", "")
    stem = F.regexp_extract(bare, r"([^/]+)$", 1)
    exact = paths.select(low.alias("key"), "path").union(paths.select(bare.alias("key"), "path")).groupBy("key").agg(F.max("path").alias("path"))
    stems = paths.select(stem.alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"))
    return exact.withColumn("exact", F.lit(True)).unionByName(stems.withColumn("exact", F.lit(False)))


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """source_path, link_text, target_path: exact path first, else stem; links to nothing and to the note itself are left out."""
    index = link_index(paths)
    key = links.withColumn("key", F.lower(F.trim("link_text")))
    exact = index.where("exact").select("key", F.col("path").alias("p1"))
    stem = index.where("NOT exact").select("key", F.col("path").alias("p2"))
    found = key.join(exact, "key", "left").withColumn("leaf", F.regexp_extract("key", r"([^/]+?)(?:\.md)?$", 1)).join(stem.withColumnRenamed("key", "leaf"), "leaf", "left")
    found = found.withColumn("target_path", F.coalesce("p1", "p2")).where("target_path IS NOT NULL AND target_path <> source_path")
    return found.groupBy("source_path", "target_path").agg(F.min("link_text").alias("link_text"))


def build_edges(files: DataFrame) -> DataFrame:
    """Edges of files (path, text), from their whole text."""
    links = files.where("text IS NOT NULL").select(F.col("path").alias("source_path"), F.explode(wiki_links(F.col("text"))).alias("link_text"))
    return resolve_links(links, files.select("path").distinct())


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """path, in_degree, out_degree."""
    i = edges.groupBy(F.col("target_path").alias("path")).agg(F.count(F.lit(1)).alias("in_degree"))
    o = edges.groupBy(F.col("source_path").alias("path")).agg(F.count(F.lit(1)).alias("out_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("path").join(i, "path", "left").join(o, "path", "left").select("path", zero("in_degree"), zero("out_degree"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, iterations: int = 20, cut: int = 5) -> DataFrame:
    """path, pagerank after exactly `iterations` rounds from a uniform start; what dangling notes hold isn't redistributed. Lineage is cut every `cut` rounds."""
    paths = materialize(nodes.select("path").distinct(), "nodes")
    n = paths.count()
    known = edges.select("source_path", "target_path").distinct().join(paths.select(F.col("path").alias("source_path")), "source_path", "left_semi").join(paths.select(F.col("path").alias("target_path")), "target_path", "left_semi")
    out = known.groupBy("source_path").agg(F.count(F.lit(1)).alias("out"))
    links = materialize(known.join(out, "source_path").select(F.col("source_path").alias("path"), "target_path", (1 / F.col("out")).alias("share")), "links")
    ranks = paths.withColumn("pagerank", F.lit(1.0 / max(n, 1)))
    for i in range(iterations):
        got = links.join(ranks, "path").groupBy(F.col("target_path").alias("path")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        ranks = paths.join(got, "path", "left").select("path", ((1 - damping) / max(n, 1) + damping * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        if (i + 1) % cut == 0 and i + 1 < iterations:
            ranks = materialize(ranks, "ranks")
    return ranks


def undirected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b in both orders, among known notes, without loops and repetition."""
    known = nodes.select(F.col("path").alias("a")).distinct()
    both = edges.select(F.col("source_path").alias("a"), F.col("target_path").alias("b")).union(edges.select("target_path", "source_path")).where("a <> b").distinct()
    return both.join(known, "a", "left_semi").join(known.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def neighbourhood(adjacency: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """start, path, hops: breadth-first, up to `depth` hops, many starts at once. starts: start."""
    adjacency = materialize(adjacency.select("a", "b"), "adjacency") if depth > 1 else adjacency
    seen = starts.select("start", F.col("start").alias("path"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        nxt = frontier.join(adjacency.withColumnRenamed("a", "path"), "path").select("start", F.col("b").alias("path")).distinct()
        frontier = nxt.join(seen, ["start", "path"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
        if hop < depth:
            seen = materialize(seen, "seen")
            frontier = seen.where(F.col("hops") == hop)
    return seen


def structural_gaps(adjacency: DataFrame, top_k: int | None = 10, min_shared: int = 2) -> DataFrame:
    """a < b, shared, score: unlinked pairs by the sum of 1 / ln(degree) over common neighbours.

    A note of fewer than min_shared neighbours can't be part of a wanted pair and emits none.
    """
    deg = adjacency.groupBy("a").agg(F.count(F.lit(1)).alias("deg"))
    wide = deg.where(F.col("deg") >= min_shared).select("a")
    hubs = adjacency.join(wide.withColumnRenamed("a", "b"), "b", "left_semi").join(deg.where("deg >= 2"), "a").select(F.col("a").alias("hub"), F.col("b").alias("x"), (1 / F.log("deg")).alias("w"))
    pairs = hubs.join(hubs.select("hub", F.col("x").alias("y")), "hub").where("x < y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("shared"), F.sum("w").alias("score")).where(F.col("shared") >= min_shared)
    gaps = pairs.join(adjacency.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").select(F.col("x").alias("a"), F.col("y").alias("b"), "shared", "score")
    return gaps if top_k is None else gaps.orderBy(F.round("score", 9).desc(), F.desc("shared"), "a", "b").limit(top_k)


def components(nodes: DataFrame, adjacency: DataFrame, max_rounds: int = 60) -> DataFrame:
    """path, component (its smallest path): labels spread over links and jump along labels until none moves."""
    adjacency = materialize(adjacency.select("a", "b"), "adjacency")
    labels = materialize(nodes.select("path", F.col("path").alias("component")).distinct(), "labels")
    for _ in range(max_rounds):
        got = adjacency.join(labels.select(F.col("path").alias("b"), "component"), "b").groupBy(F.col("a").alias("path")).agg(F.min("component").alias("got"))
        hop = labels.join(got, "path", "left").select("path", F.col("component").alias("old"), F.least("component", F.coalesce("got", "component")).alias("component"))
        jump = labels.select(F.col("path").alias("component"), F.col("component").alias("top"))
        moved = Observation()  # counted while the labels are written
        new = hop.join(jump, "component", "left").select("path", "old", F.coalesce("top", "component").alias("component"))
        labels = materialize(new.observe(moved, F.count_if(F.col("old") != F.col("component")).alias("n")).select("path", "component"), "labels")
        if not observed(moved).get("n", 0 if labels.isEmpty() else 1):
            return labels
    raise RuntimeError(f"components still change after {max_rounds} rounds")


def _brandes(start: np.ndarray, near: np.ndarray, source: int) -> np.ndarray:
    """Dependencies of one source on every other note, level by level. The neighbours of note v are near[start[v] : start[v + 1]]."""
    n = len(start) - 1
    reached, paths, front, steps = np.zeros(n, dtype=bool), np.zeros(n), np.array([source]), []
    reached[source], paths[source] = True, 1.0
    while True:
        count = start[front + 1] - start[front]
        v = np.repeat(front, count)
        w = near[np.repeat(start[front] - np.cumsum(count) + count, count) + np.arange(len(v))]
        new = ~reached[w]
        v, w = v[new], w[new]
        if not len(w):
            break
        got = np.bincount(w, paths[v], minlength=n)
        front = np.flatnonzero(got)
        paths[front], reached[front] = got[front], True
        steps.append((v, w))
    share = np.zeros(n)
    for v, w in reversed(steps):
        share += np.bincount(v, paths[v] / paths[w] * (1 + share[w]), minlength=n)
    share[source] = 0.0
    return share


def betweenness(nodes: DataFrame, adjacency: DataFrame, max_broadcast_edges: int = 2_000_000) -> DataFrame:
    """path, betweenness (each unordered pair once).

    Sources are independent: the adjacency is broadcast if its counted size is within the
    bound, and each task walks from its sources. Larger graphs go by level over joins.
    """
    spark = nodes.sparkSession
    adjacency = materialize(adjacency, "adjacency")
    if adjacency.count() > max_broadcast_edges:
        return _betweenness_joins(nodes, adjacency)
    got = adjacency.select("a", "b").toArrow()
    names = pc.unique(got["a"])  # every link is there in both orders
    a, b = (pc.index_in(got[c], value_set=names).to_numpy().astype(np.int64) for c in ("a", "b"))
    order = np.lexsort((b, a))
    shared = spark.sparkContext.broadcast((names.to_pylist(), np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(names)))]), b[order]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, start, near = shared.value
        total = np.zeros(len(names))
        for batch in batches:
            for s in batch["id"]:
                total += _brandes(start, near, s)
        some = np.flatnonzero(total)
        if len(some):
            yield pd.DataFrame({"path": [names[v] for v in some], "part": total[some]})

    sources = spark.range(0, len(names), 1, 4 * spark.sparkContext.defaultParallelism)
    part = sources.mapInPandas(run, "path string, part double").groupBy("path").agg((F.sum("part") / 2).alias("betweenness"))
    return nodes.select("path").distinct().join(part, "path", "left").select("path", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def _betweenness_joins(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """The same by breadth-first levels of all sources over joins, then dependencies back from the deepest level."""
    seen = materialize(adjacency.select(F.col("a").alias("s"), F.col("a").alias("v"), F.lit(0).alias("level"), F.lit(1.0).alias("paths")).distinct(), "seen")
    depth = 0
    while True:
        front = seen.where(F.col("level") == depth)
        step = front.join(adjacency.withColumnRenamed("a", "v"), "v").groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        new = materialize(step.join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(depth + 1).alias("level"), "paths"), "level")
        if new.limit(1).count() == 0:
            break
        seen = materialize(seen.unionByName(new), "seen")
        depth += 1
    share = seen.where(F.col("level") == depth).select("s", "v", "paths", F.lit(0.0).alias("share"))
    total = share
    for level in range(depth, 0, -1):
        up = seen.where(F.col("level") == level - 1)
        back = share.join(adjacency.withColumnRenamed("a", "v"), "v").select("s", F.col("b").alias("v"), (1 / F.col("paths") * (1 + F.col("share"))).alias("part"))
        got = back.groupBy("s", "v").agg(F.sum("part").alias("part"))
        share = materialize(up.join(got, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("part", F.lit(0.0))).alias("share")), "share")
        total = total.unionByName(share)
    part = total.where("s <> v").groupBy(F.col("v").alias("path")).agg((F.sum("share") / 2).alias("betweenness"))
    return nodes.select("path").distinct().join(part, "path", "left").select("path", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def articulation(nodes: DataFrame, adjacency: DataFrame, candidates: DataFrame, max_candidates: int = 1000) -> DataFrame:
    """path, fragments: components left when the candidate (column path) is removed, for all candidates at once.

    Labels carry the removed note, so all removals spread in one loop. Every removal is a graph of its own, so the
    candidates are a short list: more than max_candidates are refused, and the list is broadcast.
    """
    cands = materialize(candidates.select(F.col("path").alias("gone")).distinct(), "candidates")
    if cands.count() > max_candidates:
        raise ValueError(f"more than {max_candidates} candidates: each needs the components of a whole graph")
    cands = F.broadcast(cands)
    space = nodes.select("path").distinct().join(cands, F.col("gone") != F.col("path"))
    ids = space.select(F.concat_ws("\u0001", "gone", "path").alias("path"))
    adj = adjacency.join(cands, (F.col("gone") != F.col("a")) & (F.col("gone") != F.col("b")))
    key = lambda c: F.concat_ws("\u0001", "gone", c)
    labels = components(ids, materialize(adj.select(key("a").alias("a"), key("b").alias("b")), "removed"))
    return labels.select(F.split_part("path", F.lit("\u0001"), F.lit(1)).alias("path"), "component").groupBy("path").agg(F.countDistinct("component").alias("fragments"))
