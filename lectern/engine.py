"""Queries by name with parameters, over a set of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.models import embed
from lectern.operators import assemble, bm25, community, cooccur, graph, memory, quality, rank, transcripts, tune
from lectern.operators.vectors import vector_topk
from lectern.plans.retrieval import related_notes
from lectern.session import materialize


class Engine:
    """tables: notes, chunks, vectors (chunk_id, note_path, vec), triples, edges, pairs, usage, errors, memories, messages, snapshots; those a query needs must be there."""

    _tools: dict[str, Callable] = {}

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], as_of: str, dim: int = 64, embedder=None):
        self.spark, self.tables, self.as_of, self.dim, self.embedder = spark, tables, as_of, dim, embedder

    def __getattr__(self, name: str) -> DataFrame:
        tables = self.__dict__.get("tables", {})
        if name in tables:
            return tables[name]
        raise AttributeError(f"no table {name}")

    @classmethod
    def tool(cls, f: Callable) -> Callable:
        cls._tools[f.__name__] = f
        return f

    @classmethod
    def names(cls) -> list[str]:
        return sorted(cls._tools)

    def query(self, name: str, **params) -> DataFrame:
        if name not in self._tools:
            raise KeyError(f"no query {name}; there are {', '.join(self.names())}")
        return self._tools[name](self, **params)

    @property
    def now(self):
        return F.lit(self.as_of).cast("timestamp_ntz")

    def asked(self, text: str) -> DataFrame:
        """One query as a table: query_id, text, qvec."""
        one = self.spark.createDataFrame([(0, text)], "query_id long, text string")
        return embed(one, "text", "qvec", self.embedder)

    def fact_vectors(self, facts: DataFrame) -> DataFrame:
        """chunk_id (the fact's number), vec of the facts that have a vector."""
        v = facts if "vec" in facts.columns else embed(facts, "triple_text", "vec", self.embedder)
        return v.where("vec IS NOT NULL").select(F.col("triple_id").alias("chunk_id"), "vec").dropDuplicates(["chunk_id"])

    def scope(self, df: DataFrame, workspace: str | None) -> DataFrame:
        """Rows whose note lies below the workspace, whatever the case."""
        ws = (workspace or "").strip("/").lower()
        return df.where(F.lower("note_path").startswith(ws + "/")) if ws else df


@Engine.tool
def search(e: Engine, text: str, top_k: int = 5, mode: str = "hybrid", workspace: str | None = None, ablate: tuple[str, ...] = ()) -> DataFrame:
    """Notes for a text. Keyword hits have score 0; without keyword hits the vectors decide."""
    q, chunks, vectors = e.asked(text), e.scope(e.chunks, workspace), e.scope(e.vectors, workspace)
    hits = bm25.bm25(e.chunks, "chunk_id", "content", q.select("query_id", "text"), None)
    pos = F.row_number().over(rank.Window.partitionBy("query_id").orderBy(F.round("rank", 9), "chunk_id"))
    inside = hits.withColumnRenamed("doc", "chunk_id").join(chunks.select("chunk_id", "note_path", "heading_path", "content"), "chunk_id").withColumn("pos", pos)
    if mode == "keyword":
        found = inside.where(F.col("pos") <= top_k).select("query_id", "chunk_id", "note_path", F.lit(0.0).alias("score"), F.col("pos").alias("place"))
        return assemble.present(found, e.chunks, e.notes)
    pool = inside.where("pos <= 50").join(vectors.select("chunk_id", "vec"), "chunk_id").join(q.select("query_id", "qvec"), "query_id")
    if mode == "semantic" or pool.limit(1).count() == 0:
        near = vector_topk(vectors, q.select("query_id", "qvec"), top_k).join(vectors.select("chunk_id", "note_path"), "chunk_id")
        place = F.row_number().over(rank.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
        return assemble.present(near.select("query_id", "chunk_id", "note_path", F.col("similarity").alias("score"), place.alias("place")), e.chunks, e.notes)
    t = e.tables
    ev = rank.Evidence(vectors, t.get("usage"), e.as_of, t.get("triples"), t.get("pairs"), t.get("errors"), None, None, frozenset(ablate))
    return assemble.present(rank.hybrid(pool, q.select("query_id", "text"), ev, top_k=top_k), e.chunks, e.notes)


@Engine.tool
def ask(e: Engine, text: str, top_k: int = 8, workspace: str | None = None) -> DataFrame:
    """The prompt with its sources from which an answer is generated."""
    v = e.scope(e.vectors, workspace)
    near = vector_topk(v, e.asked(text).select("query_id", "qvec"), top_k).join(v.select("chunk_id", "note_path"), "chunk_id")
    place = F.row_number().over(rank.Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return assemble.sources(near.withColumn("place", place), e.chunks)


def found_facts(e: Engine, q: DataFrame, top_k: int, mode: str = "hybrid", workspace: str | None = None) -> DataFrame:
    """query_id, doc, score, place of the facts found for one query: the 30 best keyword hits by 0.3 keyword + 0.7 cosine; by vectors alone without keyword hits.

    Facts without a vector take part in keyword search only, and stand for themselves, with score 0, where no hit has one.
    Vectors are the column `vec` of the facts if there is one, else the embedder's of their text.
    """
    inside = e.scope(e.triples, workspace)
    first = F.row_number().over(rank.Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "pos"))
    if mode != "semantic":
        hits = bm25.bm25(e.triples, "triple_id", "triple_text", q.select("query_id", "text"), top_k if mode == "keyword" else 30, within=inside.select(F.col("triple_id").alias("doc")))
        hits = materialize(hits, "facts")
        words = hits.where(F.col("pos") <= top_k).select("query_id", "doc", F.lit(0.0).alias("score"), F.col("pos").alias("place"))
        if mode == "keyword":
            return words
        if not hits.isEmpty():
            near = hits.join(e.fact_vectors(inside).withColumnRenamed("chunk_id", "doc"), "doc").join(q.select("query_id", "qvec"), "query_id")
            scored = materialize(rank.base_scores(near).select("query_id", "doc", "score", "pos").withColumn("place", first), "facts")
            return words if scored.isEmpty() else scored.where(F.col("place") <= top_k).drop("pos")
    near = vector_topk(e.fact_vectors(inside), q.select("query_id", "qvec"), top_k)
    return near.select("query_id", F.col("chunk_id").alias("doc"), F.col("similarity").alias("score"), F.col("chunk_id").alias("pos")).withColumn("place", first).drop("pos")


@Engine.tool
def triples(e: Engine, text: str, top_k: int = 10, workspace: str | None = None, mode: str = "hybrid") -> DataFrame:
    inside = e.scope(e.triples, workspace).select(F.col("triple_id").alias("doc"), "note_path", "subject", "predicate", "object")
    j = found_facts(e, e.asked(text), top_k, mode, workspace).join(inside, "doc")
    return j.orderBy("place").limit(top_k).select("note_path", "subject", "predicate", "object", "score")


@Engine.tool
def tiered(e: Engine, text: str, top_k: int = 5) -> DataFrame:
    """Facts first: where they cover enough notes well enough, notes by facts and chunks together, else by chunks alone."""
    q = e.asked(text)
    facts = found_facts(e, q, 3 * top_k).join(e.triples.select(F.col("triple_id").alias("doc"), "note_path"), "doc").select("query_id", "note_path", "score")
    if tune.route(facts).where("use_facts").limit(1).count() == 0:
        return search(e, text, top_k).select("query_id", "note_path", "score")
    hits = bm25.bm25(e.chunks, "chunk_id", "content", q.select("query_id", "text"), 50).withColumnRenamed("doc", "chunk_id").join(e.vectors, "chunk_id").join(q.select("query_id", "qvec"), "query_id")
    return tune.merge_tiers(tune.normalize(facts), tune.normalize(rank.base_scores(hits)), top_k=top_k)


@Engine.tool
def related(e: Engine, note: str, top_k: int = 10) -> DataFrame:
    return related_notes(e.vectors, note, top_k)


@Engine.tool
def neighbourhood(e: Engine, note: str, depth: int = 1) -> DataFrame:
    adj = graph.undirected(e.notes, e.edges)
    return graph.neighbourhood(adj, e.notes.where(F.col("path").isin(note, note + ".md")).select(F.col("path").alias("start")), depth)


@Engine.tool
def pagerank(e: Engine, iterations: int = 20) -> DataFrame:
    return graph.pagerank(e.notes, e.edges, iterations=iterations)


@Engine.tool
def gaps(e: Engine, top_k: int = 10, min_shared: int = 2) -> DataFrame:
    return graph.structural_gaps(graph.undirected(e.notes, e.edges), top_k, min_shared)


@Engine.tool
def bridges(e: Engine, top_k: int = 10) -> DataFrame:
    b = graph.betweenness(e.notes, graph.undirected(e.notes, e.edges))
    return b.where("betweenness > 0").orderBy(F.round("betweenness", 9).desc(), "path").limit(top_k)


@Engine.tool
def communities(e: Engine) -> DataFrame:
    return community.detect(e.vectors, e.triples, e.pairs, e.edges)[0]


@Engine.tool
def top_pairs(e: Engine, limit: int = 20) -> DataFrame:
    return cooccur.top_pairs(e.pairs, limit)


@Engine.tool
def diff(e: Engine) -> DataFrame:
    return quality.snapshot_diff(e.notes, e.snapshots)


@Engine.tool
def prediction_errors(e: Engine, least: int = 2) -> DataFrame:
    return quality.error_report(e.errors, least)


@Engine.tool
def dormancy(e: Engine, threshold: float = 0.05) -> DataFrame:
    return quality.dormancy(e.notes, rank.hotness(e.usage, e.now), e.now, threshold)


@Engine.tool
def memories(e: Engine, text: str | None = None, workspace: str | None = None, entity_type: str | None = None, limit: int = 20) -> DataFrame:
    m = e.memories.where(memory.valid(e.now))
    if workspace:
        m = m.where(memory.in_workspace(F.col("workspace"), workspace.strip("/")))
    if entity_type:
        m = m.where(F.col("entity_type") == entity_type)
    if text is None:
        return m.orderBy(F.desc("created_at"), "memory_id").limit(limit)
    return assemble.search_memories(m if "mvec" in m.columns else embed(m, "content", "mvec", e.embedder), e.asked(text), e.now, limit)


@Engine.tool
def transcript(e: Engine, text: str, limit: int = 20, role: str | None = None) -> DataFrame:
    return transcripts.search(e.messages, text, limit, role)
