"""Queries of the graph operators. The graph: notes linked by facts whose object another note describes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import graph
from lectern.registry import query
from lectern.session import materialize
from lectern.sources import tables as t
from lectern.sources.tables import sql

_NODES = "SELECT path FROM v_notes"
_KNOWN = "SELECT source_path, target_path FROM v_edges WHERE source_path IN (SELECT path FROM v_notes) AND target_path IN (SELECT path FROM v_notes)"
_ADJ = "SELECT source_path AS a, target_path AS b FROM known UNION SELECT target_path, source_path FROM known"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return t.notes(spark, d).select("path")


def _adjacency(spark: SparkSession, d: str) -> DataFrame:
    return materialize(graph.undirected(_nodes(spark, d), t.note_edges(spark, d)), "adjacency")


@query(
    sql(
        """SELECT source_path, target_path, min(link_text) AS link_text FROM (
      SELECT source_path, link_text, coalesce(e.path, s.path) AS target_path FROM l
      LEFT JOIN e ON e.key = lower(trim(link_text)) LEFT JOIN s ON s.key = regexp_extract(lower(trim(link_text)), '([^/]+?)(?:\\.md)?$', 1))
    WHERE target_path IS NOT NULL AND target_path <> source_path GROUP BY 1, 2""",
        files="""SELECT path, text FROM documents WHERE path IS NOT NULL
    UNION ALL SELECT path, title FROM v_notes
    UNION ALL SELECT source_path, 'See [[' || upper(regexp_extract(target_path, '([^/]+)\\.md$', 1)) || '|this]] and [[' || target_path || ']].' FROM v_edges""",
        p="SELECT DISTINCT path FROM files",
        l="SELECT path AS source_path, unnest(list_distinct(regexp_extract_all(text, '\\[\\[([^\\]|#]+?)(?:[|][^\\]]+?)?\\]\\]', 1))) AS link_text FROM files WHERE text IS NOT NULL",
        e="SELECT key, max(path) AS path FROM (SELECT lower(path) AS key, path FROM p UNION ALL SELECT regexp_replace(lower(path), '\\.md$', ''), path FROM p) GROUP BY 1",
        s="SELECT regexp_extract(regexp_replace(lower(path), '\\.md$', ''), '([^/]+)$', 1) AS key, min(path) AS path FROM p GROUP BY 1",
    )
)
def edges_build(spark: SparkSession, d: str) -> DataFrame:
    """The link graph of whole texts: the documents, and the notes with links to those that their facts name, by path and by name in other case."""
    stem = F.upper(F.regexp_extract("target_path", r"([^/]+)\.md$", 1))
    named = t.note_edges(spark, d).select("source_path", F.concat(F.lit("See [["), stem, F.lit("|this]] and [["), "target_path", F.lit("]].")))
    files = t.table(spark, d, "documents").where("path IS NOT NULL").select("path", "text").union(t.notes(spark, d).select("path", "title")).union(named)
    return graph.build_edges(files)


@query(
    sql(
        "SELECT path, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM v_notes LEFT JOIN (SELECT target_path AS path, count(*) AS n FROM v_edges GROUP BY 1) i USING (path) LEFT JOIN (SELECT source_path AS path, count(*) AS n FROM v_edges GROUP BY 1) o USING (path)"
    )
)
def degrees(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(_nodes(spark, d), t.note_edges(spark, d))


_PR = {
    "known": _KNOWN,
    "share": "SELECT source_path, target_path, 1::DOUBLE / count(*) OVER (PARTITION BY source_path) AS w FROM known",
    "n": "SELECT count(*)::DOUBLE AS n FROM v_notes",
}


@query(sql("SELECT path, round(r, 9) AS pagerank FROM pr20", **{k: _PR[k] for k in ("known", "share", "n")}, **{f"pr{i}": (f"SELECT path, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(g, 0) AS r FROM v_notes CROSS JOIN n LEFT JOIN (SELECT target_path AS path, sum(r * w) AS g FROM share JOIN pr{i - 1} p ON p.path = source_path GROUP BY 1) USING (path)" if i else "SELECT path, 1 / n AS r FROM v_notes CROSS JOIN n") for i in range(21)}))
def pagerank_20(spark: SparkSession, d: str) -> DataFrame:
    return graph.pagerank(_nodes(spark, d), t.note_edges(spark, d)).select("path", F.round("pagerank", 9).alias("pagerank"))


@query(
    sql(
        """SELECT start, path, min(hops) AS hops FROM (
        SELECT path AS start, path, 0 AS hops FROM v_notes UNION ALL SELECT a, b, 1 FROM adj
        UNION ALL SELECT x.a, y.b, 2 FROM adj x JOIN adj y ON x.b = y.a) GROUP BY 1, 2""",
        known=_KNOWN,
        adj=_ADJ,
    )
)
def bfs_depth2(spark: SparkSession, d: str) -> DataFrame:
    """Neighbourhoods of two hops, from every note."""
    return graph.neighbourhood(_adjacency(spark, d), _nodes(spark, d).withColumnRenamed("path", "start"), 2)


@query(
    sql(
        """SELECT x.b AS a, y.b AS b, count(*) AS shared, round(sum(1 / ln(deg)), 9) AS score
        FROM adj x JOIN adj y ON x.a = y.a AND x.b < y.b JOIN (SELECT a, count(*) AS deg FROM adj GROUP BY 1) dg ON dg.a = x.a
        WHERE NOT EXISTS (SELECT 1 FROM adj z WHERE z.a = x.b AND z.b = y.b) GROUP BY 1, 2 HAVING count(*) >= 2
        ORDER BY 4 DESC, 3 DESC, 1, 2 LIMIT 10""",
        known=_KNOWN,
        adj=_ADJ,
    )
)
def adamic_adar_gaps(spark: SparkSession, d: str) -> DataFrame:
    """The 10 strongest missing links."""
    return graph.structural_gaps(_adjacency(spark, d)).withColumn("score", F.round("score", 9))


_REACH = "SELECT path AS s, path AS v FROM v_notes UNION SELECT reach.s, adj.b FROM reach JOIN adj ON adj.a = reach.v"


@query(sql("SELECT v AS path, min(s) AS component FROM reach GROUP BY 1", known=_KNOWN, adj=_ADJ, reach=_REACH))
def components(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_nodes(spark, d), _adjacency(spark, d))


# Walks of each length; the first length that leads to a note counts the shortest paths. No distance here comes near 24.
_BETWEEN = {
    "known": _KNOWN,
    "adj": _ADJ,
    "walks": "SELECT path AS s, path AS v, 0 AS k, 1::DOUBLE AS n FROM v_notes UNION ALL SELECT s, b, k + 1, sum(n) FROM walks JOIN adj ON a = v WHERE k < 24 GROUP BY s, b, k",
    "short": "SELECT s, v, min(k) AS d, arg_min(n, k) AS n FROM walks GROUP BY 1, 2",
    "betw": """SELECT path, coalesce(b, 0) AS betweenness FROM v_notes LEFT JOIN (SELECT x.v AS path, sum(x.n * y.n / z.n) AS b FROM short x JOIN short y ON y.s = x.v JOIN short z ON z.s = x.s AND z.v = y.v
        WHERE x.s < y.v AND x.d > 0 AND y.d > 0 AND x.d + y.d = z.d GROUP BY 1) USING (path)""",
}


@query(sql("SELECT path, round(betweenness, 6) AS betweenness FROM betw", **_BETWEEN))
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    out = graph.betweenness(_nodes(spark, d), _adjacency(spark, d))
    return out.select("path", F.round("betweenness", 6).alias("betweenness"))


@query(
    sql(
        """SELECT path, round(betweenness, 6) AS betweenness, fragments, fragments > (SELECT count(DISTINCT c) FROM (SELECT min(s) AS c FROM reach GROUP BY v)) AS articulation
        FROM top10 JOIN (SELECT g, count(DISTINCT c) AS fragments FROM (SELECT g, min(s) AS c FROM cut GROUP BY g, v) GROUP BY 1) ON g = path""",
        **_BETWEEN,
        reach=_REACH,
        top10="SELECT * FROM betw WHERE betweenness > 0 ORDER BY round(betweenness, 6) DESC, path LIMIT 10",
        cut="SELECT t.path AS g, n.path AS s, n.path AS v FROM top10 t JOIN v_notes n ON n.path <> t.path UNION SELECT g, s, b FROM cut JOIN adj ON a = v WHERE b <> g",
    )
)
def bridges(spark: SparkSession, d: str) -> DataFrame:
    """The 10 notes of greatest betweenness and the fragments left without each."""
    nodes, adj = _nodes(spark, d), _adjacency(spark, d)
    top = materialize(graph.betweenness(nodes, adj).where("betweenness > 0").orderBy(F.round("betweenness", 6).desc(), "path").limit(10), "top")
    whole = graph.components(nodes, adj).agg(F.countDistinct("component").alias("whole"))
    frag = graph.articulation(nodes, adj, top)
    return top.join(frag, "path").crossJoin(F.broadcast(whole)).select("path", F.round("betweenness", 6).alias("betweenness"), "fragments", (F.col("fragments") > F.col("whole")).alias("articulation"))


@query(sql("SELECT (SELECT count(*) FROM v_notes) AS n_notes, (SELECT count(*) // 2 FROM adj) AS n_edges, (SELECT count(DISTINCT c) FROM (SELECT v, min(s) AS c FROM reach GROUP BY 1)) AS n_components", known=_KNOWN, adj=_ADJ, reach=_REACH))
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, adj = _nodes(spark, d), _adjacency(spark, d)
    c = graph.components(nodes, adj).agg(F.count(F.lit(1)).alias("n_notes"), F.countDistinct("component").alias("n_components"))
    e = adj.agg(F.floor(F.count(F.lit(1)) / 2).alias("n_edges"))
    return c.crossJoin(F.broadcast(e)).select("n_notes", "n_edges", "n_components")


@query(
    sql(
        """SELECT doc_id, link FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '\\[\\[([^\\]|#]+?)(?:[|][^\\]]+?)?\\]\\]', 1))) AS link FROM documents WHERE text IS NOT NULL)"""
    )
)
def link_extract(spark: SparkSession, d: str) -> DataFrame:
    """Distinct link targets of every document."""
    from lectern.functions.text import wiki_links

    return t.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(wiki_links(F.col("text"))).alias("link"))


@query(
    sql(
        """SELECT source_path, target_path, min(link_text) AS link_text FROM (
        SELECT l.note_path AS source_path, l.link_text, coalesce(e.path, s.path) AS target_path
        FROM (SELECT source_path AS note_path, upper(regexp_extract(target_path, '([^/]+)\\.md$', 1)) AS link_text FROM v_edges) l
        LEFT JOIN (SELECT key, max(path) AS path FROM (SELECT lower(path) AS key, path FROM v_notes UNION ALL SELECT regexp_replace(lower(path), '\\.md$', ''), path FROM v_notes) GROUP BY 1) e ON e.key = lower(trim(l.link_text))
        LEFT JOIN (SELECT regexp_extract(regexp_replace(lower(path), '\\.md$', ''), '([^/]+)$', 1) AS key, min(path) AS path FROM v_notes GROUP BY 1) s ON s.key = regexp_extract(lower(trim(l.link_text)), '([^/]+?)(?:\\.md)?$', 1)
        ) WHERE target_path IS NOT NULL AND target_path <> source_path GROUP BY 1, 2"""
    )
)
def link_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Links by file name, in other case, resolved to notes by path or stem."""
    links = t.note_edges(spark, d).select("source_path", F.upper(F.regexp_extract("target_path", r"([^/]+)\.md$", 1)).alias("link_text"))
    return graph.resolve_links(links, t.notes(spark, d).select("path"))
