"""The queries of the training-data operators, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm import conversations, cooccurrence, knn_graph, leakage, near_duplicates, packing, shared_spans, splitting
from lectern.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_SPACE = "' ' || chr(9) || chr(10) || chr(13)"


# 4. Splitting oversized items at natural boundaries


@query(f"SELECT DISTINCT chunk_id FROM chunks WHERE length(trim(content, {_SPACE})) > 2000")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, sf_dir, "chunks"), with_text=False).select("chunk_id").distinct()


@query()
def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(_table(spark, sf_dir, "chunks"))


@query(f"SELECT DISTINCT chunk_id, md5(trim(content, {_SPACE})) AS rejoined, true AS fits FROM chunks WHERE length(trim(content, {_SPACE})) > 2000")
def p4_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each chunk put together again without their overlaps, and whether all keep to the limit and the overlap."""
    p = splitting.split_oversized(_table(spark, sf_dir, "chunks")).withColumn("first", F.col("position") - F.col("piece"))
    own = p.groupBy("chunk_id", "heading_path", "first").agg(F.array_sort(F.collect_list(F.struct("piece", "start", "end", "content"))).alias("p"))  # a chunk's own pieces
    text = F.array_join(F.transform("p", lambda x: F.when(x["piece"] == 0, x["content"]).otherwise(F.substring(x["content"], F.lit(201), F.lit(2000)))), "")
    step = F.forall(F.sequence(F.lit(2), F.size("p")), lambda i: F.element_at("p", i)["start"] == F.element_at("p", (i - 1).cast("int"))["end"] - 200)
    fits = F.forall("p", lambda x: (F.length(x["content"]) <= 2000) & (F.length(x["content"]) == x["end"] - x["start"])) & step
    return own.select("chunk_id", F.md5(text).alias("rejoined"), fits.alias("fits")).distinct()


# 5. Rebuilding conversations from message rows

_COUNTING = f"""
WITH typed AS (
  SELECT session_id, id, uuid,
         CASE WHEN lower(trim(role, {_SPACE})) IN ('user', 'human') THEN 1
              WHEN lower(trim(role, {_SPACE})) IN ('assistant', 'ai') THEN 2 END AS r,
         CASE WHEN regexp_matches(trim(timestamp, {_SPACE}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}')
              THEN epoch_us(TRY_CAST(trim(timestamp, {_SPACE}) AS TIMESTAMPTZ)) END AS at_us,
         length(trim(content, {_SPACE})) > 0 AS body
  FROM messages WHERE session_id IS NOT NULL
), keyed AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, coalesce(nullif(uuid, ''), 'row ' || id) ORDER BY id) AS nth_uuid FROM typed
), once AS (
  SELECT *, row_number() OVER (PARTITION BY session_id, id) AS nth_id FROM keyed WHERE nth_uuid = 1
), counting AS (
  SELECT * FROM once WHERE nth_id = 1 AND r IS NOT NULL AND coalesce(body, false)
), turns AS (
  SELECT *, lead(r) OVER w AS next_r, row_number() OVER w AS turn FROM counting
  WINDOW w AS (PARTITION BY session_id ORDER BY at_us NULLS FIRST, id)
), kept AS (
  SELECT session_id, count(*) AS n_turns FROM turns GROUP BY session_id
  HAVING count(*) FILTER (WHERE at_us IS NULL) = 0 AND count(*) FILTER (WHERE turn = 1 AND r = 2) = 0
     AND count(*) FILTER (WHERE r = 1 AND coalesce(next_r, 0) <> 2) = 0
)
"""


@query(
    _COUNTING
    + """
SELECT session_id FROM (SELECT session_id FROM messages UNION SELECT session_id FROM sessions)
WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM kept)
"""
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped_sessions(_table(spark, sf_dir, "messages"), _table(spark, sf_dir, "sessions"))


@query(
    _COUNTING
    + """
SELECT session_id, turn AS turn, CASE r WHEN 1 THEN 'user' ELSE 'assistant' END AS role, id, n_turns
FROM turns JOIN kept USING (session_id)
"""
)
def p5_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(_table(spark, sf_dir, "messages")).select("session_id", "turn", "role", "id", "n_turns")


# 7. Evaluation texts leaking into training text

_GRAMS = """
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') FROM benchmark WHERE text IS NOT NULL
), grams AS (
  SELECT DISTINCT kind, id, array_to_string(words[i:i + 12], ' ') AS gram
  FROM (SELECT kind, id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
)
"""


@query(_GRAMS + "SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM grams d JOIN grams b ON d.gram = b.gram AND d.kind = 0 AND b.kind = 1")
def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_spans(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).select("doc_id", "item_id").distinct()


@query()
def p7_decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.decontaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


# 8. Long exact spans shared between records


# Windows as hashes of 64 bits.
_WINDOWS = """
WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND length(text) >= 300),
w AS (SELECT doc_id, i, hash(substring(text, i, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM t)),
g AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))
"""


@query(_WINDOWS + "SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM (SELECT DISTINCT doc_id, h FROM w JOIN g USING (h)) a JOIN (SELECT DISTINCT doc_id, h FROM w JOIN g USING (h)) b ON a.h = b.h AND a.doc_id < b.doc_id")
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_pairs(_table(spark, sf_dir, "documents"))


@query(
    _WINDOWS
    + """SELECT doc_id, sum(least(300, coalesce(later - i, 300)))::BIGINT AS shared_chars FROM (
    SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS later FROM (SELECT DISTINCT doc_id, i FROM w JOIN g USING (h))) GROUP BY 1"""
)
def p8_shared_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_lengths(_table(spark, sf_dir, "documents"))


# 1. Items that appear together

_NOTES = """
WITH e AS (
  SELECT DISTINCT note_path, lower(trim(entity)) AS entity
  FROM (SELECT note_path, subject AS entity FROM triples UNION ALL SELECT note_path, object FROM triples)
  WHERE note_path IS NOT NULL AND length(trim(entity)) > 0
), m AS (SELECT entity, count(*) AS n FROM e GROUP BY entity),
t AS (SELECT count(DISTINCT note_path) AS n FROM e),
p AS (
  SELECT x.entity AS entity_a, y.entity AS entity_b, count(*) AS weight
  FROM e x JOIN e y ON x.note_path = y.note_path AND x.entity < y.entity GROUP BY ALL
), s AS (
  SELECT entity_a, entity_b, weight, a.n AS n_a, b.n AS n_b, t.n AS n
  FROM p JOIN m a ON a.entity = entity_a JOIN m b ON b.entity = entity_b CROSS JOIN t
)
"""


@query(_NOTES + "SELECT entity_a, entity_b FROM s WHERE weight >= 3 AND weight * n >= 5 * n_a * n_b")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cooccurrence.entity_pairs(_table(spark, sf_dir, "triples"), 3, 5.0).select("entity_a", "entity_b")


_WEIGHTS = _NOTES + "SELECT entity_a, entity_b, weight, round(weight * n::DOUBLE / (n_a::DOUBLE * n_b), 6) AS ratio FROM s"


@query(_WEIGHTS)
def p1_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cooccurrence.entity_pairs(_table(spark, sf_dir, "triples"))
    return pairs.withColumn("ratio", F.round("ratio", 6))


@query(_WEIGHTS)
def p1_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table, reached by a first load of the older rows and an update of the notes with later ones."""
    triples = _table(spark, sf_dir, "triples")
    late = F.col("updated_at") >= F.lit("2026-01-01").cast("timestamp_ntz")
    index = cooccurrence.PairIndex(spark)
    index.update(cooccurrence.note_entities(triples.where(~late | F.col("updated_at").isNull())))
    changed = cooccurrence.note_entities(triples).join(triples.where(late).select(F.col("note_path").alias("basket")).distinct(), "basket", "left_semi")
    index.update(changed)
    return index.scores().select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("n").alias("weight"), F.round("ratio", 6).alias("ratio"))


# 2. Most similar vectors for every vector


_COSINES = """
WITH e AS (
  SELECT DISTINCT chunk_id, embedding::DOUBLE[] AS v FROM chunks WHERE chunk_id IS NOT NULL AND len(embedding) = 64
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), u AS (SELECT chunk_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e),
s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, max(list_dot_product(a.u, b.u)) AS sim FROM u a JOIN u b ON a.chunk_id <> b.chunk_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 12) DESC, b) AS rank FROM s)
"""
_NEAREST = _COSINES + "SELECT a AS chunk_id, b AS neighbour, round(sim, 2) AS similarity, rank FROM r WHERE rank <= 10"


@query(_COSINES + "SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE rank <= 10 AND sim >= 0.92")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = knn_graph.similar_pairs(_table(spark, sf_dir, "chunks"), "chunk_id", "embedding", 0.92)
    return pairs.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


@query(_NEAREST)
def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate; equal to the SQL where a tree's leaf holds all vectors, as in the small tables."""
    chunks = _table(spark, sf_dir, "chunks")
    near = knn_graph.exact_neighbours(knn_graph.build_graph(chunks, "chunk_id", "embedding"), chunks, "chunk_id", "embedding")
    return near.select(F.col("id").alias("chunk_id"), "neighbour", F.round("sim", 2).alias("similarity"), "rank")


@query(_NEAREST + " AND a % 20 = 0")
def p2_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy search of the graph: the chunks whose id is divisible by 20 as queries, against all chunks; the best 16 found are ranked by exact cosines."""
    chunks = _table(spark, sf_dir, "chunks")
    graph = knn_graph.build_graph(chunks, "chunk_id", "embedding")
    found = knn_graph.search(graph, chunks.where("chunk_id % 20 = 0"), "chunk_id", "embedding", top=16)
    exact = knn_graph.exact_cosines(found.select(F.col("id").alias("a"), F.col("neighbour").alias("b")), chunks, "chunk_id", "embedding", 64)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.round("cosine", 12).desc(), "b"))
    ranked = exact.withColumn("rank", rank).where("rank <= 10")
    return ranked.select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbour"), F.round("cosine", 2).alias("similarity"), "rank")


# 3. Near-duplicate records with small edits

_SETS = """
WITH w AS (
  SELECT DISTINCT memory_id, list_sort(list_distinct(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'))) AS words
  FROM memories WHERE memory_id IS NOT NULL AND content IS NOT NULL
), s AS (SELECT memory_id, words FROM w WHERE len(words) >= 6)
"""


@query(
    _SETS
    + """
, k AS (SELECT memory_id, words, unnest(words) AS word FROM s),
c AS (SELECT x.memory_id AS a, y.memory_id AS b, len(x.words) + len(y.words) AS total, count(*) AS common
      FROM k x JOIN k y ON x.word = y.word AND x.memory_id < y.memory_id GROUP BY x.memory_id, y.memory_id, x.words, y.words)
SELECT DISTINCT a AS memory_a, b AS memory_b FROM c WHERE common >= 0.7 * (total - common)
"""
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_table(spark, sf_dir, "memories"))


@query(
    _SETS.replace("WITH w AS", "WITH RECURSIVE w AS")
    + """
, k AS (SELECT memory_id, words, unnest(words) AS word FROM s),
c AS (SELECT x.memory_id AS a, y.memory_id AS b, x.words AS wa, y.words AS wb, count(*) AS common
      FROM k x JOIN k y ON x.word = y.word AND x.memory_id <> y.memory_id GROUP BY ALL),
l AS (SELECT * FROM c WHERE common >= 0.7 * (len(wa) + len(wb) - common)),
reach AS (SELECT DISTINCT a AS origin, a AS node FROM l UNION SELECT origin, b FROM reach JOIN l ON a = node)
SELECT memory_id, group_id, n_links FROM (SELECT node AS memory_id, min(origin) AS group_id FROM reach GROUP BY 1)
JOIN (SELECT a AS memory_id, count(DISTINCT CASE WHEN wa <> wb THEN wb END) AS n_links FROM l GROUP BY 1) USING (memory_id)
"""
)
def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_table(spark, sf_dir, "memories"))


# 6. Filling fixed-capacity containers with items


@query()
def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


@query("SELECT DISTINCT doc_id, true AS whole, true AS fits FROM documents WHERE length(text) > 0")
def p6_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document whether all its tokens are placed once, undivided unless over the capacity, and its containers keep to the capacity."""
    docs = _table(spark, sf_dir, "documents")
    sizes = materialize(packing.token_counts(docs), "token-counts")
    placed = materialize(packing.pack(sizes, 2048), "placed")
    load = placed.groupBy("container").agg(F.sum("n_tokens").alias("load"))
    mine = placed.join(load, "container").groupBy("doc_id").agg(F.sum("n_tokens").alias("placed"), F.count(F.lit(1)).alias("pieces"), F.max("load").alias("fullest"))
    whole = (F.col("placed") == F.col("n_tokens")) & (F.col("pieces") == F.ceil(F.col("n_tokens") / 2048))
    return sizes.where("n_tokens > 0").join(mine, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), (F.col("fullest") <= 2048).alias("fits"))
