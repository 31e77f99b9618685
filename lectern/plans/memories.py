"""Queries of memories, sessions, feedback, errors and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import bm25 as text_rank
from lectern.operators import memory, quality, rank
from lectern.operators.sequence import numbered
from lectern.registry import query
from lectern.session import materialize
from lectern.sources import tables as t
from lectern.sources.tables import sql

NOW = "2026-01-01 00:00:00"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(sql(f"SELECT entity_type, count(*) AS total, count(*) FILTER (WHERE expires_at <= TIMESTAMP '{NOW}') AS expired, count(*) FILTER (WHERE embed_pending) AS pending FROM v_memories GROUP BY 1"))
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.stats(t.memories(spark, d), _now())


@query(sql(f"SELECT memory_id, content, entity_type, created_at FROM v_memories WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND (trim(workspace, '/') = 'work' OR starts_with(trim(workspace, '/'), 'work/')) ORDER BY created_at DESC, memory_id LIMIT 20"))
def memory_list(spark: SparkSession, d: str) -> DataFrame:
    """The 20 newest valid memories of a workspace and those below it."""
    m = t.memories(spark, d).where(memory.valid(_now()) & memory.in_workspace(F.col("workspace"), "work"))
    return m.orderBy(F.desc("created_at"), "memory_id").limit(20).select("memory_id", "content", "entity_type", "created_at")


@query(sql(f"SELECT memory_id FROM v_memories WHERE (expires_at IS NULL OR expires_at > TIMESTAMP '{NOW}') AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 365 DAY"))
def memory_prune(spark: SparkSession, d: str) -> DataFrame:
    return memory.prune(t.memories(spark, d), _now(), 365).select("memory_id")


_PAIRED = "SELECT a.memory_id AS target_id, min(b.memory_id) AS source_id FROM one a JOIN one b ON a.source_agent = b.source_agent AND a.workspace = b.workspace AND a.entity_type <> b.entity_type AND a.memory_id < b.memory_id GROUP BY 1"
_PRI = "CASE {}.entity_type WHEN 'bug' THEN 6 WHEN 'decision' THEN 5 WHEN 'convention' THEN 4 WHEN 'learning' THEN 3 WHEN 'observation' THEN 2 WHEN 'context' THEN 1 ELSE 0 END"


@query(
    sql(
        f"""SELECT t.memory_id, CASE WHEN length(s.content) > length(t.content) * 1.2::DOUBLE THEN s.content ELSE t.content END AS content,
        CASE WHEN {_PRI.format('s')} > {_PRI.format('t')} THEN s.entity_type ELSE t.entity_type END AS entity_type,
        coalesce(t.merge_count, 0) + coalesce(s.merge_count, 0) + 1 AS merge_count, list_concat(coalesce(t.merged_from, []), [s.memory_id]) AS merged_from,
        array_to_string(list_sort(list_distinct(list_concat(coalesce(t.tags, []), coalesce(s.tags, [])))), ',') AS tags
        FROM paired p JOIN one t ON t.memory_id = target_id JOIN one s ON s.memory_id = source_id""",
        one="SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY content) AS nth FROM v_memories WHERE content IS NOT NULL) WHERE nth = 1",
        paired=_PAIRED,
    )
)
def memory_merge(spark: SparkSession, d: str) -> DataFrame:
    """Each memory merged with the next one of its agent and workspace that has another type."""
    nth = F.row_number().over(Window.partitionBy("memory_id").orderBy("content"))
    one = t.memories(spark, d).where("content IS NOT NULL").withColumn("nth", nth).where("nth = 1").drop("nth")
    key = one.select("memory_id", "source_agent", "workspace", "entity_type").where("source_agent IS NOT NULL AND workspace IS NOT NULL AND entity_type IS NOT NULL")
    back = Window.partitionBy("source_agent", "workspace").orderBy(F.desc("memory_id"))  # from the last id on: the start of the next run of another type
    run = key.withColumn("start", F.when(F.col("entity_type") != F.lead("entity_type").over(back), F.col("memory_id")))
    paired = run.select("memory_id", F.last("start", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("other")).where("other IS NOT NULL")
    src = one.select(F.col("memory_id").alias("other"), F.struct(*one.columns).alias("s"))
    out = paired.join(one.select("memory_id", F.struct(*one.columns).alias("t")), "memory_id").join(src, "other")
    m = memory.merge()
    return out.select("memory_id", m["content"].alias("content"), m["entity_type"].alias("entity_type"), m["merge_count"].alias("merge_count"), m["merged_from"].alias("merged_from"), F.array_join(F.array_sort(m["tags"]), ",").alias("tags"))


_EDIT = "SELECT memory_id, CASE WHEN entity_type = 'context' THEN 'observation' ELSE entity_type END AS entity_type, revision_count + (entity_type = 'context')::INT AS revision_count, CASE WHEN entity_type = 'context' THEN NULL ELSE expires_at END AS expires_at FROM v_memories"


@query(sql(_EDIT))
def memory_update(spark: SparkSession, d: str) -> DataFrame:
    """Every short-lived context memory made a permanent observation."""
    m = t.memories(spark, d)
    none = F.lit(None)
    edits = m.where("entity_type = 'context'").select("memory_id", none.cast("string").alias("content"), none.cast("array<string>").alias("tags"), none.cast("array<string>").alias("add_tags"), none.cast("array<string>").alias("remove_tags"), F.lit("observation").alias("entity_type"), F.lit(0).alias("ttl_hours")).distinct()
    return memory.update(m, edits, _now()).select("memory_id", "entity_type", "revision_count", "expires_at")


_LONG = {
    "mq": "SELECT memory_id AS query_id, content AS text FROM v_memories WHERE content IS NOT NULL",
    "q_terms": "SELECT query_id, [word] AS phrase, 1 AS qtf FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(word) DESC, word) AS nth FROM (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM mq) WHERE length(word) >= 4) WHERE nth <= 5",
}
_MB = {**_LONG, **{k: v for k, v in text_rank.sql_ctes("SELECT memory_id AS doc, content AS body FROM v_memories", "SELECT 1", None).items() if k not in ("q_words", "q_terms")}}


@query(sql("SELECT query_id, doc AS memory_id, round(rank, 6) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), doc) AS nth FROM bm WHERE query_id <> doc) WHERE nth <= 5", **_MB))
def similar_memories(spark: SparkSession, d: str) -> DataFrame:
    """For every memory, the five best keyword candidates for a duplicate."""
    m = t.memories(spark, d).where("content IS NOT NULL")
    qs = m.select(F.col("memory_id").alias("query_id"), F.col("content").alias("text"))
    return memory.similar_by_text(m, qs).select("query_id", "memory_id", F.round("rank", 6).alias("rank"))


_TAGS = {
    **_MB,
    "near10": "SELECT query_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rank, 9), doc) AS nth FROM bm WHERE query_id <> doc) WHERE nth <= 10",
    "named": """SELECT memory_id, unnest(list_sort(list_distinct(list_concat(
      list_filter(list_transform(p, lambda y: lower(list_extract(string_split(y, '.'), -1))), lambda e: e IN ('py', 'ts', 'js', 'rs', 'go', 'md', 'toml', 'yaml', 'yml', 'json')),
      list_transform(list_filter(list_transform(p, lambda y: string_split(y, '/')), lambda s: len(s) > 1), lambda s: CASE WHEN s[-2] <> '' THEN s[-2] ELSE s[1] END))))[1:5]) AS tag
      FROM (SELECT memory_id, regexp_extract_all(content, '[\\w/.-]+\\.\\w{1,10}') AS p FROM v_memories WHERE content IS NOT NULL)""",
    "weighed": """SELECT query_id, tag, sum(w)::BIGINT AS weight FROM (
      SELECT query_id, unnest(tags) AS tag, 1 AS w FROM near10 JOIN v_memories ON memory_id = doc WHERE content IS NOT NULL UNION ALL SELECT memory_id, tag, 2 FROM named) GROUP BY 1, 2""",
}


@query(sql("SELECT query_id, tag, weight FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, tag) AS nth FROM weighed) WHERE nth <= 5", **_TAGS))
def tag_suggestions(spark: SparkSession, d: str) -> DataFrame:
    """Tags for every memory from similar memories and the paths it names."""
    m = materialize(t.memories(spark, d).where("content IS NOT NULL").select("memory_id", "content", "tags"), "texts")  # made distinct once
    return memory.suggest_tags(m, m.select(F.col("memory_id").alias("query_id"), F.col("content").alias("text")))


DRIFT_SQL = sql(
    """SELECT memory_id, note_path, round(distance, 6) AS cosine_distance FROM (SELECT memory_id, n.note_path, 1 - max(list_dot_product(mv, vec) / (sqrt(list_dot_product(mv, mv)) * sqrt(list_dot_product(vec, vec)) + 1e-10)) AS distance
    FROM named n JOIN (SELECT vec_id, embedding::DOUBLE[] AS mv FROM embeddings) e ON e.vec_id = memory_id JOIN v_vectors v ON v.note_path = n.note_path GROUP BY 1, 2) WHERE distance > 0.4""",
    stems="SELECT regexp_extract(regexp_replace(lower(path), '\\.md$', ''), '([^/]+)$', 1) AS key, min(path) AS path FROM v_notes GROUP BY 1",
    named="""SELECT DISTINCT m.memory_id, s.path AS note_path FROM (SELECT DISTINCT memory_id FROM v_memories WHERE content IS NOT NULL) m
    JOIN (SELECT chunk_id, min(note_path) AS note_path FROM v_vectors GROUP BY 1) c ON c.chunk_id = m.memory_id JOIN stems s ON s.key = regexp_extract(lower(c.note_path), '([^/]+)\\.md$', 1)""",
)


@query(DRIFT_SQL)
def memory_drift(spark: SparkSession, d: str) -> DataFrame:
    """Memories far from the notes they name: each names the note of the chunk with its number, and has the stored vector of that number."""
    v = t.chunk_vectors(spark, d)
    stem = v.groupBy(F.col("chunk_id").alias("memory_id")).agg(F.regexp_extract(F.min("note_path"), r"([^/]+)\.md$", 1).alias("stem"))
    m = t.memories(spark, d).where("content IS NOT NULL").select("memory_id").distinct()
    named = m.join(stem, "memory_id").select("memory_id", F.concat(F.lit("decided in [["), "stem", F.lit("]]")).alias("content"))
    vectors = t.table(spark, d, "embeddings").select(F.col("vec_id").alias("memory_id"), F.col("embedding").cast("array<double>").alias("mvec"))
    return memory.drift(named, vectors, t.notes(spark, d).select("path"), v).select("memory_id", "note_path", F.round("cosine_distance", 6).alias("cosine_distance"))


# Sessions


@query("SELECT s.session_id, s.project, s.last_ts, coalesce(m.n, 0) AS n_messages FROM (SELECT session_id, max(project) AS project, max(last_ts) AS last_ts FROM sessions WHERE session_id IS NOT NULL GROUP BY 1) s LEFT JOIN (SELECT session_id, count(*) AS n FROM messages GROUP BY 1) m USING (session_id) ORDER BY s.last_ts DESC NULLS LAST, 1 LIMIT 20")
def session_list(spark: SparkSession, d: str) -> DataFrame:
    """The 20 latest sessions with the number of their messages, counted before the join."""
    s = t.table(spark, d, "sessions").where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("project").alias("project"), F.max("last_ts").alias("last_ts"))
    n = t.table(spark, d, "messages").groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    j = s.join(n, "session_id", "left").select("session_id", "project", "last_ts", F.coalesce("n", F.lit(0)).alias("n_messages"))
    return j.orderBy(F.desc_nulls_last("last_ts"), "session_id").limit(20)


@query("SELECT lower(trim(role)) AS role, count(*) AS n, count(DISTINCT session_id) AS n_sessions, count(tool_name) AS with_tool FROM messages GROUP BY 1")
def transcript_stats(spark: SparkSession, d: str) -> DataFrame:
    m = t.table(spark, d, "messages").groupBy(F.lower(F.trim("role")).alias("role"))
    return m.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session_id").alias("n_sessions"), F.count("tool_name").alias("with_tool"))


_ORDERED = "SELECT DISTINCT id, session_id, content, timestamp FROM messages WHERE session_id IS NOT NULL"


@query(
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp NULLS FIRST, id) AS nth FROM ({_ORDERED})),
    h AS (SELECT id AS hit, session_id, nth FROM o WHERE contains(lower(content), 'archive'))
    SELECT h.hit, o.id, o.nth - h.nth AS off FROM h JOIN o ON o.session_id = h.session_id AND o.nth BETWEEN h.nth - 2 AND h.nth + 2"""
)
def context_window(spark: SparkSession, d: str) -> DataFrame:
    """Two messages around every hit of a phrase; the neighbourhood is an equi-join on the numbered positions."""
    m = t.table(spark, d, "messages").select("id", "session_id", "content", "timestamp").where("session_id IS NOT NULL").distinct()
    o = materialize(numbered(m.select("id", "session_id", "content", "timestamp"), "session_id", F.asc_nulls_first("timestamp"), "id").select("id", "session_id", "nth", F.contains(F.lower("content"), F.lit("archive")).alias("hit")), "ordered")
    hits = o.where("hit").select(F.col("id").alias("hit"), "session_id", F.explode(F.sequence(F.lit(-2), F.lit(2))).alias("off"), "nth").withColumn("nth", F.col("nth") + F.col("off"))
    return hits.join(o.select("session_id", "nth", "id"), ["session_id", "nth"]).select("hit", "id", F.col("off").cast("long").alias("off"))


# Errors, usage and feedback


@query(sql("SELECT note_path, error_type, count(*) AS n, round(avg(cosine_distance), 8) AS avg_distance, max(cosine_distance) AS max_distance, min(detected_at) AS first_seen, max(detected_at) AS last_seen FROM v_errors GROUP BY 1, 2 HAVING count(*) >= 2"))
def error_report(spark: SparkSession, d: str) -> DataFrame:
    return quality.error_report(t.errors(spark, d)).withColumn("avg_distance", F.round("avg_distance", 8))


@query(sql("SELECT error_type, count(*) AS n_notes FROM (SELECT note_path, error_type FROM v_errors GROUP BY 1, 2 HAVING count(*) >= 2) GROUP BY 1"))
def error_groups(spark: SparkSession, d: str) -> DataFrame:
    """The number of groups that the report would list."""
    return quality.error_report(t.errors(spark, d)).groupBy("error_type").agg(F.count(F.lit(1)).alias("n_notes"))


_NTH = "SELECT note_path, error_type, detected_at, row_number() OVER (PARTITION BY note_path, error_type ORDER BY detected_at) AS nth FROM v_errors"


@query(
    sql(
        "SELECT note_path, error_type, detected_at FROM lim",
        e=_NTH,
        lim="""SELECT note_path, error_type, detected_at, nth FROM e WHERE nth = 1
        UNION ALL SELECT x.note_path, x.error_type, x.detected_at, x.nth FROM (
          SELECT e.*, row_number() OVER (PARTITION BY e.note_path, e.error_type ORDER BY e.nth) AS k FROM lim JOIN e ON e.note_path = lim.note_path AND e.error_type = lim.error_type AND e.nth > lim.nth AND e.detected_at >= lim.detected_at + INTERVAL 1 HOUR
        ) x WHERE k = 1""",
    )
)
def error_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Errors that are logged under the limit of one an hour per note and type."""
    return quality.rate_limited(t.errors(spark, d))


_DORM = f"SELECT path, coalesce(hotness, 0) AS hotness, CASE WHEN hotness >= 0.05 THEN 'active' WHEN hotness IS NOT NULL THEN 'dormant' WHEN coalesce(updated_at < TIMESTAMP '{t.AS_OF}' - INTERVAL 90 DAY, true) THEN 'never' ELSE 'new' END AS state FROM v_notes LEFT JOIN hot ON note_path = path"
_HOT = f"SELECT note_path, (1 + count(*))::DOUBLE / (2 + count(*)) * pow(2::DOUBLE, -greatest(0, (epoch_us(TIMESTAMP '{t.AS_OF}') - epoch_us(max(used_at))) / 86400000000::DOUBLE) / 30) AS hotness FROM v_usage GROUP BY 1"


def _dormancy(spark: SparkSession, d: str) -> DataFrame:
    at = F.lit(t.AS_OF).cast("timestamp_ntz")
    return quality.dormancy(t.notes(spark, d), rank.hotness(t.usage(spark, d), at), at)


@query(sql("SELECT state, count(*) AS n FROM dorm GROUP BY 1", hot=_HOT, dorm=_DORM))
def dormancy_counts(spark: SparkSession, d: str) -> DataFrame:
    return _dormancy(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(sql("SELECT path, state, round(hotness, 9) AS hotness FROM dorm", hot=_HOT, dorm=_DORM))
def dormancy_report(spark: SparkSession, d: str) -> DataFrame:
    return _dormancy(spark, d).select("path", "state", F.round("hotness", 9).alias("hotness"))


@query(
    sql(
        "SELECT path, old_status, CASE WHEN state IN ('dormant', 'never') AND old_status = 'active' THEN 'dormant' WHEN state = 'active' AND old_status = 'dormant' THEN 'active' ELSE old_status END AS status FROM (SELECT path, state, coalesce(CASE WHEN json_valid(frontmatter) THEN frontmatter ->> '$.status' END, 'active') AS old_status FROM dorm JOIN v_notes USING (path))",
        hot=_HOT,
        dorm=_DORM,
    )
)
def demotion_status(spark: SparkSession, d: str) -> DataFrame:
    """Status after demoting dormant notes and promoting those in use again; other statuses stay."""
    old = F.coalesce(F.get_json_object("frontmatter", "$.status"), F.lit("active"))
    n = t.notes(spark, d).select("path", old.alias("old_status"))
    status = F.when(F.col("state").isin("dormant", "never") & (F.col("old_status") == "active"), "dormant").when((F.col("state") == "active") & (F.col("old_status") == "dormant"), "active").otherwise(F.col("old_status"))
    return _dormancy(spark, d).join(n, "path").select("path", "old_status", status.alias("status"))


def _searches(spark: SparkSession, d: str) -> DataFrame:
    """Views as searches of a user that showed the pages of the number in props and the next two."""
    e = t.table(spark, d, "events").where("event_type = 'view'")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("user_id").alias("key"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((k + i) % 100).cast("string")).alias("shown"), F.col("ts").alias("searched_at"))


def _uses(spark: SparkSession, d: str) -> DataFrame:
    e = t.table(spark, d, "events").where("event_type IN ('click', 'purchase')")
    return e.select(F.col("user_id").alias("key"), F.get_json_object("props", "$.k").alias("path"), F.col("ts").alias("used_at"))


_ATTR = {
    "se": "SELECT user_id AS key, (((props ->> '$.k')::INT + i) % 100)::VARCHAR AS path, i AS nth, ts AS searched_at FROM events, range(0, 10) r(i) WHERE event_type = 'view'",
    "us": "SELECT DISTINCT user_id AS key, props ->> '$.k' AS path, ts AS used_at FROM events WHERE event_type IN ('click', 'purchase')",
    "att": "SELECT key, path, used_at, max(searched_at) AS searched_at, arg_max(nth, searched_at) + 1 AS rank FROM us JOIN se USING (key, path) WHERE searched_at <= used_at AND used_at - searched_at <= INTERVAL 24 HOUR GROUP BY 1, 2, 3",
}


@query(sql("SELECT key, path, used_at, searched_at, rank FROM att", **_ATTR))
def feedback_attribution(spark: SparkSession, d: str) -> DataFrame:
    """Each use and the latest search of that user within a day that showed the path."""
    return quality.attribute(_uses(spark, d), _searches(spark, d), 86_400)


@query(sql("SELECT path, count(*) AS n, array_to_string(list(DISTINCT key ORDER BY key), ',') AS keys FROM att GROUP BY 1 HAVING count(*) >= 2", **_ATTR))
def feedback_labels(spark: SparkSession, d: str) -> DataFrame:
    a = quality.attribute(_uses(spark, d), _searches(spark, d), 86_400)
    g = a.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    return g.where("n >= 2").select("path", "n", "keys")


@query(sql("SELECT count(*) AS n_events, count(DISTINCT key) AS n_keys, count(DISTINCT path) AS n_paths, round(avg(rank), 6) AS mean_rank FROM att", **_ATTR))
def feedback_stats(spark: SparkSession, d: str) -> DataFrame:
    a = quality.attribute(_uses(spark, d), _searches(spark, d), 86_400)
    return a.agg(F.count(F.lit(1)).alias("n_events"), F.countDistinct("key").alias("n_keys"), F.countDistinct("path").alias("n_paths"), F.round(F.avg("rank"), 6).alias("mean_rank"))


_OLD = "SELECT path, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY updated_at NULLS FIRST, content_hash NULLS FIRST) AS nth FROM notes WHERE path IS NOT NULL) WHERE nth = 1 AND path NOT LIKE 'meta/%'"


@query(sql("SELECT path, CASE WHEN b.path IS NULL THEN 'added' WHEN c.path IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT path, content_hash FROM v_notes WHERE path NOT LIKE 'inbox/%') c FULL JOIN old b USING (path) WHERE c.path IS NULL OR b.path IS NULL OR c.content_hash IS DISTINCT FROM b.content_hash", old=_OLD))
def diff_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The latest revisions against the earliest; meta/ stands for notes added since, inbox/ for notes deleted."""
    first = t.table(spark, d, "notes").where("path IS NOT NULL").groupBy("path").agg(F.min(F.struct("updated_at", "content_hash")).alias("r")).select("path", "r.content_hash")
    return quality.snapshot_diff(t.notes(spark, d).where(~F.col("path").startswith("inbox/")), first.where(~F.col("path").startswith("meta/")))


@query(sql("SELECT path, title, updated_at FROM v_notes WHERE updated_at >= TIMESTAMP '2026-01-01' ORDER BY updated_at DESC, path LIMIT 20"))
def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    n = t.notes(spark, d).where(F.col("updated_at") >= F.lit("2026-01-01").cast("timestamp_ntz"))
    return n.orderBy(F.desc("updated_at"), "path").limit(20).select("path", "title", "updated_at")


@query(sql("SELECT DISTINCT note_path FROM v_chunks WHERE note_path IS NOT NULL AND note_path NOT IN (SELECT path FROM v_notes)"))
def orphans(spark: SparkSession, d: str) -> DataFrame:
    """Indexed paths without a note."""
    return t.chunks(spark, d).where("note_path IS NOT NULL").select("note_path").distinct().join(t.notes(spark, d).select(F.col("path").alias("note_path")), "note_path", "left_anti")


@query(sql("SELECT DISTINCT path FROM v_notes n JOIN triples t ON t.note_path = n.path WHERE t.content_hash <> n.content_hash"))
def stale_facts(spark: SparkSession, d: str) -> DataFrame:
    """Notes with facts taken from another revision."""
    f = t.table(spark, d, "triples").select(F.col("note_path").alias("path"), F.col("content_hash").alias("was")).distinct()
    return t.notes(spark, d).join(f, "path").where("was <> content_hash").select("path").distinct()


_FAIL = "SELECT note_path, count(*) AS attempts, max(detected_at) AS last_attempt_at FROM v_errors GROUP BY 1"


@query(sql("SELECT note_path, attempts, next_retry_at FROM (SELECT *, last_attempt_at + [1, 6, 24, 72, 168][least(attempts, 5)] * INTERVAL 1 HOUR AS next_retry_at FROM f) WHERE next_retry_at <= TIMESTAMP '2024-02-05'", f=_FAIL))
def retry_due(spark: SparkSession, d: str) -> DataFrame:
    f = t.errors(spark, d).groupBy("note_path").agg(F.count(F.lit(1)).alias("attempts"), F.max("detected_at").alias("last_attempt_at"))
    return quality.retry_due(f, F.lit("2024-02-05").cast("timestamp_ntz")).select("note_path", "attempts", "next_retry_at")
