from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import memory, quality

def now():
    return F.lit("2024-06-01").cast("timestamp_ntz")

SCHEMA = "memory_id long, content string, tags array<string>, entity_type string, workspace string, updated_at timestamp_ntz, created_at timestamp_ntz, expires_at timestamp_ntz, revision_count int, merge_count int, merged_from array<long>, embed_pending boolean"


def at(s):
    return datetime.fromisoformat(s) if s else None


def rows(spark, *items):
    return spark.createDataFrame([(i, c, tags, kind, ws, None, at(made), at(until), 1, 0, None, False) for i, c, tags, kind, ws, made, until in items], SCHEMA)


def test_validity_workspace_and_pruning(spark):
    m = rows(spark, (1, "a", None, "bug", "/work/", "2024-05-01", None), (2, "b", None, "bug", "work/x", "2023-01-01", "2024-06-02"), (3, "c", None, "context", "workshop", "2024-05-30", "2024-06-01"), (4, "d", None, "bug", None, "2024-05-30", None))
    assert {r[0] for r in m.where(memory.valid(now())).select("memory_id").collect()} == {1, 2, 4}
    assert {r[0] for r in m.where(memory.in_workspace(F.col("workspace"), "work")).select("memory_id").collect()} == {1, 2}
    assert {r["memory_id"] for r in memory.prune(m, now(), 90).collect()} == {1, 4}
    assert {r["entity_type"]: (r["total"], r["expired"]) for r in memory.stats(m, now()).collect()} == {"bug": (3, 0), "context": (1, 1)}


def test_update(spark):
    m = rows(spark, (1, "a", ["x", "y"], "context", None, "2024-05-01", "2024-06-02"), (2, "b", None, "bug", None, "2024-05-01", None))
    e = spark.createDataFrame([(1, None, None, ["z"], ["x"], "bug", 0), (3, "no such", None, None, None, None, None)], "memory_id long, content string, tags array<string>, add_tags array<string>, remove_tags array<string>, entity_type string, ttl_hours int")
    got = {r["memory_id"]: r for r in memory.update(m, e, now()).collect()}
    assert (got[1]["tags"], got[1]["entity_type"], got[1]["expires_at"], got[1]["revision_count"], got[1]["content"]) == (["y", "z"], "bug", None, 2, "a")
    assert set(got) == {1, 2} and got[2]["revision_count"] == 1 and got[2]["updated_at"] is None


def test_merge(spark):
    m = rows(spark, (1, "short text", ["a", "b"], "observation", None, "2024-05-01", None), (2, "a text that is much longer", ["b", "c"], "bug", None, "2024-05-01", None))
    p = m.where("memory_id = 1").select(F.struct("*").alias("t")).crossJoin(m.where("memory_id = 2").select(F.struct("*").alias("s")))
    r = p.select(*[c.alias(n) for n, c in memory.merge().items()]).first()
    assert tuple(r) == ("a text that is much longer", ["a", "b", "c"], "bug", 1, [2], 2)


def test_current_state_of_events(spark):
    e = spark.createDataFrame([(1, "old", 1, False), (1, "new", 2, False), (2, "x", 1, False), (2, None, 5, True)], "memory_id long, content string, seq long, deleted boolean")
    assert [tuple(r) for r in memory.current(e).collect()] == [(1, "new")]


def test_similar_and_tags(spark):
    m = rows(spark, (1, "deploy pipeline failed because of secrets", ["ops"], "bug", None, "2024-05-01", None), (2, "the deploy pipeline needs secrets", ["ops", "ci"], "bug", None, "2024-05-01", None), (3, "lunch menu", ["food"], "bug", None, "2024-05-01", None))
    q = spark.createDataFrame([(10, "deploy pipeline secrets in infra/app.py")], "query_id long, text string")
    assert {r["memory_id"] for r in memory.similar_by_text(m, q).collect()} == {1, 2}
    assert {r["tag"]: r["weight"] for r in memory.suggest_tags(m, q).collect()} == {"ops": 2, "ci": 1, "infra": 2, "py": 2}


def test_drift(spark):
    m = rows(spark, (1, "x is a blocker in [[project]]", None, "bug", None, "2024-05-01", None), (2, "about [[other]]", None, "bug", None, "2024-05-01", None))
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0])], "memory_id long, mvec array<double>")
    n = spark.createDataFrame([("a/project.md",), ("a/other.md",)], "path string")
    c = spark.createDataFrame([("a/project.md", [0.0, 1.0]), ("a/other.md", [0.0, 1.0]), ("a/other.md", [1.0, 0.1])], "note_path string, vec array<double>")
    found = memory.drift(m, v, n, c)
    assert [(r["memory_id"], r["note_path"]) for r in found.collect()] == [(1, "a/project.md")]
    opened = spark.createDataFrame([(1, "a/project.md", 0.5)], "memory_id long, note_path string, cosine_distance double")
    assert memory.drift_log(opened, found).count() == 1


def ts(spark, rows_, names):
    df = spark.createDataFrame(rows_, names)
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in df.columns if c.endswith("_at")})


def test_attribution(spark):
    s = ts(spark, [(1, ["a", "b"], "2024-01-01 10:00:00"), (1, ["b", "a"], "2024-01-01 10:20:00"), (2, ["a"], "2024-01-01 10:00:00")], "key long, shown array<string>, searched_at string")
    u = ts(spark, [(1, "a", "2024-01-01 10:25:00"), (1, "a", "2024-01-01 10:25:00"), (1, "c", "2024-01-01 10:25:00"), (2, "a", "2024-01-01 12:00:00"), (1, "b", "2024-01-01 10:50:00")], "key long, path string, used_at string")
    got = {(r["key"], r["path"]): (r["rank"], r["searched_at"].minute) for r in quality.attribute(u, s).collect()}
    assert got == {(1, "a"): (2, 20), (1, "b"): (1, 20)}


def test_rate_limit_and_reports(spark):
    e = ts(spark, [("n", "low", 0.5, f"2024-01-01 {h}") for h in ("10:00:00", "10:30:00", "11:00:00", "11:59:59", "12:00:00")] + [("m", "low", 0.9, "2024-01-01 10:00:00")], "note_path string, error_type string, cosine_distance double, detected_at string")
    assert [r["detected_at"].hour for r in quality.rate_limited(e).where("note_path = 'n'").orderBy("detected_at").collect()] == [10, 11, 12]
    assert [(r["note_path"], r["n"]) for r in quality.error_report(e).collect()] == [("n", 5)]
    k = spark.createDataFrame([(0.1, True, False), (0.4, False, True), (0.4, True, True), (0.4, False, False), (0.95, False, True)], "s double, inside boolean, given boolean")
    assert [r[0] for r in k.select(quality.classify_error(F.col("s"), F.col("inside"), F.col("given"))).collect()] == ["low_overlap", "contextual_mismatch", None, None, None]


def test_snapshots_folders_retries(spark):
    a = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "path string, content_hash string")
    b = spark.createDataFrame([("b", "9"), ("c", None), ("d", "4")], "path string, content_hash string")
    assert {tuple(r) for r in quality.snapshot_diff(a, b).collect()} == {("a", "added"), ("b", "modified"), ("d", "deleted")}
    p = spark.createDataFrame([("w/x/1.md",), ("w/2.md",), ("w/2.md",), ("root.md",)], "path string")
    assert {r["folder"]: r["n_notes"] for r in quality.folder_rollup(p).collect()} == {"w": 2, "w/x": 1}
    f = ts(spark, [("a", 1, "2024-05-31 22:30:00"), ("b", 9, "2024-05-20 00:00:00"), ("c", 1, "2024-05-31 23:30:00")], "note_path string, attempts int, last_attempt_at string")
    assert {r["note_path"] for r in quality.retry_due(f, now()).collect()} == {"a", "b"}
    fold = [r["fold"] for r in quality.interleaved(spark.range(1000).withColumnRenamed("id", "query_id")).collect()]
    assert abs(sum(fold) - 500) <= 32
