"""Logs, summaries, sessions and numbering; what the entry point and the shared folder do without their needs."""

import subprocess
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.operators import lifecycle as c
from lectern.operators import quality
from lectern.operators.sequence import numbered


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_numbering_spans_partitions(spark):
    data = [(f"k{i % 3}" if i % 10 else None, (i * 7919) % 1000, i) for i in range(1000)] + [("hot", i // 2, 5000 + i) for i in range(600)]
    df = spark.createDataFrame(data, "key string, at int, id int")
    want = set()
    for key in {k for k, _, _ in data}:
        mine = sorted((a, i) for k, a, i in data if k == key)
        want |= {(key, a, i, n + 1) for n, (a, i) in enumerate(mine)}
    assert {tuple(r) for r in numbered(df, "key", "at", "id").collect()} == want
    assert [r["nth"] for r in numbered(df, None, "id").orderBy("id").collect()] == list(range(1, 1601))
    assert numbered(df.limit(0), "key", "at").count() == 0
    assert [r["fold"] for r in quality.interleaved(spark.range(7).toDF("query_id")).orderBy("query_id").collect()] == [0, 1, 0, 1, 0, 1, 0]


def test_rate_limit_walks_each_key(spark):
    at = lambda m: datetime(2024, 1, 1, m // 60, m % 60)
    e = spark.createDataFrame([("n", "a", at(m)) for m in (0, 59, 60, 61, 121, 121, 240)] + [("n", "b", at(30)), (None, "a", at(1)), (None, "a", at(2))], "note_path string, error_type string, detected_at timestamp_ntz")
    got = [(r["note_path"], r["error_type"], r["detected_at"]) for r in quality.rate_limited(e).collect()]
    assert sorted(got, key=repr) == sorted([("n", "a", at(m)) for m in (0, 60, 121, 240)] + [("n", "b", at(30)), (None, "a", at(1))], key=repr)


def test_logs_and_sessions(spark):
    at = datetime(2024, 5, 1)
    log = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    assert rows(c.newest(c.recorded(log, spark.createDataFrame([("c", 3), ("a", 1)], log.schema)), 2, F.desc("n"))) == [("b", 2), ("c", 3)]
    s = spark.createDataFrame([("x", "p", at, None), ("y", "p", at, at)], "session_id string, project string, started_at timestamp_ntz, ended_at timestamp_ntz")
    new = spark.createDataFrame([("x", "q", at), ("z", None, at)], "session_id string, project string, started_at timestamp_ntz")
    later = F.lit("2025-01-01").cast("timestamp_ntz")
    done = c.ended(c.started(s, new), new.select("session_id"), later)
    assert {(r["session_id"], r["ended_at"].year) for r in done.collect()} == {("x", 2025), ("y", 2024), ("z", 2025)}
    e = spark.createDataFrame([("a", None), ("b", None), ("c", at)], "path string, resolved_at timestamp_ntz")
    assert {(r[0], r[1] and r[1].year) for r in c.closed(e, F.col("path") != "b", later).collect()} == {("a", 2025), ("b", None), ("c", 2024)}


def test_summaries_and_states(spark):
    notes = spark.createDataFrame([("a", "A", "1"), ("b", None, "2"), ("c", "C", None)], "path string, title string, content_hash string")
    summ = spark.createDataFrame([("a", "of a", "0"), ("c", "of c", None)], "path string, summary string, content_hash string")
    assert rows(c.missing_summaries(notes, summ).select("path")) == [("b",)]
    assert rows(c.stale_summaries(notes, summ)) == [("a", "0", "1")]
    asked = spark.createDataFrame([("a",), ("a",), ("b",), ("nowhere",)], "path string")
    assert rows(c.looked_up(asked, notes.withColumn("title", F.coalesce("title", F.lit("B"))), summ)) == [("a", "of a", "summary"), ("b", "B", "title"), ("nowhere", None, "missing")]
    files = spark.createDataFrame([("f", 2.0), ("g", 2.0), ("h", 1.0)], "key string, mtime double")
    assert rows(c.harvest_due(files, spark.createDataFrame([("f", 1.0), ("h", 1.0)], "key string, harvested double"))) == [("f", 2.0), ("g", 2.0)]
    none = spark.createDataFrame([], "updated_at timestamp_ntz")
    assert rows(c.rebuild_due(none, F.lit("2024-01-01").cast("timestamp_ntz"))) == [(0, 0, False)]


def test_facts_follow_their_notes(spark):
    facts = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "b", 4)], "query_id int, note_path string, pos int")
    ranked = spark.createDataFrame([(1, "c", 1), (1, "b", 2)], "query_id int, note_path string, place int")
    assert [r["pos"] for r in c.follow_notes(facts, ranked).orderBy("at").collect()] == [3, 2, 4, 1]


def test_a_missing_dependency_costs_only_its_queries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(k.startswith('p1_') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300)


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Spark:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Spark())
