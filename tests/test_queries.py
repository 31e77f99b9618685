"""Registered queries against their SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
CHECKED = ["hybrid_full", "similarity_matrix", "pagerank_20", "feedback_attribution", "memory_merge", "demotion_status", "stream_rate_limit", "export_notes", "tiered_merge", "cooccurrence_incremental"]


@pytest.fixture(scope="module")
def db():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def rows(df):
    return sorted(map(repr, df[sorted(df.columns)].astype(str).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, db, name):
    got, want = entry.queries()[name](spark, DATA).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert rows(got) == rows(want.astype({c: t for c, t in got.dtypes.items() if str(t)[:5] in ("int64", "float")}))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_documented_or_named(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 80


def test_the_rest_needs_no_training_data_operators():
    import pathlib
    import re

    root = pathlib.Path(entry.__file__).parent / "lectern"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"\bllm\b", f.read_text()), f


def test_workspace_is_filtered_before_the_best_chunks_are_kept(spark):
    from lectern.operators import bm25
    from lectern.sources import tables as t

    c = t.chunks(spark, DATA)
    every = bm25.bm25(c, "chunk_id", "content", t.questions(spark, DATA).select("query_id", "text"), None).toPandas()
    inside = {r["chunk_id"] for r in c.where("lower(note_path) LIKE 'work/%'").collect()}
    every = every[every["doc"].isin(inside)].assign(key=lambda x: x["rank"].round(9)).sort_values(["query_id", "key", "doc"]).groupby("query_id").head(50)
    got = entry.queries()["keyword_workspace"](spark, DATA).toPandas()
    assert set(zip(got["query_id"], got["chunk_id"])) == set(zip(every["query_id"], every["doc"])) and len(got) == len(every)


def test_weight_search_is_the_whole_search(monkeypatch):
    from lectern.operators import tune

    monkeypatch.setattr(tune, "coordinate_ascent", lambda *a, **kw: (a, kw))
    assert entry.queries()["weight_search"]("spark", "dir") == (("spark", "dir"), {})
    assert list(tune.GRIDS) == ["convergence", "inhibition_strength", "inhibition_threshold", "hotness", "cooccurrence", "link_penalty"]
    assert tune.GRIDS["convergence"] == (0.0, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0) and tune.GRIDS["inhibition_threshold"][-1] == 0.95
