import math
import random

from pyspark.sql import functions as F

from lectern.operators import bm25, quality, rank, transcripts, tune
from lectern.operators.vectors import vector_topk

DOCS = ["gamma related content here", "gamma gamma alpha beta", "delta epsilon zeta", "foo-bar baz café", "unrelated words entirely in this longer doc gamma", "alpha only"]


def search(spark, text, **kw):
    d = spark.createDataFrame([(i + 1, t) for i, t in enumerate(DOCS)] + [(7, None)], "id long, body string")
    q = spark.createDataFrame([(1, text)], "query_id long, text string")
    return {r["doc"]: r["rank"] for r in bm25.bm25(d, "id", "body", q, **kw).collect()}


def test_known_scores(spark):
    got = search(spark, "gamma alpha")
    want = {1: -1.01664e-06, 2: -0.5975664, 5: -7.26552e-07, 6: -0.7466112}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-5) for k in want)


def test_phrases_multiplicity_and_odd_words(spark):
    assert set(search(spark, '"foo-bar"')) == {4} and search(spark, "bar-foo") == {}
    once, twice = search(spark, "alpha"), search(spark, "alpha alpha")
    assert all(math.isclose(twice[k], 2 * once[k]) for k in once)
    assert search(spark, "!!! -gamma") == {} and search(spark, "") == {}
    assert set(search(spark, "gamma alpha", match_all=True)) == {2}
    assert list(search(spark, "gamma alpha", limit=1)) == [6]


def test_vector_topk_equals_sorting(spark):
    rnd = random.Random(0)
    v = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(60)] + [(100, [1.0] * 8), (101, [1.0] * 8)]
    q = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(5)] + [(9, [1.0] * 8)]
    vs, qs = spark.createDataFrame(v, "chunk_id long, vec array<double>"), spark.createDataFrame(q, "query_id long, qvec array<double>")

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6)

    want = {(i, c) for i, a in q for c, _ in sorted(((c, cos(a, b)) for c, b in v), key=lambda p: (-p[1], p[0]))[:3]}
    for bound in (100, 2):
        assert {(r["query_id"], r["chunk_id"]) for r in vector_topk(vs, qs, 3, max_queries=bound).collect()} == want
    assert vector_topk(vs.limit(0), qs, 3).count() == 0


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id long, chunk_id long, note_path string, heading_path string, content string, vec array<double>, rank double, pos long, qvec array<double>")


def unit(angle):
    return [math.cos(angle), math.sin(angle)]


def test_link_dump_ranks_below_prose_only_with_the_penalty(spark):
    q = unit(0)
    rows = [(1, 1, "a.md", "# A", "substantive prose", unit(math.acos(0.7)), -1.0, 1, q), (1, 2, "b.md", "# B > ## Related", "[[x]] [[y]] [[z]]", unit(-math.acos(0.9)), -1.0, 2, q)]
    c = candidates(spark, rows)
    first = lambda w: rank.hybrid(c, None, rank.Evidence(), w).where("place = 1").first()["note_path"]
    assert first(rank.Weights(link_penalty=1.0)) == "b.md" and first(rank.Weights(link_penalty=0.5)) == "a.md"
    ablated = rank.hybrid(c, None, rank.Evidence(ablate=frozenset({"link_section"})))
    assert {(r["note_path"], r["score"]) for r in ablated.collect()} == {(r["note_path"], r["score"]) for r in rank.hybrid(c, None, rank.Evidence(), rank.Weights(link_penalty=1.0)).collect()}


def test_hotness(spark):
    u = spark.createDataFrame([("a", "2024-01-31"), ("b", "2024-01-31"), ("b", "2024-01-01"), ("c", "2024-01-01")], "note_path string, used_at string").withColumn("used_at", F.col("used_at").cast("timestamp_ntz"))
    h = {r["note_path"]: r["hotness"] for r in rank.hotness(u, F.lit("2024-01-31").cast("timestamp_ntz")).collect()}
    assert math.isclose(h["a"], 2 / 3) and h["b"] > h["a"] and math.isclose(h["c"], 1 / 3)


def test_inhibition_and_error_demotion(spark):
    q = unit(0)
    rows = [(1, 1, "a", "", "x", unit(0.1), -1.0, 1, q), (1, 2, "b", "", "x", unit(0.11), -1.0, 2, q), (1, 3, "c", "", "x", unit(-1.2), -1.0, 3, q)]
    base = rank.best_per_note(rank.base_scores(candidates(spark, rows)), 15)
    before = {r["note_path"]: r["score"] for r in base.collect()}
    after = {r["note_path"]: r["score"] for r in rank.inhibition_stage(base, rank.Weights()).collect()}
    assert after["a"] == before["a"] and math.isclose(after["b"], before["b"] * (1 - 0.3 * math.cos(0.01)), rel_tol=1e-6) and after["c"] == before["c"]
    e = spark.createDataFrame([("a",), ("a",), ("b",)], "note_path string")
    low = {r["note_path"]: r["score"] for r in rank.error_stage(base, e).collect()}
    assert math.isclose(low["a"], before["a"] / 1.2) and low["b"] == before["b"]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a/x.md", 1), (1, "b/y.md", 2), (1, "c/z.md", 3), (2, "q.md", 1)], "query_id long, path string, place long")
    labels = spark.createDataFrame([(1, "B/"), (1, "none"), (2, "other"), (3, "x")], "query_id long, target string")
    m = {r["query_id"]: r for r in quality.metrics(ranked, labels).collect()}
    assert (m[1]["recall"], m[1]["mrr"]) == (0.5, 0.5) and math.isclose(m[1]["ndcg"], (1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert m[2]["recall"] == m[2]["mrr"] == m[2]["ndcg"] == m[3]["recall"] == 0


def test_budget_keeps_the_first(spark):
    e = spark.createDataFrame([(1, 1, 900), (1, 2, 10), (2, 1, 40), (2, 2, 50), (2, 3, 20)], "query_id long, place long, cost long")
    assert {(r["query_id"], r["place"]) for r in quality.within_budget(e, 100).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_normalize_and_merge(spark):
    s = spark.createDataFrame([(1, "a", 2.0), (1, "b", -1.0), (1, "a", 1.0), (2, "c", -3.0)], "query_id long, note_path string, score double")
    assert {(r["note_path"], r["score"]) for r in tune.normalize(s).collect()} == {("a", 1.0), ("b", 0.0), ("c", 0.0)}
    f = spark.createDataFrame([(1, "b", 1.0), (1, "z", 0.25)], "query_id long, note_path string, score double")
    got = [(r["note_path"], r["score"]) for r in tune.merge_tiers(f, tune.normalize(s).where("query_id = 1")).orderBy(F.desc("score")).collect()]
    assert got == [("b", 1.0), ("a", 0.5), ("z", 0.25)]
    assert tune.route(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.1), (2, "a", 0.9)], "query_id long, note_path string, score double")).where("use_facts").count() == 1


def test_transcript_search(spark):
    m = spark.createDataFrame([(1, "s", "user", "We deployed the archives", "2024"), (2, "s", "user", "deploy later", "2024"), (3, "s", "ai", "nothing here", "2024"), (4, "s", "user", None, "2024")], "id long, session_id string, role string, content string, timestamp string")
    hits = {r["id"]: r["highlighted"] for r in transcripts.search(m, "deploying").collect()}
    assert set(hits) == {1, 2} and hits[1] == "We >>>deployed<<< the archives"
    assert [r["id"] for r in transcripts.search(m, "deploy NOT archive").collect()] == [2]
    assert [r["id"] for r in transcripts.search(m, '"deploys later"').collect()] == [2]
    assert transcripts.search(m, "").count() == 0
