from pyspark.sql import functions as F

from lectern.engine import Engine
from lectern.functions import models
from lectern.operators import assemble

TEXTS = {"a/apple.md": "apple fruit harvest orchard", "b/banana.md": "banana fruit harvest tropics", "c/cherry.md": "cherry fruit harvest blossom"}


def engine(spark):
    chunks = spark.createDataFrame([(i, p, "# H", t, 0) for i, (p, t) in enumerate(TEXTS.items())], "chunk_id long, note_path string, heading_path string, content string, position int")
    vectors = models.embed(chunks, "content", "vec").select("chunk_id", "note_path", "vec")
    notes = spark.createDataFrame([(p, None, None) for p in TEXTS], "path string, title string, updated_at timestamp_ntz")
    edges = spark.createDataFrame([("a/apple.md", "b/banana.md")], "source_path string, target_path string")
    facts = spark.createDataFrame([(1, "a/apple.md", "apple", "is a", "fruit", "apple is a fruit"), (2, "b/banana.md", "banana", "is a", "fruit", "banana is a fruit")], "triple_id long, note_path string, subject string, predicate string, object string, triple_text string")
    m = spark.createDataFrame([(1, "pick the apple in autumn", "bug", "a", "2024-01-01", None), (2, "old news", "bug", None, "2024-01-01", "2024-01-02")], "memory_id long, content string, entity_type string, workspace string, created_at string, expires_at string").withColumn("expires_at", F.col("expires_at").cast("timestamp_ntz"))
    return Engine(spark, {"chunks": chunks, "vectors": vectors, "notes": notes, "edges": edges, "triples": facts, "memories": m}, "2024-06-01")


def test_search_modes(spark):
    e = engine(spark)
    first = lambda name, **kw: e.query(name, **kw).orderBy("place").first()
    assert first("search", text="banana harvest", top_k=2)["note_path"] == "b/banana.md"
    word = first("search", text="banana", mode="keyword")
    assert (word["note_path"], word["score"], word["title"]) == ("b/banana.md", 0.0, "b/banana.md")
    assert first("search", text="cherry blossom", mode="semantic")["note_path"] == "c/cherry.md"
    assert e.query("search", text="nothingmatches", top_k=2).count() == 2
    assert {r["note_path"] for r in e.query("search", text="fruit", workspace="/C/").collect()} == {"c/cherry.md"}
    assert first("search", text="apple", ablate=("convergence", "hotness"))["note_path"] == "a/apple.md"


def test_other_queries(spark):
    e = engine(spark)
    assert e.query("ask", text="apple orchard", top_k=1).first()["cited"] == ["a/apple.md"]
    assert [r["subject"] for r in e.query("triples", text="banana").collect()] == ["banana"]
    assert e.query("tiered", text="banana fruit").orderBy(F.desc("score")).first()["note_path"] == "b/banana.md"
    assert e.query("related", note="a/apple.md", top_k=1).count() == 1
    assert {r["path"] for r in e.query("neighbourhood", note="a/apple").collect()} == {"a/apple.md", "b/banana.md"}
    assert [r["memory_id"] for r in e.query("memories").collect()] == [1]
    assert [r["memory_id"] for r in e.query("memories", text="apple autumn").collect()] == [1]
    assert len(Engine.names()) >= 15


def test_context_budget(spark):
    rows = lambda n, size: spark.createDataFrame([(i, "x" * size) for i in range(n)], "place long, text string")
    got = assemble.context({"memories": rows(9, 80), "facts": rows(9, 40), "notes": rows(2, 4000)}, 100).groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in got} == {"memories": 2, "facts": 2, "notes": 1}


def test_facts_of_answers():
    one = {"s": "a", "p": "b", "o": "c"}
    for raw in ('[{"s":"a","p":"b","o":"c"}]', '```json\n{"triples": [{"s":"a","p":"b","o":"c"}, {"s":"a","p":"","o":"c"}]}\n```', 'Sure: [{"subject":"a","predicate":" b ","object":"c"}] done'):
        assert models.parse_facts(raw) == [one]
    assert models.parse_facts("no json") == models.parse_facts(None) == models.parse_facts("[broken") == []
    assert models.query_lines("1. first\n- second\n\n* \"third\"", 2) == ["first", "second"]


def test_embedding(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id long, t string")
    got = {r["id"]: r["v"] for r in models.embed(df, "t", "v").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] is None and not any(got[3])
    own = {r["id"]: r["v"] for r in models.embed(df, "t", "v", lambda ts: [[float(len(t))] for t in ts], 1).collect()}
    assert own[1] == [3.0] and own[3] == [0.0]
    cache = spark.createDataFrame([], "hash string, vec array<double>")
    out, new = models.embed_missing(df, "t", cache)
    assert new.count() == 2 and models.embed_missing(df, "t", new)[1].count() == 0 and out.count() == 3


def test_saving_and_harvest(spark):
    now = F.lit("2024-06-01").cast("timestamp_ntz")
    old = models.embed(spark.createDataFrame([(1, "the deploy pipeline failed because of secrets", "bug")], "memory_id long, content string, entity_type string"), "content", "mvec")
    new = models.embed(spark.createDataFrame([(2, "the deploy pipeline failed because of secrets", None, "bug", "/w/", 2.0), (3, "other", None, "nonsense", None, None)], "memory_id long, content string, tags array<string>, entity_type string, workspace string, ttl_hours double"), "content", "mvec")
    rows, dup = assemble.save_memories(new, old, now)
    r = rows.collect()
    assert len(r) == 1 and r[0]["workspace"] == "w" and r[0]["expires_at"].hour == 2
    assert [(d["query_id"], d["memory_id"]) for d in dup.collect()] == [(2, 1)]
    m = spark.createDataFrame([("s", 1, "assistant", "The root cause was a wrong path in src/app/main.py and more"), ("s", 2, "user", "<tag> root cause of everything that was ever wrong"), ("s", 3, "user", "short")], "session string, pos long, role string, text string")
    h = assemble.harvest(m, old.select("memory_id", "content", "entity_type")).collect()
    assert [(x["pos"], x["entity_type"], x["duplicate"]) for x in h] == [(1, "bug", False)] and "py" in h[0]["tags"]


def test_community_search_and_labels(spark):
    s = spark.createDataFrame([("c1", 0, "x", [1.0, 0.0]), ("c2", 0, "y", [0.0, 1.0]), ("c3", 1, "z", [1.0, 0.1])], "community_id string, level int, summary string, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, qvec array<double>")
    mem = spark.createDataFrame([("c2", "work/a.md"), ("c1", "home/b.md")], "community_id string, note_path string")
    assert [r["community_id"] for r in assemble.communities(s, q).collect()] == ["c1"]
    assert assemble.communities(s, q, members=mem, workspace="work", floor=-1).first()["community_id"] == "c2"
    assert assemble.communities(s, q, level=7).count() == 2
    n = spark.createDataFrame([("a", "Title A"), ("b", "Title B"), ("c", None)], "path string, title string")
    su = spark.createDataFrame([("a", "This is the first sentence. More.")], "note_path string, summary string")
    assert {(r["query"], r["target"]) for r in assemble.auto_labels(n, su).collect()} == {("This is the first sentence.", "a"), ("Title B", "b")}


def test_workspace_is_filtered_before_the_best_facts_are_kept(spark):
    rows = [(i, "out/a.md", "apple", "is", "x", "apple apple") for i in range(40)] + [(100 + i, "in/b.md", "apple", "is", "y", "apple and some more words") for i in range(5)]
    facts = spark.createDataFrame(rows, "triple_id long, note_path string, subject string, predicate string, object string, triple_text string")
    assert Engine(spark, {"triples": facts}, "2024-06-01").query("triples", text="apple", workspace="in").count() == 5


def test_facts_are_ranked_by_words_and_vectors(spark):
    rows = [(1, "a.md", "apple", "is", "red", "apple is red", [0.0, 1.0]), (2, "b.md", "apple", "is", "ripe", "apple is ripe and sweet today", [1.0, 0.0]), (3, "c.md", "pear", "is", "green", "pear is green", [0.6, 0.8])]
    facts = spark.createDataFrame(rows, "triple_id long, note_path string, subject string, predicate string, object string, triple_text string, vec array<double>")
    e = Engine(spark, {"triples": facts}, "2024-06-01", embedder=lambda texts: [[1.0, 0.0] for _ in texts])
    paths = lambda **kw: [r["note_path"] for r in e.query("triples", **kw).collect()]
    assert paths(text="apple") == ["b.md", "a.md"]
    assert paths(text="apple", mode="keyword") == ["a.md", "b.md"]
    assert paths(text="nothingmatches", top_k=2) == ["b.md", "c.md"]
    assert paths(text="apple", mode="semantic", workspace="/c.md/") == []
