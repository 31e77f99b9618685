import random

from lectern.llm import leakage as k

DOCS = "doc_id long, text string, item_id int, start string"
ITEMS = "item_id long, text string, doc_id int"


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 0, "") for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, 0) for i, t in items], ITEMS)
    return k.leaked_spans(d, b, **kw)


def pairs(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def words(a, b):
    return [f"w{i}" for i in range(a, b)]


def test_thirteen_words(spark):
    item = " ".join(words(0, 20))
    docs = [(1, "Intro. " + ", ".join(words(3, 16)).upper() + " end"), (2, " ".join(words(3, 15))), (3, None), (4, ""), (5, " ".join(words(0, 12) + ["x"] + words(12, 20))), (6, item + " " + item)]
    items = [(7, item), (8, None), (9, "too short"), (10, item), (7, item)]
    assert pairs(run(spark, docs, items)) == {(1, 7), (1, 10), (6, 7), (6, 10)}
    spans = [r for r in run(spark, docs, items).collect() if r["doc_id"] == 6 and r["item_id"] == 7]
    assert len(spans) == 2


def test_empty(spark):
    assert run(spark, [], [(1, " ".join(words(0, 20)))]).count() == 0
    assert run(spark, [(1, "a b c")], []).count() == 0


def test_blocks_of_items_equal_one_set(spark):
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(50)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(40)]
    docs = [(i, " ".join(rnd.choices(vocab, k=40) + items[i % 40][1].split()[i % 9 : i % 9 + 8 + i % 10])) for i in range(120)]

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 13]) for i in range(len(w) - 12)}

    want = {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}
    assert pairs(run(spark, docs, items)) == want and want
    assert pairs(run(spark, docs, items, max_broadcast_chars=500)) == want


def test_spans_are_cut(spark):
    leak = " ".join(words(0, 15))
    d = spark.createDataFrame([(1, f"before {leak} after " + "filler " * 60), (2, leak + " x"), (3, "İ " * 3 + leak + " İ" * 200)], "doc_id long, text string")
    b = spark.createDataFrame([(9, leak)], "item_id long, text string")
    got = {r["doc_id"]: r for r in k.decontaminated(d, b).collect()}
    assert got[1]["text"].startswith("before  after") and not got[1]["dropped"]
    assert got[2]["dropped"] and got[2]["text"] is None
    assert leak not in got[3]["text"] and got[3]["removed"] == len(leak)


def test_joined_items_equal_broadcast_ones(spark):
    """Beyond the bound: the same spans, from one scan of the documents."""
    item = " ".join(words(0, 20))
    docs = [(1, "Intro. " + ", ".join(words(3, 16)).upper() + " end"), (3, None), (4, ""), (5, "İ " + " ".join(words(0, 13) + ["x"] + words(2, 20))), (6, item + " " + item), (6, "y " + item), (6, item + " " + item)]
    items = [(7, item), (8, None), (9, "too short"), (10, item), (7, item), (11, " ".join(words(2, 18)))]
    spans = lambda **kw: sorted(tuple(r) for r in run(spark, docs, items, **kw).select("doc_id", "item_id", "start", "end").collect())
    assert spans(max_broadcast_chars=10) == spans() and len(spans()) > 8
    plan = run(spark, docs, items, max_broadcast_chars=10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert run(spark, [], items, max_broadcast_chars=10).count() == 0
