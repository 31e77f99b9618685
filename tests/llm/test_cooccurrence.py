import random
from collections import Counter
from itertools import combinations

from lectern.llm import cooccurrence as c

SCHEMA = "note_path string, subject string, object string, n int, item string"


def rows(df):
    return {(r["entity_a"], r["entity_b"]): r["weight"] for r in df.collect()}


def brute(baskets):
    out = Counter()
    for items in baskets.values():
        out.update(combinations(sorted(items), 2))
    return out


def test_pairs_of_dirty_triples(spark):
    t = [("a", " X ", "y", 1, "z"), ("a", "x", "Y", 1, "z"), ("b", "x", "y", 1, "z"), (None, "x", "y", 1, "z"), ("c", "", "x", 1, "z"), ("c", None, "   ", 1, "z"), ("d", "x", "x", 1, "z")]
    assert rows(c.entity_pairs(spark.createDataFrame(t, SCHEMA))) == {("x", "y"): 2}


def test_empty(spark):
    assert c.entity_pairs(spark.createDataFrame([], SCHEMA), 3, 5.0).count() == 0


def test_thresholds_equal_a_filter_of_all_pairs(spark):
    rnd = random.Random(1)
    t = [(f"n{rnd.randrange(60)}", f"e{int(rnd.random() ** 2 * 30)}", f"e{int(rnd.random() ** 2 * 30)}", 0, "") for _ in range(400)]
    df = spark.createDataFrame(t, SCHEMA)
    every = c.entity_pairs(df).collect()
    want = {(r["entity_a"], r["entity_b"]) for r in every if r["weight"] >= 3 and r["ratio"] >= 2 - 1e-9}
    got = {(r["entity_a"], r["entity_b"]) for r in c.entity_pairs(df, 3, 2.0).collect()}
    assert got == want and want


def test_large_basket_is_split_exactly(spark, monkeypatch):
    monkeypatch.setattr(c, "BLOCK", 7)
    items = [f"i{k:03}" for k in range(60)]
    e = spark.createDataFrame([("b", i, 1) for i in items], "basket string, item string, sign int")
    got = {(r["a"], r["b"]): r["n"] for r in c.pair_deltas(e).collect()}
    assert got == dict.fromkeys(combinations(items, 2), 1)


def test_updates_equal_a_fresh_load(spark):
    rnd = random.Random(3)
    baskets = {f"b{k}": {f"i{rnd.randrange(12)}" for _ in range(rnd.randrange(1, 6))} for k in range(25)}
    for support, share in ((1, 1.0), (3, 0.4)):
        state = {k: set(v) for k, v in baskets.items()}
        index = c.PairIndex(spark, support, share)
        index.update(spark.createDataFrame([(k, i) for k, v in state.items() for i in v], "basket string, item string"))
        for change in ({"b1": {"i1", "i2"}, "b2": set(), "new": {"i0", "i3", "i11"}}, {"new": {"i5"}, "b7": {"i1", "i2", "i3"}}):
            affected = index.update(spark.createDataFrame([(k, i) for k, v in change.items() for i in (v or [None])], "basket string, item string"))
            state.update(change)
            n = Counter(i for v in state.values() for i in v)
            total = sum(1 for v in state.values() if v)
            ok = {i for i, m in n.items() if support <= m <= share * total + 1e-6}
            want = {p: k for p, k in brute({b: v & ok for b, v in state.items()}).items()}
            got = {(r["a"], r["b"]): (r["n"], r["n_a"], r["n_b"]) for r in index.scores().collect()}
            assert got == {(a, b): (k, n[a], n[b]) for (a, b), k in want.items()}
            assert index.total == total
            assert affected.count() <= len(got)


def test_an_update_rewrites_few_buckets_and_a_session_reopens_the_state(spark, tmp_path):
    rnd = random.Random(4)
    baskets = [(f"b{k}", f"i{rnd.randrange(60)}") for k in range(150) for _ in range(6)]
    index = c.PairIndex(spark, buckets=dict.fromkeys(c.SCHEMAS, 40), root=f"file://{tmp_path}/index")
    index.update(spark.createDataFrame(baskets, "basket string, item string"))
    was = dict(index.files["pairs"])
    index.update(spark.createDataFrame([("b7", "i1"), ("b7", "i2")], "basket string, item string"))
    moved = [b for b in was if index.files["pairs"].get(b) != was[b]]
    assert 0 < len(moved) < len(was)
    index.update(spark.createDataFrame([("b7", "i1"), ("b7", "i3")], "basket string, item string"))
    assert len([b for b in was if index.files["pairs"].get(b, "").split("/")[-2:-1] == ["pairs-000000003"]]) <= 0.05 * len(was)
    again = c.PairIndex.open(spark, index.root)
    assert again.total == index.total == 150 and again.version == 3
    assert sorted(again.scores().collect()) == sorted(index.scores().collect())
    names = {f.name for f in (tmp_path / "index").iterdir() if f.name.startswith("manifest")}
    assert names == {"manifest-000000003.json"}
    before = again.total
    try:
        again.update(spark.createDataFrame([("b8", 1)], "basket string, wrong int"))
    except Exception:
        pass
    assert again.total == before and c.PairIndex.open(spark, index.root).version == 3
