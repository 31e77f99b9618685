import math
import random

from lectern.operators import community, cooccur, graph


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def edges(spark, pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], "source_path string, target_path string")


def ranks(spark, names, pairs):
    return {r["path"]: r["pagerank"] for r in graph.pagerank(nodes(spark, names), edges(spark, pairs)).collect()}


def test_pagerank(spark):
    assert all(math.isclose(v, 1 / 3) for v in ranks(spark, "abc", ["ab", "bc", "ca"]).values())
    hub = ranks(spark, "abch", ["ah", "bh", "ch", "hx"])
    assert math.isclose(hub["a"], 0.0375) and math.isclose(hub["h"], 0.133125)
    assert ranks(spark, [], []) == {}


def test_gaps(spark):
    adj = graph.undirected(nodes(spark, "XYABC"), edges(spark, ["XA", "XB", "XC", "YA", "YB", "YC", "Aghost"[:1] + "Z"]))
    top = graph.structural_gaps(adj).first()
    assert (top["a"], top["b"], top["shared"]) == ("X", "Y", 3) and math.isclose(top["score"], 3 / math.log(2))


BARBELL = ["AB", "BC", "CA", "CD", "DE", "EF", "FG", "GE"]


def test_barbell(spark):
    n = nodes(spark, "ABCDEFG")
    adj = graph.undirected(n, edges(spark, BARBELL))
    for bound in (2_000_000, 1):
        b = {r["path"]: r["betweenness"] for r in graph.betweenness(n, adj, bound).collect()}
        assert math.isclose(b["D"], 9) and max(b, key=b.get) == "D" and b["A"] == 0
    cuts = {r["path"]: r["fragments"] for r in graph.articulation(n, adj, nodes(spark, "DA")).collect()}
    assert cuts == {"D": 2, "A": 1}


def test_components_and_neighbourhood(spark):
    rnd = random.Random(1)
    names = [f"n{i:03}" for i in range(80)]
    pairs = [tuple(rnd.sample(names, 2)) for _ in range(60)] + [(names[i], names[i + 1]) for i in range(30)]
    n, e = nodes(spark, names), edges(spark, pairs + [("n000", "gone")])
    adj = graph.undirected(n, e)
    near = {x: set() for x in names}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)

    def reach(s, depth=10**9):
        seen, front = {s: 0}, [s]
        while front and depth:
            front = [w for v in front for w in near[v] if w not in seen and not seen.setdefault(w, seen[v] + 1) is None]
            depth -= 1
        return seen

    got = {r["path"]: r["component"] for r in graph.components(n, adj).collect()}
    assert got == {x: min(reach(x)) for x in names}
    hops = {(r["start"], r["path"]): r["hops"] for r in graph.neighbourhood(adj, n.withColumnRenamed("path", "start"), 3).collect()}
    assert hops == {(s, v): h for s in names for v, h in reach(s, 3).items()}
    assert graph.components(n.limit(0), adj.limit(0)).count() == 0


def test_links_resolve_by_path_then_stem(spark):
    files = spark.createDataFrame([("research/a.md", "[[b]] [[research/c]] [[nowhere]] [[a]]"), ("x/b.md", "[[A|alias]] [[c#part]]"), ("research/c.md", None), ("z/b.md", "")], "path string, text string")
    got = {(r["source_path"], r["target_path"]) for r in graph.build_edges(files).collect()}
    assert got == {("research/a.md", "x/b.md"), ("research/a.md", "research/c.md"), ("x/b.md", "research/a.md")}


def triples(spark, rows):
    return spark.createDataFrame(rows, "note_path string, subject string, object string")


def state(spark, rows):
    return spark.createDataFrame(rows, "entity_a string, entity_b string, weight double, reinforcement double")


def table(df):
    return {(r["entity_a"], r["entity_b"]): (r["weight"], round(r["reinforcement"], 6)) for r in df.collect()}


def test_association(spark):
    t = triples(spark, [("n1", "a", "b"), ("n2", "a", "b"), ("n3", "a", "c"), ("n3", "b", "b")])
    old = state(spark, [("a", "b", 9.0, 2.0), ("x", "y", 4.0, 0.0), ("p", "q", 1.0, 3.0)])
    built = table(cooccur.rebuild(old, t))
    assert built == {("a", "b"): (3.0, 2.0), ("a", "c"): (1.0, 0.0), ("b", "c"): (1.0, 0.0), ("p", "q"): (0.0, 3.0)}
    again = cooccur.rebuild(cooccur.rebuild(old, t), t)
    assert table(again) == built
    used = spark.createDataFrame([("b", "a"), ("a", "b"), ("c", "z"), ("q", "q")], "entity_a string, entity_b string")
    assert table(cooccur.reinforce(again, used)) == built | {("a", "b"): (3.0, 2.2), ("c", "z"): (0.0, 1.0)}
    cap = cooccur.reinforce(state(spark, [("a", "b", 1.0, 99.0)]), used)
    assert table(cap)[("a", "b")] == (1.0, 100.0)


def test_incremental_equals_rebuild(spark):
    before = triples(spark, [("n1", "a", "c"), ("n2", "a", "b"), ("n3", "e", "f")])
    after = triples(spark, [("n1", "a", "d"), ("n2", "a", "b"), ("n3", "e", "f")])
    s = cooccur.rebuild(state(spark, []), before)
    changed = spark.createDataFrame([("n1",)], "note_path string")
    got = cooccur.upsert_notes(s, after, changed)
    assert {k: v for k, v in table(got).items() if v != (0.0, 0.0)} == table(cooccur.rebuild(state(spark, []), after))


def test_communities(spark):
    s = spark.createDataFrame([(a, b, 0.9) for g in ("abc", "def") for a in g for b in g if a < b], "a string, b string, value double")
    n = spark.createDataFrame([(x,) for x in "abcdef"], "note_path string")
    m = {r["note_path"]: r["community"] for r in community.attractor(s, n, 5.0, 50, True).collect()}
    assert len({m[x] for x in "abc"}) == len({m[x] for x in "def"}) == 1 and m["a"] != m["d"]
    two = spark.createDataFrame([("a", "b", 0.9), ("c", "d", 0.9)], "a string, b string, value double")
    split = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "2")], "note_path string, community string")
    lump = spark.createDataFrame([(x, "1") for x in "abcd"], "note_path string, community string")
    assert math.isclose(community.modularity(two, split).first()[0], 0.5) and math.isclose(community.modularity(two, lump).first()[0], 0, abs_tol=1e-12)
    assert community.iterations(200) == 50 and community.iterations(3001) == 15


def test_semantic_threshold_prunes(spark):
    v = [(f"a{i}", [1.0, 0.0]) for i in range(3)] + [(f"b{i}", [0.5, 3**0.5 / 2]) for i in range(3)]
    df = spark.createDataFrame(v, "note_path string, vec array<double>")
    for rows in (1024, 2):
        got = {(r["a"], r["b"]) for r in community.semantic_edges(df, block_rows=rows).collect()}
        assert got == {(x, y) for g in "ab" for x, y in ((f"{g}0", f"{g}1"), (f"{g}0", f"{g}2"), (f"{g}1", f"{g}2"))}
    folders = spark.createDataFrame([("work/a",), ("work/b",), ("home/c",), ("root.md",)], "note_path string")
    assert [(r["a"], r["b"]) for r in community.folder_edges(folders).collect()] == [("work/a", "work/b")]


def test_components_of_no_notes(spark):
    from lectern.operators import graph

    assert graph.components(spark.createDataFrame([], "path string"), spark.createDataFrame([], "a string, b string")).count() == 0
