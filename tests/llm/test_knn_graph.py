import os

import numpy as np
import pytest

from lectern.llm import knn_graph as g

SCHEMA = "chunk_id long, embedding array<float>, block int, sim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x") for i, e in rows], SCHEMA)


def test_recall_and_near_copies(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 64))
    x[700:720] = x[:20] + 0.02 * rng.normal(size=(20, 64))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows + rows[:50])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :10]
    graph = g.build_graph(df, "chunk_id", "embedding", leaf=200)
    got = {}
    for r in graph.neighbours(10).collect():
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert len(got) == 1500
    assert np.mean([len(set(truth[i]) & got[i]) / 10 for i in range(1500)]) > 0.9
    pairs = {tuple(r) for r in g.similar_pairs(df, "chunk_id", "embedding", 0.92, leaf=200).collect()}
    assert pairs == {(int(i), int(j)) for i, j in zip(*np.nonzero(s >= 0.92)) if i < j}
    found = {}
    for r in g.search(graph, df.where("chunk_id % 20 = 0"), "chunk_id", "embedding").collect():
        found.setdefault(r["id"], set()).add(r["neighbour"])
    assert len(found) == 75
    assert np.mean([len(set(truth[i]) & found[i]) / 10 for i in found]) > 0.9


def test_unusable_vectors_and_ties(spark):
    one = [1.0] + [0.0] * 63
    rows = [(1, one), (2, one), (3, [2 * v for v in one]), (4, None), (5, []), (6, [0.0] * 64), (7, [float("nan")] * 64), (8, [1.0] * 63), (9, [float("inf")] * 64), (None, one), (10, [0.0, 1.0] + [0.0] * 62), (11, [None] + [1.0] * 63)]
    df = frame(spark, rows)
    assert {tuple(r) for r in g.similar_pairs(df, "chunk_id", "embedding", 0.92).collect()} == {(1, 2), (1, 3), (2, 3)}


def test_empty(spark):
    assert g.similar_pairs(frame(spark, []), "chunk_id", "embedding", 0.9).count() == 0
    assert g.similar_pairs(frame(spark, [(1, [1.0] * 64)]), "chunk_id", "embedding", 0.9).count() == 0


def test_blocks_of_equal_vectors_are_divided(spark):
    df = frame(spark, [(i, [1.0] + [0.0] * 63) for i in range(300)])
    graph = g.build_graph(df, "chunk_id", "embedding", leaf=20, rounds=1)
    assert graph.state.count() >= 7
    assert graph.neighbours(10).groupBy("id").count().where("count = 10").count() == 300


def near_copies(n, seed=0, far=0):
    """Copies of one vector, all pairs of them at a cosine above 0.99 but none equal, and unrelated vectors."""
    rng = np.random.default_rng(seed)
    one = rng.normal(size=64)
    x = np.concatenate([one + np.linalg.norm(one) * 0.0066 * rng.normal(size=(n, 64)), rng.normal(size=(far, 64))]).astype(np.float32)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return x, s


def true_pairs(s, floor, top=10):
    order = np.argsort(-s, axis=1)[:, :top]
    return {(min(i, int(j)), max(i, int(j))) for i in range(len(s)) for j in order[i] if s[i, j] >= floor}


def test_a_hot_group_of_near_copies_is_ranked_by_exact_cosines(spark):
    x, s = near_copies(400, far=300)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    want = true_pairs(s, 0.92)
    assert {tuple(r) for r in g.similar_pairs(df, "chunk_id", "embedding", 0.92).collect()} == want
    near = {(r["id"], r["neighbour"]): r["rank"] for r in g.exact_neighbours(g.build_graph(df, "chunk_id", "embedding"), df, "chunk_id", "embedding").collect()}
    order = np.argsort(-s, axis=1)[:, :10]
    assert all(near[i, int(j)] == k + 1 for i in range(400) for k, j in enumerate(order[i]))


DATA = "/root/testdata/sf0.1/chunks.parquet"


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
@pytest.mark.parametrize("settings", [{}, {"leaf": 128}, {"leaf": 16, "sample_rows": 300}])
def test_recall_of_the_stored_table(spark, settings):
    """All chunks are indexed; those with an id divisible by 20 are compared with brute force."""
    df = spark.read.parquet(DATA)
    graph = g.build_graph(df, "chunk_id", "embedding", **settings)
    rows = g.prepare(df, "chunk_id", "embedding", 64).collect()
    ids = np.array([r["id"] for r in rows])
    x = np.stack([np.frombuffer(r["vec"], dtype=np.int8) for r in rows]).astype(np.float32) * np.array([r["scale"] for r in rows], dtype=np.float32)[:, None]
    place = {int(i): k for k, i in enumerate(ids)}
    asked = np.flatnonzero(ids % 20 == 0)
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    tenth = dict(zip(ids[asked].tolist(), np.sort(s, axis=1)[:, -10].tolist()))
    hits = sum(float(x[place[r["id"]]] @ x[place[r["neighbour"]]]) >= tenth[r["id"]] - 0.001 for r in graph.neighbours(10).where("id % 20 = 0").collect())
    assert hits / (10 * len(asked)) > 0.95


def test_one_tree_is_refused(spark):
    with pytest.raises(ValueError):
        g.build_graph(frame(spark, []), "chunk_id", "embedding", trees=1)


def test_a_hot_block_is_divided_by_the_senders(spark, monkeypatch):
    monkeypatch.setattr(g, "LOAD", 100)
    x, _ = near_copies(300, far=200)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    got = {}
    for r in g.build_graph(df, "chunk_id", "embedding", leaf=20).neighbours(10).collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert all(len(set(v)) == 10 and i not in v for i, v in got.items()) and len(got) == 500
    assert np.mean([s[i, j] >= np.sort(s[i])[-10] - 0.003 for i, v in got.items() for j in v]) > 0.9
