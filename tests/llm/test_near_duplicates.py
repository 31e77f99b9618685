import random

import numpy as np

from lectern.llm import near_duplicates as nd

SCHEMA = "memory_id long, content string, rep int, words string, key int"


def frame(spark, rows):
    return spark.createDataFrame([(i, c, 0, "w", 1) for i, c in rows], SCHEMA)


def brute(rows, t=0.7):
    import re

    s = [(i, set(re.findall(r"[^\W_]+", c.lower()))) for i, c in rows if i is not None and c is not None]
    s = [(i, w) for i, w in s if len(w) >= 6]
    return {(min(i, j), max(i, j)) for i, a in s for j, b in s if i != j and len(a & b) >= t * len(a | b) - 1e-9}


def corpus(seed, n=250, longest=40, vocabulary=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if out and rnd.random() < 0.4:
            w = rnd.choice(out)[1].split()
            for _ in range(rnd.randrange(0, 5)):
                w[rnd.randrange(len(w))] = f"w{rnd.randrange(vocabulary)}"
            rnd.shuffle(w)
        else:
            w = [f"w{int(rnd.random() ** 2 * vocabulary)}" for _ in range(rnd.randrange(4, longest))]
        out.append((i, " ".join(w)))
    return out


def test_pairs_equal_brute_force(spark):
    rows = corpus(1)
    got = {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows) and got


def test_long_sets_and_split_shards(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 8)
    rows = corpus(2, 200, 60)
    assert {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()} == brute(rows)


def test_dirty_rows(spark):
    a = "one two three four five six seven"
    rows = [(1, a), (1, a), (2, a.upper() + "!"), (3, None), (4, ""), (5, "ok"), (6, "one two three four five"), (None, a), (7, a + " eight"), (8, "é ß ж 漢字 x1 y2"), (9, "É ß ж 漢字 x1 y2")]
    got = {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == brute(rows) == {(1, 2), (1, 7), (2, 7), (8, 9)}


def test_empty(spark):
    assert nd.near_duplicate_pairs(frame(spark, [])).count() == 0
    assert nd.near_duplicate_groups(frame(spark, [])).count() == 0


def test_groups_are_components(spark):
    rows = corpus(4)
    pairs = brute(rows)
    parent = {i: i for p in pairs for i in p}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in sorted(pairs):
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r["memory_id"]: r["group_id"] for r in nd.near_duplicate_groups(frame(spark, rows)).collect()}
    assert got == {i: top(i) for i in parent}


def test_trees_find_all_within_the_radius(monkeypatch):
    monkeypatch.setattr(nd, "STEP", 500)
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 1 << 63, (600, 2), dtype=np.uint64)
    for i in range(100, 600):  # near one before, or equal to it
        if i % 3:
            bits[i] = bits[rng.integers(i)]
            for _ in range(i % 7):
                bits[i, rng.integers(2)] ^= np.uint64(1) << np.uint64(rng.integers(64))
    shard, size = np.sort(rng.integers(0, 5, 600)), rng.integers(15, 25, 600)
    held, asks = np.flatnonzero(rng.random(600) < 0.7), np.flatnonzero(rng.random(600) < 0.8)
    q, m = nd.BKForest(bits, shard, held).near(asks, shard, size, 0.7)
    d = np.bitwise_count(bits[:, None] ^ bits[None]).sum(axis=2)
    want = {(i, j) for i in asks for j in held if shard[i] == shard[j] and 0.7 * size[i] <= size[j] <= size[i] and d[i, j] <= nd.radius(size[i], size[j], 0.7)}
    assert set(zip(q.tolist(), m.tolist())) == want and len(q) == len(want) > 300


def test_an_id_with_several_contents_names_no_two_classes(spark):
    a, b = "one two three four five six seven", "red blue green black white brown pink"
    rows = [(1, a), (1, b), (2, a), (3, b), (4, a + " eight")]
    got = {tuple(r) for r in nd.near_duplicate_pairs(frame(spark, rows)).collect()}
    assert got == {(1, 2), (1, 3), (1, 4), (2, 4)}
    groups = {(r["memory_id"], r["group_id"]) for r in nd.near_duplicate_groups(frame(spark, rows)).collect()}
    assert groups == {(1, 1), (2, 1), (3, 1), (4, 1)}
