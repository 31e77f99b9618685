import os
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import packing as p


def fill(histogram, capacity):
    placed, opened = p.plan(histogram, capacity)
    load, seen = defaultdict(int), defaultdict(set)
    for size, rank, count, first in placed:
        for k in range(count):
            load[first + k] += size
            assert rank + k not in seen[size]
            seen[size].add(rank + k)
    assert all(v <= capacity for v in load.values()) and set(load) == set(range(opened))
    assert {s: len(v) for s, v in seen.items()} == {s: n for s, n in histogram.items() if n}
    return opened


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_places_every_item_once(histogram):
    opened = fill(histogram, 64)
    total = sum(s * n for s, n in histogram.items())
    assert opened <= 1 + 2 * total // 64


def test_little_is_left_unused():
    rnd = random.Random(1)
    h = defaultdict(int)
    for _ in range(20_000):
        h[min(2048, int(rnd.lognormvariate(5.5, 1)) + 1)] += 1
    opened = fill(dict(h), 2048)
    assert sum(s * n for s, n in h.items()) / (opened * 2048) > 0.98


def test_items(spark):
    rows = [(1, 100), (2, 250), (3, 0), (4, None), (5, 30), (6, 70), (6, 70), (7, 100)]
    got = p.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), 100).collect()
    load = defaultdict(int)
    for r in got:
        load[r["container"]] += r["n_tokens"]
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in got) == [(1, 0, 100), (2, 0, 100), (2, 1, 100), (2, 2, 50), (5, 0, 30), (6, 0, 70), (6, 0, 70), (7, 0, 100)]
    assert max(load.values()) <= 100 and len(load) == 7
    assert p.pack(spark.createDataFrame([], "doc_id long, n_tokens long"), 100).count() == 0


def test_a_hot_size_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 40 ELSE id % 90 + 1 END AS n_tokens")
    got = p.pack(df, 100).groupBy("container").sum("n_tokens").collect()
    assert max(r[1] for r in got) <= 100
    assert sum(r[1] for r in got) == sum(40 if i % 3 == 0 else i % 90 + 1 for i in range(3000))


@pytest.mark.skipif(not os.path.exists(p.TOKENIZER), reason="no tokenizer files")
def test_documents(spark):
    rows = [(1, "hello world"), (2, None), (3, ""), (4, "word " * 5000), (5, "<|endoftext|> é漢")]
    got = p.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), 2048).collect()
    assert {r["doc_id"] for r in got} == {1, 4, 5}
    assert sum(r["n_tokens"] for r in got if r["doc_id"] == 4) == len(p._encoding(p.TOKENIZER).encode_ordinary("word " * 5000))


def test_sizes_of_millions(spark):
    """Sizes beyond 2,097,152 and ranks among them keep their order."""
    capacity = 4_194_304
    sizes = [3_000_000] * 5 + [1_000_000] * 7 + [2_097_152] * 3 + [194_304] * 9 + [4_194_304, 9_000_000]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    rows = p.pack(df, capacity).collect()
    fill = {}
    for r in rows:
        fill[r["container"]] = fill.get(r["container"], 0) + r["n_tokens"]
    assert sum(fill.values()) == sum(sizes) and max(fill.values()) <= capacity
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) == len(sizes) + 2
    assert sorted(fill) == list(range(len(fill))) and len(fill) <= -(-sum(sizes) // capacity) + 2


def test_rounds_over_tables(spark, monkeypatch):
    """Many range partitions with carries between them: each item placed once, no container over its capacity, as full as in one process."""
    monkeypatch.setattr(p, "RUNS", 3)
    rnd = random.Random(6)
    capacity = 100
    histogram = {}
    for _ in range(3000):
        size = min(capacity, max(1, int(rnd.lognormvariate(2.8, 1))))
        histogram[size] = histogram.get(size, 0) + 1
    runs = p.rounds(spark.createDataFrame(list(histogram.items()), "n_tokens long, n long"), capacity).collect()
    load, ranks = defaultdict(int), defaultdict(list)
    for r in runs:
        ranks[r["size"]] += range(r["rank"], r["rank"] + r["n"])
        for c in range(r["first"], r["first"] + r["n"]):
            load[c] += r["size"]
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}
    assert max(load.values()) <= capacity and sorted(load) == list(range(len(load)))
    assert len(load) <= p.plan(dict(histogram), capacity)[1] * 1.01 + 1
    assert p._carries({1: 5, 2: 3}, {0: 6, 1: 2}, 3) == [(0, 0, 1, 0, 5), (1, 0, 2, 0, 2), (0, 5, 2, 2, 1)]
