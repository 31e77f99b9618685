import os
import random

import numpy as np
import pytest

from lectern.llm import shared_spans as s

SCHEMA = "doc_id long, text string, bucket int, hot string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 0, "") for i, t in docs], SCHEMA)


def brute(docs, n):
    held = {}
    for i, t in docs:
        if i is not None:
            for j in range(len(t or "") - n + 1):
                held.setdefault(t[j : j + n], set()).add(i)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    chars = {}
    for i, t in docs:
        if i is None:
            continue
        mark = np.zeros(len(t or ""), dtype=bool)
        for j in range(len(mark) - n + 1):
            if len(held[t[j : j + n]]) > 1:
                mark[j : j + n] = True
        if mark.any():
            chars[i] = int(mark.sum())
    return pairs, chars


def corpus(seed):
    rnd = random.Random(seed)
    base = ["".join(rnd.choices("abcdef é漢\n", k=rnd.randrange(60, 400))) for _ in range(25)]
    docs = []
    for i in range(60):
        t = rnd.choice(base)
        if rnd.random() < 0.6:
            u = rnd.choice(base)
            a = rnd.randrange(len(u))
            t = t[: rnd.randrange(len(t))] + u[a : a + rnd.randrange(60, 200)] + t[len(t) // 2 :]
        docs.append((i, t))
    return docs + [(60, None), (61, ""), (62, "ab" * 200), (63, "ba" * 150), (64, "a" * 300), (65, "a" * 99), (66, "a" * 99), (None, "a" * 99)] + [(100 + i, rnd.choice(base)) for i in range(30)]


@pytest.mark.parametrize("hot", [0, 4, 512])
def test_equals_brute_force(spark, hot):
    docs = corpus(1)
    pairs, chars = brute(docs, 80)
    df = frame(spark, docs + docs[:5])
    got = s._shared_windows(s._texts(df, 80), None, 80, True, hot=hot).select("doc_a", "doc_b").distinct()
    assert {tuple(r) for r in got.collect()} == pairs and pairs
    assert {tuple(r) for r in s.shared_pairs(df, 80).collect()} == pairs
    if hot == 512:
        assert {tuple(r) for r in s.shared_lengths(df, 80).collect()} == set(chars.items())


def test_empty(spark):
    assert s.shared_pairs(frame(spark, [])).count() == 0
    assert s.shared_lengths(frame(spark, [])).count() == 0


def test_hashes_and_minima():
    codes = np.array([ord(c) for c in "the cat and the cat and the dog"], dtype=np.uint32)
    h = s.gram_hashes(codes, 7)
    text = "the cat and the cat and the dog"
    seen = {}
    for i in range(len(text) - 6):
        assert seen.setdefault(text[i : i + 7], h[i]) == h[i]
    assert len(set(h.tolist())) == len(seen)
    x = np.random.default_rng(0).integers(0, 100, 50)
    assert s.sliding_min(x, 13).tolist() == [x[i : i + 13].min() for i in range(38)]


def test_lengths_form_no_pairs():
    from lectern.llm import shared_spans

    strings = [(i, 0, "x" * 40 + f"{i:03d}") for i in range(50)]
    shared, pairs = shared_spans.count_windows(strings, 40, False)
    assert not pairs and shared == shared_spans.count_windows(strings, 40)[0] and len(shared) == 50


def test_one_header_in_very_many_records(spark):
    """A header of 400 characters in 20,000 records that differ otherwise: no pairs are formed and no bucket comes to one task."""
    rnd = random.Random(3)
    header = "".join(rnd.choices("abcdefghij", k=400))
    tails = spark.range(20_000).selectExpr("id AS doc_id", f"concat('{header}', '#', sha2(cast(id AS string), 256)) AS text")
    texts = sorted((r["text"], r["doc_id"]) for r in tails.collect())
    common = [len(os.path.commonprefix([a[0], b[0]])) for a, b in zip(texts, texts[1:])]
    want = {d: max(x) for (_, d), x in zip(texts, zip([0, *common], [*common, 0]))}
    assert {r["doc_id"]: r["shared_chars"] for r in s.shared_lengths(tails).collect()} == want
    few = s.shared_pairs(tails.where("doc_id % 32 = 0"))
    assert few.count() == 625 * 624 // 2
