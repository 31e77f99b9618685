import math
import random
from pathlib import Path

import numpy as np
import pytest

from lectern.operators import community
from lectern.session import shared_dir


def listed(spark, n=12, seed=3):
    rnd = random.Random(seed)
    names = [f"{'abc'[i % 3]}/n{i:02}" for i in range(n)]
    pairs = [(a, b, round(rnd.uniform(0.05, 1.3), 3)) for a in names for b in names if a < b and rnd.random() < (0.8 if a[0] == b[0] else 0.15)]
    return names, spark.createDataFrame(pairs, "a string, b string, value double"), spark.createDataFrame([(x,) for x in names], "note_path string")


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(5)
    names = [f"{'abc'[i % 3]}/n{i:02}" for i in range(14)]
    vectors = spark.createDataFrame([(i, p, [rnd.gauss(0, 1) for _ in range(64)]) for i, p in enumerate(names) for _ in range(2)], "chunk_id long, note_path string, vec array<double>")
    facts = [(p, rnd.choice("uvwxyz"), rnd.choice("uvwxyz")) for p in [*names, "nowhere"] for _ in range(3)]
    triples = spark.createDataFrame(facts, "note_path string, subject string, object string")
    state = spark.createDataFrame([("u", "v", 2.0), ("w", "z", 0.5), ("x", "y", 1.0), ("u", "gone", 9.0)], "entity_a string, entity_b string, weight double")
    edges = spark.createDataFrame([(names[0], names[5]), (names[5], names[0]), (names[2], names[9]), (names[2], "nowhere"), (names[4], names[4])], "source_path string, target_path string")
    return names, facts, vectors, triples, state, edges


def brute(names, facts, vectors, state, edges):
    rows = {}
    for r in vectors.collect():
        rows.setdefault(r["note_path"], []).append(r["vec"])
    mean = {p: np.mean(v, axis=0) for p, v in rows.items()}
    ents = {p: {e for q, s, o in facts if q == p for e in (s, o)} for p in names}
    pairs = [(a, b) for a in names for b in names if a < b]
    cos = {(a, b): max(0.0, mean[a] @ mean[b] / math.sqrt((mean[a] @ mean[a]) * (mean[b] @ mean[b]))) for a, b in pairs}
    floor = np.mean(list(cos.values())) + 0.5 * np.std(list(cos.values()))
    weight = {(r["entity_a"], r["entity_b"]): r["weight"] for r in state.collect()}
    both = {(a, b): ents[a] & ents[b] for a, b in pairs}
    raw = {k: len(c) + sum(w for (e, f), w in weight.items() if e in c and f in c) for k, c in both.items() if len(c) >= 2}
    linked = {frozenset((r["source_path"], r["target_path"])) for r in edges.collect()}
    value = {k: 0.6 * cos[k] * (cos[k] >= floor) + 0.25 * raw.get(k, 0) / max(raw.values()) + 0.15 * (frozenset(k) in linked) + 0.3 * (k[0][0] == k[1][0]) for k in pairs}
    return {k: v for k, v in value.items() if v > 0}


def files(spark):
    return {p for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet")}


def dense(names, s, beta, top_k, merge):
    n, at = len(names), {p: i for i, p in enumerate(sorted(names))}
    m = np.zeros((n, n))
    for r in (community.row_topk(s, top_k) if n > top_k else community.both_ways(s)).collect():
        m[at[r["a"]], at[r["b"]]] = r["value"]
    state = np.eye(n)
    for _ in range(community.iterations(n)):
        z = np.exp(beta * (m @ state))
        z /= z.sum(axis=1, keepdims=True)
        moved, state = np.abs(z - state).max(), z
        if moved < 1e-4:
            break
    home = state.argmax(axis=1)
    size = np.bincount(home, minlength=n)
    big, unit = np.flatnonzero(size > 1), state / np.linalg.norm(state, axis=1, keepdims=True)
    if merge and len(big):
        for i in np.flatnonzero(size[home] == 1):
            home[i] = big[int(np.argmax(unit[big] @ unit[home[i]]))]
    return {p: sorted(names)[home[i]] for p, i in at.items()}


def test_more_notes_than_a_dense_matrix_holds(spark):
    names, s, n = listed(spark)
    for beta, top_k, merge in ((0.5, 4, True), (2.0, 3, False), (5.0, 50, True)):
        rows = {r[0]: r[1] for r in community.attractor(s, n, beta, top_k, merge, max_notes=3).collect()}
        assert rows == dense(names, s, beta, top_k, merge)


def test_pairs_of_notes_are_compared_without_being_written(spark, tables):
    names, facts, vectors, triples, state, edges = tables
    before = files(spark)
    got = {(r["a"], r["b"]): r["value"] for r in community.similarity(vectors, triples, state, edges).pairs(5).collect()}
    want = brute(names, facts, vectors, state, edges)
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert files(spark) == before


def test_nearest_notes_without_listed_pairs(spark, tables):
    _, _, vectors, triples, state, edges = tables
    before = files(spark)
    x = community.similarity(vectors, triples, state, edges)
    want = {(r["a"], r["b"], r["nth"]) for r in community.row_topk(x.pairs(), 4).collect()}
    assert {(r["a"], r["b"], r["nth"]) for r in x.row_topk(4).collect()} == want and files(spark) == before


def test_modularity_without_listed_pairs(spark, tables):
    names, _, vectors, triples, state, edges = tables
    before = files(spark)
    x = community.similarity(vectors, triples, state, edges)
    other = np.arange(len(names)) % 2
    for g, q in zip((x.folder, other), x.modularity(x.folder, other)):
        members = spark.createDataFrame([(p, str(c)) for p, c in zip(x.paths, g.tolist())], "note_path string, community string")
        assert math.isclose(q, community.modularity(x.pairs(), members).first()[0], abs_tol=1e-12)
    assert files(spark) == before


def test_statistics_of_more_notes_than_a_dense_matrix_holds(spark, tables, monkeypatch):
    _, _, vectors, triples, state, edges = tables
    dense = [sorted(map(tuple, df.collect())) for df in community.detect(vectors, triples, state, edges)]
    homes = community._homes
    monkeypatch.setattr(community, "_homes", lambda *a: homes(*a, max_notes=3))
    assert [sorted(map(tuple, df.collect())) for df in community.detect(vectors, triples, state, edges)] == dense
    few = vectors.where("note_path < 'a/n04'")
    assert [df.count() for df in community.detect(few, triples, state, edges)] == [0, 0]


def test_notes_are_sent_to_tasks_once(spark, tables, monkeypatch):
    _, _, vectors, triples, state, edges = tables
    sent, broadcast = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: (sent.append(value), broadcast(self, value))[1])
    x = community.similarity(vectors, triples, state, edges)
    x.modularity(x.folder)
    x.row_topk(4).collect()
    assert sum(isinstance(v, community.Blend) for v in sent) == 1


def test_tiles_and_blocks_of_any_size(spark, tables, monkeypatch):
    names, facts, vectors, triples, state, edges = tables
    want = brute(names, facts, vectors, state, edges)
    x = community.similarity(vectors, triples, state, edges)
    near = sorted(map(tuple, x.nearest(4).collect()))
    mark = np.zeros(len(names), dtype=np.uint64)
    monkeypatch.setattr(community, "COLUMNS", 3)
    for lo, hi in ((0, 5), (5, 14)):
        got = {(lo + int(r), c + int(j)): v[r, j] for c, _, v in x.upper(lo, hi, mark) for r, j in zip(*np.nonzero(v))}
        wanted = {(i, j): want[names_i, names_j] for i, names_i in enumerate(x.paths) for j, names_j in enumerate(x.paths) if lo <= i < hi and (names_i, names_j) in want}
        assert set(got) == set(wanted) and all(math.isclose(got[k], wanted[k], abs_tol=1e-9) for k in got)
        rows = np.concatenate([v for _, _, v in sorted(x.tiles(lo, hi, mark, near=True), key=lambda t: t[0])], axis=1)
        for r in range(lo, hi):
            first = sorted((-round(v, 9), j) for j, v in enumerate(rows[r - lo]) if v > 0)[:4]
            assert [j for _, j in first] == [j for i, j, _, _ in sorted(near, key=lambda t: (t[0], t[3])) if i == r]


def test_leading_notes_of_a_row_while_tiles_come_in():
    rnd = np.random.default_rng(1)
    value = np.round(rnd.random((6, 40)), 1)
    least, kept = np.full(6, 1e-300), []
    for c in range(0, 40, 7):
        r, j = np.nonzero(value[:, c : c + 7] >= least[:, None])
        kept, least = community._leading([*kept, (r, c + j, value[r, c + j])], 5, least)
    [(r, j, _)] = kept
    for i in range(6):
        assert list(j[r == i]) == [x for _, x in sorted((-v, x) for x, v in enumerate(value[i]) if v > 0)[:5]]


def test_shared_entities_of_notes_with_few_or_many(spark):
    rnd = np.random.default_rng(4)
    n, m = 30, 90
    has = rnd.random((n, m)) < np.where(np.arange(n) < 3, 0.9, 0.1)[:, None]
    note, ent = np.nonzero(has)
    couples = sorted({tuple(sorted(rnd.choice(m, 2, replace=False).tolist())) for _ in range(400)})
    weight = rnd.random(len(couples))
    keys = np.array([a * m + b for a, b in couples])
    x = community.Blend(spark, np.arange(n).astype(str).astype(object), np.zeros((n, 1)), posts=(community._grouped(note, ent, n), community._grouped(ent, note, m), (keys, weight), m))
    mark = np.zeros(n, dtype=np.uint64)
    for i in range(n):
        want = {}
        for j in range(n):
            both = has[i] & has[j]
            if i != j and both.sum() >= 2:
                want[j] = both.sum() + sum(w for (a, b), w in zip(couples, weight) if both[a] and both[b])
        js, raw = x.raw(i, mark)
        assert js.tolist() == sorted(want) and np.allclose(raw, [want[j] for j in js.tolist()]) and not mark.any()


def test_rows_of_the_state_against_the_dense_state():
    rnd = np.random.default_rng(7)
    n, beta = 40, 1.5
    m = np.where(rnd.random((n, n)) < 0.08, rnd.random((n, n)), 0)
    m[3] = 0  # a note without a neighbour
    i, j = np.nonzero(m)
    rows = community._Rows(n, np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))]), j, m[i, j], beta)
    state = np.eye(n)
    for t in range(1, 5):
        z = np.exp(beta * (m @ state))
        z /= z.sum(axis=1, keepdims=True)
        for x in range(n):
            at, w, total = rows.w(x, t)
            got = np.full(n, 1 / total)
            got[at] = (1 + w) / total
            assert np.allclose(got, z[x], rtol=0, atol=1e-12) and math.isclose(rows.moved(x, t), np.abs(z[x] - state[x]).max(), abs_tol=1e-12)
            assert rows.home(x, t) == np.flatnonzero(z[x] >= z[x].max() * (1 - 1e-12))[0] and not rows.before.any()
        state = z


def test_a_round_gives_attractors_and_movement_in_one_job(spark, monkeypatch):
    names, s, n = listed(spark)
    jobs, plain = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema, *a, **k: (jobs.append(schema), plain(self, f, schema, *a, **k))[1])
    rows = {r[0]: r[1] for r in community.attractor(s, n, 0.5, 4, False, max_notes=3).collect()}
    assert rows == dense(names, s, 0.5, 4, False)
    assert len([x for x in jobs if "home" in x]) == len(jobs)


def test_second_round_of_few_entries_among_many_notes():
    n, beta = 200, 2.0
    i, j, value = np.array([0, 0, 1, 2, 5]), np.array([1, 2, 0, 5, 2]), np.array([0.5, 0.25, 0.5, 1.0, 1.0])
    rows = community._Rows(n, np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))]), j, value, beta)
    m = np.zeros((n, n))
    m[i, j] = value
    state = np.exp(beta * m) / np.exp(beta * m).sum(axis=1, keepdims=True)
    p = m @ (state - 1 / np.exp(beta * m).sum(axis=1, keepdims=True))
    for x in (0, 1, 2, 3, 5):
        at, got = rows.p(x, 2)
        assert at.tolist() == np.flatnonzero(p[x] > 1e-15).tolist() and np.allclose(got, p[x, at])
