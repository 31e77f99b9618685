"""Topic communities: blended note similarity, attractor dynamics, modularity."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.vectors import mean_vector
from lectern.session import width

SEMANTIC, COOCCURRENCE, LINKS, FOLDER = 0.6, 0.25, 0.15, 0.3
MIN_SHARED, THRESHOLD_K = 2, 0.5
COARSE, FINE = (0.5, 80), (2.0, 20)
ROWS, COLUMNS = 128, 1024  # of a tile: it and its vectors fit into a core's cache


def note_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("note_path").agg(mean_vector(F.col("vec")).alias("vec"))


@lru_cache(maxsize=256)
def _couples(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


@dataclass(frozen=True)
class Blend:
    """The weighted similarity of all pairs of notes, by row blocks and never as a whole.

    Notes are numbered by path. A task gets what belongs to single notes (a vector of 512 bytes, folder, entities, links), once for all passes, and compares its
    rows with all notes tile by tile, in matrix products that stay in a core's cache: nothing is shuffled, and only results leave the task.
    """

    spark: SparkSession
    paths: np.ndarray  # sorted
    unit: np.ndarray  # vectors of length 1
    folder: np.ndarray | None = None  # a number per folder
    posts: tuple | None = None  # entities of notes and notes of entities, as (starts, values) each, and stored pairs of entities, as (keys, weights)
    links: tuple | None = None  # linked notes, as (starts, values)
    floor: float = -1.0  # least cosine that counts
    top: float = 1.0  # greatest raw value of shared entities
    semantic: float = SEMANTIC
    sent: Broadcast | None = None  # this blend, as tasks have it

    def run(self, work, schema: str, rows: int | None = None) -> DataFrame:
        """work(blend, (first row, end) of each row block of the task) -> record batches, over all row blocks."""
        n, shared = len(self.paths), self.sent or self.spark.sparkContext.broadcast(replace(self, spark=None))
        size, now = rows or ROWS, {"floor": self.floor, "top": self.top, "semantic": self.semantic}
        blocks = -(-n // size)
        starts = self.spark.range(0, blocks * size, size, min(max(1, blocks), 16 * width(self.spark)))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from work(replace(shared.value, **now), ((lo, min(n, lo + size)) for b in batches for lo in b.column("id").to_pylist()))

        return starts.mapInArrow(each, schema)

    def raw(self, i: int, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Notes that share at least MIN_SHARED entities with note i, with the count plus the stored weights of pairs among the shared ones. mark: a zero per note."""
        (at, ents), (start, notes), (keys, weights), n_ents = self.posts
        own = ents[at[i] : at[i + 1]]
        m = len(own)
        if m < MIN_SHARED:
            return np.empty(0, dtype=np.int64), np.empty(0)
        lists = [notes[start[e] : start[e + 1]] for e in own]
        x, y = _couples(m)
        key = own[x] * n_ents + own[y]  # own is sorted
        found = np.searchsorted(keys, key)
        hit = np.flatnonzero((found < len(keys)) & (keys[np.minimum(found, max(0, len(keys) - 1))] == key)) if len(keys) else ()
        if m > 63:
            return self._raw_of_many(i, lists, [(x[p], y[p], weights[found[p]]) for p in hit])
        for k, one in enumerate(lists):
            mark[one] |= np.uint64(1 << k)
        mark[i] = 0
        longest = max(range(m), key=lambda k: len(lists[k]))
        js = np.concatenate([one for k, one in enumerate(lists) if k != longest])  # one of two shared entities isn't the longest
        bits = mark[js]
        js = np.unique(js[bits & (bits - np.uint64(1)) != 0])
        bits = mark[js]
        for one in lists:
            mark[one] = 0
        kinds = np.arange(1 << m, dtype=np.uint64) if m <= 10 else bits
        value = np.bitwise_count(kinds).astype(np.float64)
        for p in hit:
            value += weights[found[p]] * ((kinds >> np.uint64(x[p])) & (kinds >> np.uint64(y[p])) & np.uint64(1))
        return js, value[bits.astype(np.int64)] if m <= 10 else value

    def _raw_of_many(self, i: int, lists: list, hits: list) -> tuple[np.ndarray, np.ndarray]:
        """raw() of a note with more entities than a word has bits."""
        shared = np.bincount(np.concatenate(lists), minlength=len(self.paths)).astype(np.float64)
        shared[i] = 0
        js = np.flatnonzero(shared >= MIN_SHARED)
        mark = np.zeros(len(self.paths), dtype=bool)
        for x, y, w in hits:
            mark[lists[x]] = True
            shared[lists[y][mark[lists[y]]]] += w
            mark[lists[x]] = False
        return js, shared[js]

    def _added(self, lo: int, hi: int, mark: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row - lo, note, value) of shared entities, and the same of links, by note."""
        out = []
        if self.posts is not None:
            js, raw = zip(*(self.raw(i, mark) for i in range(lo, hi)))
            out.append((np.repeat(np.arange(hi - lo), [len(j) for j in js]), np.concatenate(js), COOCCURRENCE * np.concatenate(raw) / self.top))
        if self.links is not None:
            at, to = self.links
            js = to[at[lo] : at[hi]]
            out.append((np.repeat(np.arange(hi - lo), np.diff(at[lo : hi + 1])), js, np.full(len(js), LINKS)))
        return [tuple(x[order] for x in one) for one in out for order in [np.argsort(one[1], kind="stable")]]

    def tiles(self, lo: int, hi: int, mark: np.ndarray, first: int = 0, near: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
        """(c, d, rows lo to hi of the similarity's columns c to d), 0 where there is none, from column first. near: beginning at the rows' own columns."""
        n, added, least = len(self.paths), self._added(lo, hi, mark), max(self.floor, 1e-12)
        starts = list(range(first, n, COLUMNS))
        if near:
            at = (lo - first) // COLUMNS
            starts = starts[at:] + starts[:at]
        for c in starts:
            d = min(n, c + COLUMNS)
            v = self.unit[lo:hi] @ self.unit[c:d].T
            np.minimum(v, 1, out=v)
            np.multiply(v, v >= least, out=v)
            v *= self.semantic
            if self.folder is not None:
                v += FOLDER * same if np.ndim(same := _same(self.folder, lo, hi, c, d)) else FOLDER * int(same)
            for r, j, value in added:
                a, b = np.searchsorted(j, (c, d))
                v[r[a:b], j[a:b] - c] += value[a:b]
            own = np.arange(max(lo, c), min(hi, d))
            v[own - lo, own - c] = 0
            yield c, d, v

    def upper(self, lo: int, hi: int, mark: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """tiles() of the pairs that begin in rows lo to hi, each pair once."""
        for c, d, v in self.tiles(lo, hi, mark, lo):
            yield c, d, np.triu(v, lo - c + 1) if c < hi else v

    def measured(self, k: float | None, rows: int | None = None) -> Blend:
        """With the least cosine, mean + k * population deviation over all pairs, and the greatest raw value."""

        def moments(x: Blend, blocks: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            s1 = s2 = top = 0.0
            n, mark = len(x.paths), np.zeros(len(x.paths), dtype=np.uint64)
            for lo, hi in blocks:
                for c in range(lo, n if k is not None else lo, COLUMNS):
                    s = x.unit[lo:hi] @ x.unit[c : min(n, c + COLUMNS)].T
                    np.clip(s, 0, 1, out=s)
                    s = np.triu(s, lo - c + 1) if c < hi else s  # each pair once
                    s1, s2 = s1 + float(s.sum()), s2 + float(np.vdot(s, s))
                if x.posts is not None:
                    top = max([top, *(float(raw.max()) for _, raw in (x.raw(i, mark) for i in range(lo, hi)) if len(raw))])
            yield pa.RecordBatch.from_pydict({"s1": [s1], "s2": [s2], "top": [top]})

        n, x = len(self.paths), replace(self, sent=self.spark.sparkContext.broadcast(replace(self, spark=None)))
        m = x.run(moments, "s1 double, s2 double, top double", rows).agg(F.sum("s1"), F.sum("s2"), F.max("top")).first()
        floor, pairs = -1.0, n * (n - 1) / 2
        if k is not None and pairs:
            mean = m[0] / pairs
            floor = mean + k * max(0.0, m[1] / pairs - mean * mean) ** 0.5
        return replace(x, floor=floor, top=m[2] or 1.0)

    def pairs(self, rows: int | None = None) -> DataFrame:
        """a < b, value: every pair that has a similarity."""

        def each(x: Blend, blocks: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            names, mark = pa.array(x.paths, pa.string()), np.zeros(len(x.paths), dtype=np.uint64)
            for lo, hi in blocks:
                for c, _, v in x.upper(lo, hi, mark):
                    r, j = np.nonzero(v > 0)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(lo + r)), names.take(pa.array(c + j)), pa.array(v[r, j])], names=["a", "b", "value"])

        return self.run(each, "a string, b string, value double", rows)

    def nearest(self, k: int, rows: int | None = None) -> DataFrame:
        """i, j, value, nth: numbers of the k most similar notes of each (ties by number, that is by path)."""

        def each(x: Blend, blocks: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            mark = np.zeros(len(x.paths), dtype=np.uint64)
            for lo, hi in blocks:
                least = np.full(hi - lo, np.finfo(np.float64).tiny)
                kept, held = [], 0
                for c, _, v in x.tiles(lo, hi, mark, near=True):
                    r, j = np.nonzero(v >= least[:, None])
                    kept.append((r, c + j, v[r, j]))
                    held += len(r)
                    if held > 4 * k * (hi - lo):
                        kept, least = _leading(kept, k, least)
                        held = len(kept[0][0])
                [(r, j, value)], _ = _leading(kept, k, least)
                nth = np.arange(len(r)) - np.searchsorted(r, r) + 1
                yield pa.RecordBatch.from_arrays([pa.array(lo + r), pa.array(j), pa.array(value), pa.array(nth)], names=["i", "j", "value", "nth"])

        return self.run(each, "i long, j long, value double, nth long", rows)

    def row_topk(self, k: int) -> DataFrame:
        """a, b, value, nth as row_topk has them of listed pairs."""
        paths = self.spark.sparkContext.broadcast(self.paths)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = pa.array(paths.value, pa.string())
            for b in batches:
                yield pa.RecordBatch.from_arrays([names.take(b.column("i")), names.take(b.column("j")), b.column("value"), b.column("nth")], names=["a", "b", "value", "nth"])

        return self.nearest(k).mapInArrow(named, "a string, b string, value double, nth long")

    def modularity(self, *partitions: np.ndarray) -> list[float]:
        """Of each partition, a community number per note, on the whole similarity."""
        shared = self.spark.sparkContext.broadcast(partitions)

        def sums(x: Blend, blocks: Iterator[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
            inside, strength, mark = np.zeros(len(shared.value)), [np.zeros(int(g.max(initial=0)) + 1) for g in shared.value], np.zeros(len(x.paths), dtype=np.uint64)
            for lo, hi in blocks:
                for c, d, v in x.upper(lo, hi, mark):
                    here, there = v.sum(axis=1), v.sum(axis=0)
                    for p, g in enumerate(shared.value):
                        np.add.at(strength[p], g[lo:hi], here)
                        np.add.at(strength[p], g[c:d], there)
                        same = _same(g, lo, hi, c, d)
                        inside[p] += 2 * float(v[same].sum() if np.ndim(same) else here.sum() if same else 0)
            for p, own in enumerate(strength):
                of = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of) + 1, p)), pa.array(np.append(of, -1)), pa.array(np.append(own[of], inside[p]))], names=["p", "community", "value"])

        out, found = [], self.run(sums, "p long, community long, value double").groupBy("p", "community").agg(F.sum("value").alias("value")).toArrow()
        part, community, value = (found[c].to_numpy() for c in ("p", "community", "value"))
        for p in range(len(partitions)):
            inside, strength = value[(part == p) & (community < 0)].sum(), value[(part == p) & (community >= 0)]
            total = strength.sum()
            out.append(float(inside / total - (strength**2).sum() / total**2) if total else 0.0)
        return out


def _same(group: np.ndarray, lo: int, hi: int, c: int, d: int) -> np.ndarray | bool:
    """Which pairs of rows lo to hi and columns c to d are of one group; one answer where all are or none is."""
    a, b = group[lo:hi], group[c:d]
    if (a == a[0]).all() and (b == b[0]).all():
        return bool(a[0] == b[0])
    return a[:, None] == b[None, :]


def _leading(kept: list, k: int, least: np.ndarray) -> tuple[list, np.ndarray]:
    """The k first of each row by rounded value and note, and what a value must reach to be among them."""
    r, j, value = (np.concatenate(x) for x in zip(*kept))
    order = np.lexsort((j, -np.round(value, 9), r))
    r, j, value = r[order], j[order], value[order]
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    last, least = nth == k - 1, least.copy()
    least[r[last]] = np.maximum(least[r[last]], value[last] - 2e-9)
    first = nth < k
    return [(r[first], j[first], value[first])], least


def _grouped(key: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, values): the sorted values of key k are values[starts[k] : starts[k + 1]]."""
    order = np.lexsort((value, key))
    return np.concatenate([[0], np.cumsum(np.bincount(key, minlength=n))]), value[order]


def _numbers(column, of: pa.Array) -> np.ndarray:
    """The place of each value in `of`, -1 where it isn't there."""
    return pc.fill_null(pc.index_in(column, value_set=of), -1).to_numpy().astype(np.int64)


def _unit_blend(notes: DataFrame) -> Blend:
    got = notes.select("note_path", "vec").toArrow()
    vec = np.asarray(pc.list_flatten(got["vec"].combine_chunks()).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(got), -1) if len(got) else np.zeros((0, 1))
    paths = np.asarray(got["note_path"].to_pylist(), dtype=object)
    order = np.argsort(paths)
    del got
    vec = vec[order]
    vec /= np.linalg.norm(vec, axis=1, keepdims=True) + 1e-10
    return Blend(notes.sparkSession, paths[order], vec)


def semantic_edges(notes: DataFrame, k: float | None = THRESHOLD_K, block_rows: int = 1024) -> DataFrame:
    """a < b, value: cosines of note vectors, floored at 0, at or above mean + k * population deviation over all pairs.

    All pairs are compared, as the definition wants, in matrix products; the moments are summed first.
    """
    return replace(_unit_blend(notes), semantic=1.0).measured(k, block_rows).pairs(block_rows)


def folder_edges(notes: DataFrame, depth: int = 1) -> DataFrame:
    """Notes of one top folder; a file at the root is its own group. Every pair of a folder is an edge by definition."""
    group = F.array_join(F.slice(F.split("note_path", "/"), 1, depth), "/")
    g = notes.select("note_path", group.alias("g"))
    return g.withColumnRenamed("note_path", "a").join(g.withColumnRenamed("note_path", "b"), "g").where("a < b").select("a", "b", F.lit(1.0).alias("value"))


def similarity(vectors: DataFrame, triples: DataFrame, state: DataFrame, edges: DataFrame) -> Blend:
    """The four signals, weighted and summed, among notes that have a vector: cosines over the threshold, shared entities (at least MIN_SHARED, their
    count plus the stored weights of pairs among them, over the greatest), links and equal top folders."""
    blend = _unit_blend(note_vectors(vectors))
    names, n = pa.array(blend.paths, pa.string()), len(blend.paths)
    tops = np.asarray([p.split("/")[0] for p in blend.paths], dtype=object)
    folder = np.unique(tops.astype(str), return_inverse=True)[1] if n else np.zeros(0, dtype=np.int64)
    known = triples.select("note_path", F.col("subject").alias("entity")).union(triples.select("note_path", F.col("object"))).distinct().toArrow()
    note, entities = _numbers(known["note_path"], names), pc.unique(known["entity"])
    ent = _numbers(known["entity"], entities)
    note, ent = note[note >= 0], ent[note >= 0]
    stored = state.select("entity_a", "entity_b", "weight").toArrow()
    a, b = _numbers(stored["entity_a"], entities), _numbers(stored["entity_b"], entities)
    both = (a >= 0) & (b >= 0)
    key = np.minimum(a, b)[both] * len(entities) + np.maximum(a, b)[both]
    order = np.argsort(key)
    posts = (_grouped(note, ent, n), _grouped(ent, note, len(entities)), (key[order], stored["weight"].to_numpy()[both][order]), len(entities))
    linked = edges.select("source_path", "target_path").where("source_path <> target_path").toArrow()
    a, b = _numbers(linked["source_path"], names), _numbers(linked["target_path"], names)
    inside = (a >= 0) & (b >= 0)
    ends = np.unique(np.concatenate([np.stack([a, b], 1)[inside], np.stack([b, a], 1)[inside]]), axis=0)
    return replace(blend, folder=folder, posts=posts, links=_grouped(ends[:, 0], ends[:, 1], n)).measured(THRESHOLD_K)


def both_ways(s: DataFrame) -> DataFrame:
    return s.select("a", "b", "value").union(s.select("b", "a", "value"))


def row_topk(s: DataFrame, k: int) -> DataFrame:
    """The k strongest neighbours of each note (ties by path): a, b, value, nth."""
    nth = F.row_number().over(Window.partitionBy("a").orderBy(F.round("value", 9).desc(), "b"))
    return both_ways(s).withColumn("nth", nth.cast("long")).where(F.col("nth") <= k)


def iterations(n: int) -> int:
    return 50 if n <= 200 else 30 if n <= 1000 else 20 if n <= 3000 else 15


def attractor(s: DataFrame, notes: DataFrame, beta: float, top_k: int, merge_singletons: bool, tolerance: float = 1e-4, max_notes: int = 8000) -> DataFrame:
    """note_path, community: each note's dominant attractor once softmax(beta * S * state) settles.

    Up to max_notes one task holds the state as a dense square matrix; beyond, `_settled` works on its rows.
    """
    n = notes.count()
    near = row_topk(s, top_k) if n > top_k else both_ways(s)
    names = sorted(r[0] for r in notes.select("note_path").distinct().collect())
    got, of = near.select("a", "b", "value").toArrow(), pa.array(names, pa.string())
    homes = _homes(notes.sparkSession, len(names), _numbers(got["a"], of), _numbers(got["b"], of), got["value"].to_numpy(), beta, merge_singletons, tolerance, max_notes)
    return notes.sparkSession.createDataFrame([(p, names[h]) for p, h in zip(names, homes)], "note_path string, community string")


def _homes(spark: SparkSession, n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray, beta: float, merge_singletons: bool, tolerance: float = 1e-4, max_notes: int = 8000) -> np.ndarray:
    """The attractor of each of n notes, from the entries (i, j, value) of the similarity."""
    if n > max_notes:
        return _settled(spark, n, i, j, value, beta, merge_singletons, tolerance)
    rows = spark.createDataFrame(pa.table({"i": i, "j": j, "value": value}), "i long, j long, value double").withColumn("g", F.lit(0))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((n, n), dtype=np.float32)
        m[pdf["i"], pdf["j"]] = pdf["value"]
        state = np.eye(n, dtype=np.float32)
        for _ in range(iterations(n)):
            z = beta * (m @ state)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True) + 1e-10
            moved = np.abs(z - state).max()
            state = z
            if moved < tolerance:
                break
        home = state.argmax(axis=1)
        size = np.bincount(home, minlength=n)
        big = np.flatnonzero(size > 1)
        if merge_singletons and len(big):
            unit = state / (np.linalg.norm(state, axis=1, keepdims=True) + 1e-10)
            for i in np.flatnonzero(size[home] == 1):
                home[i] = big[int(np.argmax(unit[big] @ unit[home[i]]))]
        return pd.DataFrame({"i": np.arange(n), "home": home})

    home = np.zeros(n, dtype=np.int64)  # what one note without a neighbour has
    for r in rows.groupBy("g").applyInPandas(settle, "i long, home long").toLocalIterator():
        home[r["i"]] = r["home"]
    return home


class _Rows:
    """Rows of the state after t rounds, from the similarity alone.

    A softmax doesn't see a constant in its row, so a row is (1 + w) / z with w = exp(beta * p) - 1, p = S * (the state's w / z of the round before), which is 0
    outside the notes that t steps reach, and z = n + sum(w). The first round starts from the unit matrix: there p is the row of S.
    """

    def __init__(self, n: int, start: np.ndarray, near: np.ndarray, value: np.ndarray, beta: float):
        self.n, self.start, self.near, self.value, self.beta, self.kept, self.held, self.before = n, start, near, value, beta, {}, 0, np.zeros(n)
        # w / z of the first round as a rectangle: rows have few entries, and where one has less, note n fills it up with 0.
        row = np.repeat(np.arange(n), np.diff(start))
        at = np.arange(len(near)) - start[row]
        self.notes, self.first = np.full((n, max(1, int(np.diff(start).max(initial=0)))), n, dtype=np.int32), np.zeros((n, max(1, int(np.diff(start).max(initial=0)))))
        self.notes[row, at], self.first[row, at] = near, np.expm1(beta * value)
        self.first /= n + self.first.sum(axis=1, keepdims=True)

    def p(self, i: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Notes and p of row i after t rounds."""
        a, b = self.start[i], self.start[i + 1]
        if t == 1 or a == b:
            return self.near[a:b], self.value[a:b]
        if t == 2:
            j = self.near[a:b]
            to, part = self.notes[j].ravel(), (self.value[a:b, None] * self.first[j]).ravel()
            if 16 * len(to) < self.n:
                at, back = np.unique(to, return_inverse=True)
                sums = np.bincount(back, part)
                some = (at < self.n) & (sums != 0)
                return at[some], sums[some]
            sums = np.bincount(to, part, minlength=self.n + 1)[: self.n]
            at = np.flatnonzero(sums)
            return at, sums[at]
        parts = [(m, *self.w(j, t - 1)) for m, j in zip(self.value[a:b], self.near[a:b])]
        sums = np.bincount(np.concatenate([x for _, x, _, _ in parts]), np.concatenate([m / z * w for m, _, w, z in parts]), minlength=self.n)
        at = np.flatnonzero(sums)
        return at, sums[at]

    def w(self, i: int, t: int) -> tuple[np.ndarray, np.ndarray, float]:
        """Notes, w and z of row i after t rounds; what was asked lately is kept, up to a size."""
        if (got := self.kept.get((i, t))) is None:
            at, p = self.p(i, t)
            w = np.expm1(self.beta * p)
            got = at, w, self.n + float(w.sum())
            if self.held > 10_000_000:
                self.kept, self.held = {}, 0
            self.kept[i, t] = got
            self.held += len(at)
        return got

    def moved(self, i: int, t: int) -> float:
        """How far row i moved in round t."""
        at, w, z = self.w(i, t)
        if t == 1:
            new = np.full(self.n, 1 / z)
            new[at] = (1 + w) / z
            new[i] -= 1
            return float(np.abs(new).max())
        was_at, was, was_z = self.w(i, t - 1)
        self.before[was_at] = was
        inside = np.abs((1 + w) / z - (1 + self.before[at]) / was_z).max(initial=0.0)
        self.before[at] = 0
        left = was_at[self.before[was_at] != 0]  # notes that aren't reached any more
        gone = np.abs(1 / z - (1 + self.before[left]) / was_z).max(initial=0.0)
        self.before[was_at] = 0
        return float(max(inside, gone, abs(1 / z - 1 / was_z) if len(at) + len(left) < self.n else 0.0))

    def home(self, i: int, t: int) -> int:
        """The greatest of row i; equal up to rounding, the first."""
        at, w, _ = self.w(i, t)
        if not len(at) or w.max() <= 0:
            return 0
        p = np.log1p(w)
        return int(at[p >= p.max() * (1 - 1e-9)].min())


def _settled(spark: SparkSession, n: int, i: np.ndarray, j: np.ndarray, value: np.ndarray, beta: float, merge_singletons: bool, tolerance: float) -> np.ndarray:
    """The same where the square matrix is too large: tasks compute rows on their own, from the similarity's rows, which are broadcast.

    Among n notes a row of the state is close to 1 / n, so few rounds settle: with COARSE and FINE at most three beyond 8,000 notes.
    """
    order = np.lexsort((j, i))
    shared = spark.sparkContext.broadcast((n, np.concatenate([[0], np.cumsum(np.bincount(i, minlength=n))]), j[order], value[order], beta))

    def over(ids: np.ndarray, work, schema: str) -> list:
        """work(rows, ids) -> record batch, over parts of ids."""
        parts = max(1, min(len(ids), 4 * width(spark)))
        cut, told = np.linspace(0, len(ids), parts + 1).astype(int), spark.sparkContext.broadcast(ids)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _Rows(*shared.value)
            for b in batches:
                for k in b.column("id").to_pylist():
                    yield work(rows, told.value[cut[k] : cut[k + 1]])

        return spark.range(0, parts, 1, parts).mapInArrow(each, schema).collect()

    every, home = np.arange(n), np.zeros(n, dtype=np.int64)
    for t in range(2, iterations(n) + 1):

        def round_of(rows: _Rows, ids: np.ndarray, t: int = t, last: bool = t == iterations(n)) -> pa.RecordBatch:
            """The attractors, unless a row still moves."""
            homes = []
            for x in ids:
                if not last and rows.moved(x, t) >= tolerance:
                    return pa.RecordBatch.from_pydict({"settled": [False], "first": [ids[0]], "home": pa.array([[]], pa.list_(pa.int64()))})
                homes.append(rows.home(x, t))
            return pa.RecordBatch.from_pydict({"settled": [True], "first": [ids[0]], "home": pa.array([homes], pa.list_(pa.int64()))})

        got = over(every, round_of, "settled boolean, first long, home array<long>")
        if all(r["settled"] for r in got):
            for r in got:
                home[r["first"] : r["first"] + len(r["home"])] = r["home"]
            break

    size = np.bincount(home, minlength=n)
    big, alone = np.flatnonzero(size > 1), np.flatnonzero(size[home] == 1)
    if not merge_singletons or not len(big) or not len(alone):
        return home

    def closest(rows: _Rows, ids: np.ndarray) -> pa.RecordBatch:
        """The widest cosine between an attractor's row and those of the larger communities."""
        best, at = np.full(len(ids), -np.inf), np.zeros(len(ids), dtype=np.int64)
        step = max(1, 4_000_000 // n)
        for lo in range(0, len(ids), step):
            some = np.ones((n, len(ids[lo : lo + step])))  # a column each: what a row of `to` has lies together
            for x, i in enumerate(ids[lo : lo + step]):
                to, w, _ = rows.w(home[i], t)
                some[to, x] += w
            some /= np.linalg.norm(some, axis=0)
            every = some.sum(axis=0)
            for b in big:
                to, w, _ = rows.w(b, t)
                cos = (every + w @ some[to]) / (n + 2 * w.sum() + w @ w) ** 0.5
                wider = cos > best[lo : lo + step]
                best[lo : lo + step][wider], at[lo : lo + step][wider] = cos[wider], b
        return pa.RecordBatch.from_pydict({"i": ids, "home": at})

    for r in over(alone, closest, "i long, home long"):
        home[r["i"]] = r["home"]
    return home


def modularity(s: DataFrame, members: DataFrame) -> DataFrame:
    """One row, modularity: weighted, of a partition (note_path, community) on the whole similarity."""
    w = both_ways(s)
    ends = w.join(members.select(F.col("note_path").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("note_path").alias("b"), F.col("community").alias("cb")), "b")
    inside = ends.where("ca = cb").groupBy("ca").agg(F.sum("value").alias("inside"))
    strength = w.join(members.select(F.col("note_path").alias("a"), F.col("community").alias("ca")), "a").groupBy("ca").agg(F.sum("value").alias("strength"))
    total = w.agg(F.sum("value").alias("total"))
    rows = strength.join(inside, "ca", "left").crossJoin(F.broadcast(total))
    return rows.agg(F.coalesce(F.sum((F.coalesce("inside", F.lit(0.0)) - F.col("strength") * F.col("strength") / F.col("total")) / F.col("total")), F.lit(0.0)).alias("modularity"))


def detect(vectors: DataFrame, triples: DataFrame, state: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(level, community, note_path) and (level, communities, sizes, modularity), level 0 coarse and 1 fine. Fewer than three notes give none."""
    spark, x = vectors.sparkSession, similarity(vectors, triples, state, edges)
    n, rows, found = len(x.paths), [], []
    if n >= 3:
        near = x.nearest(max(COARSE[1], FINE[1])).toArrow()
        i, j, value, nth = (near[c].to_numpy() for c in ("i", "j", "value", "nth"))
        for (beta, top_k), merge in ((COARSE, True), (FINE, False)):
            used = nth <= top_k
            found.append(_homes(spark, n, i[used], j[used], value[used], beta, merge))
        for level, (home, q) in enumerate(zip(found, x.modularity(*found))):
            size = np.bincount(home)
            size = size[size > 0]
            rows.append((len(size), int(size.min()), int(size.max()), float(size.mean()), q, level))
    members = pa.table({"note_path": pa.array(np.tile(x.paths, len(found)), pa.string()), "community": pa.array(x.paths[np.concatenate(found)] if found else [], pa.string()), "level": pa.array(np.repeat(np.arange(len(found)), n), pa.int32())})
    schema = "n_communities long, min_size long, max_size long, mean_size double, modularity double, level int"
    return spark.createDataFrame(members, "note_path string, community string, level int"), spark.createDataFrame(rows, schema)


def size_stats(members: DataFrame) -> DataFrame:
    size = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return size.agg(F.count(F.lit(1)).alias("n_communities"), F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.avg("size").alias("mean_size"))


def health(n_coarse: int, n_fine: int, q_coarse: float, q_fine: float, least: float = 0.05) -> str | None:
    """A warning where the hierarchy carries no structure."""
    if n_coarse and n_fine <= n_coarse:
        return f"the fine level has {n_fine} communities, the coarse one {n_coarse}: fine isn't finer"
    if max(q_coarse, q_fine) < least:
        return f"modularity {q_coarse:.3f} and {q_fine:.3f}: below {least}, the notes hardly form communities"
    return None


def build_status(notes: DataFrame, built_at, max_age_days: int = 14, max_drift: float = 0.10) -> DataFrame:
    """One row: notes, changed since the build, drift, stale. built_at and the clock come as a struct of timestamps (built, now)."""
    c = notes.agg(F.count(F.lit(1)).alias("n_notes"), F.coalesce(F.sum(F.when(F.col("updated_at") > built_at["built"], 1).otherwise(0)), F.lit(0)).alias("changed"))
    age = F.datediff(built_at["now"], built_at["built"])
    drift = F.when(F.col("n_notes") > 0, F.col("changed") / F.col("n_notes")).otherwise(0.0)
    return c.select("n_notes", "changed", drift.alias("drift"), age.alias("age_days"), ((age >= max_age_days) | (drift >= max_drift)).alias("stale"))
