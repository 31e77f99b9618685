"""Most similar vectors for every vector: NN-descent over blocks, and greedy search of the graph.

Vectors are stored as 64 signed bytes and a scale (cosine error about 0.001). A random
projection tree, fitted on a bounded sample, puts every vector into a block of
bounded size; oversized leaves are divided by hash. Blocks hold ids, vectors and each vector's
current neighbours as packed columns, one row per block.

A round is a join of neighbours of neighbours: every vector goes to the blocks of some
vectors it lists, those it found last first, once per block however many of them live there;
those that meet at one vector, one of them by a new edge, are compared with each other by matrix
products; better neighbours go back to their home blocks and are merged. An edge is new until it has
been sent once. The graph is written to the shared folder after each round. Blocks that receive more
than LOAD vectors are divided by the senders' blocks, differently in each round, so that a
hub's vectors never come to one task; hubs are met in random groups of bounded size, never left out.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize, remove_path, scratch_path, width

STATE = "block int, ids binary, vec binary, scale binary, nbr binary, sim binary, new binary"
FOUND = "block int, v binary, nbr binary, sim binary"
#: Vectors that one group of a round receives before its block is divided.
LOAD = 32_768


# Vectors


def prepare(vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """id, vec (dim signed bytes), scale of every usable vector: `dim` finite numbers, not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("e")
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            x = x[ok]
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            scale = np.abs(x).max(axis=1) / 127
            q = np.rint(x / scale[:, None]).astype(np.int8)
            length = np.linalg.norm(q.astype(np.float64), axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array([r.tobytes() for r in q], pa.binary()), pa.array((1 / length).astype(np.float32))], names=["id", "vec", "scale"])

    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("e")).where(F.col("id").isNotNull() & (F.size("e") == dim))
    src = src.where(~F.exists("e", lambda v: v.isNull()))
    rows = src.mapInArrow(run, "id long, vec binary, scale float")
    return rows.groupBy("id").agg(F.min(F.struct("vec", "scale")).alias("v")).select("id", "v.vec", "v.scale")


def _matrix(vec, scale, dim: int) -> np.ndarray:
    return np.frombuffer(vec, dtype=np.int8).reshape(-1, dim).astype(np.float32) * np.frombuffer(scale, dtype=np.float32)[:, None]


class Tree:
    """A tree of two-means splits, begun at random vectors of the sample; a side holds a sixth of a node at least."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.normal: list[np.ndarray] = []
        self.cut: list[float] = []
        self.child: list[list[int]] = []
        self.leaves = 0
        self.root = self._grow(sample, leaf, rng, 0)

    def _grow(self, x: np.ndarray, leaf: int, rng, depth: int) -> int:
        if len(x) <= leaf or depth > 40:
            self.leaves += 1
            return -self.leaves
        some = x if len(x) <= 4096 else x[rng.choice(len(x), 4096, replace=False)]
        a, b = some[rng.choice(len(some), 2, replace=False)].astype(np.float32)
        for _ in range(6):
            near = some @ (a - b) > (a @ a - b @ b) / 2
            if near.all() or not near.any():
                break
            a, b = some[near].mean(axis=0), some[~near].mean(axis=0)
        w = a - b
        p = x @ w
        cut = float(np.clip((a @ a - b @ b) / 2, *np.quantile(p, (1 / 6, 5 / 6))))
        low = p <= cut
        if low.all() or not low.any():
            self.leaves += 1
            return -self.leaves
        at = len(self.normal)
        self.normal.append(w)
        self.cut.append(cut)
        self.child.append([0, 0])
        self.child[at][0] = self._grow(x[low], leaf, rng, depth + 1)
        self.child[at][1] = self._grow(x[~low], leaf, rng, depth + 1)
        return at

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf (from 0) of every vector."""
        out = np.zeros(len(x), dtype=np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                low = x[rows] @ self.normal[node] <= self.cut[node]
                stack += [(self.child[node][0], rows[low]), (self.child[node][1], rows[~low])]
        return out


class Forest:
    """Trees and how many groups each leaf is divided into, so that no group exceeds `cap` by much."""

    def __init__(self, trees: list[Tree], cap: int):
        self.trees, self.cap = trees, cap
        self.base = np.cumsum([0] + [t.leaves for t in trees])
        self.parts = np.ones(int(self.base[-1]), dtype=np.int64)

    def leaves(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.base[t] + self.trees[t].route(x)

    def size(self, counts: dict[int, int]) -> None:
        """Divide the leaves. A reference to a vector is its block * stride + its place there, in 4 bytes where that suffices."""
        for k, n in counts.items():
            self.parts[k] = -(-n // self.cap)
        self.first = np.cumsum(self.parts) - self.parts
        self.stride = 2 * self.cap
        self.ref = np.int32 if int(self.parts.sum()) * self.stride < 1 << 31 else np.int64

    def groups(self, x: np.ndarray, ids: np.ndarray, t: int) -> np.ndarray:
        leaf = self.leaves(x, t)
        h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return (self.first[leaf] + (h % self.parts[leaf].astype(np.uint64)).astype(np.int64)).astype(np.int32)


# Lists of neighbours


def best(v: np.ndarray, nbr: np.ndarray, sim: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most similar distinct neighbours of 0..n-1, as padded (n, k) arrays; ties by reference."""
    o = np.lexsort((-sim, nbr, v))
    v, nbr, sim = v[o], nbr[o], sim[o]
    if len(v):
        keep = np.concatenate([[True], (v[1:] != v[:-1]) | (nbr[1:] != nbr[:-1])])
        v, nbr, sim = v[keep], nbr[keep], sim[keep]
    o = np.lexsort((nbr, -sim, v))
    v, nbr, sim = v[o], nbr[o], sim[o]
    rank = np.arange(len(v)) - np.searchsorted(v, v)
    keep = rank < k
    refs, sims = np.full((n, k), -1, dtype=nbr.dtype), np.full((n, k), -2, dtype=np.float32)
    refs[v[keep], rank[keep]], sims[v[keep], rank[keep]] = nbr[keep], sim[keep]
    return refs, sims


def _dense(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of the k most similar others within one group."""
    n, k = len(x), min(k, len(x) - 1)
    if k < 1:
        e = np.empty(0, dtype=np.int64)
        return e, e, np.empty(0, dtype=np.float32)
    rows, cols, sims = [], [], []
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        m = np.arange(len(s))
        s[m, m + a] = -3
        j = np.argpartition(-s, k - 1, axis=1)[:, :k]
        rows.append(np.repeat(m + a, k))
        cols.append(j.ravel())
        sims.append(np.take_along_axis(s, j, 1).ravel())
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims).astype(np.float32)


def _by_block(block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each block."""
    o = np.argsort(block, kind="stable")
    b = block[o]
    cut = np.flatnonzero(np.diff(b)) + 1
    for rows in np.split(o, cut):
        if len(rows):
            yield int(block[rows[0]]), rows


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names = [c.split() for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "float": pa.float32()}
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names)], names=[n for n, _ in names])


def _unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def _ship(v: np.ndarray, nbr: np.ndarray, sim: np.ndarray, forest: Forest) -> pa.Table:
    """Candidates packed by the home block of v; their distances from cosine 1 in half precision, which is finest where neighbours are nearest."""
    rows = [(b, (v[r] - b * forest.stride).astype(np.int16).tobytes(), nbr[r].tobytes(), (1 - sim[r]).astype(np.float16).tobytes()) for b, r in _by_block(v // forest.stride)]
    return _table(rows, FOUND)


# Steps


def _home(shared, dim: int, k: int):
    def build(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        forest: Forest = shared.value
        ids = t.column("id").to_numpy()
        if len(ids) > forest.stride:
            raise ValueError(f"a block has {len(ids)} vectors, more than {forest.stride}")
        raw = np.frombuffer(b"".join(t.column("vec").to_pylist()), dtype=np.int8).reshape(-1, dim)
        scale = t.column("scale").to_numpy().astype(np.float32)
        o = np.argsort(ids)
        ids, raw, scale = ids[o], raw[o], scale[o]
        block = key[0].as_py()
        v, w, s = _dense(raw.astype(np.float32) * scale[:, None], k)
        nbr, sim = best(v, (block * forest.stride + w).astype(forest.ref), s, len(ids), k)
        return _table([(block, ids.tobytes(), raw.tobytes(), scale.tobytes(), nbr.tobytes(), sim.tobytes(), (nbr >= 0).astype(np.int8).tobytes())], STATE)

    return build


def _rows(b: pa.RecordBatch) -> Iterator[dict]:
    yield from b.to_pylist()


TREE = "grp int, ref binary, vec binary, scale binary"


def _tree_messages(shared, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for b in batches:
            for r in _rows(b):
                ids = np.frombuffer(r["ids"], dtype=np.int64)
                x = _matrix(r["vec"], r["scale"], dim)
                raw = np.frombuffer(r["vec"], dtype=np.int8).reshape(-1, dim)
                scale = np.frombuffer(r["scale"], dtype=np.float32)
                ref = (r["block"] * forest.stride + np.arange(len(ids))).astype(forest.ref)
                out = []
                for t in range(1, len(forest.trees)):
                    out += [(g, ref[rows].tobytes(), raw[rows].tobytes(), scale[rows].tobytes()) for g, rows in _by_block(forest.groups(x, ids, t))]
                yield from _table(out, TREE).to_batches()

    return run


def _tree_join(shared, dim: int, k: int):
    def join(t: pa.Table) -> pa.Table:
        forest: Forest = shared.value
        ref = _unpack(t, "ref", forest.ref)
        v, w, s = _dense(_unpack(t, "vec", np.int8).reshape(-1, dim).astype(np.float32) * _unpack(t, "scale", np.float32)[:, None], k)
        return _ship(ref[v], ref[w], s, forest)

    return join


EDGES = "target int, salt int, ref binary, vec binary, scale binary, bar binary, u binary, m binary, new binary"


def _lists(r: dict, ref) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(neighbours, cosines, new or not) of a block's vectors."""
    n = len(r["ids"]) // 8
    return np.frombuffer(r["nbr"], dtype=ref).reshape(n, -1), np.frombuffer(r["sim"], dtype=np.float32).reshape(n, -1), np.frombuffer(r["new"], dtype=np.int8).reshape(n, -1)


def _chosen(nbr: np.ndarray, new: np.ndarray, fan: int) -> np.ndarray:
    """Which edges are sent in a round: the nearest `fan`, new ones before old ones."""
    score = np.where(nbr >= 0, 2 - new, 3) * nbr.shape[1] + np.arange(nbr.shape[1])
    out = np.zeros(nbr.shape, dtype=bool)
    at = np.argsort(score, axis=1)[:, :fan]
    np.put_along_axis(out, at, True, axis=1)
    return out & (nbr >= 0)


def _loads(shared, fan: int):
    """target, n: how many vectors a block sends to each block, once per pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        for b in batches:
            for r in _rows(b):
                nbr, _, new = _lists(r, forest.ref)
                sent = np.where(_chosen(nbr, new, fan), nbr // forest.stride, -1)
                sent.sort(axis=1)
                first = np.ones(sent.shape, dtype=bool)
                first[:, 1:] = sent[:, 1:] != sent[:, :-1]
                at, n = np.unique(sent[first & (sent >= 0)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n)], names=["target", "n"])

    return run


def _edge_messages(shared, dim: int, fan: int, divided, turn: int):
    """Every vector to the blocks of those it lists (and to its own), with the bar that a new neighbour must pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest: Forest = shared.value
        parts = divided.value
        for b in batches:
            for r in _rows(b):
                nbr, sim, new = _lists(r, forest.ref)
                n, home = len(nbr), r["block"]
                bar = (1 - sim[:, -1]).astype(np.float16)
                raw = np.frombuffer(r["vec"], dtype=np.int8).reshape(-1, dim)
                scale = np.frombuffer(r["scale"], dtype=np.float32)
                own = np.arange(n)
                ref = (home * forest.stride + own).astype(forest.ref)
                src, place = np.nonzero(_chosen(nbr, new, fan))
                u, fresh = np.concatenate([nbr[src, place], ref]), np.concatenate([new[src, place], np.zeros(n, dtype=np.int8)])
                src = np.concatenate([src, own])
                out = []
                for target, rows in _by_block(u // forest.stride):
                    salts = range(parts.get(target, 1)) if target == home else ((home * 0x9E3779B1 + turn * 0x85EBCA6B >> 7) % parts.get(target, 1),)
                    mem, m = np.unique(src[rows], return_inverse=True)
                    packed = [ref[mem].tobytes(), raw[mem].tobytes(), scale[mem].tobytes(), bar[mem].tobytes(), (u[rows] - target * forest.stride).astype(np.int16).tobytes(), m.astype(np.int16).tobytes(), fresh[rows].tobytes()]
                    out += [(target, s, *packed) for s in salts]
                yield from _table(out, EDGES).to_batches()

    return run


def _edge_join(shared, dim: int, group: int, most: int, keep_best: int, seed: int):
    """Compare the members that meet at a vector, in random groups, if one came by a new edge; keep what passes a member's bar."""

    def join(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        forest: Forest = shared.value
        rng = np.random.default_rng([seed, key[0].as_py(), key[1].as_py()])
        width_ = np.dtype(forest.ref).itemsize
        sizes = [len(x) // width_ for x in t.column("ref").to_pylist()]
        offset = np.repeat(np.cumsum([0] + sizes[:-1]), [len(x) // 2 for x in t.column("m").to_pylist()])
        ref = _unpack(t, "ref", forest.ref)
        x = _unpack(t, "vec", np.int8).reshape(-1, dim).astype(np.float32) * _unpack(t, "scale", np.float32)[:, None]
        bar = np.concatenate([1 - _unpack(t, "bar", np.float16).astype(np.float32), [np.float32(9)]])
        u, m, new = _unpack(t, "u", np.int16), _unpack(t, "m", np.int16) + offset, _unpack(t, "new", np.int8)
        o = np.lexsort((rng.random(len(u)), u))
        u, m, new = u[o], m[o], new[o]
        at = np.arange(len(u)) - np.searchsorted(u, u)
        g = np.cumsum(at % group == 0) - 1
        size = np.bincount(g, minlength=1)
        cv, cw, cs = [], [], []
        low = 1
        for wide in (4, 8, 12, 16, 24, 32, group):  # groups of like size share one padded product
            mine = np.flatnonzero((size > low) & (size <= wide))
            low = wide
            if not len(mine):
                continue
            row = np.full(len(size), -1, dtype=np.int64)
            row[mine] = np.arange(len(mine))
            here = row[g] >= 0
            full, fresh = np.full((len(mine), wide), -1, dtype=np.int64), np.zeros((len(mine), wide), dtype=bool)
            full[row[g[here]], at[here] % group], fresh[row[g[here]], at[here] % group] = m[here], new[here] > 0
            most_, diagonal = min(most, wide - 1), np.arange(wide)
            step = max(1, 3_000_000 // (wide * wide))
            for a in range(0, len(full), step):
                p, f = full[a : a + step], fresh[a : a + step]
                y = x[p]
                d = np.matmul(y, y.transpose(0, 2, 1))
                d[:, diagonal, diagonal] = -3
                d[(p < 0)[:, None, :] | ~(f[:, :, None] | f[:, None, :])] = -3
                d[d <= bar[p][:, :, None]] = -3
                j = np.argpartition(-d, most_, axis=2)[:, :, :most_]
                q = np.take_along_axis(d, j, 2)
                i0, i1, i2 = np.nonzero(q > -2.5)
                cv.append(p[i0, i1])
                cw.append(p[i0, j[i0, i1, i2]])
                cs.append(q[i0, i1, i2])
        if not cv:
            return _table([], FOUND)
        v, w, s = np.concatenate(cv), np.concatenate(cw), np.concatenate(cs)
        other = ref[v] != ref[w]  # a vector of a divided block may be there twice
        v, w, s = v[other], w[other], s[other]
        _, first = np.unique(v * len(ref) + w, return_index=True)
        v, w, s = v[first], w[first], s[first]
        o = np.lexsort((-s, v))
        v, w, s = v[o], w[o], s[o]
        keep = np.arange(len(v)) - np.searchsorted(v, v) < keep_best
        return _ship(ref[v[keep]], ref[w[keep]], s[keep], forest)

    return join


def _merge(shared, k: int, fan: int):
    """A block's lists with what was found for them; edges sent in this round are no longer new. fan 0: none were sent."""

    def merge(state: pa.Table, found: pa.Table) -> pa.Table:
        if not state.num_rows:
            return _table([], STATE)
        forest: Forest = shared.value
        r = state.to_pylist()[0]
        nbr, sim, new = _lists(r, forest.ref)
        n = len(nbr)
        known = new.astype(bool) & ~_chosen(nbr, new, fan) if fan else new.astype(bool)
        real = nbr >= 0
        old_v = np.repeat(np.arange(n), real.sum(axis=1))
        v = np.concatenate([old_v, _unpack(found, "v", np.int16)])
        refs, sims = best(v, np.concatenate([nbr[real], _unpack(found, "nbr", forest.ref)]), np.concatenate([sim[real], 1 - _unpack(found, "sim", np.float16).astype(np.float32)]), n, k)
        stale = (old_v * (1 << 40) + nbr[real].astype(np.int64))[~known[real]]
        fresh = ~np.isin(np.arange(n)[:, None] * (1 << 40) + refs.astype(np.int64), stale) & (refs >= 0)
        return _table([(r["block"], r["ids"], r["vec"], r["scale"], refs.tobytes(), sims.tobytes(), fresh.astype(np.int8).tobytes())], STATE)

    return merge


class KnnGraph:
    """A neighbour graph in the shared folder: state (blocks), the forest that routes queries, and its settings."""

    def __init__(self, state: DataFrame, shared, dim: int, k: int):
        self.state, self.shared, self.dim, self.k = state, shared, dim, k

    def names(self) -> DataFrame:
        """ref, id of every vector."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in _rows(b):
                    ids = np.frombuffer(r["ids"], dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ids)) + r["block"] * shared.value.stride), pa.array(ids)], names=["ref", "id"])

        return self.state.select("block", "ids").mapInArrow(run, "ref long, id long")

    def neighbours(self, top: int = 10, floor: float = -1.0) -> DataFrame:
        """id, neighbour, sim (approximate cosine), rank from 1; only those of at least `floor`."""
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in _rows(b):
                    ids = np.frombuffer(r["ids"], dtype=np.int64)
                    nbr = np.frombuffer(r["nbr"], dtype=shared.value.ref).reshape(len(ids), -1)[:, :top]
                    sim = np.frombuffer(r["sim"], dtype=np.float32).reshape(len(ids), -1)[:, :top]
                    i, j = np.nonzero(sim >= floor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(nbr[i, j].astype(np.int64)), pa.array(sim[i, j]), pa.array((j + 1).astype(np.int32))], names=["id", "ref", "sim", "rank"])

        near = self.state.select("ids", "nbr", "sim").mapInArrow(run, "id long, ref long, sim float, rank int")
        return near.join(self.names().withColumnRenamed("id", "neighbour"), "ref").select("id", "neighbour", "sim", "rank")


def build_graph(
    vectors: DataFrame, key: str, column: str, dim: int = 64, k: int = 28, trees: int = 4, leaf: int = 2048, rounds: int = 3, fan: int = 20, group: int = 48, keep_best: int = 10, tree_best: int = 12, sample_rows: int = 50_000, seed: int = 7
) -> KnnGraph:
    """The approximate k-nearest-neighbour graph of all usable vectors by NN-descent.

    sample_rows bounds the sample on which the trees are fitted; every row is indexed.
    Vectors of another size, null, with null, NaN or infinite numbers, or all zero take no part.
    Repeated rows count once; of an id's several vectors one is kept, the least as stored. An empty table gives an empty graph.
    """
    if trees < 2:
        raise ValueError("with one tree no list ever leaves its block: at least two are needed")
    spark = vectors.sparkSession
    paths: list[str] = []

    def store(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        paths.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    base = store(prepare(vectors, key, column, dim), "vectors")
    total = base.count()
    share = min(1.0, sample_rows / max(1, total))
    picked = base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("vec", "scale").limit(2 * sample_rows).toPandas()
    x = np.frombuffer(b"".join(picked["vec"]), dtype=np.int8).reshape(-1, dim).astype(np.float32) * picked["scale"].to_numpy(dtype=np.float32)[:, None]
    grain = max(8, int(leaf * len(x) / max(1, total)))
    forest = Forest([Tree(x, grain, seed + t) for t in range(trees)], 2 * leaf)
    shared = spark.sparkContext.broadcast(forest)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        n = np.zeros(int(f.base[-1]), dtype=np.int64)
        for b in batches:
            y = np.frombuffer(b"".join(b.column("vec").to_pylist()), dtype=np.int8).reshape(-1, dim).astype(np.float32)
            y *= b.column("scale").to_numpy()[:, None]
            for t in range(len(f.trees)):
                n += np.bincount(f.leaves(y, t), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["leaf", "n"])

    counts = base.select("vec", "scale").mapInArrow(count, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect()  # at most one row per leaf
    forest.size({r["leaf"]: r["n"] for r in counts})
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            y = np.frombuffer(b"".join(b.column("vec").to_pylist()), dtype=np.int8).reshape(-1, dim).astype(np.float32)
            y *= b.column("scale").to_numpy()[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(f.groups(y, b.column("id").to_numpy(), 0)), *b.columns], names=["block", *b.schema.names])

    routed = base.mapInArrow(route, "block int, id long, vec binary, scale float")
    state = store(routed.groupBy("block").applyInArrow(_home(shared, dim, k), STATE), "graph")
    for i in range(-1, rounds):
        if i < 0:
            met = state.select("block", "ids", "vec", "scale").mapInArrow(_tree_messages(shared, dim), TREE)
            found = met.groupBy("grp").applyInArrow(_tree_join(shared, dim, tree_best), FOUND)
        else:
            heavy = state.select("ids", "nbr", "sim", "new").mapInArrow(_loads(shared, fan), "target int, n long").groupBy("target").agg(F.sum("n").alias("n")).where(F.col("n") > LOAD)
            divided = spark.sparkContext.broadcast({r["target"]: -(-r["n"] // LOAD) for r in heavy.collect()})  # at most one row per block
            met = state.mapInArrow(_edge_messages(shared, dim, fan, divided, i), EDGES)
            found = met.groupBy("target", "salt").applyInArrow(_edge_join(shared, dim, group, 12, keep_best, seed + i), FOUND)
        state = store(state.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_merge(shared, k, fan if i >= 0 else 0), STATE), "graph")
        for old in paths[:-1]:
            remove_path(spark, old)
        del paths[:-1], met, found
        gc.collect()
        spark._jvm.System.gc()  # with no plan of the round left, the context cleaner drops its shuffle files
    return KnnGraph(state, shared, dim, k)


ASKED = "shard int, id long, vec binary, scale float, refs binary, sims binary, nbrs binary, done binary, seen binary"
ASK = "block int, shard int, id long, vec binary, scale float, probes binary, bar float"
REPLY = "shard int, id long, refs binary, sims binary, nbrs binary"


def _frontier(r: dict, ref, k: int, expand: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the best candidates not expanded yet, their neighbours not seen yet)."""
    done = np.frombuffer(r["done"], dtype=np.int8)
    places = np.flatnonzero(done == 0)[:expand]
    near = np.frombuffer(r["nbrs"], dtype=ref).reshape(-1, k)[places].ravel()
    return places, np.setdiff1d(near[near >= 0], np.frombuffer(r["seen"], dtype=ref))


def search(graph: KnnGraph, queries: DataFrame, key: str, column: str, top: int = 10, beam: int = 32, rounds: int = 4, expand: int = 8) -> DataFrame:
    """id, neighbour, sim (approximate cosine), rank: the `top` most similar indexed vectors of every query but itself.

    Greedy search of the graph, all queries at once: a query starts in the block it would be
    stored in; in each round the best candidates not yet expanded send it to their
    neighbours' blocks, which compare it with those neighbours only. Unusable queries have no rows.
    """
    spark, shared, dim, k = graph.state.sparkSession, graph.shared, graph.dim, graph.k
    shards = width(spark)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = shared.value
        for b in batches:
            ids = b.column("id").to_numpy()
            y = np.frombuffer(b"".join(b.column("vec").to_pylist()), dtype=np.int8).reshape(-1, dim).astype(np.float32)
            y *= b.column("scale").to_numpy()[:, None]
            n = len(ids)
            shard = pa.array((ids % shards).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(f.groups(y, ids, 0)), shard, *b.columns, pa.array([b""] * n, pa.binary()), pa.array(np.full(n, -2, dtype=np.float32))], names=[c.split()[0] for c in ASK.split(", ")])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = shared.value
        for b in batches:
            out = []
            for r in _rows(b):
                _, new = _frontier(r, f.ref, k, expand)
                sims = np.frombuffer(r["sims"], dtype=np.float32)
                bar = float(sims[beam - 1]) if len(sims) >= beam else -2.0
                out += [(block, r["shard"], r["id"], r["vec"], r["scale"], new[rows].tobytes(), bar) for block, rows in _by_block(new // f.stride)]
            yield from _table(out, ASK).to_batches()

    def answer(state: pa.Table, asks: pa.Table) -> pa.Table:
        if not state.num_rows or not asks.num_rows:
            return _table([], REPLY)
        f: Forest = shared.value
        r = state.to_pylist()[0]
        x = _matrix(r["vec"], r["scale"], dim)
        nbr = np.frombuffer(r["nbr"], dtype=f.ref).reshape(len(x), -1)
        out = []
        for a in asks.to_pylist():
            q = np.frombuffer(a["vec"], dtype=np.int8).astype(np.float32) * np.float32(a["scale"])
            at = np.frombuffer(a["probes"], dtype=f.ref).astype(np.int64) - r["block"] * f.stride if a["probes"] else np.arange(len(x))
            sims = x[at] @ q
            best_ = np.flatnonzero(sims > a["bar"])
            best_ = best_[np.argsort(-sims[best_], kind="stable")][:beam]
            if len(best_):
                out.append((a["shard"], a["id"], (at[best_] + r["block"] * f.stride).astype(f.ref).tobytes(), sims[best_].astype(np.float32).tobytes(), nbr[at[best_]].tobytes()))
        return _table(out, REPLY)

    def gather(state: pa.Table, replies: pa.Table) -> pa.Table:
        f: Forest = shared.value
        got: dict[int, list[dict]] = {}
        for a in replies.to_pylist():
            got.setdefault(a["id"], []).append(a)
        out = []
        for r in state.to_pylist():
            mine = got.get(r["id"], [])
            done = np.frombuffer(r["done"], dtype=np.int8).copy()
            places, new = _frontier(r, f.ref, k, expand)
            done[places] = 1
            refs = np.concatenate([np.frombuffer(a["refs"], dtype=f.ref) for a in [r, *mine]])
            sims = np.concatenate([np.frombuffer(a["sims"], dtype=np.float32) for a in [r, *mine]])
            near = np.concatenate([np.frombuffer(a["nbrs"], dtype=f.ref).reshape(-1, k) for a in [r, *mine]])
            done = np.concatenate([done, np.zeros(len(refs) - len(done), dtype=np.int8)])
            o = np.argsort(-sims, kind="stable")[:beam]
            seen = np.union1d(np.union1d(np.frombuffer(r["seen"], dtype=f.ref), new), refs).astype(f.ref)
            out.append((r["shard"], r["id"], r["vec"], r["scale"], refs[o].tobytes(), sims[o].tobytes(), near[o].tobytes(), done[o].tobytes(), seen.tobytes()))
        return _table(out, ASKED)

    paths: list[str] = []

    def store(df: DataFrame) -> DataFrame:
        paths.append(scratch_path(spark, "asked"))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    asks = store(prepare(queries, key, column, dim).mapInArrow(start, ASK))
    empty = F.lit(b"")
    state = asks.select("shard", "id", "vec", "scale", *[empty.alias(c) for c in ("refs", "sims", "nbrs", "done", "seen")])
    for _ in range(rounds + 1):
        replies = graph.state.select("block", "vec", "scale", "nbr").groupBy("block").cogroup(asks.groupBy("block")).applyInArrow(answer, REPLY)
        state = store(state.groupBy("shard").cogroup(replies.groupBy("shard")).applyInArrow(gather, ASKED))
        asks = state.mapInArrow(ask, ASK)
        for old in paths[:-1]:
            remove_path(spark, old)
        del paths[:-1], replies
        gc.collect()
        spark._jvm.System.gc()  # as in build_graph

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = shared.value
        for b in batches:
            rows = [(r["id"], int(v), float(s)) for r in _rows(b) for v, s in zip(np.frombuffer(r["refs"], dtype=f.ref)[: top + 1], np.frombuffer(r["sims"], dtype=np.float32))]
            yield from _table(rows, "id long, ref long, sim float").to_batches()

    found = state.mapInArrow(show, "id long, ref long, sim float").join(graph.names().withColumnRenamed("id", "neighbour"), "ref").where("neighbour <> id")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "neighbour"))
    return found.select("id", "neighbour", "sim", rank.alias("rank")).where(F.col("rank") <= top)


def _packed(vectors: DataFrame, key: str, column: str, dim: int, wanted: DataFrame) -> DataFrame:
    """id, x (dim packed numbers, in single precision if they are stored so) of the usable vectors of the ids in `wanted`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("e").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            x = x if x.dtype == np.float32 else x.astype(np.float64)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(ok)), pa.array([r.tobytes() for r in x[ok]], pa.binary())], names=["id", "x"])

    src = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("e")).where(F.size("e") == dim).where(~F.exists("e", lambda v: v.isNull()))
    return src.join(wanted, "id", "left_semi").mapInArrow(run, "id long, x binary").distinct()


def _lengths_1(packed: list[bytes], dim: int) -> np.ndarray:
    """The vectors of _packed in double precision, of length 1."""
    x = np.frombuffer(b"".join(packed), dtype=np.float32 if len(packed) and len(packed[0]) == 4 * dim else np.float64).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact_cosines(pairs: DataFrame, vectors: DataFrame, key: str, column: str, dim: int) -> DataFrame:
    """a, b, cosine of pairs of ids, from the vectors as given; of an id's several vectors the nearest counts."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (_lengths_1(b.column(c).to_pylist(), dim) for c in ("x", "y"))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array((x * y).sum(axis=1))], names=["a", "b", "cosine"])

    known = _packed(vectors, key, column, dim, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    both = pairs.join(known.withColumnRenamed("id", "a"), "a").join(known.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(score, "a long, b long, cosine double").groupBy("a", "b").agg(F.max("cosine").alias("cosine"))


def _met(unsure: DataFrame, stored: DataFrame, vectors: DataFrame, key: str, column: str, dim: int, top: int, floor: float) -> DataFrame:
    """a, b, cosine: of every unsure vector the `top` most similar of each list of those that it lists."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in _rows(b):
                w, s = np.array(r["ids"]), _lengths_1(r["ys"], dim) @ _lengths_1([r["x"]], dim)[0]
                s[w == r["id"]] = -3
                for o in np.argsort(-s, kind="stable")[:top]:
                    if s[o] >= floor:
                        out.append((min(r["id"], int(w[o])), max(r["id"], int(w[o])), float(s[o])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["a", "b", "cosine"])

    asks = stored.join(unsure, "id", "left_semi").select("id", F.col("neighbour").alias("via"))
    lists = stored.join(asks.select(F.col("via").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("via"), F.col("neighbour").alias("id"))
    known = _packed(vectors, key, column, dim, asks.select("id").union(lists.select("id")).distinct())
    held = lists.join(known, "id").groupBy("via").agg(F.collect_list("id").alias("ids"), F.collect_list("x").alias("ys"))  # at most k entries
    return asks.join(known, "id").join(held, "via").select("id", "x", "ids", "ys").mapInArrow(score, "a long, b long, cosine double")


#: Bound of the error of a cosine of 8-bit vectors, several times the usual error of about 0.001.
ERROR = 0.005


def exact_neighbours(graph: KnnGraph, vectors: DataFrame, key: str, column: str, top: int = 10, floor: float = -1.0) -> DataFrame:
    """id, neighbour, sim (exact cosine of at least `floor`), rank: the `top` most similar of each vector among all that it lists or that list it.

    Stored neighbours get exact cosines before the cut, as the stored order is that of 8-bit vectors; only those too far
    below the stored `top`-th to pass it are spared. Where the last stored neighbour is too close to the `top`-th for the
    cut at k to be sure, neighbours of neighbours are compared exactly too.
    """
    stored = materialize(graph.neighbours(graph.k, floor - 2 * ERROR).where("id <> neighbour"), "stored")
    nth = F.max(F.when(F.col("rank") == top, F.col("sim"))).over(Window.partitionBy("id"))
    close = stored.withColumn("nth", nth).where((F.col("rank") <= top) | (F.col("sim") >= F.col("nth") - 2 * ERROR))
    pairs = close.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
    scored = materialize(exact_cosines(pairs, vectors, key, column, graph.dim).where(F.col("cosine") >= floor), "cosines")

    def ranked(scored: DataFrame) -> DataFrame:
        side = lambda v, w: F.struct(F.col(v).alias("id"), F.col(w).alias("neighbour"))
        ends = scored.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p"), F.col("cosine").alias("sim")).select("p.id", "p.neighbour", "sim")
        rank = F.row_number().over(Window.partitionBy("id").orderBy(F.round("sim", 12).desc(), "neighbour"))
        return ends.withColumn("rank", rank).where(F.col("rank") <= top)

    last = stored.where(F.col("rank") == graph.k).select("id", F.col("sim").alias("last"))
    worst = F.coalesce("sim", F.lit(floor))
    unsure = last.join(ranked(scored).where(F.col("rank") == top).select("id", "sim"), "id", "left").where((worst < F.col("last") + ERROR) & (worst < 1 - 1e-9)).select("id")
    unsure = materialize(unsure, "unsure")
    if unsure.isEmpty():
        return ranked(scored)
    more = _met(unsure, stored, vectors, key, column, graph.dim, top, floor)
    return ranked(scored.unionByName(more).groupBy("a", "b").agg(F.max("cosine").alias("cosine")))


def similar_pairs(vectors: DataFrame, key: str, column: str, floor: float, top: int = 10, dim: int = 64, **settings) -> DataFrame:
    """a < b: pairs with a cosine of `floor` or more of which one is among the `top` most similar of the other, by exact cosines."""
    near = exact_neighbours(build_graph(vectors, key, column, dim, **settings), vectors, key, column, top, floor)
    return near.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
