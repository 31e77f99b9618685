"""Filling fixed-capacity containers with items: bulk-synchronous best fit.

Items and the gaps of open containers are one table, range-sorted by size from large to small. In each round a
sweep gives every item its successor, the smallest free gap that holds it, each gap once (several times where
items outnumber the gaps). Every range partition sweeps on its own; items left there are
carried to the gaps that partitions of larger sizes have left, nearest first. Conflicts between items of one size
are resolved by rank. Gaps are updated and the round repeats until no item fits; then containers are opened.

Sizes are whole numbers up to the capacity, and items of one size are interchangeable but for their
rank. So the rows of the table are runs (size, first rank, count) and (gap, first container, count): the
outcome is the same, and the rounds' work is bounded by capacity and rounds, not by the number of items.
Ranks and containers of the items themselves are found in parallel over range partitions.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize, shared_dir, width

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern that belongs to the vocabulary file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict[str, object] = {}


def _encoding(path: str):
    """The tokenizer, once per Python worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, n_tokens of every non-null text."""
    docs = documents.select(F.col("doc_id").cast("long"), "text").where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _encoding(tokenizer).encode_ordinary
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(count(t)) for t in b.column("text").to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return docs.mapInArrow(run, "doc_id long, n_tokens long")


class Containers:
    """Runs of open containers and the placements made so far."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first container, count)
        self.placed: list[tuple[int, int, int, int]] = []  # size, first rank, count, first container

    def open(self, size: int, rank: int, count: int) -> None:
        self.placed.append((size, rank, count, self.opened))
        if size < self.capacity:
            self.gaps[self.capacity - size].append((self.opened, count))
        self.opened += count


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Placements (size, first rank, count, first container) of all items, and the number of containers: the rounds in one process, for a histogram at hand and as the measure of `rounds`."""
    c = Containers(capacity)
    left: dict[int, tuple[int, int]] = {}  # size -> (first rank, count)
    for size, n in histogram.items():
        if 2 * size > capacity:
            c.open(size, 0, n)  # no two of them share a container
        else:
            left[size] = (0, n)
    while left:
        progress, gaps, stack = False, defaultdict(list), []
        values = sorted(set(left) | set(c.gaps), reverse=True)
        for v in values:
            stack += [(v, first, n) for first, n in c.gaps.get(v, [])]
            if v not in left:
                continue
            rank, n = left.pop(v)
            while n and stack:
                gap, first, free = stack.pop()
                m = min(n, free)
                each = max(1, min(gap // v, n // free))  # where items outnumber the gaps, a gap takes several
                c.placed += [(v, rank + j * m, m, first) for j in range(each)]
                progress = True
                if gap > v * each:
                    gaps[gap - v * each].append((first, m))
                if free > m:
                    stack.append((gap, first + m, free - m))
                rank, n = rank + m * each, n - m * each
            if n:
                left[v] = (rank, n)
        for gap, first, n in stack:
            gaps[gap].append((first, n))
        c.gaps = gaps
        if left and not progress:
            total = sum(s * n for s, (_, n) in left.items())
            need = max(1, -(-total // capacity))
            for size in sorted(left, reverse=True):
                rank, n = left[size]
                m = min(n, need)
                c.open(size, rank, m)
                need -= m
                if m == n:
                    del left[size]
                else:
                    left[size] = (rank + m, n - m)
                if not need:
                    break
    return c.placed, c.opened


# The rounds over tables of runs. kind 0: gaps, key is the first container; 1: items, key is the first rank.
STATE = "kind int, value long, key long, n long"
#: what 0 and 1: gaps and items left, off their place among those of the partition; 2: placed (size, first rank, count, first container); 3: gaps after use.
SWEPT = "what int, part int, off long, value long, key long, n long, first long"
#: Runs that a range partition is meant to hold.
RUNS = 2_000
#: Runs of placements that are broadcast, 64 MB.
MAX_PLACED = 2_000_000


def _rows_of(b: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in b.columns))


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64()}
    cols = [c.split() for c in schema.split(", ")]
    data = list(zip(*rows)) if rows else [()] * len(cols)
    return pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for x, (_, k) in zip(data, cols)], names=[c for c, _ in cols])


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition from large to small: gaps lie on a stack, the smallest on top."""
    part, stack, left = TaskContext.get().partitionId(), [], 0
    for b in batches:
        out = []
        for kind, value, key, n in _rows_of(b):
            if kind == 0:
                stack.append((value, key, n))
                continue
            while n and stack:
                gap, first, free = stack.pop()
                m = min(n, free)
                each = max(1, min(gap // value, n // free))
                out += [(2, part, 0, value, key + j * m, m, first) for j in range(each)]
                if gap > value * each:
                    out.append((3, part, 0, gap - value * each, first, m, 0))
                if free > m:
                    stack.append((gap, first + m, free - m))
                key, n = key + m * each, n - m * each
            if n:
                out.append((1, part, left, value, key, n, 0))
                left += n
        yield _batch(out, SWEPT)
    rest, off = [], 0
    for gap, first, free in reversed(stack):
        rest.append((0, part, off, gap, first, free, 0))
        off += free
    yield _batch(rest, SWEPT)


def _carries(items: dict[int, int], gaps: dict[int, int], parts: int) -> list[tuple[int, int, int, int, int]]:
    """(part of gaps, offset, part of items, offset, count): items left meet the nearest gaps left by partitions of larger sizes."""
    stack, out = [], []
    for j in range(parts):
        at, n = 0, items.get(j, 0)
        while at < n and stack:
            i, used = stack.pop()
            m = min(n - at, gaps[i] - used)
            out.append((i, used, j, at, m))
            at += m
            if used + m < gaps[i]:
                stack.append((i, used + m))
        if gaps.get(j):
            stack.append((j, 0))
    return out


def _tag(shared):
    """Cut the runs left by the carries: id of the carry (-1: none) and the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
        for c, (i, x, j, y, m) in enumerate(shared.value):
            spans[(0, i)].append((x, m, c))
            spans[(1, j)].append((y, m, c))
        for b in batches:
            out = []
            for what, part, off, value, key, n, _ in _rows_of(b):
                at = 0
                for x, m, c in sorted(spans.get((what, part), ())):
                    lo, hi = max(off + at, x), min(off + n, x + m)
                    if lo >= hi:
                        continue
                    if lo > off + at:
                        out.append((-1, what, 0, value, key + at, lo - off - at))
                    out.append((c, what, lo - x, value, key + lo - off, hi - lo))
                    at = hi - off
                if at < n:
                    out.append((-1, what, 0, value, key + at, n - at))
            yield _batch(out, "id int, what int, off long, value long, key long, n long")

    return run


def _pair(t: pa.Table) -> pa.Table:
    """Place the items of one carry in its gaps, in order."""
    rows = sorted(zip(*(t.column(c).to_pylist() for c in ("what", "off", "value", "key", "n"))))
    gaps, items, out = [r[2:] for r in rows if r[0] == 0], [r[2:] for r in rows if r[0] == 1], []
    i = j = x = y = 0
    while i < len(gaps) and j < len(items):
        (gap, first, free), (size, rank, n) = gaps[i], items[j]
        m = min(free - x, n - y)
        out.append((2, 0, 0, size, rank + y, m, first + x))
        if gap > size:
            out.append((3, 0, 0, gap - size, first + x, m, 0))
        x, y = x + m, y + m
        if x == free:
            i, x = i + 1, 0
        if y == n:
            j, y = j + 1, 0
    return pa.Table.from_batches([_batch(out, SWEPT)])


def _opened(capacity: int, need: int, opened: int, before: dict[int, int]):
    """A container of its own for each of the `need` largest items left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for what, part, off, value, key, n, first in _rows_of(b):
                at = before.get(part, 0) + off
                m = min(max(need - at, 0), n) if what == 1 else 0
                if m:
                    out.append((2, part, 0, value, key, m, opened + at))
                    if value < capacity:
                        out.append((3, part, 0, capacity - value, opened + at, m, 0))
                if m < n:
                    out.append((what, part, off, value, key + m, n - m, first))
            yield _batch(out, SWEPT)

    return run


def rounds(histogram: DataFrame, capacity: int) -> DataFrame:
    """size, rank, n, first: runs of placements of all items. histogram: n_tokens, n."""
    spark = histogram.sparkSession
    state = materialize(histogram.select(F.lit(1).alias("kind"), F.col("n_tokens").cast("long").alias("value"), F.lit(0).cast("long").alias("key"), F.col("n").cast("long").alias("n")), "runs")
    large, runs = state.agg(F.sum(F.when(2 * F.col("value") > capacity, F.col("n")).otherwise(0)), F.count(F.lit(1))).first()
    placed, opened = [], 0
    need = int(large or 0)  # no two of these share a container
    by = [F.desc("value"), "kind", "key"]
    while True:
        parts = max(2, min(width(spark), runs // RUNS + 1))
        swept = materialize(state.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_sweep, SWEPT), "swept")
        told = swept.groupBy("part", "what").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("tokens"), F.count(F.lit(1)).alias("runs")).collect()  # four rows a partition
        count = lambda what: {r["part"]: r["n"] for r in told if r["what"] == what}
        items, fitted = count(1), count(2)
        if fitted:
            placed.append(swept.where("what = 2"))
        if not items:
            break
        tokens = sum(r["tokens"] for r in told if r["what"] == 1)
        runs = sum(r["runs"] for r in told if r["what"] != 2)
        carries = _carries(items, count(0), parts)
        if carries:
            tagged = materialize(swept.where("what < 2").mapInArrow(_tag(spark.sparkContext.broadcast(carries)), "id int, what int, off long, value long, key long, n long"), "carried")
            met = materialize(tagged.where("id >= 0").groupBy("id").applyInArrow(_pair, SWEPT), "met")
            placed.append(met.where("what = 2"))
            rest = tagged.where("id < 0").unionByName(met.where("what = 3"), allowMissingColumns=True).unionByName(swept.where("what = 3"), allowMissingColumns=True)
        elif fitted:
            rest = swept.where("what <> 2")
        else:
            need = need or -(-int(tokens) // capacity)
            need = min(need, sum(items.values()))
            before = {j: sum(n for i, n in items.items() if i < j) for j in items}
            rest = materialize(swept.mapInArrow(_opened(capacity, need, opened, before), SWEPT), "opened")
            placed.append(rest.where("what = 2"))
            rest = rest.where("what <> 2")
            opened += need
            need = 0
        state = rest.select(F.when(F.col("what") == 1, 1).otherwise(0).alias("kind"), "value", "key", "n")
    out = spark.createDataFrame([], SWEPT) if not placed else placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return materialize(out.select(F.col("value").alias("size"), F.col("key").alias("rank"), "n", "first"), "placements")


def pack(sizes: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, n_tokens, container. sizes: doc_id, n_tokens.

    An item over the capacity is divided into pieces of `capacity` and a rest; no other
    item is divided. Each container holds at most `capacity`. Items of size 0 or null
    need no container and are left out. Repeated rows are repeated items.
    """
    spark = sizes.sparkSession
    whole = F.floor((F.col("n_tokens") - 1) / capacity).cast("int")
    piece = F.explode(F.sequence(F.lit(0), whole))
    items = (
        sizes.where(F.col("n_tokens") > 0)
        .select("doc_id", "n_tokens", piece.alias("piece"))
        .select("doc_id", "piece", F.when(F.col("piece") < F.floor((F.col("n_tokens") - 1) / capacity), F.lit(capacity)).otherwise(F.col("n_tokens") - F.col("piece") * capacity).cast("int").alias("n_tokens"))
    )
    keys = ["n_tokens", "doc_id", "piece"]
    shared_dir(spark)
    rows = items.repartitionByRange(width(spark), *keys).sortWithinPartitions(*keys).checkpoint()

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            counts += np.bincount(b.column(0).to_numpy(zero_copy_only=False), minlength=capacity + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), TaskContext.get().partitionId(), dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["part", "size", "n"])

    # Ranges don't overlap, so there are at most capacity + partitions rows.
    local = rows.select("n_tokens").mapInArrow(shape, "part int, size int, n long").collect()
    histogram: dict[int, int] = defaultdict(int)
    before: dict[tuple[int, int], int] = {}
    for r in sorted(local):
        before[(r["part"], r["size"])] = histogram[r["size"]]
        histogram[r["size"]] += r["n"]
    sizes_ = spark.createDataFrame([(int(k), int(n)) for k, n in histogram.items()], "n_tokens long, n long")
    placed = rounds(sizes_, capacity)
    if placed.count() > MAX_PLACED:
        raise ValueError(f"more than {MAX_PLACED} runs of placements: take a smaller capacity")
    table = placed.toPandas().sort_values(["size", "rank"])
    runs = table[["size", "rank", "n", "first"]].to_numpy(dtype=np.int64).reshape(-1, 4)
    recipe = spark.sparkContext.broadcast((runs[:, 0].copy(), runs[:, 1].copy(), runs[:, 3].copy(), before))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, ranks, first, before = recipe.value
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for b in batches:
            if not b.num_rows:
                continue
            size = b.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.flatnonzero(np.diff(size)) + 1])
            lengths = np.diff(np.concatenate([starts, [len(size)]]))
            base = []
            for s, n in zip(size[starts].tolist(), lengths.tolist()):
                base.append(before.get((part, s), 0) + seen[s])
                seen[s] += n
            rank = np.repeat(base, lengths) + np.arange(len(size)) - np.repeat(starts, lengths)
            k = np.empty(len(size), dtype=np.int64)
            low, high = np.searchsorted(sizes, size[starts], "left"), np.searchsorted(sizes, size[starts], "right")
            for a, n, lo, hi in zip(starts.tolist(), lengths.tolist(), low.tolist(), high.tolist()):  # the runs of one size, by rank
                k[a : a + n] = lo + np.searchsorted(ranks[lo:hi], rank[a : a + n], "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first[k] + rank - ranks[k])], names=[*b.schema.names, "container"])

    return rows.mapInArrow(assign, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, n_tokens int, container long")


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """The documents' texts in containers of `capacity` tokens: doc_id, piece, n_tokens, container. Null and empty texts have none."""
    return pack(materialize(token_counts(documents, tokenizer), "token-counts"), capacity)
