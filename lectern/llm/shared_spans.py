"""Long exact spans shared between records, by super-k-mer partitioning.

A window is `length` characters. Its minimiser is the smallest hash of the k-grams in
it; consecutive windows with the same minimiser form one super-k-mer, which travels
as one packed string to the bucket of that minimiser. Equal windows have equal
minimisers, so every bucket is counted on its own, by sorting its windows.

Minimisers that occur in one record only can't hold a shared window. They are found
first, from 16 bytes per super-k-mer, and only strings of shared minimisers travel.

A bucket of more than HOT super-k-mers (a licence text in very many records) never comes to one
task: its windows travel singly, as two hashes of 64 bits, and are counted by Spark's aggregation.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

GRAM = 32
HOT = 512


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(codes: np.ndarray, k: int, mult: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every k-gram, from hashes of half the size."""
    mult = np.uint64(mult)
    h, size, out, done = _mix(codes.astype(np.uint64) + (mult >> np.uint64(32))), 1, None, 0
    n = len(codes)
    while True:
        if k & size:
            if out is None:
                out, done = h, size
            else:
                m = n - done - size + 1
                out = out[:m] * (mult ** np.uint64(size)) + h[done : done + m]
                done += size
        if size * 2 > k:
            return _mix(out[: n - k + 1])
        m = n - 2 * size + 1
        h = h[:m] * (mult ** np.uint64(size)) + h[size : size + m]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    size, n = 1, len(x)
    while size * 2 <= w:
        m = len(x) - size
        x = np.minimum(x[:m], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: n - w + 1], x[rest : rest + n - w + 1]) if rest else x


def super_kmers(codes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of every super-k-mer of a text of at least `length` code points."""
    m = sliding_min(gram_hashes(codes, k), length - k + 1)
    starts = np.concatenate([[0], np.flatnonzero(m[1:] != m[:-1]) + 1])
    return m[starts].astype(np.int64), starts, np.diff(np.concatenate([starts, [len(m)]]))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _minimisers(docs: DataFrame, length: int, k: int) -> DataFrame:
    """doc_id, bucket, start, windows of every super-k-mer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, ms, starts, wins = [], [], [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                m, s, w = super_kmers(_codes(text), length, k)
                rows.append(np.full(len(m), i))
                ms.append(m)
                starts.append(s)
                wins.append(w)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(ms)), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(np.concatenate(wins).astype(np.int32))],
                    names=["doc_id", "bucket", "start", "windows"],
                )

    return docs.mapInArrow(run, "doc_id long, bucket long, start int, windows int")


def _packed(docs: DataFrame, length: int) -> DataFrame:
    """The packed strings: bucket, doc_id, start, packed. Input rows have spans (bucket, start, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, buckets, starts, texts = [], [], [], []
            for i, (text, spans) in enumerate(zip(b.column("text").to_pylist(), b.column("spans").to_pylist())):
                for s in spans:
                    a = s["start"]
                    rows.append(i)
                    buckets.append(s["bucket"])
                    starts.append(a)
                    texts.append(text[a : a + s["windows"] + length - 1])
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(buckets, pa.int64()), b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(texts, pa.string())], names=["bucket", "doc_id", "start", "packed"]
                )

    return docs.mapInArrow(run, "bucket long, doc_id long, start int, packed string")


def _windows(docs: DataFrame, length: int) -> DataFrame:
    """h1, h2, doc_id, start: the windows of the spans one by one, by two hashes (equal windows: equal hashes; others agree with a chance of 2^-128)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (text, spans) in enumerate(zip(b.column("text").to_pylist(), b.column("spans").to_pylist())):
                codes = _codes(text)
                at = np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in spans])
                h1, h2 = gram_hashes(codes, length)[at], gram_hashes(codes, length, 0xD6E8FEB86659FD93)[at]
                doc = b.column("doc_id").take(pa.array(np.full(len(at), i)))
                yield pa.RecordBatch.from_arrays([pa.array(h1.astype(np.int64)), pa.array(h2.astype(np.int64)), doc, pa.array(at.astype(np.int32))], names=["h1", "h2", "doc_id", "start"])

    return docs.mapInArrow(run, "h1 long, h2 long, doc_id long, start int")


def _hot_shared(windows: DataFrame, length: int, want_pairs: bool) -> DataFrame:
    """What _counted gives, of hot buckets. Windows of the same records are one group, of which one window stands for all; only its pairs are formed."""
    windows = materialize(windows, "hot-windows")
    none = F.lit(None)
    if not want_pairs:
        shared = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h1", "h2")
        return windows.join(shared, ["h1", "h2"]).select(F.col("doc_id").alias("doc_a"), none.cast("long").alias("doc_b"), "start", (F.col("start") + length).alias("end"))
    owners = windows.select("h1", "h2", "doc_id").distinct()
    groups = owners.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y")).where("n > 1")
    one = groups.groupBy("n", "x", "y").agg(F.min(F.struct("h1", "h2")).alias("w")).select("w.h1", "w.h2")
    members = materialize(owners.join(one, ["h1", "h2"]), "hot-groups")
    pairs = members.withColumnRenamed("doc_id", "doc_a").join(members.withColumnRenamed("doc_id", "doc_b"), ["h1", "h2"]).where("doc_a < doc_b")
    return pairs.select("doc_a", "doc_b", none.cast("int").alias("start"), none.cast("int").alias("end")).distinct()


def count_windows(strings: list[tuple[int, int, str]], length: int, want_pairs: bool = True) -> tuple[dict[tuple[int, int], list], set[tuple[int, int]]]:
    """Shared runs of windows and pairs of one bucket. strings: (doc, start, packed).

    The windows of all strings are sorted; equal neighbours that belong to two records or
    more are shared. Returns {(doc, start): window offsets}, {(doc, doc)}; no pairs are formed unless wanted.
    """
    by_text: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for doc, start, text in strings:
        by_text[text].append((doc, start))
    texts = list(by_text)
    shared: dict[tuple[int, int], list] = defaultdict(list)
    groups: set[frozenset[int]] = set()
    if len(texts) == 1:
        docs = frozenset(d for d, _ in by_text[texts[0]])
        if len(docs) > 1:
            if want_pairs:
                groups.add(docs)
            for key in by_text[texts[0]]:
                shared[key] = list(range(len(texts[0]) - length + 1))
    else:
        windows = sorted((t[w : w + length], i, w) for i, t in enumerate(texts) for w in range(len(t) - length + 1))
        owners = [frozenset(d for d, _ in by_text[t]) for t in texts]
        at = 0
        while at < len(windows):
            end = at + 1
            while end < len(windows) and windows[end][0] == windows[at][0]:
                end += 1
            same = {i for _, i, _ in windows[at:end]}
            docs = owners[windows[at][1]] if len(same) == 1 else frozenset().union(*(owners[i] for i in same))
            if len(docs) > 1:
                if want_pairs:
                    groups.add(docs)
                for _, i, w in windows[at:end]:
                    for key in by_text[texts[i]]:
                        shared[key].append(w)
            at = end
    pairs = {p for g in groups for p in combinations(sorted(g), 2)}
    return shared, pairs


def _runs(offsets: list[int]) -> list[tuple[int, int]]:
    x = np.unique(np.asarray(offsets))
    cut = np.flatnonzero(np.diff(x) != 1)
    return list(zip(x[np.concatenate([[0], cut + 1])].tolist(), x[np.concatenate([cut, [len(x) - 1]])].tolist()))


def _counted(packed: DataFrame, length: int, want_pairs: bool) -> DataFrame:
    """doc_a, doc_b; or, unless pairs are wanted, doc_a with start and end of a run of shared windows. No bucket has more than HOT strings."""
    sorted_ = packed.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, seen = None, [], set()
        rows: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                shared, pairs = count_windows(held, length, want_pairs)
                if want_pairs:
                    new = pairs - seen
                    seen.update(new)
                    rows.extend((a, b, None, None) for a, b in new)
                    if len(seen) > 1_000_000:
                        seen.clear()
                else:
                    rows.extend((d, None, s + a, s + e + length) for (d, s), offsets in shared.items() for a, e in _runs(offsets))

        for b in batches:
            for bucket, doc, start, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "doc_id", "start", "packed"))):
                if bucket != key:
                    close()
                    key, held = bucket, []
                held.append((doc, start, text))
            if len(rows) > 5_000:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    return sorted_.mapInArrow(run, "doc_a long, doc_b long, start int, end int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    a, b, s, e = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["doc_a", "doc_b", "start", "end"])


def _copies(docs: DataFrame) -> DataFrame:
    """doc_id, rep of records that are exact copies of others; rep is the smallest id. Records with several texts are left as they are."""
    one = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("key")).groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("last")).where("key = last").select("doc_id", "key")
    classes = one.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "rep")
    return materialize(one.join(classes, "key").select("doc_id", "rep"), "copies")


def _texts(documents: DataFrame, length: int) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long"), "text").where((F.length("text") >= length) & F.col("doc_id").isNotNull())


def _shared_windows(docs: DataFrame, copies: DataFrame | None, length: int, want_pairs: bool, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """What _counted gives; of exact copies (doc_id, rep) only the representative takes part, so a hot group of copies is one record here."""
    if length < 2 * gram:
        raise ValueError(f"length must be at least {2 * gram}")
    grams = materialize(_minimisers(docs, length, gram), "super-k-mers")
    if copies is not None:
        grams = grams.join(copies.where("doc_id <> rep").select("doc_id"), "doc_id", "left_anti")
    buckets = (
        grams.groupBy("bucket")
        .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n"))
        .where("lo <> hi")
        .select("bucket", (F.col("n") > hot).alias("hot"))
    )
    buckets = materialize(buckets, "shared-minimisers")

    def spans(some: DataFrame) -> DataFrame:
        mine = grams.join(some, "bucket").groupBy("doc_id").agg(F.collect_set(F.struct("bucket", "start", "windows")).alias("spans"))
        return docs.join(mine, "doc_id")

    found = _counted(_packed(spans(buckets.where("NOT hot").select("bucket")), length), length, want_pairs)
    crowded = buckets.where("hot").select("bucket")
    return found if crowded.isEmpty() else found.unionByName(_hot_shared(_windows(spans(crowded), length), length, want_pairs))


def shared_pairs(documents: DataFrame, length: int = 300) -> DataFrame:
    """doc_a < doc_b: the pairs of records that have a common substring of at least `length` code points.

    Every pair is listed, those of exact copies too: pairs of representatives are found, then
    expanded. Defined cases: null texts, null ids and texts under the length share nothing;
    repeated rows of a record don't pair it with itself; a span repeated inside one record only
    isn't shared; an empty table gives no rows.
    """
    docs = _texts(documents, length)
    copies = _copies(docs)
    found = _shared_windows(docs, copies, length, True).select("doc_a", "doc_b").distinct()
    a, b = copies.select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("x")), copies.select(F.col("rep").alias("doc_b"), F.col("doc_id").alias("y"))
    across = found.join(a, "doc_a", "left").join(b, "doc_b", "left").select(F.coalesce("x", "doc_a").alias("x"), F.coalesce("y", "doc_b").alias("y"))
    inside = a.join(b.withColumnRenamed("doc_b", "doc_a"), "doc_a").where("x < y").select("x", "y")
    return across.unionByName(inside).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_lengths(documents: DataFrame, length: int = 300) -> DataFrame:
    """doc_id, shared_chars: the characters of each record that lie in spans found elsewhere; records with none are left out.

    No pairs are formed; an exact copy is shared as a whole. The runs of a record are bounded by its own length.
    """
    docs = _texts(documents, length)
    copies = _copies(docs)
    runs = _shared_windows(docs, copies, length, False).select(F.col("doc_a").alias("doc_id"), "start", "end").distinct()
    step = lambda acc, x: F.struct(
        (acc["total"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("total"), F.greatest(acc["upto"], x["end"]).alias("upto")
    )
    zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
    folded = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end"))), zero, step)
    single = runs.groupBy("doc_id").agg(folded["total"].cast("long").alias("shared_chars")).join(copies.select("doc_id"), "doc_id", "left_anti")
    whole = docs.select("doc_id", F.length("text").cast("long").alias("shared_chars")).join(copies.select("doc_id"), "doc_id", "left_semi").distinct()
    return single.unionByName(whole)
