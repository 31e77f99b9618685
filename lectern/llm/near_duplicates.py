"""Near-duplicate records with small edits: BK-trees over word-set sketches.

Contents with one word set form a class; classes are compared. Each class gets a
parity sketch (every word flips one of 128 bits), so that the Hamming distance of two
sketches never exceeds the symmetric difference of the sets: a similarity threshold
becomes an integer radius and nothing above it is lost. A shard holds the classes with one
rare word among those that similar sets must share. Its smaller sets form a BK-tree, children keyed
by their integer Hamming distance to the parent; every set of the shard asks it and follows only
the edges within its radius. All trees of an Arrow batch grow and are searched level by level, in
whole columns. Survivors are verified on their word hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

COUNTERS = 1 << 18
BLOCK = 2048
#: Pairs of askers and tree nodes that one step of a search may hold.
STEP = 2_000_000


def words_of(content):
    """Sorted distinct words of a text column."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))


def radius(n, m, threshold: float):
    """The greatest symmetric difference of sets of n and m words with a Jaccard similarity of the threshold or more."""
    return n + m - 2 * np.ceil(threshold / (1 + threshold) * (np.asarray(n) + m) - 1e-9).astype(np.int64)


def prefixes(n: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(words by which a set is found, words by which it asks): the rarest, of which two similar sets share one.

    A set of n words shares at least threshold * n with any similar set, and 2 * threshold / (1 + threshold) * n with one that isn't smaller.
    """
    return n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1, n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1


def _first(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(sets, 2) words of 64 bits: the parity of each bit over a set's word hashes. No set is empty."""
    bit = np.uint64(1) << (hashes & 63).astype(np.uint64)
    high = (hashes & 64).astype(bool)
    zero = np.uint64(0)
    return np.stack([np.bitwise_xor.reduceat(np.where(high, zero, bit), offsets[:-1]), np.bitwise_xor.reduceat(np.where(high, bit, zero), offsets[:-1])], axis=1)


class BKForest:
    """The BK-trees of many shards. Nodes are rows of `bits`; children are keyed by their integer distance to the parent."""

    def __init__(self, bits: np.ndarray, shard: np.ndarray, rows: np.ndarray):
        """rows: those that enter the tree of their shard, in this order."""
        self.bits = bits
        keys, first = np.unique(shard[rows], return_index=True)
        self.shards, self.roots = keys, rows[first]
        self.size = np.bincount(np.searchsorted(keys, shard[rows]), minlength=len(keys))
        at = self.roots[np.searchsorted(keys, shard[rows])]
        wait = at != rows
        rows, at = rows[wait], at[wait]
        edges, children = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(rows):  # one level of all trees a turn
            slot = at * 129 + self.distance(rows, at)
            taken, first, place = np.unique(slot, return_index=True, return_inverse=True)
            edges.append(taken)
            children.append(rows[first])
            at = rows[first][place]
            wait = at != rows
            rows, at = rows[wait], at[wait]
        edge, child = np.concatenate(edges), np.concatenate(children)
        o = np.argsort(edge, kind="stable")
        self.edge, self.child = edge[o], child[o]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)

    def near(self, asks: np.ndarray, shard: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """(asker, node) of all nodes that are not larger than the asker and whose size and distance allow the threshold. asks: rows; shard and size are of all rows."""
        found_q, found_m = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if not len(self.shards):
            return found_q[0], found_m[0]
        spot = np.minimum(np.searchsorted(self.shards, shard[asks]), len(self.shards) - 1)
        there = self.shards[spot] == shard[asks]
        asks, spot = asks[there], spot[there]
        load = np.cumsum(self.size[spot])
        cuts = np.searchsorted(load, np.arange(STEP, int(load[-1]) + STEP if len(load) else 0, STEP), "right")
        for part in np.split(np.arange(len(asks)), np.unique(cuts)):
            q, m = asks[part], self.roots[spot[part]]
            while len(q):
                d = self.distance(q, m)
                n = size[q]
                fits = (size[m] <= n) & (size[m] >= threshold * n - 1e-9) & (d <= radius(n, size[m], threshold))
                found_q.append(q[fits])
                found_m.append(m[fits])
                reach = radius(n, n, threshold)  # no smaller partner allows more
                a = np.searchsorted(self.edge, m * 129 + np.maximum(d - reach, 0), "left")
                b = np.searchsorted(self.edge, m * 129 + np.minimum(d + reach, 128), "right")
                count = b - a
                q = np.repeat(q, count)
                m = self.child[np.repeat(a - (np.cumsum(count) - count), count) + np.arange(len(q))]
        return np.concatenate(found_q), np.concatenate(found_m)


def word_classes(records: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(rep, h) of every class of equal word sets, h its word hashes, and (memory_id, rep) of its records.

    A class is named by its smallest id; where an id with several contents would name two classes, they are named by a hash of the set.
    """
    words = records.select(F.col("memory_id").cast("long"), words_of(F.col("content")).alias("words")).where(F.col("memory_id").isNotNull() & (F.size("words") >= min_words))
    key = F.unhex(F.substring(F.sha2(F.array_join("words", " "), 256), 1, 32)).alias("key")
    sets = words.select("memory_id", key, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    classes = materialize(sets.groupBy("key").agg(F.min("memory_id").alias("rep"), F.min("h").alias("h")), "word-classes")
    twice = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep", F.lit(True).alias("twice"))
    twice = materialize(twice, "several-contents")
    if not twice.isEmpty():
        classes = classes.join(twice, "rep", "left").select("key", F.when(F.col("twice"), F.xxhash64("key")).otherwise(F.col("rep")).alias("rep"), "h")
    members = sets.select("memory_id", "key").distinct().join(classes.select("key", "rep"), "key").select("memory_id", "rep")
    return classes.select("rep", "h"), materialize(members, "class-members")


MEMBERS = "key long, rep long, n int, found boolean, lo long, hi long"


def _shard_members(counts, threshold: float, above: int = 0):
    """A row for every rare word of every class by which it asks; `found` where it is in the tree too. above: only words with more occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column("h")
            h, offsets = col.flatten().to_numpy(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])
            n, row = np.diff(offsets), _first(offsets)
            bits = sketches(h, offsets)
            many = often[np.mod(h, len(often))]
            o = np.lexsort((h, many, row))
            h, many = h[o], many[o]
            place = np.arange(len(h)) - offsets[row]
            held, asked = prefixes(n, threshold)
            keep = (place < asked[row]) & (many > max(1, above))  # a word of one class only joins nothing
            row = row[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep]), b.column("rep").take(pa.array(row)), pa.array(n[row].astype(np.int32)), pa.array((place < held[_first(offsets)])[keep]), pa.array(bits[row, 0].view(np.int64)), pa.array(bits[row, 1].view(np.int64))],
                names=[c.split()[0] for c in MEMBERS.split(", ")],
            )

    return run


def _search(threshold: float):
    """Grow and search the trees of the shards in a sorted partition; a shard may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def answer(t: pa.Table) -> Iterator[pa.RecordBatch]:
            col = lambda c: t.column(c).to_numpy()
            cell = np.stack([col("key"), col("i"), col("j")])
            shard = np.cumsum(np.concatenate([[0], (cell[:, 1:] != cell[:, :-1]).any(axis=0)]))
            rep, n, held, asks = col("rep"), col("n").astype(np.int64), col("held"), col("asks")
            bits = np.stack([col("lo").view(np.uint64), col("hi").view(np.uint64)], axis=1)
            q, m = BKForest(bits, shard, np.flatnonzero(held)).near(np.flatnonzero(asks), shard, n, threshold)
            other = rep[q] != rep[m]
            a, b = np.minimum(rep[q], rep[m])[other], np.maximum(rep[q], rep[m])[other]
            if len(a):
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["rep_a", "rep_b"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            cell = np.stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            last = np.flatnonzero((cell != cell[:, -1:]).any(axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from answer(t.slice(0, cut).combine_chunks())
            rest = t.slice(cut)
        if rest is not None and rest.num_rows:
            yield from answer(rest.combine_chunks())

    return run


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """rep_a < rep_b: the pairs of classes at the threshold or above. classes: rep, h.

    Word counts come to the driver in COUNTERS slots at most. Shards over BLOCK members are divided into cells of two blocks.
    """
    spark = classes.sparkSession
    slot = F.pmod("word", F.lit(COUNTERS)).cast("int").alias("slot")
    counted = classes.select(F.explode("h").alias("word")).groupBy(slot).agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most COUNTERS rows
    counts = np.zeros(COUNTERS, dtype=np.int64)
    counts[counted["slot"].to_numpy(dtype=np.int64)] = counted["n"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(counts)
    rows = classes.mapInArrow(_shard_members(shared, threshold), MEMBERS)
    work = ["key", "i", "j", "rep", "n", "held", "asks", "lo", "hi"]
    one = F.lit(0)
    plain = lambda r: r.select("key", one.alias("i"), one.alias("j"), "rep", "n", F.col("found").alias("held"), F.lit(True).alias("asks"), "lo", "hi")
    cells = plain(rows)
    hot = None
    if counts.max(initial=0) > BLOCK:  # only then can a shard be larger
        heavy = classes.mapInArrow(_shard_members(shared, threshold, BLOCK), MEMBERS).select("key", "found")
        hot = materialize(heavy.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("found").cast("long")).alias("trees")).where(F.col("size") > BLOCK), "hot-shards")
        hot = None if hot.isEmpty() else hot
    if hot is not None:
        parts = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
        large = rows.join(hot, "key").withColumn("block", F.xxhash64("rep"))
        until = lambda c: F.sequence(F.lit(0), F.greatest(parts(c) - 1, F.lit(0)))
        tree = large.where("found").select("key", F.pmod("block", F.greatest(parts("trees"), F.lit(1))).cast("int").alias("i"), F.explode(until("size")).alias("j"), "rep", "n", F.lit(True).alias("held"), F.lit(False).alias("asks"), "lo", "hi")
        ask = large.where("trees > 0").select("key", F.explode(until("trees")).alias("i"), F.pmod("block", parts("size")).cast("int").alias("j"), "rep", "n", F.lit(False).alias("held"), F.lit(True).alias("asks"), "lo", "hi")
        cells = plain(rows.join(hot.select("key"), "key", "left_anti")).unionByName(tree).unionByName(ask)
    ordered = cells.select(work).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = ordered.mapInArrow(_search(threshold), "rep_a long, rep_b long").distinct()
    a = classes.select(F.col("rep").alias("rep_a"), F.col("h").alias("h_a"))
    b = classes.select(F.col("rep").alias("rep_b"), F.col("h").alias("h_b"))
    both = F.size(F.array_intersect("h_a", "h_b"))
    checked = pairs.join(a, "rep_a").join(b, "rep_b").withColumn("both", both)
    return checked.where(F.col("both") >= F.lit(threshold) * (F.size("h_a") + F.size("h_b") - F.col("both")) - 1e-9).select("rep_a", "rep_b")


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.7, min_words: int = 6) -> DataFrame:
    """memory_a < memory_b: all pairs of records whose distinct words have a Jaccard similarity of the threshold or more.

    Defined cases: null, empty and short contents (under min_words distinct words) pair with
    nothing; records with equal word sets are pairs; repeated rows count once; an id with
    several contents is compared by each; a null id is ignored; an empty table gives no rows.
    """
    classes, ids = word_classes(records, min_words)
    links = similar_classes(classes, threshold)
    a, b = ids.select(F.col("memory_id").alias("x"), F.col("rep").alias("rep_a")), ids.select(F.col("memory_id").alias("y"), F.col("rep").alias("rep_b"))
    across = links.join(a, "rep_a").join(b, "rep_b").where("x <> y")
    inside = a.join(b.withColumnRenamed("rep_b", "rep_a"), "rep_a").where("x < y")
    both = across.select("x", "y").union(inside.select("x", "y"))
    return both.select(F.least("x", "y").alias("memory_a"), F.greatest("x", "y").alias("memory_b")).distinct()


def near_duplicate_groups(records: DataFrame, threshold: float = 0.7, min_words: int = 6, max_rounds: int = 50) -> DataFrame:
    """memory_id, group_id, n_links: groups of records connected by similar pairs; group_id is the smallest id of the group.

    Copies aren't expanded: classes are linked, labels spread over links and jump along
    labels, and each record takes its class's label. n_links counts the class's links to
    other classes. Records without links and copies are left out.
    """
    classes, copies = word_classes(records, min_words)
    links = materialize(similar_classes(classes, threshold), "class-links")
    edges = links.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).union(links.select(F.col("rep_b"), F.col("rep_a")))
    labels = edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("n_links"))
    labels = materialize(labels, "labels")
    for _ in range(max_rounds):
        l2 = labels.select(F.col("a").alias("b"), F.col("label").alias("other"))
        best = edges.join(l2, "b").groupBy("a").agg(F.min("other").alias("other"))
        hop = labels.join(best, "a").select("a", F.least("label", "other").alias("label"), "n_links", F.col("label").alias("old"))
        up = labels.select(F.col("a").alias("label"), F.col("label").alias("top"))
        nxt = materialize(hop.join(up, "label", "left").select("a", F.least("label", F.coalesce("top", "label")).alias("label"), "n_links", (F.least("label", F.coalesce("top", "label")) < F.col("old")).alias("moved")), "labels")
        labels = nxt.drop("moved")
        if nxt.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError(f"labels still move after {max_rounds} rounds")
    multi = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    known = copies.join(labels.withColumnRenamed("a", "rep"), "rep", "left").join(multi, "rep", "left")
    named = known.where("label IS NOT NULL OR copies IS NOT NULL").select("memory_id", F.coalesce("label", "rep").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    smallest = named.groupBy("label").agg(F.min("memory_id").alias("group_id"))
    return named.join(smallest, "label").select("memory_id", "group_id", "n_links")
