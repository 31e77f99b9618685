"""Evaluation texts leaking into training text.

The n-grams of the held-out items form a broadcast hash set. Training texts are
scanned in Arrow batches: words become the items' word numbers, windows get a
rolling hash, hits are verified word by word.

Evaluation sets too large for a broadcast are joined instead, with one scan of the corpus: windows that
pass a Bloom filter of fixed size meet the items' n-grams in an equi-join on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize

WORD = regex.compile(r"[\p{L}\p{N}]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """The longest runs of Unicode letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def _rolling(numbers: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(max(0, len(numbers) - n + 1), dtype=np.uint64)
    x = numbers.astype(np.uint64)
    for j in range(n):
        h = h * _BASE + x[j : j + len(h)]
    return h


class GramSet:
    """Hash set of the items' word n-grams, with what exact verification needs."""

    def __init__(self, items: list[tuple[int, str]], n: int):
        self.n, self.vocab = n, {}
        numbers, owners = [], []
        for item, text in items:
            w = words(text or "")
            if len(w) < n:
                continue
            numbers.append([self.vocab.setdefault(x, len(self.vocab) + 1) for x in w] + [0])
            owners += [item] * len(w) + [item]
        self.flat = np.asarray([x for a in numbers for x in a], dtype=np.int64)
        self.owner = np.asarray(owners, dtype=np.int64)
        h = _rolling(self.flat, n)
        whole = _clear(self.flat, n)
        at = np.flatnonzero(whole)
        order = at[np.argsort(h[at], kind="stable")]
        self.hashes, self.at = h[order], order

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window offsets, items) of every verified hit; 0 in numbers is a word that no item has."""
        ok = _clear(numbers, self.n)
        at = np.flatnonzero(ok)
        if not len(at) or not len(self.hashes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        h = _window_hashes(numbers, at, self.n)
        lo, hi = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = hi - lo
        win = np.repeat(at, count)
        if not len(win):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        nth = np.arange(len(win)) - np.repeat(np.cumsum(count) - count, count)
        src = self.at[np.repeat(lo, count) + nth]
        same = np.ones(len(win), dtype=bool)
        for j in range(self.n):
            same &= numbers[win + j] == self.flat[src + j]
        return win[same], self.owner[src[same]]


def _clear(numbers: np.ndarray, n: int) -> np.ndarray:
    """Whether each window of n numbers has no 0."""
    if len(numbers) < n:
        return np.zeros(0, dtype=bool)
    zeros = np.concatenate([[0], np.cumsum(numbers == 0)])
    return zeros[n:] == zeros[:-n]


def _window_hashes(numbers: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    x = numbers.astype(np.uint64)
    for j in range(n):
        h = h * _BASE + x[at + j]
    return h


#: Bits of the filter in front of the join, 8 MB.
FILTER_BITS = 1 << 26


def leaked_spans(documents: DataFrame, items: DataFrame, n: int = 13, max_broadcast_chars: int = 20_000_000) -> DataFrame:
    """doc_id, item_id, start, end (character offsets, end excluded), one row per maximal run of shared n-grams.

    Items of up to max_broadcast_chars characters in all are broadcast; larger sets are joined, never dropped, and
    the corpus is scanned once either way. Defined cases: null, empty
    and blank texts and items of fewer than n words match nothing; an item leaking twice
    into a document gives two rows; repeated rows of either table add nothing; with no
    items or documents the result is empty; further columns are ignored.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    src = items.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).dropDuplicates()
    if (src.agg(F.sum(F.length("text"))).first()[0] or 0) <= max_broadcast_chars:
        return _scan(docs, spark.sparkContext.broadcast(GramSet([(r[0], r[1]) for r in src.collect()], n))).dropDuplicates()
    return _joined(docs, src, n)


def _places(gram_words: list[str], cache: dict[str, int]) -> np.ndarray:
    """A hash of every word."""
    out = []
    for w in gram_words:
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    if len(cache) > 500_000:
        cache.clear()
    return np.asarray(out, dtype=np.uint64)


def _joined(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """leaked_spans for evaluation sets of any size."""

    def slots(ws: list[str], cache: dict[str, int]) -> np.ndarray:
        return (_rolling(_places(ws, cache), n) >> np.uint64(20)) % np.uint64(FILTER_BITS)

    def item_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        for b in batches:
            for item, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                ws = words(text)
                if len(ws) >= n:
                    s = slots(ws, cache)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), item)), pa.array(s.astype(np.int64)), pa.array([" ".join(ws[i : i + n]) for i in range(len(s))])], names=["item_id", "slot", "gram"])

    grams = materialize(items.mapInArrow(item_grams, "item_id long, slot long, gram string").distinct(), "item-grams")
    word = (F.col("slot").bitwiseAND(F.lit(63))).cast("int")
    packed = grams.select(F.shiftright("slot", 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), word).alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()  # at most FILTER_BITS / 64 rows
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[packed["at"].to_numpy(dtype=np.int64)] = packed["bits"].to_numpy(dtype=np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = shared.value, {}
        for b in batches:
            rows, at, starts, ends, texts = [], [], [], [], []
            for r, text in enumerate(b.column("text").to_pylist()):
                ws = words(text)
                if len(ws) < n:
                    continue
                s = slots(ws, cache)
                hit = np.flatnonzero(known[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63)) & np.uint64(1))
                if len(hit):
                    spot = [m.span() for m in WORD.finditer(text.lower())] if len(text.lower()) == len(text) else _spans(text)
                for k in hit.tolist():
                    rows.append(r)
                    at.append(k)
                    starts.append(spot[k][0])
                    ends.append(spot[k + n - 1][1])
                    texts.append(" ".join(ws[k : k + n]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), b.column("text_key").take(pa.array(rows, pa.int64())), pa.array(at, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "text_key", "k", "start", "end", "gram"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.withColumn("text_key", F.xxhash64("text"))  # an id may have several texts: runs don't cross them
    hits = keyed.mapInArrow(windows, f"doc_id {kind}, text_key long, k int, start int, end int, gram string").join(grams.select("gram", "item_id"), "gram").drop("gram").distinct()
    by = Window.partitionBy("doc_id", "text_key", "item_id").orderBy("k")
    runs = hits.withColumn("run", F.col("k") - F.row_number().over(by)).groupBy("doc_id", "text_key", "item_id", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select("doc_id", "item_id", "start", "end").distinct()


def _scan(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams: GramSet = shared.value
        get, n = grams.vocab.get, grams.n
        for b in batches:
            texts = b.column("text").to_pylist()
            numbers: list[int] = []
            first = [0]
            for t in texts:
                numbers += [get(w, 0) for w in words(t)]
                numbers.append(0)
                first.append(len(numbers))
            win, item = grams.hits(np.asarray(numbers, dtype=np.int64))
            row = np.searchsorted(np.asarray(first), win, "right") - 1
            rows, items, starts, ends = [], [], [], []
            order = np.lexsort((win, item, row))
            spot: list[tuple[int, int]] = []
            at, prev = -1, None
            for r, i, w in zip(row[order].tolist(), item[order].tolist(), win[order].tolist()):
                if r != at:
                    at, spot = r, [m.span() for m in WORD.finditer(texts[r].lower())] if len(texts[r].lower()) == len(texts[r]) else _spans(texts[r])
                k = w - first[r]
                if prev and prev[0] == r and prev[1] == i and w <= prev[2] + 1:
                    ends[-1] = spot[k + n - 1][1]
                else:
                    rows.append(r)
                    items.append(i)
                    starts.append(spot[k][0])
                    ends.append(spot[k + n - 1][1])
                prev = (r, i, w)
            if rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "item_id", "start", "end"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, start int, end int")


def _spans(text: str) -> list[tuple[int, int]]:
    """Offsets of words in a text that grows when lower-cased, mapped back to the text."""
    back: list[int] = []
    for i, c in enumerate(text):
        back += [i] * len(c.lower())
    return [(back[m.start()], back[m.end() - 1] + 1) for m in WORD.finditer(text.lower())]


def decontaminated(documents: DataFrame, items: DataFrame, n: int = 13, drop_ratio: float = 0.5) -> DataFrame:
    """Documents that leak, cleaned: doc_id, n_items, removed (characters), dropped, text.

    Leaked spans are cut out; where they make up more than drop_ratio of the text the
    document is dropped (text null). The spans of a document are bounded by its length.
    """
    spans = leaked_spans(documents, items, n)
    per = spans.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.countDistinct("item_id").alias("n_items"))
    joined = documents.select("doc_id", "text").dropDuplicates().join(per, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, kept = [], []
            for text, spans_ in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                parts, at, gone = [], 0, 0
                for s in spans_ or []:
                    a, e = max(s["start"], at), s["end"]
                    if e > a:
                        parts.append((text or "")[at:a])
                        gone += e - a
                        at = e
                parts.append((text or "")[at:])
                removed.append(gone)
                kept.append(None if gone > drop_ratio * len(text or "") else "".join(parts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_items"), pa.array(removed, pa.int32()), pa.array([k is None for k in kept]), pa.array(kept, pa.string())], names=["doc_id", "n_items", "removed", "dropped", "text"])

    return joined.mapInArrow(run, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_items long, removed int, dropped boolean, text string")
