"""Splitting oversized items at natural boundaries by pointer doubling.

Every offset of a text is joined to its farthest legal successor: the cut that a
piece ending there is followed by, given the overlap. Squaring that successor
table yields the 2, 4, 8, ... fold successors, so all greedy cuts of a text come
out after log2(pieces) gathers rather than one cut after another. A text is one
cell of one row, hence the tables stay inside its Arrow batch: the operator is a
narrow stage without any shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
_FENCE = re.compile(r"^[ ]{0,3}(```|~~~)", re.M)
_HEADING = re.compile(r"^[ ]{0,3}#{1,6}[ \t]", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"[.!?…。！？]['\")\]]*\s+")
_WORD = re.compile(r"[\s]+")


def boundary_tables(text: str) -> list[np.ndarray]:
    """For each class, strongest first, the greatest boundary at or before every offset (0 where none is).

    Classes: headings and code fences, blank lines, line ends, sentence ends, white space.
    """
    n = len(text)
    fences = [m.start() for m in _FENCE.finditer(text)]
    inside = np.zeros(n + 1, dtype=bool)
    for a, b in zip(fences[::2], fences[1::2]):
        inside[a + 1 : b + 1] = True
    strong = [m.start() for m in _HEADING.finditer(text) if not inside[m.start()]] + fences[::2]
    paragraphs = [m.end() for m in _PARAGRAPH.finditer(text) if not inside[m.end()]]
    levels = [strong, paragraphs, [m.end() for m in _LINE.finditer(text)], [m.end() for m in _SENTENCE.finditer(text)], [m.end() for m in _WORD.finditer(text)]]
    tables, marks = [], np.zeros(n + 1, dtype=np.int32)
    for ends in levels:
        at = np.asarray(ends, dtype=np.int32)
        marks[at] = at
        tables.append(np.maximum.accumulate(marks))
    return tables


def successors(text: str, limit: int, overlap: int) -> np.ndarray:
    """The farthest legal successor of every offset taken as the end of a piece.

    A cut of a stronger class is preferred while it keeps half of the reach; a hard
    cut at the reach remains where not even white space lies in it.
    """
    n, step = len(text), limit - overlap
    here = np.arange(n + 1, dtype=np.int32)
    reach = np.minimum(here + step, n).astype(np.int32)
    out = reach.copy()
    tables = boundary_tables(text)
    open_ = reach < n
    for depth, table in enumerate(tables):
        cut = table[reach]
        legal = open_ & (cut > here + (step // 2 if depth < 3 else step // 4))
        out[legal] = cut[legal]
        open_ &= ~legal
    split = (out < n) & (out > here + 1)
    codes = np.frombuffer((text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    split &= (codes[out] == 10) & (codes[np.maximum(out - 1, 0)] == 13)  # a CRLF stays whole
    out[split] -= 1
    return out


def cut_points(text: str, limit: int, overlap: int) -> np.ndarray:
    """Ends of all greedy pieces, ascending, by squaring the successor table."""
    n = len(text)
    table = successors(text, limit, overlap)
    cuts = np.asarray([overlap], dtype=np.int32)  # as if a piece had ended there, so that the first one starts at 0
    while cuts.max() < n:
        cuts = np.concatenate([cuts, table[cuts]])
        table = table[table]
    return np.unique(cuts[cuts > overlap])


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of each piece; a text within the limit is its own piece."""
    if len(text) <= limit:
        return [(0, len(text))]
    ends = cut_points(text, limit, overlap).tolist()
    return list(zip([0] + [e - overlap for e in ends[:-1]], ends))


def split_oversized(chunks: DataFrame, limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces of every chunk whose content, stripped of white space, has more than `limit` code points.

    Returns chunk_id, heading_path, position (the chunk's, null as 0, plus the number of
    the piece), piece (0-based), start, end (offsets in the stripped content) and content.
    Consecutive pieces share exactly `overlap` characters. Defined cases: null, empty,
    blank and small contents give no rows; repeated rows count once; rows with the same
    chunk_id but other content are split each; a text without any boundary gets hard
    cuts; an empty table gives an empty result; other columns are ignored.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and under half of the limit")
    body = F.btrim(F.col("content"), F.lit(BLANKS))
    big = (
        chunks.select("chunk_id", "heading_path", F.coalesce(F.col("position"), F.lit(0)).cast("int").alias("position"), body.alias("content"))
        .where(F.length("content") > limit)
        .dropDuplicates()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, nth, starts, ends, texts = [], [], [], [], []
            for i, text in enumerate(b.column("content").to_pylist()):
                for k, (s, e) in enumerate(pieces(text, limit, overlap)):
                    rows.append(i)
                    nth.append(k)
                    starts.append(s)
                    ends.append(e)
                    texts.append(text[s:e] if with_text else None)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("chunk_id").take(take),
                    b.column("heading_path").take(take),
                    pa.array(np.asarray(b.column("position").take(take).to_numpy(zero_copy_only=False), dtype=np.int32) + np.asarray(nth, dtype=np.int32)),
                    pa.array(nth, pa.int32()),
                    pa.array(starts, pa.int32()),
                    pa.array(ends, pa.int32()),
                    pa.array(texts, pa.string()),
                ],
                names=["chunk_id", "heading_path", "position", "piece", "start", "end", "content"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in big.schema.fields}
    return big.mapInArrow(run, f"chunk_id {kinds['chunk_id']}, heading_path string, position int, piece int, start int, end int, content string")
