"""Exact vector search for a stated set of queries, in matrix products over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_QUERIES = 20_000


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6, max_queries: int = MAX_QUERIES) -> DataFrame:
    """query_id, chunk_id, similarity (rounded): the k most similar vectors of each query, ties by chunk_id.

    vectors: chunk_id, vec; queries: query_id, qvec (arrays of doubles of one size). The queries are
    broadcast, at most max_queries at a time, and larger sets go block by block. Each batch passes on its k best
    (with everything within rounding of the last), so the shuffle doesn't grow with the vectors' size.
    """
    blocks = max(1, -(-queries.count() // max_queries))
    out = None
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        one = _scan(vectors, part, k, digits)
        out = one if out is None else out.unionByName(one)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return out.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def _scan(vectors: DataFrame, queries: DataFrame, k: int, digits: int) -> DataFrame:
    rows = queries.select("query_id", "qvec").collect()
    q = np.asarray([r["qvec"] for r in rows], dtype=np.float64).reshape(len(rows), len(rows[0]["qvec"]) if rows else 1)
    shared = vectors.sparkSession.sparkContext.broadcast((np.asarray([r["query_id"] for r in rows], dtype=np.int64), q, np.linalg.norm(q, axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, lengths = shared.value
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = (x @ q.T) / (np.linalg.norm(x, axis=1)[:, None] * lengths[None, :] + 1e-10)
            last = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)]
            i, j = np.nonzero(s >= last[None, :] - 10.0**-digits)
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), b.column("chunk_id").take(pa.array(i)), pa.array(s[i, j])], names=["query_id", "chunk_id", "s"])

    found = vectors.select("chunk_id", "vec").mapInArrow(run, "query_id long, chunk_id long, s double")
    return found.select("query_id", "chunk_id", F.round("s", digits).alias("similarity"))
