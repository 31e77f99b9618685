"""Numbering rows of hot keys: no task ever orders all rows of a key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize, width


def numbered(rows: DataFrame, key: str | None, *order: Column | str, name: str = "nth") -> DataFrame:
    """Adds `name`, the row's number from 1 among the rows of its key (None: among all rows) in the given order.

    Rows are sorted in range partitions by key and order, numbered in each, and the counts of earlier
    partitions are added; of these there is one per key and partition.
    """
    of = F.lit(0) if key is None else F.xxhash64(F.col(key))  # a key's rows lie together; equal hashes are told apart below
    keyed = rows.withColumn("_of", of).withColumn("_key", F.lit("") if key is None else F.col(key).cast("string"))
    by = ["_of", "_key", *order]
    ranged = keyed.repartitionByRange(width(rows.sparkSession), *by).sortWithinPartitions(*by)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, part = None, 0, TaskContext.get().partitionId()
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column("_key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            codes = np.nan_to_num(np.asarray(codes, dtype=np.float64), nan=-1).astype(np.int64)
            start = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            size = np.diff(np.concatenate([start, [b.num_rows]]))
            nth = np.arange(b.num_rows) - np.repeat(start, size) + 1
            first, end = b.column("_key")[0].as_py(), b.column("_key")[b.num_rows - 1].as_py()
            if first == last:
                nth[: size[0]] += seen
            seen = int(nth[-1])
            last = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nth), pa.array(np.full(b.num_rows, part, dtype=np.int32))], names=[*b.schema.names, "_local", "_part"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema.fields)
    local = materialize(ranged.mapInArrow(count, f"{fields}, _local long, _part int"), "numbered")
    sizes = local.groupBy("_key", "_part").agg(F.max("_local").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_key", "_part", before.alias("_before")).where("_before > 0")  # keys that span partitions only
    s = sizes.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), "_before")
    return local.join(s, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left").select(*rows.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name))
