"""Sinks: JSON export, Markdown files of memories, versioned tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import scratch_path

PERSISTENT = ("bug", "decision", "convention", "learning", "observation")


def export_json(df: DataFrame, path: str) -> None:
    """Notes as JSON lines sorted by path, a range of paths a file."""
    df.repartitionByRange("path").sortWithinPartitions("path").write.mode("overwrite").json(path)


def eligible(memories: DataFrame) -> DataFrame:
    """Memories that are written out: with a uuid, without a time limit, of a persistent type."""
    return memories.where(F.col("uuid").isNotNull() & F.col("expires_at").isNull() & F.col("entity_type").isin(*PERSISTENT))


def rendered(memories: DataFrame) -> DataFrame:
    """relpath, hash, body of each eligible memory: front matter with the hash of the text, then the text."""
    text = F.btrim("content", F.lit(" \t\r\n"))
    digest = F.concat(F.lit("sha256:"), F.sha2(text, 256))
    plain = F.regexp_replace("uuid", "-", "")
    dashed = F.regexp_replace(F.lower(plain), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    m = eligible(memories).where(plain.rlike("^[0-9a-fA-F]{32}$") & F.col("content").isNotNull())
    title = F.substring(F.regexp_extract(text, r"^[# \t]*([^\r\n]*)", 1), 1, 80)
    front = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("title: "), F.to_json(F.struct(title.alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(title.alias("t")))) - 6)), F.concat(F.lit("uuid: "), dashed), F.concat(F.lit("memory_id: "), F.col("memory_id").cast("string")),
        F.concat(F.lit("entity_type: "), F.col("entity_type")), F.concat(F.lit("tags: ["), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), ", "), F.lit("]")), F.concat(F.lit("created_at: "), F.col("created_at").cast("string")), F.concat(F.lit("hash: "), digest), F.lit("---"), F.lit(""),
    )
    rel = F.concat(F.lit("memories/"), "entity_type", F.lit("/"), F.date_format("created_at", "yyyy-MM"), F.lit("/"), dashed, F.lit(".md"))
    return m.select(rel.alias("relpath"), digest.alias("hash"), F.concat(front, F.lit("\n"), text, F.lit("\n")).alias("body")).where("relpath IS NOT NULL")


def sync_plan(wanted: DataFrame, on_disk: DataFrame) -> DataFrame:
    """relpath, action: create, update, conflict (edited on disk; the table wins), remove, or keep. on_disk: relpath, stated (hash in the file), actual (hash of its text)."""
    j = wanted.select("relpath", F.col("hash").alias("want")).join(on_disk, "relpath", "full")
    action = (
        F.when(F.col("want").isNull(), "remove")
        .when(F.col("actual").isNull(), "create")
        .when(~F.col("actual").eqNullSafe(F.col("stated")), "conflict")
        .when(F.col("actual") != F.col("want"), "update")
        .otherwise("keep")
    )
    return j.select("relpath", action.alias("action"))


def write_files(files: DataFrame, root: str) -> int:
    """Write (relpath, body) as files below root, each replaced in one step; returns how many. Runs in parallel where root is a shared folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            for rel, body in zip(b["relpath"], b["body"]):
                path = os.path.normpath(os.path.join(root, rel))
                if not path.startswith(os.path.normpath(root) + os.sep):
                    raise ValueError(f"{rel} leaves the folder")
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(body)
                os.replace(part, path)
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("relpath", "body").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


class Versioned:
    """A table whose writes make new versions: readers see a complete version, a failed write none."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path, self.version = spark, name, None, 0

    def write(self, df: DataFrame, *partitions: str) -> DataFrame:
        path = scratch_path(self.spark, f"{self.name}-v{self.version + 1}")
        w = df.write
        (w.partitionBy(*partitions) if partitions else w).parquet(path)
        self.path, self.version = path, self.version + 1
        return self.read()

    def read(self) -> DataFrame:
        if self.path is None:
            raise ValueError(f"{self.name} has no version yet")
        return self.spark.read.parquet(self.path)
