"""Rebuilding conversations from message rows.

Rows are range-partitioned by (session, instant, id), so a session of any size is
spread over as many partitions as it fills. Each partition runs the automaton over
its slice of a session and leaves one summary; the automaton looks at neighbours
only, so summaries compose in partition order (its transition monoid is
first role, last role, broken), and one small row per session and partition is
all that is shuffled for the verdict.

States: start, user (a question is open), assistant (answered), broken. Accepting: assistant.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import shared_dir, width

BLANKS = " \t\r\n"
USER, ASSISTANT = 1, 2


def role_code(role: Column) -> Column:
    """1 for user or human, 2 for assistant or ai, else null; case and outer white space don't matter."""
    r = F.lower(F.btrim(role, F.lit(BLANKS)))
    return F.when(r.isin("user", "human"), USER).when(r.isin("assistant", "ai"), ASSISTANT).cast("int")


def instant(ts: Column) -> Column:
    """The instant of an ISO 8601 string, without zone as UTC (the session's); null where unreadable."""
    t = F.btrim(ts, F.lit(BLANKS))
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), t.try_cast("timestamp"))


def counting_rows(messages: DataFrame, with_content: bool = False) -> DataFrame:
    """The user and assistant rows that count: redelivered and repeated rows removed, blank ones dropped.

    One aggregation by (session, uuid) keeps the smallest id; a repeated id is a repeated
    row and falls into the same group, or, where its copies differ in uuid, is removed by
    a second aggregation by (session, id).
    """
    content = F.btrim(F.col("content"), F.lit(BLANKS))
    body = F.when(F.length(content) > 0, F.col("content")) if with_content else (F.length(content) > 0)
    row = F.struct(F.col("id"), role_code(F.col("role")).alias("role"), F.unix_micros(instant(F.col("timestamp"))).alias("at"), body.alias("body"))
    known = F.when(F.length("uuid") > 0, F.col("uuid"))
    src = messages.where(F.col("session_id").isNotNull()).select("session_id", known.alias("uuid"), row.alias("m"))
    with_uuid = src.where(F.col("uuid").isNotNull()).groupBy("session_id", "uuid").agg(F.min("m").alias("m")).select("session_id", "m")
    once = with_uuid.unionByName(src.where(F.col("uuid").isNull()).select("session_id", "m")).groupBy("session_id", F.col("m.id").alias("id")).agg(F.min("m").alias("m"))
    keep = F.col("m.body").isNotNull() if with_content else F.coalesce(F.col("m.body"), F.lit(False))
    cols = ["session_id", "id", F.col("m.role").alias("role"), F.col("m.at").alias("at")]
    return once.where(F.col("m.role").isNotNull() & keep).select(*cols, *([F.col("m.body").alias("content")] if with_content else []))


def ordered(rows: DataFrame) -> DataFrame:
    """Rows sorted by session, instant and id over range partitions; no session is bound to one partition."""
    keys = [F.col("session_id"), F.col("at").asc_nulls_first(), F.col("id")]
    return rows.repartitionByRange(width(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _slices(batch: pa.RecordBatch) -> np.ndarray:
    ids = batch.column("session_id")
    if len(ids) < 2:
        return np.zeros(len(ids), dtype=np.int64)
    change = pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.flatnonzero(change) + 1])


def summaries(rows: DataFrame) -> DataFrame:
    """One row per session and partition: part, first and last role, broken, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        out: list[list] = []
        for b in batches:
            if not b.num_rows:
                continue
            role = b.column("role").to_numpy(zero_copy_only=False)
            lost = b.column("at").is_null().to_numpy(zero_copy_only=False)
            starts = _slices(b)
            ends = np.concatenate([starts[1:], [b.num_rows]])
            double = np.concatenate([[False], (role[1:] == USER) & (role[:-1] == USER)])
            double[starts] = False
            bad = np.add.reduceat((double | lost).astype(np.int64), starts) > 0
            names = b.column("session_id").take(pa.array(starts)).to_pylist()
            for s, e, name, x in zip(starts.tolist(), ends.tolist(), names, bad.tolist()):
                if last is not None and last[0] == name:
                    last[3] = last[3] or x or (last[2] == USER and role[s] == USER)
                    last[2], last[4] = int(role[e - 1]), last[4] + e - s
                else:
                    last = [name, int(role[s]), int(role[e - 1]), x, e - s]
                    out.append(last)
            if len(out) > 20_000:  # the open slice stays behind
                yield _summary_batch(out[:-1], part)
                out = out[-1:]
        if out:
            yield _summary_batch(out, part)

    return rows.select("session_id", "role", "at").mapInArrow(run, "session_id string, part int, first int, last int, broken boolean, n long")


def _summary_batch(rows: list[list], part: int) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(cols[0], pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.int64())],
        names=["session_id", "part", "first", "last", "broken", "n"],
    )


def verdicts(parts: DataFrame) -> DataFrame:
    """session_id, n, keep: the summaries of a session composed in partition order (at most one per partition)."""
    seq = F.array_sort(F.collect_list(F.struct("part", "first", "last", "broken", "n")))
    zero = F.struct(F.lit(0).alias("last"), F.lit(False).alias("broken"))
    step = lambda a, x: F.struct(
        x["last"].alias("last"),
        (a["broken"] | x["broken"] | ((a["last"] == 0) & (x["first"] == ASSISTANT)) | ((a["last"] == USER) & (x["first"] == USER))).alias("broken"),
    )
    done = parts.groupBy("session_id").agg(seq.alias("s"), F.sum("n").alias("n")).withColumn("e", F.aggregate("s", zero, step))
    return done.select("session_id", "n", (~F.col("e.broken") & (F.col("e.last") == ASSISTANT)).alias("keep"))


def dropped_sessions(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """session_id of every conversation to drop, of all that occur in either table.

    Defined cases: null session_id is no session; a session without counting rows, one
    with a counting row whose timestamp can't be read, one that opens with the assistant
    and one with an unanswered user row is dropped; rows of other roles and blank rows
    don't count; equal instants are ordered by id; empty tables give no rows.
    """
    kept = verdicts(summaries(ordered(counting_rows(messages)))).where("keep").select("session_id")
    every = messages.select("session_id").union(sessions.select("session_id")).where(F.col("session_id").isNotNull()).distinct()
    return every.join(kept, "session_id", "left_anti")


def conversations(messages: DataFrame) -> DataFrame:
    """The turns of every kept conversation: session_id, turn (1-based), role, content, at, id, n_turns.

    One row per turn, never one cell per session, so a session of any length fits. The
    sorted rows are checkpointed: their partitions give both the verdicts and the turn numbers.
    """
    shared_dir(messages.sparkSession)
    rows = ordered(counting_rows(messages, with_content=True)).checkpoint()
    parts = summaries(rows)
    kept = verdicts(parts).where("keep").select("session_id", F.col("n").alias("n_turns"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("n").over(Window.partitionBy("session_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = parts.select("session_id", "part", before.alias("base")).join(kept, "session_id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, name, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            starts = _slices(b)
            local = np.arange(b.num_rows) - np.repeat(starts, np.diff(np.concatenate([starts, [b.num_rows]])))
            ids = b.column("session_id")
            if ids[0].as_py() == name:
                first = int(starts[1]) if len(starts) > 1 else b.num_rows
                local[:first] += seen
            name, seen = ids[b.num_rows - 1].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, dtype=np.int32)), pa.array(local)], names=[*b.schema.names, "part", "local"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    numbered = rows.mapInArrow(number, f"{kinds}, part int, local long")
    return numbered.join(base, ["session_id", "part"]).select(
        "session_id",
        (F.col("base") + F.col("local") + 1).alias("turn"),
        F.when(F.col("role") == USER, "user").otherwise("assistant").alias("role"),
        "content",
        F.timestamp_micros("at").alias("at"),
        "id",
        "n_turns",
    )
