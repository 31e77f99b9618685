"""Full-text search of transcripts over stems: words, quoted phrases and NOT."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WORD, fold, stem, stems
from lectern.operators.bm25 import B, K1, MIN_IDF


def parse(text: str) -> tuple[list[list[str]], list[list[str]]]:
    """(wanted, excluded) stemmed phrases of a query: bare words and "quoted phrases" are alternatives, NOT excludes the next one."""
    wanted, excluded, negate = [], [], False
    for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', text):
        if bare in ("OR", "AND"):
            continue
        if bare == "NOT":
            negate = True
            continue
        phrase = [stem(w) for w in re.findall(r"[^\W_]+", (quoted or bare).lower())]
        if phrase:
            (excluded if negate else wanted).append(phrase)
        negate = False
    return wanted, excluded


def _starts(words, phrase: list[str]):
    """How often a phrase occurs in an array of stems."""
    at = F.sequence(F.lit(1), F.size(words))
    hit = lambda i: F.array_join(F.slice(words, i, len(phrase)), "\u0001") == "\u0001".join(phrase)
    return F.when(F.size(words) > 0, F.size(F.filter(at, hit))).otherwise(0)


def search(messages: DataFrame, text: str, limit: int = 20, role: str | None = None, since=None) -> DataFrame:
    """id, session_id, rank, highlighted: the best messages; an empty query finds nothing. Statistics are of all messages."""
    wanted, excluded = parse(text)
    rows = messages.where("content IS NOT NULL").select("id", "session_id", "role", "content", "timestamp").distinct()
    words = rows.withColumn("words", stems(F.regexp_extract_all(fold("content"), F.lit(WORD), F.lit(0))))
    cols = {f"t{i}": _starts(F.col("words"), p) for i, p in enumerate(wanted)} | {f"x{i}": _starts(F.col("words"), p) for i, p in enumerate(excluded)}
    counted = words.withColumn("dl", F.size("words")).withColumns(cols) if cols else words.withColumn("dl", F.size("words"))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(wanted))])
    j = counted.crossJoin(F.broadcast(stats))
    rank = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"t{i}"), F.col(f"df{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(MIN_IDF))
        rank = rank - idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    any_hit = F.lit(False)
    for i in range(len(wanted)):
        any_hit = any_hit | (F.col(f"t{i}") > 0)
    kept = j.withColumn("rank", rank).where(any_hit)
    for i in range(len(excluded)):
        kept = kept.where(F.col(f"x{i}") == 0)
    if role is not None:
        kept = kept.where(F.lower(F.trim("role")) == role)
    if since is not None:
        kept = kept.where(F.col("timestamp") >= since)
    best = kept.orderBy(F.round("rank", 9), "id").limit(limit)
    heads = sorted({p[0][: max(3, len(p[0]) - 1)] for p in wanted})
    marked = F.regexp_replace("content", r"(?i)\b((?:" + "|".join(map(re.escape, heads)) + r")[\p{L}\p{N}]*)", ">>>$1<<<") if heads else F.col("content")
    return best.select("id", "session_id", F.round("rank", 6).alias("rank"), marked.alias("highlighted"))
