"""Pluggable text models: an embedder and a generator, each with an offline default, and parsing of what generators return."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import first_sentence
from lectern.functions.vectors import hash_embedding

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]


def embed(df: DataFrame, text: str, out: str, model: Embed | None = None, batch: int = 50) -> DataFrame:
    """Adds a vector of each text. Without a model, signed feature hashing in the JVM; with one, called on batches of texts in the tasks."""
    if model is None:
        return df.withColumn(out, F.when(F.col(text).isNotNull(), hash_embedding(F.col(text))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            vectors: list = [None] * len(b)
            at = [i for i, t in enumerate(b[text]) if t is not None]
            for k in range(0, len(at), batch):
                for i, v in zip(at[k : k + batch], model([b[text].iloc[j] for j in at[k : k + batch]])):
                    vectors[i] = v
            yield b.assign(**{out: vectors})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` array<double>")


def embed_missing(df: DataFrame, text: str, cache: DataFrame, model: Embed | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with vec, new cache rows): texts are looked up by hash, only misses are embedded. cache: hash, vec."""
    keyed = df.withColumn("hash", F.sha2(F.col(text), 256))
    misses = keyed.where(F.col(text).isNotNull()).select("hash", F.col(text).alias("t")).dropDuplicates(["hash"]).join(cache, "hash", "left_anti")
    new = embed(misses, "t", "vec", model).select("hash", "vec")
    return keyed.join(cache.unionByName(new), "hash", "left").drop("hash"), new


def summarize(text, model: None = None) -> Column:
    """The offline summary: the leading sentence."""
    return first_sentence(text)


def generate(df: DataFrame, prompt: str, out: str, model: Generate) -> DataFrame:
    """Adds the model's answer to each prompt; a failing batch gives null answers and its error in `error`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield b.assign(**{out: model(b[prompt].tolist())}, error=None)
            except Exception as e:
                yield b.assign(**{out: None}, error=str(e)[:500])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, `{out}` string, error string")


def parse_facts(raw: str | None) -> list[dict]:
    """Facts of a generator's answer: JSON, fenced or surrounded by prose, a list or an object that holds one; incomplete ones are dropped."""
    if not raw:
        return []
    body = re.sub(r"```(?:json)?", "", raw)
    found = None
    for left, right in sorted(("[]", "{}"), key=lambda p: body.find(p[0]) if p[0] in body else len(body)):
        a, b = body.find(left), body.rfind(right)
        if 0 <= a < b:
            try:
                found = json.loads(body[a : b + 1])
                break
            except ValueError:
                continue
    if isinstance(found, dict):
        lists = [v for v in found.values() if isinstance(v, list)]
        found = lists[0] if lists else [found]
    out = []
    for f in found or []:
        if isinstance(f, dict):
            f = {k: str(f.get(k) or "").strip() for k in ("s", "p", "o")} if "s" in f else {"s": str(f.get("subject") or "").strip(), "p": str(f.get("predicate") or "").strip(), "o": str(f.get("object") or "").strip()}
            if all(f.values()):
                out.append(f)
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in "spo"])))
def facts(raw: pd.Series) -> pd.Series:
    return raw.map(parse_facts)


def query_lines(text: str, k: int) -> list[str]:
    """Up to k queries of a generator's answer, one a line, numbering and bullets removed."""
    lines = (re.sub(r"^\s*(?:[-*•]|\d+[.)])\s*", "", x).strip().strip('"') for x in text.splitlines())
    return [x for x in lines if x][:k]
