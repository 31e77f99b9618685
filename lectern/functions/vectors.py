"""Vector expressions, evaluated by the JVM, and the offline embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b) -> Column:
    """Cosine of two columns of doubles with the usual guard against a zero norm."""
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def mean_vector(vec, dim: int = 64) -> Column:
    """Aggregate: the mean of vectors, one running sum per dimension, combined before the shuffle."""
    return F.array(*[F.avg(F.element_at(vec, i + 1)) for i in range(dim)])


def hash_embedding(text, dim: int = 64) -> Column:
    """A deterministic offline embedding: signed feature hashing of the words, scaled to length 1 (all zero without words)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    raw = F.aggregate(
        hashes,
        F.array_repeat(F.lit(0.0), dim),
        lambda acc, h: F.transform(acc, lambda v, i: v + F.when(F.pmod(h, F.lit(dim)) == i, F.when(h < 0, -1.0).otherwise(1.0)).otherwise(0.0)),
    )
    return F.transform(raw, lambda v: v / (norm(raw) + EPS))
