"""Column builders for vectors and perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASHES = ("phash", "ahash", "dhash")
LIMITS = {"phash": 10, "ahash": 12, "dhash": 12}
WEIGHTS = {"phash": 0.5, "ahash": 0.25, "dhash": 0.25}
BITS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine, cut to 0..1; NaN with an all-zero vector."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size == 0, F.lit(float("nan"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / F.when(size == 0, 1.0).otherwise(size))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def votes(distances: dict[str, Column]) -> Column:
    return sum(((d > LIMITS[h]).cast("int") for h, d in list(distances.items())[1:]), (distances["phash"] > LIMITS["phash"]).cast("int"))


def hash_similarity(distances: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of 1 - distance / 64; weights are brought to a sum of one."""
    weights = weights or WEIGHTS
    total = sum(weights.values())
    parts = [(1 - distances[h] / BITS) * (w / total) for h, w in weights.items()]
    return sum(parts[1:], parts[0])


def vote_confidence(n: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + n / 3.0 * 0.3 + (1 - similarity) * 0.2)


def image_likeness(a: Column, b: Column) -> Column:
    """1 - mean absolute difference / 255 of two equally long arrays of grey values."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return 1 - total / F.greatest(F.size(a), F.lit(1)) / 255.0
