"""Vector expressions over ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x / n))


def cosine(a: Column, b: Column, on_mismatch: str = "zero", on_zero: str = "zero", clamp: bool = False) -> Column:
    """Cosine of two vectors. ``on_mismatch`` and ``on_zero`` are "zero" or "raise"; ``clamp`` to [0, 1]."""
    length = norm(a) * norm(b)
    value = F.when(length > 0, dot(a, b) / length).otherwise(F.raise_error(F.lit("zero vector")) if on_zero == "raise" else F.lit(0.0))
    value = F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vector sizes differ")) if on_mismatch == "raise" else F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) if clamp else value


def hash_embedding(text: Column | str, buckets: int = 16) -> Column:
    """Counts of word tokens by bucket; a token's bucket is the first 8 hex digits of its SHA-256."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+)"), 1)
    places = F.transform(found, lambda t: (F.conv(F.substring(F.sha2(t, 256), 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(places, lambda p: p == b)).cast("double"))
