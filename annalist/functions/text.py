"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Distinct lower-cased runs of Unicode word characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))


def subject_key(subject: Column | str) -> Column:
    """A subject without its non-word characters, lower-cased: what "same subject" compares."""
    return F.lower(F.regexp_replace(subject, r"(?U)\W+", ""))


def same_subject(a: Column, b: Column) -> Column:
    """Equal keys, or one key inside the other; an empty key is the same as nothing."""
    x, y = subject_key(a), subject_key(b)
    return (x != "") & (y != "") & (x.contains(y) | y.contains(x))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """|a & b| / |a | b| of two arrays; ``both_empty`` where neither has a member."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the text trimmed, with runs of white space as one space."""
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def identity(prefix: str, *parts: Column, length: int = 24) -> Column:
    """A content-derived id: equal parts give equal ids, on every run."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length))


def bigrams(text: Column | str) -> Column:
    """Adjacent Han pairs, over characters that are not Han too, and ``w:`` latin words, repeats included."""
    han = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}])"), 1)
    pairs = F.when(F.size(han) > 1, F.transform(F.sequence(F.lit(1), F.size(han) - 1), lambda i: F.array_join(F.slice(han, i, 2), ""))).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1), lambda w: F.concat(F.lit("w:"), w))
    return F.concat(pairs, words)
