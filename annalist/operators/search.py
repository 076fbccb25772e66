"""Lexical search over accepted understandings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code point ranges written without spaces. Fixed values.
UNSPACED = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF))


def text_tokens(text: str | None) -> list[str]:
    """Case-folded runs of letters and digits; of unspaced scripts the run and its overlapping pairs."""
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    kinds = ["u" if any(a <= ord(c) <= b for a, b in UNSPACED) else "w" if c.isalnum() else " " for c in folded]
    out, start = [], 0
    for i in range(1, len(folded) + 1):
        if i == len(folded) or kinds[i] != kinds[start]:
            run = folded[start:i]
            if kinds[start] != " ":
                out.append(run)
            if kinds[start] == "u" and len(run) > 1:
                out += [run[k : k + 2] for k in range(len(run) - 1)]
            start = i
    return list(dict.fromkeys(out))


def search_tokens(text: Column | str) -> Column:
    """NFKC and full case folding have no JVM expression, so this one runs in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(text_tokens)

    return F.pandas_udf(run, "array<string>")(text)


def index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token), a row each."""
    return rows.select(key, F.explode(search_tokens(text)).alias("token"))


def matches(heads: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, region_id): heads that share a token with a query; a query without tokens matches all.

    ``heads``: region_id, content; ``queries``: query_id, query_text.
    """
    q = queries.select("query_id", search_tokens("query_text").alias("tokens"))
    every = q.filter(F.size("tokens") == 0).select("query_id").crossJoin(heads.select("region_id"))
    hits = q.select("query_id", F.explode("tokens").alias("token")).join(index(heads, "region_id", "content"), "token").select("query_id", "region_id").distinct()
    return hits.unionByName(every)


def visible_heads(heads: DataFrame, valid: DataFrame, rejected: DataFrame) -> DataFrame:
    """Heads all of whose sources are valid now, without rejected ones. ``heads`` has sources (array)."""
    bad = heads.select("region_id", F.explode("sources").alias("evidence_id")).join(valid.filter("valid").select("evidence_id"), "evidence_id", "left_anti").select("region_id").distinct()
    return heads.join(bad, "region_id", "left_anti").join(rejected.select("region_id", "content_hash").distinct(), ["region_id", "content_hash"], "left_anti").orderBy("region_id", "revision_number")
