"""File sources with validation, and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = (
    "type string, schema_version string, corpus_id string, embedding_provider string, embedding_model string, embedding_version string, "
    "vector_dimension int, block_id string, occurred_at string, text string, vector array<double>, _corrupt_record string"
)
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(block_id, occurred_at, text, vector) of a JSONL corpus: one metadata row, then block rows.

    Raises if a line is no JSON, metadata is missing, repeated or of another version than 1, an id
    repeats, a time has no offset, a vector has another length than declared, or a number is not
    finite. Checks are aggregates over one scan; rows come ordered by (occurred_at, block_id).
    """
    rows = spark.read.schema(LINE).json(path)
    found = rows.filter("type = 'metadata'").select("schema_version", "vector_dimension").limit(2).collect()
    if len(found) != 1 or str(found[0][0]) not in ("1", "v1"):
        raise ValueError("one metadata row of schema version 1 is needed")
    dims = found[0][1]
    blocks = rows.filter("type = 'block'")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    bad = blocks.agg(
        F.count_if(F.col("block_id").isNull() | (F.trim("block_id") == "")).alias("ids missing"), (F.count("block_id") - F.count_distinct("block_id")).alias("ids repeated"),
        F.count_if(~F.coalesce(F.col("occurred_at").rlike(OFFSET), F.lit(False))).alias("times without an offset"),
        F.count_if(~F.coalesce(F.size("vector") == dims, F.lit(False))).alias("vectors of another length"), F.count_if(~F.coalesce(finite, F.lit(False))).alias("numbers not finite"),
    )
    faults = bad.crossJoin(rows.agg(F.count_if(F.col("_corrupt_record").isNotNull() | ~F.coalesce(F.col("type").isin("metadata", "block"), F.lit(False))).alias("lines malformed"))).first().asDict()
    if any(faults.values()):
        raise ValueError(", ".join(f"{n} {what}" for what, n in faults.items() if n))
    return blocks.select("block_id", F.to_timestamp("occurred_at").alias("occurred_at"), "text", "vector").orderBy("occurred_at", "block_id")


def read_fixture(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.json(path, multiLine=True)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
