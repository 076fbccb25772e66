"""A corpus pipeline: toxicity, line dedup, SimHash near-dedup, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from annalist.llm import lines, packing, simhash, substrings, toxicity
from annalist.scratch import materialize


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on ``labels``, scores under its threshold."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later copies of lines, alone or in runs."""
    return lines.line_dedup(docs, shortest=1)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without windows of 50 words that start in a smaller doc_id."""
    return substrings.substring_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens over every document kept so far."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("packing", packing_stage),
]
#: The classifier, XXH64 fingerprints and the tokenizer have no SQL; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as a table and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
