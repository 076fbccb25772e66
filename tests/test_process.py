"""The stream of items: barrier, waiting, commit and replay."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from annalist.operators import compilation
from annalist.streaming import compile as streaming

SCHEMA = "lineage_id string, evidence_id string, ordering_key string, subject string, content string, occurred_at timestamp, known_at timestamp, topics array<string>, recap boolean"


def item(lineage, n, subject, topics=None, recap=False, content=None):
    when = datetime(2024, 1, 1) + timedelta(days=n)
    return (lineage, f"{lineage}{n:03}", f"{n:03}", subject, content or f"{subject} {n}", when, when, topics, recap)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, source, root, provider=None):
    streaming.process(spark.readStream.schema(SCHEMA).parquet(source), root, provider).awaitTermination(180)
    return streaming.read_states(spark, root)


def told(states):
    return sorted(tuple(r) for r in states.select("lineage_id", "action", "evidence_id", "block_id", "state_version", "content").fillna("").collect())


def test_a_failed_item_blocks_its_lineage_until_it_passes(spark, tmp_path):
    source, root, flag = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "down"
    flag.touch()
    where = str(flag)

    def provider(compiler, row):
        import os

        if row["subject"] == "bad" and os.path.exists(where):
            raise ValueError("the model is down")
        return compiler.decide(row)

    rows = [item("a", i, s) for i, s in enumerate(["x", "x", "bad", "x", "y"])] + [item("b", i, "z") for i in range(3)]
    arrive(spark, source, rows)
    got = run(spark, source, root, provider)
    assert [tuple(r) for r in got.filter("action in ('FAILED', 'BLOCKED')").orderBy("evidence_id").select("evidence_id", "action", "failure").collect()] == [
        ("a002", "FAILED", "the model is down"), ("a003", "BLOCKED", None), ("a004", "BLOCKED", None)
    ]
    assert got.filter("lineage_id = 'b'").count() == 3
    arrive(spark, source, [item("a", 5, "y")])
    assert run(spark, source, root, provider).filter("evidence_id = 'a005'").first().action == "BLOCKED"
    flag.unlink()
    arrive(spark, source, [rows[2]])
    made = run(spark, source, root, provider).filter(F.col("action").isin(*compilation.MADE))
    whole = compilation.compile_batch(spark.createDataFrame([*rows, item("a", 5, "y")], SCHEMA))
    assert told(made) == told(whole)
    arrive(spark, source, [rows[0], rows[2], item("a", 1, "x")])
    assert told(run(spark, source, root, provider).filter(F.col("action").isin(*compilation.MADE))) == told(whole)


def test_a_batch_that_dies_before_its_commit_appears_once(spark, tmp_path, monkeypatch):
    rows = [item("a", 0, "s"), item("a", 1, "s", topics=["p", "q"]), item("b", 0, "t"), item("a", 2, "q"), item("a", 3, "s", recap=True), item("b", 1, "t t2")]
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    plain, died = streaming.committing, []

    def dying(root):
        commit = plain(root)

        def once(batch, batch_id):
            if batch_id == 1 and not died:
                died.append(batch_id)
                batch.limit(1).write.mode("overwrite").parquet(f"{root}/states/batch_id={batch_id}")  # half a batch, and no commit
                raise RuntimeError("killed")
            commit(batch, batch_id)
            commit(batch.withColumn("content", F.lit("again")), batch_id)  # a retry after the commit is passed over

        return once

    monkeypatch.setattr(streaming, "committing", dying)
    arrive(spark, source, rows[:3])
    run(spark, source, root)
    arrive(spark, source, rows[3:])
    with pytest.raises(Exception, match="killed"):
        run(spark, source, root)
    assert streaming.read_states(spark, root).filter("batch_id = 1").count() == 0
    got = run(spark, source, root)
    assert died == [1] and told(got) == told(compilation.compile_batch(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(r.batch_id for r in streaming.committed(spark, root).collect()) == [0, 1]


def test_items_that_cannot_be_compiled_and_late_ones(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/out"
    arrive(spark, source, [item("a", 5, "x"), (*item("b", 1, "x")[:4], None, None, None, None, None)])
    arrive(spark, source, [item("c", 1, "x")])
    assert {(r.evidence_id, r.action) for r in run(spark, source, root).collect()} == {("a005", "NEW"), ("b001", "FAILED"), ("c001", "NEW")}
    arrive(spark, source, [item("a", 1, "x"), item("b", 2, "x")])
    got = {(r.evidence_id, r.action) for r in run(spark, source, root).filter("batch_id = 1").collect()}
    assert got == {("a001", "LATE"), ("b002", "BLOCKED")}
    assert streaming.read_states(spark, f"{tmp_path}/none").count() == 0
