import pandas as pd
import pytest

from annalist.engine import EVIDENCE, LIFECYCLE, Engine, Settings


def evidence(spark, rows):
    t = lambda d: pd.Timestamp(d).to_pydatetime()
    return spark.createDataFrame([("L", i, None, subject, text, t(day), None, [], False, {"source": "s", "canonical": "true"}) for i, subject, text, day in rows], EVIDENCE)


ROWS = [("e1", "alpha", "deadline is friday", "2026-08-01"), ("e2", "beta", "deadline friday is near", "2026-08-02"), ("e3", "alpha", "friday is the deadline", "2026-08-03"), ("e4", "gamma", "deadline is friday again", "2026-08-04")]


def test_ingest_read_correct(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Settings(least_support=2, least_similarity=0.3))
    with pytest.raises(RuntimeError):
        engine.derived("states")
    assert engine.run_batch(evidence(spark, ROWS)) == 1
    assert engine.ingest(evidence(spark, ROWS)) == 0
    with pytest.raises(ValueError):
        engine.ingest(evidence(spark, [("e1", "alpha", "other words", "2026-08-01")]))
    assert engine.derived("states").count() == 4
    assert engine.blocks_at("2026-08-02 12:00:00").count() == 2
    assert engine.derived("lines").count() >= 2 and engine.line_frontier().count() >= 1
    nodes, sources = engine.project_line([1.0] * 16)
    assert nodes.count() >= 1 and sources.count() >= 1
    engine.surfaces().count()

    states = sorted(r[0] for r in engine.derived("states").select("state_id").collect())
    proposal = spark.createDataFrame([("r", "The deadline is Friday", states[:2])], "region_id string, content string, support array<string>")
    assert engine.accept(proposal).first().action == "INITIAL_CREATION"
    assert engine.accept(proposal).first().action == "NO_CHANGE"
    assert engine.heads().first().revision_number == 1
    assert [r.region_id for r in engine.query("FRIDAY?").collect()] == ["r"]
    assert engine.query("nothing here").count() == 0 and engine.query("").count() == 1
    with pytest.raises(ValueError):
        engine.accept(spark.createDataFrame([("q", "x", ["no such state"])], proposal.schema))

    shot = engine.put_snapshot("2026-08-31")
    used = engine.query("").first().sources[0]
    touched = engine.invalidate_and_rebuild(spark.createDataFrame([(used,)], "evidence_id string"), "2026-09-01")
    touched = sorted((r.kind, r.holder_id) for r in touched.collect())
    assert [kind for kind, _ in touched] == ["baseline", "block", "snapshot"] and touched[2] == ("snapshot", shot)
    again = engine.closure(spark.createDataFrame([(used,), (None,), ("no such",)], "evidence_id string")).collect()
    assert {("baseline", touched[0][1]), ("snapshot", shot)} <= {(r.kind, r.holder_id) for r in again}
    assert engine.generation() == 2 and engine.query("").count() == 0
    assert engine.blocks_at("2026-08-31").count() == 4 and engine.blocks_at("2026-09-02").count() == 3
    engine.diff(1, 2).count()

    later = Engine(spark, str(tmp_path), Settings(least_support=2, least_similarity=0.9))
    with pytest.raises(RuntimeError):
        later.derived("states")


def test_rejected_understandings_are_not_served(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.run_batch(evidence(spark, ROWS))
    state = engine.derived("states").first().state_id
    engine.accept(spark.createDataFrame([("r", "text", [state])], "region_id string, content string, support array<string>"))
    assert engine.query("").count() == 1
    with pytest.raises(ValueError):
        engine.reopen("r", "2026-09-01")
    engine.reject("r")
    assert engine.query("").count() == 0
    engine.reopen("r", "2026-09-01")
    assert engine.query("").count() == 1
    engine.reject("r")
    assert engine.query("").count() == 0


def test_superseded_evidence_leaves_views(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.run_batch(evidence(spark, ROWS))
    pair = spark.createDataFrame([("e1", "e3")], "evidence_id string, replacement string")
    engine.supersede(pair, "2026-09-01")
    engine.supersede(pair, "2026-09-03")
    assert engine.blocks_at("2026-08-31").count() == 4 and engine.blocks_at("2026-09-02").count() == 3
    assert engine.read("lifecycle", LIFECYCLE).count() == 1
    for wrong in (("e2", "e1"), ("e2", "none"), ("none", "e2")):
        with pytest.raises(ValueError):
            engine.supersede(spark.createDataFrame([wrong], pair.schema), "2026-09-04")
    assert engine.read("lifecycle", LIFECYCLE).count() == 1


def test_items_are_processed_one_after_the_other(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "one"))
    flag = tmp_path / "down"
    flag.touch()
    where = str(flag)

    def provider(compiler, row):
        import os

        if row["evidence_id"] == "e2" and os.path.exists(where):
            raise ValueError("down")
        return compiler.decide(row)

    told = lambda rows: sorted((r.evidence_id, r.action) for r in rows.collect())
    assert told(engine.process(evidence(spark, ROWS[:1]), provider)) == [("e1", "NEW")]
    assert told(engine.process(evidence(spark, ROWS[1:3]), provider)) == [("e2", "FAILED"), ("e3", "BLOCKED")]
    flag.unlink()
    assert told(engine.process(evidence(spark, ROWS[1:2]), provider)) == [("e2", "NEW"), ("e3", "NEW")]
    assert told(engine.process(evidence(spark, ROWS), provider)) == [("e4", "NEW")]
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.run_batch(evidence(spark, ROWS))
    from annalist.operators.compilation import MADE
    from annalist.streaming.compile import read_states

    columns = ["block_id", "state_version", "content", "occurred_start", "occurred_end", "raw_evidence_ids"]
    made = read_states(spark, f"{tmp_path}/one/processed").filter("action in ('" + "','".join(MADE) + "')")
    assert sorted(map(tuple, made.select(columns).collect())) == sorted(map(tuple, whole.derived("states").select(columns).collect()))


def test_observing_in_parts_equals_observing_at_once(spark, tmp_path):
    from pyspark.sql import functions as F

    from annalist.operators import linegraph

    later = [("e5", "alpha", "deadline is friday soon", "2026-08-05"), ("e6", "gamma", "the deadline is friday", "2026-08-06"), ("e7", "delta", "nothing alike whatsoever here", "2026-08-07")]
    held = []
    for name, parts in (("parts", (later[:1], later[1:])), ("once", (later,))):
        engine = Engine(spark, str(tmp_path / name), Settings(least_support=2, least_similarity=0.3))
        engine.process(evidence(spark, ROWS)).count()
        with pytest.raises(RuntimeError):
            engine.observe(evidence(spark, later), "2026-09-01")
        engine.rebuild()
        before = engine.line_tables()[0].count()
        changes = [c for part in parts for c in engine.observe(evidence(spark, part), "2026-09-01").collect()]
        assert {c.change for c in changes} >= {"JOINED", "ADDED"} and engine.generation() == 1
        members, edges = engine.line_tables()
        at = F.lit("2026-09-02").cast("timestamp")
        held.append([sorted(map(tuple, linegraph.as_of(rows, at, keys).collect())) for rows, keys in ((members, ["line_id", "block_id", "state_id"]), (edges, ["line_id", "parent", "child"]))])
        assert members.count() > before
    assert held[0] == held[1]
