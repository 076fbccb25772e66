"""The catalogue of snapshots against a plain search."""

import random
from datetime import datetime, timedelta

import pytest

from annalist.engine import Engine, Settings
from annalist.operators import snapshots
from tests.test_engine import ROWS, evidence

DAY = datetime(2024, 1, 1)


def test_the_latest_before_equals_a_search(spark):
    r = random.Random(35)
    held = [(f"s{i:02}", DAY + timedelta(days=r.randint(0, 12))) for i in range(20)]
    at = dict(held)
    latest = lambda when, but=None: max(((c, i) for i, c in held if c < when and i != but), default=(None, None))[1]
    catalogue = spark.createDataFrame([*held, held[3]], "snapshot_id string, cutoff timestamp")
    assert {x.snapshot_id: x.previous_id for x in snapshots.with_previous(catalogue).collect()} == {i: latest(c) for i, c in at.items()}
    asks = [(DAY + timedelta(days=n), but) for n in range(-1, 15) for but in (None, *r.sample(sorted(at), 6))]
    got = snapshots.latest_before(catalogue, spark.createDataFrame(asks, "cutoff timestamp, exclude_id string")).collect()
    assert {(x.cutoff, x.exclude_id): x.snapshot_id for x in got} == {(when, but): latest(when, but) for when, but in asks} and len(got) == len(asks)
    assert snapshots.with_previous(catalogue.limit(0)).count() == 0
    assert [x.snapshot_id for x in snapshots.latest_before(catalogue.limit(0), spark.createDataFrame(asks[:1], "cutoff timestamp, exclude_id string")).collect()] == [None]


def test_stability_against_the_snapshot_before(spark):
    rows = [("a", "x", [1, 2, 3]), ("b", "x", [1, 2, 4]), ("b", "y", [5]), ("c", "x", [1, 2, 4]), ("c", "y", [])]
    catalogue = spark.createDataFrame([("a", DAY), ("b", DAY + timedelta(1)), ("c", DAY + timedelta(2))], "snapshot_id string, cutoff timestamp")
    got = snapshots.stability(spark.createDataFrame(rows, "snapshot_id string, structure_id string, members array<int>"), catalogue)
    assert {(x.snapshot_id, x.structure_id): x.stability for x in got.collect()} == {("a", "x"): 0.0, ("b", "x"): 0.5, ("b", "y"): 0.0, ("c", "x"): 1.0, ("c", "y"): 0.0}


def test_the_facade_keeps_snapshots(spark, tmp_path):
    engine = Engine(spark, str(tmp_path), Settings(least_support=2, least_similarity=0.3, least_structure=0.1))
    engine.run_batch(evidence(spark, ROWS[:3]))
    first = engine.put_snapshot("2026-08-04")
    assert engine.put_snapshot("2026-08-04") == first and engine.snapshots().count() == 1
    assert {x.stability for x in engine.snapshot(first).collect()} == {0.0}
    engine.run_batch(evidence(spark, ROWS[3:]))
    second = engine.put_snapshot("2026-08-05")
    assert second != first and engine.snapshots().count() == 2
    assert any(x.stability > 0 for x in engine.snapshot(second).collect())
    with pytest.raises(KeyError):
        engine.snapshot("snapshot_none")
