"""Paths and lines of components, against the walk and the fold over the whole graph at once."""

import random

import pytest
from pyspark.sql import functions as F

from annalist.functions.text import identity
from annalist.operators import trajectory


def graph(spark, seed, sizes=(9, 7, 12, 2), chance=0.3):
    r = random.Random(seed)
    nodes, edges = [], []
    for part, n in enumerate(sizes):
        here = [part * 100 + i for i in range(n)]
        nodes += here
        edges += [(a, b, round(r.random(), 3)) for i, a in enumerate(here) for b in here[i + 1 :] if r.random() < chance or b == a + 1]
    spans = spark.createDataFrame([(n, n, n + 1) for n in nodes], "id long, s long, e long").select("id", F.timestamp_seconds("s").alias("occurred_start"), F.timestamp_seconds("e").alias("occurred_end"))
    return spark.createDataFrame(edges, "parent long, child long, score double"), spans, {(a, b): x for a, b, x in edges}


def named(paths):
    return paths.withColumn("path_id", identity("p_", F.array_join(F.transform("nodes", lambda n: n.cast("string")), "|")))


@pytest.mark.parametrize("most_nodes", [64, 5])
def test_paths_of_components_equal_the_walk(spark, most_nodes):
    edges, spans, _ = graph(spark, most_nodes)
    want = {tuple(p) for p in trajectory.enumerate_paths(edges, spans, most_paths=100_000, most_nodes=most_nodes)}
    found = trajectory.propose(edges, most_paths=5_000, most_nodes=most_nodes).collect()
    assert {tuple(r.nodes) for r in found} == want and len(found) == len(want)
    assert {r.component for r in found} == {0, 100, 200, 300} and all(r.component == r.nodes[0] // 100 * 100 for r in found)


def test_too_many_paths_fail_before_they_are_made_and_only_by_component(spark):
    wide = spark.createDataFrame([(i, j) for i in range(120) for j in (i + 1, i + 2)], "parent long, child long")  # some 10^25 paths
    with pytest.raises(RuntimeError, match="over 256 paths in one component"):
        trajectory.propose(wide)
    apart = spark.createDataFrame([(i, 1000 + i) for i in range(300)], "parent long, child long")
    assert trajectory.propose(apart).count() == 300
    assert trajectory.propose(apart.limit(0)).count() == 0
    with pytest.raises(RuntimeError, match="cycle"):
        trajectory.propose(spark.createDataFrame([(1, 2), (2, 1)], "parent long, child long"))


def test_lines_of_components_equal_one_fold_over_all(spark):
    edges, spans, scores = graph(spark, 5, sizes=(8, 9, 6, 3))
    rests = {n: {f"e{n}", f"e{n // 2}"} if n % 4 == 0 else {f"e{n}"} for part in range(4) for n in range(part * 100, part * 100 + 9)}
    found = named(trajectory.propose(edges, most_paths=5_000)).filter("size(nodes) >= 3")
    walked = [p for p in trajectory.enumerate_paths(edges, spans, most_paths=100_000) if len(p) >= 3]
    told = [(p, p[0], p[-1] + 1, sum(scores[a, b] for a, b in zip(p, p[1:])) / (len(p) - 1)) for p in walked]
    described = trajectory.described(found, edges, spans)
    assert {tuple(r.nodes): round(r.similarity, 9) for r in described.collect()} == {tuple(p): round(x, 9) for p, _, _, x in told}
    for evidence in (None, rests):
        want = sorted((line, b) for line, blocks in trajectory.bootstrap(told, evidence=evidence) for b in blocks)
        given = None if evidence is None else spark.createDataFrame([(n // 100 * 100, n, e) for n, v in rests.items() for e in v], "component long, block_id long, evidence_id string")
        assert sorted(map(tuple, trajectory.bootstrap_lines(described, given).collect())) == want and want


def test_of_several_lines_the_one_with_most_independent_support_is_extended():
    a, b = (["a", "b", "c", "d", "e"], 0, 1, 1.0), (["v", "w", "x", "y", "z"], 0, 2, 1.0)
    more, tie = (["b", "c", "d", "x", "y"], 9, 9, 0.1), (["c", "d", "x", "y"], 9, 9, 0.1)
    held = lambda *paths, **rests: [x[1] for x in trajectory.bootstrap(list(paths), **rests)]
    assert held(a, b, more) == [["a", "b", "c", "d", "e", "x", "y"], ["v", "w", "x", "y", "z"]]
    assert held(a, b, tie) == [a[0], b[0]]
    shared = {x: {"one"} for x in "bcd"}  # three blocks of one source weigh as one, and two is the least
    assert held(a, b, more, evidence=shared) == [a[0], [*b[0], "b", "c", "d"]]
    assert trajectory.independent(["a", "b", "c"], {"a": {1, 2}, "b": {2, 3}, "c": {4}}) == 2
    assert trajectory.independent(["a", "b", "c"], {"a": {1}, "b": {3}, "c": {1, 3}}) == 1
    assert held(a, evidence={x: {"one"} for x in "abcde"}) == []


def test_lines_of_times_after_2262(spark):
    """pandas has no such times; 110,000 days from 2024 are in 2325. Equal lengths, so the starts order the paths."""
    rows = [("c", [1, 2, 3], 4e11, 4e11 + 9, 0.5), ("c", [2, 3, 4], 2e11, 2e11 + 9, 0.5), ("c", [7, 8], -1e12, -1e12 + 5, 0.9)]
    paths = spark.createDataFrame([(c, nodes, int(s), int(e), x) for c, nodes, s, e, x in rows], "component string, nodes array<long>, s long, e long, similarity double")
    paths = paths.select("component", "nodes", F.timestamp_seconds("s").alias("start"), F.timestamp_seconds("e").alias("end"), "similarity")
    found = trajectory.bootstrap_lines(paths, seed=2)
    want = [(line, b) for line, blocks in trajectory.bootstrap([(n, s, e, x) for _, n, s, e, x in rows], seed=2) for b in blocks]
    assert sorted(map(tuple, found.collect())) == sorted(want) and [b for _, b in want] == [2, 3, 4, 1, 7, 8]
