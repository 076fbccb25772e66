import itertools
import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from annalist.functions import text as T
from annalist.functions import vector as V
from annalist.operators import compilation, convergence, frontier, graph, linegraph, metrics, pairs, revisions, search, similarity, structure, surface, trajectory, visibility
from annalist.sources.files import read_blocks, write_json


def ts(text):
    return F.lit(text).cast("timestamp")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# Visibility ---------------------------------------------------------------------------------------


def test_a_late_known_item_is_invisible_before_it_was_known(spark):
    evidence = spark.sql("select 'e' evidence_id, timestamp'2026-01-01' known_at")
    log = spark.sql("select 'e' evidence_id, 'x' event_type, timestamp'2030-01-01' event_at where false")
    states = spark.sql("select 's' state_id, 'b' block_id, 1 state_version, timestamp'2020-01-01' occurred_end, timestamp'2026-01-01' derived_known_at, array('e') raw_evidence_ids")
    bridge = compilation.bridge(states)
    assert visibility.at_knowledge_cutoff(states, bridge, evidence, log, ts("2025-06-01")).count() == 0
    assert visibility.at_knowledge_cutoff(states, bridge, evidence, log, ts("2026-06-01")).count() == 1


def test_an_item_invalidated_later_is_still_valid_at_the_cutoff(spark):
    evidence = spark.sql("select * from values ('a', timestamp'2024-01-01'), ('b', timestamp'2024-01-01'), ('c', timestamp'2024-03-01') t(evidence_id, known_at)")
    log = spark.sql("select * from values ('a', 'INVALIDATED', timestamp'2024-02-10'), ('b', 'SUPERSEDED', timestamp'2024-01-20') t(evidence_id, event_type, event_at)")
    assert rows(visibility.valid_at(evidence, log, ts("2024-02-01")), "evidence_id", "valid") == [("a", True), ("b", False), ("c", False)]


def test_missing_evidence_hides_a_state(spark):
    states = spark.sql("select 's' state_id, array('known', 'missing') raw_evidence_ids")
    valid = spark.sql("select 'known' evidence_id, true valid")
    assert visibility.supported(states, compilation.bridge(states), valid).count() == 0


def test_admission_checks_provenance_and_repeats(spark):
    schema = "evidence_id string, content string, occurred_at timestamp, known_at timestamp, ordering_key string, provenance map<string,string>"
    t = pd.Timestamp("2024-01-01").to_pydatetime()
    good, derived = {"source": "s", "canonical": "true"}, {"source": "s", "canonical": "true", "derived": "true"}
    batch = spark.createDataFrame([("a", "x", t, None, None, good), ("a", "x", t, None, None, good), ("b", "x", t, None, None, derived), ("c", "x", t, None, None, {"canonical": "true"}), ("d", "x", t, None, None, good)], schema)
    old = spark.createDataFrame([("d", "x", t, t, "k", good)], schema)
    assert [r[0] for r in rows(visibility.admit(batch, old), "evidence_id")] == ["a"]


def test_lifecycle_invalidation_clears_the_successor_and_is_idempotent(spark):
    evidence = spark.sql("select 'a' evidence_id")
    log = spark.sql("select * from values ('a', 1, 'SUPERSEDED', timestamp'2024-01-01', 'b'), ('a', 2, 'INVALIDATED', timestamp'2024-01-02', null) t(evidence_id, event_id, event_type, event_at, replacement)")
    assert rows(visibility.lifecycle_state(evidence, log), "state", "superseded_by") == [("INVALID", None)]
    assert visibility.invalidate(log, evidence, ts("2024-02-01")).count() == 0


# Compilation --------------------------------------------------------------------------------------


def item(i, subject, content="text", topics=(), recap=False, key=None):
    t = pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)
    return {"lineage_id": "L", "evidence_id": f"e{i}", "ordering_key": key or f"{i:04d}", "subject": subject, "content": content, "occurred_at": t, "known_at": t, "topics": list(topics), "recap": recap}


SCHEMA = "lineage_id string, evidence_id string, ordering_key string, subject string, content string, occurred_at timestamp, known_at timestamp, topics array<string>, recap boolean"


def compiled(spark, items):
    out = compilation.compile_batch(spark.createDataFrame(pd.DataFrame(items), SCHEMA)).toPandas()
    return out.sort_values(["evidence_id", "block_id"])


def test_fold_continues_recalls_and_splits(spark):
    out = compiled(spark, [item(1, "Alpha"), item(2, "alpha plan"), item(3, "beta"), item(4, "alpha", "again", recap=True), item(5, "x", topics=["one", "two"])])
    assert list(out.action) == ["NEW", "CONTINUE", "NEW", "RECAP", "SPLIT", "SPLIT"]
    assert list(out.block_id) == ["L_000001", "L_000001", "L_000002", "L_000001", "L_000003", "L_000004"]
    assert list(out.state_version) == [1, 2, 1, 3, 1, 1]


def test_recap_without_target_makes_a_block_and_content_is_not_repeated(spark):
    out = compiled(spark, [item(1, "a", "same"), item(2, "a", "same"), item(3, "zz", "new", recap=True)])
    assert list(out.action) == ["NEW", "CONTINUE", "NEW"]
    assert list(out.content) == ["same", "same", "new"]


def test_late_and_repeated_items():
    c = compilation.Compiler("L")
    assert c.process(item(5, "a"))[0]["action"] == "NEW"
    assert c.process(item(5, "a")) == []
    assert c.process(item(1, "a"))[0]["action"] == "LATE"


def test_streamed_fold_equals_the_batch(spark, tmp_path):
    from annalist.streaming.compile import compile_stream

    items = [item(i, s) for i, s in enumerate(["a", "a", "b", "a b", "c"])]
    batch = compilation.compile_batch(spark.createDataFrame(pd.DataFrame(items), SCHEMA))
    for n, part in enumerate((items[:3], items[3:])):
        spark.createDataFrame(pd.DataFrame(part), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = compile_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    columns = ["action", "evidence_id", "block_id", "state_version", "content"]
    assert rows(spark.read.parquet(str(tmp_path / "out")), *columns) == rows(batch, *columns)


# Vectors and structure ----------------------------------------------------------------------------


def test_cosine_variants(spark):
    one = spark.sql("select array(1D, 0D) a, array(-1D, 0D) b, array(0D, 0D) z, array(1D) s")
    a, b, z, s = map(F.col, "abzs")
    assert one.select(V.cosine(a, b), V.cosine(a, b, clamp=True), V.cosine(a, z), V.cosine(a, s)).first()[:] == (-1.0, 0.0, 0.0, 0.0)
    for bad in (V.cosine(a, s, on_mismatch="raise"), V.cosine(a, z, on_zero="raise")):
        with pytest.raises(Exception):
            one.select(bad).collect()


def test_knn_equals_brute_force_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    m = np.random.default_rng(3).normal(size=(60, 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vector array<double>")
    u = m / np.linalg.norm(m, axis=1)[:, None]
    want = []
    for i in range(60):
        c = u @ u[i]
        order = [j for j in sorted(range(60), key=lambda j: (-c[j], j)) if j != i and c[j] >= 0.2][:3]
        want += [(i, j, r + 1) for r, j in enumerate(order)]
    assert rows(similarity.exact_knn(points, 3, 0.2), "src", "dst", "rank") == sorted(want)


def test_snapshot_diff_asymmetry(spark):
    schema = "structure_id string, members array<string>, support double"
    before = spark.createDataFrame([("s", ["a", "b"], 0.9), ("gone", ["b", "z"], 0.5)], schema)
    after = spark.createDataFrame([("s", ["a", "b", "c"], 0.8), ("t", ["b"], 0.1)], schema)
    kinds = {(r.change_kind, r.structure_id) for r in structure.diff(before, after).collect()}
    assert kinds == {("new_members", "s"), ("new_members", "t"), ("lost_or_weakened", "s"), ("stronger", "s"), ("reorganizations", "gone"), ("linked", "s")}


def test_components_match_union_find(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = sorted((n, find(n)) for n in parent)
    assert rows(graph.connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component") == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_paths_closure_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    assert sorted(r[0] for r in graph.paths(edges).collect()) == [["a", "b", "c"], ["a", "d"]]
    starts = spark.createDataFrame([("a",)], "n string")
    assert rows(graph.reachable(edges, starts), "node", "hops") == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    with pytest.raises(RuntimeError):
        graph.paths(edges, most_paths=1)
    loop = edges.union(spark.createDataFrame([("c", "a")], "p string, c string"))
    assert {r[0] for r in graph.in_cycle(loop).collect()} >= {"a", "b", "c"}
    assert graph.in_cycle(edges).count() == 0


# Trajectories and lines ---------------------------------------------------------------------------


def test_overlapping_spans_stay_unordered(spark):
    spans = spark.sql("select * from values ('a', 0, 5), ('b', 3, 9), ('c', 5, 6) t(id, occurred_start, occurred_end)")
    edges = spark.sql("select * from values ('a', 'b', 1D), ('a', 'c', 1D) t(a, b, score)")
    assert rows(trajectory.orient(edges, spans), "parent", "child") == [("a", "c")]


def test_only_contiguous_shorter_paths_are_dropped(spark):
    paths = spark.createDataFrame([(["a", "b", "c", "d"],), (["b", "c", "d"],), (["a", "c", "d"],), (["x", "y"],)], "nodes array<string>")
    assert sorted(r.nodes for r in trajectory.maximal_paths(paths, 3).collect()) == [["a", "b", "c", "d"], ["a", "c", "d"]]


def test_long_paths_are_cut_with_an_overlap(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "parent long, child long")
    spans = spark.range(10).select("id", F.col("id").alias("occurred_start"))
    assert trajectory.enumerate_paths(edges, spans, most_nodes=6, least_support=3) == [[0, 1, 2, 3, 4, 5], [4, 5, 6, 7, 8, 9]]


def test_bootstrap_seeds_extends_and_leaves_unresolved():
    paths = [(["a", "b", "c", "d"], 0, 4, 0.9), (["c", "d", "e"], 2, 5, 0.9), (["x", "y", "z"], 0, 3, 0.9), (["a", "b", "x", "y"], 9, 9, 0.1)]
    lines = trajectory.bootstrap(paths)
    assert [blocks for _, blocks in lines] == [["a", "b", "c", "d", "x", "y", "z", "e"]]
    two = trajectory.bootstrap([(["a", "b", "c"], 0, 1, 1.0), (["x", "y", "z"], 0, 2, 1.0), (["a", "b", "x"], 7, 8, 1.0)])
    assert [blocks for _, blocks in two] == [["a", "b", "c", "x"], ["x", "y", "z"]]


def test_membership_intervals_are_half_open_and_zero_lifetimes_carry_no_identity(spark):
    r = spark.sql("select * from values ('a', 1, 5), ('b', 5, 5), ('c', 5, cast(null as int)) t(node_id, known_at, retired_at)")
    assert rows(linegraph.as_of(r, F.lit(5), ["node_id"]), "node_id") == [("c",)]
    assert rows(linegraph.as_identity(r, F.lit(5), ["node_id"]), "node_id") == [("a",), ("c",)]


def test_hidden_parents_hide_descendants(spark):
    edges = spark.sql("select * from values ('a', 'b'), ('b', 'c'), ('x', 'c'), ('x', 'y') t(parent, child)")
    seen = linegraph.visible_nodes(spark.sql("select * from values ('b'), ('c'), ('x'), ('y') t(node_id)"), edges)
    assert rows(seen, "node_id") == [("x",), ("y",)]
    assert rows(linegraph.frontier(seen, edges), "node_id") == [("y",)]


def test_shortcuts_are_refused_cycles_raise_and_late_blocks_go_between(spark):
    edges = spark.sql("select 'l' line_id, p parent, c child, timestamp'2024-01-01' known_at, cast(null as timestamp) retired_at, '' derivation_fingerprint from values ('a', 'b'), ('b', 'c') t(p, c)")
    assert linegraph.add_edge(edges, "l", "a", "c", ts("2024-02-01")).count() == 2
    with pytest.raises(RuntimeError):
        linegraph.add_edge(edges, "l", "c", "a", ts("2024-02-01"))
    after = linegraph.insert_between(edges, "l", "x", "a", "b", ts("2024-02-01"))
    assert rows(linegraph.as_of(after, ts("2024-03-01"), ["parent", "child"]), "parent", "child") == [("a", "x"), ("b", "c"), ("x", "b")]
    assert rows(linegraph.as_of(after, ts("2024-01-15"), ["parent", "child"]), "parent", "child") == [("a", "b"), ("b", "c")]


# Convergence, surfaces, frontier -------------------------------------------------------------------


def test_signals_that_share_evidence_count_once(spark):
    schema = "signal_id string, decision_key string, candidate_id string, polarity string, raw_evidence_ids array<string>, reciprocal boolean, context_id string, derivation_variant_id string"
    s = spark.createDataFrame([
        ("1", "d", "x", "support", ["e1", "e2"], True, "k1", "v"), ("2", "d", "x", "support", ["e2"], False, "k2", "v"), ("3", "d", "x", "support", ["e3"], False, "k3", "v"),
        ("4", "d", "y", "support", ["e1"], False, "k1", "v"), ("5", "d", "y", "contradict", ["e9"], False, None, "v"),
    ], schema)
    p = convergence.profiles(s, convergence.evidence_components(s))
    assert rows(p, "candidate_id", "components", "reciprocal_components", "contexts", "variants", "contradictions") == [("x", 2, 1, 1, 1, 0), ("y", 1, 0, 1, 0, 1)]
    assert rows(convergence.decide(p), "status", "winner") == [("RESOLVED", "x")]


def test_resampling_ignores_extra_points_and_cliques_are_maximal(spark):
    base = [(0, 0), (1, 0.2), (2, 1), (3, 2.4)]
    dense = [(0, 0), (0.5, 0.1), (1, 0.2), (1.5, 0.6), (2, 1), (2.5, 1.7), (3, 2.4)]
    other = [(0, 0), (0.2, 1), (1, 2), (2.5, 2.4)]
    lines = [("a", ["1"], base), ("b", ["2"], dense), ("c", ["3"], [(x + 5, y) for x, y in base]), ("d", ["4"], other), ("e", ["5"], [(1, 1), (1, 1)])]
    paths = spark.createDataFrame([(a, n, [(float(x), float(y)) for x, y in v]) for a, n, v in lines], "line_id string, node_ids array<string>, vectors array<struct<x:double,y:double>>")
    paths = paths.withColumn("vectors", F.transform("vectors", lambda v: F.array(v["x"], v["y"])))
    views = surface.signatures(paths)
    assert views.count() == 4
    found = surface.surfaces(views, 0.999).collect()
    assert len(found) == 1 and len(found[0].view_ids) == 3
    assert sorted(map(sorted, surface.cliques({1: {2, 3}, 2: {1, 3}, 3: {1, 2, 4}, 4: {3}}))) == [[1, 2, 3], [3, 4]]


def test_frontier_absorbs_near_support_and_skips_itself(spark):
    t = "timestamp'2024-01-06'"
    blocks = spark.sql(f"select 'n' block_id, 'n1' state_id, 'deadline friday' content, array(0.98D, 0.05D) vector, {t} occurred_end")
    items = spark.sql("select 'r' region_id, 'deadline friday' content, array(1D, 0D) centroid, timestamp'2024-01-01' occurred_end union all select 'future', 'x', array(1D, 0D), timestamp'2025-01-01'")
    support = spark.sql("select * from values ('r', 'o', 'o1', 'deadline', array(1D, 0D)), ('r', 'n', 'n1', 'self', array(1D, 0D)), ('future', 'o', 'o1', 'x', array(1D, 0D)) t(region_id, support_block, support_state, support_content, support_vector)")
    scored = frontier.scores(blocks, items, support)
    got = scored.first()
    cos = 0.98 / math.hypot(0.98, 0.05)
    want = 0.45 * cos + 0.30 * cos + 0.15 * 1.0 + 0.10 * (0.35 + 0.65 * 2 ** (-5 / 180))
    assert scored.count() == 1 and got.selected == ["o1"] and abs(got.score - want) < 1e-9
    assert frontier.absorptions(scored).count() == 1 and frontier.boundaries(scored).count() == 0


# Revisions, search, pairs --------------------------------------------------------------------------


def test_consolidation_compares_text_and_support_sets(spark):
    current = spark.sql("select * from values ('a', 'One  two', array('x', 'y'), 3) t(region_id, content, support, revision_number)")
    new = spark.sql("select * from values ('a', ' One two ', array('y', 'x'), array('x', 'y')), ('a', 'One two', array('x'), array('x')), ('a', 'Three', array('x'), array('x')), ('b', 'n', array('z'), array('z')), ('b', 'n', array('z'), array('q')) t(region_id, content, support, authorized)")
    assert rows(revisions.consolidate(new, current), "action", "revision_number") == [("INITIAL_CREATION", 1), ("MEANINGFUL_UPDATE", 4), ("NO_CHANGE", 3), ("SUPPORT_UPDATE", 4), ("UNAUTHORIZED", 0)]


def test_revision_links_are_checked(spark):
    r = spark.sql("select * from values ('a', 1, 'p', cast(null as string)), ('a', 2, 'q', 'p'), ('a', 4, 'r', 'q'), ('b', 1, 's', 'zz') t(region_id, revision_number, baseline_id, previous_baseline_id)")
    assert rows(revisions.broken_links(r), "baseline_id") == [("r",), ("s",)]


def test_search_tokens_fold_case_and_pair_unspaced_runs():
    assert search.text_tokens("Straße ＡＢＣ 日本語 x1") == ["strasse", "abc", "日本語", "日本", "本語", "x1"]
    assert search.text_tokens(None) == []


def test_an_empty_search_matches_everything(spark):
    heads = spark.sql("select * from values ('a', 'Alpha'), ('b', 'beta') t(region_id, content)")
    asked = spark.sql("select * from values (1, ''), (2, 'ALPHA x'), (3, 'zz') t(query_id, query_text)")
    assert rows(search.matches(heads, asked), "query_id", "region_id") == [(1, "a"), (1, "b"), (2, "a")]


VIEWS = [
    ("p1", "计划下周体检", "2024-01-01"), ("s1", "体检已经完成，结果出来了", "2024-01-08"), ("p2", "会议在周五", "2024-01-02"), ("s2", "之前说错了，会议在周四", "2024-01-03"), ("far", "体检", "2024-06-01"),
]


def test_pairs_signals_and_adjudication(spark):
    v = spark.createDataFrame(VIEWS, "memory_id string, content string, t string").select("memory_id", "content", F.to_timestamp("t").alias("received_at"), *(F.lit(None).cast("timestamp").alias(c) for c in ("semantic_time", "valid_start", "valid_end")))
    b0 = pairs.interval_pairs(v)
    assert b0.count() == 6
    found = pairs.adjudicate(pairs.with_signals(pairs.with_cosine(b0, pairs.term_weights(v)), v))
    got = {(r.predecessor_id, r.successor_id): r for r in found.collect()}
    assert got["p1", "s1"].relation == "STATE_CHANGE" and got["p1", "s1"].prior_unknown_resolved and got["p1", "s1"].resolved_dimensions == ["plan_outcome"]
    assert "plan_outcome_arc" in got["p1", "s1"].signals
    assert got["p2", "s2"].relation == "CORRECTION_RETRACTION" and got["p2", "s2"].prior_unknown_resolved is False
    assert pairs.interval_pairs(v, 5 * 30 * 86400 + 86400 * 7).count() > 6


def test_metrics_with_empty_denominators(spark):
    none = spark.createDataFrame([], "predecessor_id string, successor_id string")
    gold = spark.createDataFrame([], "predecessor_id string, successor_id string, longitudinal_relation string")
    assert rows(metrics.candidate_metrics(none, gold, 0), "candidates", "recall", "reduction_pct", "false_rate") == [(0, 1.0, 0.0, 0.0)]
    verdicts = spark.createDataFrame([], "predecessor_id string, successor_id string, relation string")
    assert rows(metrics.adjudication_metrics(verdicts, gold), "accuracy", "unrelated_rejection") == [(0.0, 1.0)]


def test_text_functions(spark):
    one = spark.sql("select ' a\\t b ' t, '开会 x 会议' h")
    assert one.select(T.content_hash("t") == F.sha2(F.lit("a b"), 256)).first()[0]
    assert one.select(T.bigrams(F.col("h"))).first()[0] == ["开会", "会会", "会议", "w:x"]


def test_jsonl_source_validates(spark, tmp_path):
    head = {"type": "metadata", "schema_version": "1", "corpus_id": "c", "vector_dimension": 2}
    block = lambda i, **k: {"type": "block", "block_id": f"b{i}", "occurred_at": "2024-01-0%dT00:00:00+00:00" % i, "text": "t", "vector": [1.0, 0.5]} | k

    def write(*lines):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(map(json.dumps, lines)))
        return str(path)

    assert [r.block_id for r in read_blocks(spark, write(head, block(2), block(1))).collect()] == ["b1", "b2"]
    for bad in ([block(1)], [head, block(1), block(1)], [head, block(1, vector=[1.0])], [head, block(1, occurred_at="2024-01-01T00:00:00")]):
        with pytest.raises(ValueError):
            read_blocks(spark, write(*bad))
    write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


# Nearline growth ----------------------------------------------------------------------------------


def test_observe_keeps_revalidates_detaches_and_routes(spark):
    schema = "line_id string, node_id string, block_id string, state_id string, vector array<double>, day int"
    timed = lambda df: df.withColumns({"occurred_start": F.expr("timestamp'2024-01-01' + make_dt_interval(day)"), "occurred_end": F.expr("timestamp'2024-01-01' + make_dt_interval(day)")}).drop("day")
    east, north = [1.0, 0.0], [0.0, 1.0]
    members = timed(spark.createDataFrame([("l", "n1", "b1", "b1@1", east, 1), ("l", "n2", "b2", "b2@1", east, 2), ("l", "n3", "b3", "b3@1", east, 3), ("k", "n4", "b4", "b4@1", north, 4), ("k", "n5", "b5", None, None, 5)], schema))
    edges = spark.createDataFrame([("l", "n1", "n2"), ("l", "n2", "n3")], "line_id string, parent string, child string")
    arriving = lambda *r: timed(spark.createDataFrame(r, "block_id string, state_id string, vector array<double>, day int"))
    found, route = trajectory.observe(members, edges, arriving(("b1", "b1@1", north, 1), ("b2", "b2@2", east, 2), ("b3", "b3@2", north, 3), ("b4", "b4@2", north, 9), ("b5", "b5@1", east, 5), ("b6", "b6@1", east, 6)))
    assert rows(found, "block_id", "decision") == [("b1", "KEPT"), ("b2", "REVALIDATED"), ("b3", "DETACHED"), ("b4", "REVALIDATED"), ("b5", "DETACHED")]
    assert rows(route, "block_id") == [("b3",), ("b5",), ("b6",)]
    found, route = trajectory.observe(members, edges, arriving(("b2", "b2@2", east, 3), ("b4", "b4@2", None, 4)))  # no longer before n3; no vector
    assert rows(found, "block_id", "decision") == [("b2", "DETACHED"), ("b4", "DETACHED")]
    found, route = trajectory.observe(members, edges, arriving(("b2", "b2@2", east, 2)).filter("false"))
    assert found.count() == route.count() == 0


def test_attach_revises_the_edge_it_comes_between_and_refuses_a_second_parent(spark):
    edges = spark.createDataFrame([("l", "a", "c"), ("m", "a", "c")], "line_id string, parent string, child string")
    spans = spark.sql("select node_id, timestamp'2024-01-01' + make_dt_interval(d) occurred_start, timestamp'2024-01-01' + make_dt_interval(d) occurred_end from values ('a', 1), ('x', 2), ('y', 0), ('c', 3) t(node_id, d)")
    wanted = lambda *r: spark.createDataFrame(r, "line_id string, node_id string, parent string, child string")
    got = rows(linegraph.attach(edges, wanted(("l", "x", "a", "c"), ("m", "y", None, "c")), spans), "line_id", "parent", "child", "change")
    assert got == [("l", "a", "c", "RETIRED"), ("l", "a", "x", "ADDED"), ("l", "x", "c", "ADDED")]
    got = rows(linegraph.attach(edges, wanted(("m", "y", None, "c")), spans, rejoin=True), "line_id", "parent", "child", "change")
    assert got == [("m", "y", "c", "ADDED")]
    for bad in (("l", "x", "c", None),), (("l", "x", "a", None), ("l", "y", None, "c")), (("l", "c", "a", None),):
        with pytest.raises(ValueError):
            linegraph.attach(edges, wanted(*bad), spans)


def test_detach_retires_a_node_and_the_edges_at_it_alone(spark):
    held = "timestamp'2024-01-01' known_at, cast(null as timestamp) retired_at"
    members = spark.sql(f"select *, {held} from values ('l', 'a'), ('l', 'b'), ('m', 'a') t(line_id, node_id)")
    edges = spark.sql(f"select *, {held} from values ('l', 'a', 'b'), ('l', 'b', 'c'), ('m', 'a', 'b') t(line_id, parent, child)")
    m, e = linegraph.detach(members, edges, spark.sql("select 'l' line_id, 'a' node_id"), ts("2024-02-01"))
    assert rows(m.filter("retired_at is not null"), "line_id", "node_id") == [("l", "a")]
    assert rows(e.filter("retired_at is not null"), "line_id", "parent", "child") == [("l", "a", "b")]


def test_paths_are_described_by_their_times_and_mean_similarity(spark):
    paths = spark.sql("select * from values ('p', array('a', 'b', 'c')), ('q', array('c')) t(path_id, nodes)")
    edges = spark.sql("select * from values ('a', 'b', 0.5D), ('b', 'c', 1.0D), ('a', 'c', 0.9D) t(parent, child, score)")
    spans = spark.sql("select id, timestamp'2024-01-01' + make_dt_interval(d) occurred_start, timestamp'2024-01-02' + make_dt_interval(d) occurred_end from values ('a', 1), ('b', 2), ('c', 3) t(id, d)")
    got = rows(trajectory.described(paths, edges, spans).withColumns({"s": F.dayofmonth("start"), "e": F.dayofmonth("end")}), "path_id", "s", "e", "similarity")
    assert got == [("p", 2, 5, 0.75), ("q", 4, 5, 0.0)]


def test_the_evidence_index_holds_every_kind_once(spark):
    blocks = spark.createDataFrame([("b1", ["1", "2", "2", None]), ("b2", []), ("b3", None), (None, ["1"])], "holder_id string, evidence_ids array<string>")
    shown = spark.createDataFrame([(7, 2), (7, 2), (8, None), (9, 3)], "holder_id long, evidence_id long")
    index = revisions.postings({"block": blocks, "snapshot": shown})
    assert sorted(map(tuple, index.collect())) == [("1", "block", "b1"), ("2", "block", "b1"), ("2", "snapshot", "7"), ("3", "snapshot", "9")]
    ids = spark.createDataFrame([(2,), (2,), (None,), (5,)], "evidence_id long")
    assert sorted(map(tuple, revisions.holders_of(ids, index).collect())) == [("block", "b1"), ("snapshot", "7")]
    assert revisions.holders_of(ids.limit(0), index).count() == 0 and revisions.holders_of(ids, index.limit(0)).count() == 0


def test_frontier_takes_the_nearest_supports_of_many_without_a_row_for_each_pair(spark, monkeypatch):
    draw = np.random.default_rng(4)
    words = "alpha beta gamma delta epsilon".split()
    point = lambda i: draw.integers(-1, 2, 3).astype(float).tolist() if i % 17 else [1.0, 2.0]  # noqa: E731  many ties, zeros, opposites, and some of another size
    blocks = [(i, i, " ".join(draw.choice(words, 2)), point(i)) for i in range(60)]
    supports = [(i % 3, i, int(draw.integers(30, 90)), str(draw.choice(words)) if i % 5 else "", point(i)) for i in range(400)]
    end = F.lit("2024-01-05").cast("timestamp")
    b = spark.createDataFrame(blocks, "block_id int, state_id int, content string, vector array<double>").withColumn("occurred_end", end)
    s = spark.createDataFrame(supports, "region_id int, support_block int, support_state int, support_content string, support_vector array<double>")
    items = spark.createDataFrame([(r, "alpha", [1.0, 0.0, 0.0]) for r in range(3)], "region_id int, content string, centroid array<double>").withColumn("occurred_end", end)
    cos = lambda u, v: 0.0 if len(u) != len(v) or not (np.any(u) and np.any(v)) else min(1.0, max(0.0, float(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)))))
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    want = {}
    for block, state, text, v in blocks:
        for r in range(3):
            others = [(round(-cos(v, w), 9), t, c) for g, _, t, c, w in supports if g == r and t != state]
            lexical = max(share(set(text.split()), {"alpha"}), share(set(text.split()), {c for _, _, c in others if c}))
            near = sorted(others)[:8]
            want[block, r] = ([t for _, t, _ in near], round(0.45 * cos(v, [1, 0, 0]) + 0.30 * -near[0][0] + 0.15 * lexical + 0.10, 6))
    for name in ("BLOCK_ROWS", "KNN_ROWS"):
        monkeypatch.setattr(frontier, name, 50, raising=False)
    scored = frontier.scores(b, items, s)
    assert {(x.block_id, x.region_id): (x.selected, round(x.score, 6)) for x in scored.collect()} == {k: (n, min(1.0, round(t, 6))) for k, (n, t) in want.items()}
    assert "collect_list(support_content" not in scored._jdf.queryExecution().toString()  # all supports of a region, for each block


@pytest.mark.parametrize("drift", [0.0, 1.0])
def test_prefix_replay_over_many_blocks_keeps_few_pairs(spark, monkeypatch, drift):
    draw = np.random.default_rng(8)
    base = draw.integers(-2, 3, (70, 4)).astype(float) + drift * np.linspace(0, 9, 70)[:, None] * [1, 0, 0, 0]
    rows = [(i, int(draw.integers(0, 40)), v.tolist()) for i, v in enumerate(base)]
    points = spark.createDataFrame([*rows, (98, 5, [1.0]), (99, 7, None)], "id int, occurred_at int, vector array<double>")
    monkeypatch.setattr(similarity, "KNN_ROWS", 20)
    for name, value in (("CUTOFFS", 7), ("FIRST_PART", 4)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    cos = lambda u, v: float(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))) if np.any(u) and np.any(v) else 0.0
    want = set()
    for cutoff in {t for _, t, _ in rows} | {5, 7}:
        held = [r for r in rows if r[1] <= cutoff]
        for i, _, v in held:
            near = sorted((-round(cos(v, w), 9), t, j) for j, t, w in held if j != i and cos(v, w) >= 0.1)
            want |= {(cutoff, i, j, rank + 1) for rank, (_, _, j) in enumerate(near[:3])}
    asked = []
    monkeypatch.setattr(similarity, "exact_knn", lambda *a, **k: asked.append(a) or pytest.fail("all pairs are asked for"))
    got = similarity.prefix_replay(points, 3, 0.1).collect()
    assert len(got) == len(want) and {(x.cutoff, x.src, x.dst, x.rank) for x in got} == want


def test_prefix_replay_writes_out_stretch_by_stretch(spark, monkeypatch):
    """A point's lists lie side by side and cutoffs repeat in one order, which files hold in little room; single precision gives the same."""
    draw = np.random.default_rng(9)
    vectors = draw.normal(size=(60, 6)).astype(np.float32).tolist()
    monkeypatch.setattr(similarity, "CUTOFFS", 8)
    frame = lambda kind: spark.createDataFrame([(i, i, v) for i, v in enumerate(vectors)], f"id int, occurred_at int, vector {kind}")
    got = similarity.prefix_replay(frame("array<double>"), 2, 0.1).withColumns({"task": F.spark_partition_id(), "part": F.pmod(F.xxhash64("src"), F.lit(64))}).collect()
    assert len(got) > 3000
    for key in (lambda r: (r.task, r.part, r.cutoff // 8), lambda r: (r.task, r.part, r.cutoff // 8, r.src, r["rank"])):
        runs = [(k, [r.cutoff for r in rows]) for k, rows in itertools.groupby(got, key)]
        assert len(runs) == len({k for k, _ in runs})
    assert all(cutoffs == list(range(cutoffs[0], cutoffs[-1] + 1)) for _, cutoffs in runs)
    plain = lambda rows: {(r.cutoff, r.src, r.dst, r["rank"], round(r.similarity, 9)) for r in rows}
    assert plain(similarity.prefix_replay(frame("array<float>"), 2, 0.1).collect()) == plain(got)


def grouped(spark):
    """Groups by their members, and vectors that are all near each other."""
    groups = spark.createDataFrame([("a", [1, 2], ["d", "e"]), ("b", [2, 3, 4], ["d", "e"]), ("c", [1, 2, 4], ["d", "e"]), ("z", [9], ["d", "e"])], "structure_id string, members array<int>, dates array<string>")
    return groups, spark.createDataFrame([(i, [1.0, i / 1000]) for i in (1, 2, 3, 4, 9)], "id int, vector array<double>")


def test_groups_that_share_meet_without_the_neighbours_of_centroids(spark, monkeypatch):
    groups, vectors = grouped(spark)
    bridge = spark.createDataFrame([(1, "x"), (2, "y"), (2, "x"), (3, None)], "id int, evidence_id string")
    found = sorted(tuple(r) for r in structure.higher_order(groups, vectors).select("left_id", "right_id", "shared").collect())
    assert found == [("a", "b", 1), ("a", "c", 2), ("a", "z", 0), ("b", "c", 2), ("b", "z", 0), ("c", "z", 0)]
    monkeypatch.setattr(structure, "exact_knn", lambda *a, **k: pytest.fail("all centroids are compared"))
    shared = structure.sharing(groups)
    assert sorted(map(tuple, shared.collect())) == [x for x in found if x[2]]
    pairs = shared.select("left_id", "right_id").union(spark.createDataFrame([("z", "zz"), ("a", "z"), ("a", "b")], "l string, r string"))
    rows = sorted((r.left_id, r.right_id, r.evidence) for r in structure.expand(pairs, groups, bridge).collect())
    assert rows == [("a", "b", ["x", "y"]), ("a", "c", ["x", "y"]), ("a", "z", ["x", "y"]), ("b", "c", ["x", "y"])]


@pytest.mark.parametrize("name", ["O38_higher_order_sharing", "O39_expand_evidence"])
def test_queries_over_shared_members_take_neighbours_once(spark, tmp_path, monkeypatch, name):
    from annalist.plans import queries

    taken, real = [], similarity.exact_knn
    monkeypatch.setattr(structure, "exact_knn", lambda points, k, *a, **o: taken.append(k) or real(points, k, *a, **o))
    draw = np.random.default_rng(4)
    spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(draw.normal(size=(40, 5)).astype(np.float32).tolist())], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() > 0 and taken == [8]
