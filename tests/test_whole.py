"""Queries against their SQL over rows that an earlier version left out."""

import hashlib
import itertools
import random
import re
import time
import unicodedata
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from annalist.operators import compilation, convergence, graph, metrics, pairs, similarity, surface, trajectory, visibility
from annalist.plans import queries
from annalist.scratch import materialize
from tests.oracle import both


def written(path, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["O63_evidence_components", "O64_profiles", "O65_O66_pareto", "O62_convergence"])
def test_decisions_hear_every_order(spark, tmp_path, name):
    draw = random.Random(3)
    n = 300
    d = written(tmp_path, lineitem={
        "l_orderkey": [draw.randrange(3900, 9000) for _ in range(n)], "l_linenumber": pa.array(range(n), pa.int32()), "l_partkey": [draw.randrange(40) for _ in range(n)],
        "l_suppkey": [draw.randrange(9) for _ in range(n)], "l_quantity": [float(draw.randrange(1, 51)) for _ in range(n)], "l_returnflag": [draw.choice("ANR") for _ in range(n)], "l_linestatus": [draw.choice("FO") for _ in range(n)],
    })
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], d)
    assert got == want


@pytest.mark.parametrize("name", ["O61d_visible_nodes", "O61e_frontier", "O61f_frontier_paths", "O60_O61g_raw_closure"])
def test_lines_hold_every_event(spark, tmp_path, name):
    users = [3] * 15 + [40] * 14 + [41] * 2 + [900] * (66 if name == "O61f_frontier_paths" else 16)  # over 12 events, ids from 40 on, a path of over 64 nodes
    d = written(tmp_path, events={"event_id": [i + 12 for i in range(len(users))], "user_id": users, "ts": [datetime(2024, 1, 1) + timedelta(hours=i) for i in range(len(users))]})
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], d)
    assert got == want


@pytest.mark.parametrize("name", ["O32_prefix_replay", "O41_O47_frontier", "O36_snapshot_diff"])
def test_every_vector_takes_part(spark, tmp_path, name):
    draw = np.random.default_rng(5)
    d = written(tmp_path, embeddings={"vec_id": list(range(130)), "embedding": pa.array(draw.normal(size=(130, 8)).tolist(), pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(130)], pa.int32())})
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], d)
    assert got == want


def test_surfaces_of_all_windows_and_dimensions(spark, tmp_path):
    draw = np.random.default_rng(6)
    shape = np.array([[0, 0, 0, 0], [0, 0, 4, 1], [0, 0, 5, 9], [0, 0, 20, 9]], float)
    lines = [np.concatenate([draw.normal(size=(5, 4)), shape + draw.normal(size=4)]) for _ in range(3)]  # alike in their last four points, in dimensions 3 and 4
    d = written(tmp_path, embeddings={"vec_id": list(range(400, 427)), "embedding": pa.array([lines[i % 3][i // 3].tolist() for i in range(27)], pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(27)], pa.int32())})
    views = []
    for x in lines:
        flat = [(s - s[0]).ravel() for s in (surface.resample(x[n : n + 4]) for n in range(6))]
        views.append([f / np.linalg.norm(f) for f in flat])
    want = sorted(round(least, 4) for t in itertools.product(*views) if (least := min(a @ b for a, b in itertools.combinations(t, 2))) >= 0.8)
    assert len(want) >= 1
    found = queries.QUERIES["O69_O72_surfaces"](spark, d).collect()
    assert sorted(round(r.least_similarity, 4) for r in found) == want and {r.n_views for r in found} == {3}


TEXTS = ["plain words, twice: plain", "Straße und Größe  über\u00a0alles", "STRASSE größe", "cafe\u0301 noe\u0308l café", "¿Qué\u2003pasó?\n\u3000Él", "l'été \u0661\u0662 déjà_vu", "", None, "qué PASÓ", "\u2028Größe "]


def hashed(text):
    return None if text is None else hashlib.sha256(" ".join(text.split()).encode()).hexdigest()


def bucketed(rows):
    return Counter((i, int(hashlib.sha256(w.encode()).hexdigest()[:8], 16) % 16) for i, text in rows for w in re.findall(r"\w+", text or ""))


def met(rows):
    words = {i: set(re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", text or "").casefold())) for i, text in rows}
    return {(q, i) for q in words if q % 5 == 0 for i in words if words[q] & words[i] or not words[q]}


def test_texts_of_every_language(spark, tmp_path):
    rows = list(enumerate(TEXTS, 1))
    ids, texts = [i for i, _ in rows], [text for _, text in rows]
    d = written(tmp_path, documents={"doc_id": ids, "text": texts}, benchmark={"item_id": ids, "text": texts})
    assert {r.doc_id: r.content_hash for r in queries.QUERIES["O81_content_hash"](spark, d).collect()} == {i: hashed(text) for i, text in rows}
    assert {(r.item_id, r.bucket): r.n for r in queries.QUERIES["O24_O25_hash_embedding"](spark, d).collect()} == bucketed(rows)
    assert {(r.query_id, r.region_id) for r in queries.QUERIES["O83_lexical_search"](spark, d).collect()} == met(rows)


def test_paths_beyond_the_limit_fail(spark):
    edges = spark.createDataFrame([(i, 1000 + i) for i in range(300)], "parent long, child long")
    spans = spark.range(1300).select("id", F.col("id").alias("occurred_start"))
    assert len(trajectory.enumerate_paths(edges, spans, most_paths=300)) == 300
    with pytest.raises(RuntimeError, match="over 256 paths"):
        trajectory.enumerate_paths(edges, spans)


def test_blocks_whose_digests_start_alike_stay_apart(spark):
    # The SHA-256 digests of "1309208|1" and "1460755|1" have the same first ten hex digits.
    e = spark.createDataFrame([(i, lineage, "s", str(i), i) for i, lineage in enumerate((1309208, 1460755))], "evidence_id long, lineage_id long, subject string, ordering_key string, occurred_at long").withColumn("known_at", F.col("occurred_at"))
    touches = compilation.islands(e)
    assert visibility.latest(compilation.block_states(touches)).count() == 2
    assert visibility.latest(compilation.supported_states(touches, e.select("evidence_id", F.lit(True).alias("valid")))).count() == 2


def test_terms_of_a_small_table_are_not_broadcast(spark, tmp_path):
    d = written(tmp_path, orders={"o_orderkey": list(range(300)), "o_custkey": [i % 9 for i in range(300)], "o_orderdate": [datetime(2024, 1, 1) + timedelta(days=i % 50) for i in range(300)]})
    v = queries.said(spark, d)
    plan = pairs.with_signals(pairs.with_cosine(pairs.interval_pairs(v, scope=["person"]), pairs.term_weights(v)), v)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    missed = metrics.missed(queries.said_gold(spark, d), queries.said_gold(spark, d))._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in missed


@pytest.mark.parametrize("k", [1, 3, 40, 300])
def test_neighbours_by_parts_equal_a_whole_sort_and_are_made_once(spark, monkeypatch, k):
    monkeypatch.setattr(similarity, "KNN_ROWS", 90)
    draw = np.random.default_rng(k)
    v = draw.normal(size=(300, 5)).round(1)
    v[200:260] = v[:60]  # equal vectors have equal scores, ids decide
    v[7], v[8, 2] = 0, np.nan
    size = np.linalg.norm(v, axis=1)
    p = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    found = similarity.exact_knn(p, k, -0.5)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    got = {(r.src, r["rank"]): (r.dst, r.similarity) for r in found.collect()}
    want = {}
    for i in range(300):
        scores = [(-(float(np.einsum("j,j->", v[i], v[j])) / (size[i] * size[j]) if size[i] * size[j] > 0 else 0.0), j) for j in range(300) if j != i]
        want |= {(i, r + 1): (j, -s) for r, (s, j) in enumerate(sorted(x for x in scores if -x[0] >= -0.5)[:k])}
    assert got.keys() == want.keys()
    assert all(abs(got[x][1] - want[x][1]) < 1e-12 for x in want)
    by = lambda rows: {(i, round(s, 9)): sorted(d for (i2, _), (d, s2) in rows.items() if i2 == i and abs(s2 - s) < 1e-9) for (i, _), (d, s) in rows.items()} if k < 4 else None
    assert by(got) == by(want)


def test_all_paths_are_written_out_where_no_bound_is_given(spark):
    # A chain of 70 nodes that ends in seven forks of two, one after the other: 128 paths.
    edges = [(i, i + 1) for i in range(70)] + [(f + i, f + 3 if i else f + j) for f in range(70, 91, 3) for i in range(3) for j in (1, 2)]
    found = graph.paths(spark.createDataFrame(edges, "parent long, child long"), most_paths=None, most_nodes=None).collect()
    assert len({tuple(r.nodes) for r in found}) == len(found) == 128 and {len(r.nodes) for r in found} == {85}
    with pytest.raises(RuntimeError):
        graph.paths(spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "parent long, child long"), most_paths=None, most_nodes=None)


def test_maximal_paths_are_whole_and_meet_only_where_one_may_hold_the_other(spark, tmp_path, monkeypatch):
    # A chain of 85 vectors, each near the next one only.
    chain = np.eye(86)[:85] + np.eye(86)[1:]
    d = written(tmp_path, embeddings={"vec_id": list(range(0, 255, 3)), "embedding": pa.array(chain.tolist(), pa.list_(pa.float32())), "label": pa.array([0] * 85, pa.int32())})
    got, want = both(spark, queries.QUERIES["O52_maximal_paths"], queries.ORACLES["O52_maximal_paths"], d)
    assert got == want and [nodes.count(">") for nodes, _ in got] == [84]
    met = []
    monkeypatch.setattr(trajectory, "materialize", lambda rows, label="table": met.append((label, rows.count())) or materialize(rows, label))
    forks = [("s", *x, "t") for x in itertools.product(*([f"{i}a", f"{i}b"] for i in range(6)))]
    parts = [(*forks[0][:4],), (*forks[5][2:],), (*forks[9][1:5],), ("s", "0a", "2a"), ("x", "y")]
    found = {tuple(r.nodes) for r in trajectory.maximal_paths(spark.createDataFrame([(list(p),) for p in forks + parts], "nodes array<string>"), 2).collect()}
    assert found == {*forks, *parts[3:]} and met == [("probe", 4)]  # not the 64 that share "s"


def test_a_closure_makes_its_edges_once(spark, tmp_path, monkeypatch):
    at = [datetime(2024, 1, 1) + timedelta(hours=i) for i in range(60)]
    d = written(tmp_path, events={"event_id": list(range(60)), "ts": at, "user_id": [i * i % 7 for i in range(60)]})
    made = []
    monkeypatch.setattr(queries, "materialize", lambda rows, label="table": made.append(label) or materialize(rows, label))
    got, want = both(spark, queries.QUERIES["O60_O61g_raw_closure"], queries.ORACLES["O60_O61g_raw_closure"], d)
    assert got == want and len(got) == 4 and made == ["edges", "nodes"]


def test_lines_of_many_paths_meet_by_their_blocks():
    draw = random.Random(4)
    told = [([a, a + draw.choice([1, 2]), a + 3, a + 3 + draw.choice([1, 2])], a, a + 5, 0.5) for a in (draw.randrange(20_000) for _ in range(20_000))]
    begun = time.monotonic()
    assert trajectory.bootstrap(told[:200], 2) and trajectory.bootstrap(told, 2)
    assert time.monotonic() - begun < 20


def test_only_shared_evidence_makes_edges(spark, monkeypatch):
    seen = []
    real = convergence.connected_components
    monkeypatch.setattr(convergence, "connected_components", lambda edges: seen.append(edges.count()) or real(edges))
    told = [(str(i), "d", "c", "support", [f"p{i}", f"q{i}"] if i > 3 else ["p0", f"q{i}"]) for i in range(50)]
    s = spark.createDataFrame(told, "signal_id string, decision_key string, candidate_id string, polarity string, raw_evidence_ids array<string>")
    assert convergence.evidence_components(s).agg(F.count_distinct("component")).first()[0] == 47
    assert seen == [3]
