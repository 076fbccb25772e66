"""Lines over time: views, edges added in bulk, attachment of many blocks, against plain loops."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from annalist.operators import graph, linegraph, nearline, surface, trajectory
from annalist.scratch import materialize


def line_edges(spark, rows):
    return spark.createDataFrame(rows, "line_id string, parent string, child string")


def all_paths(nodes, edges):
    below = defaultdict(list)
    for p, c in edges:
        below[p].append(c)
    stack = [(n,) for n in nodes if n not in {c for _, c in edges}]
    while stack:
        path = stack.pop()
        stack += [(*path, c) for c in below[path[-1]]]
        if not below[path[-1]]:
            yield path


def test_line_paths_equal_a_plain_walk_and_skip_whole_lines(spark):
    r = random.Random(71)
    nodes, edges = {}, {}
    for line in "abcdefgh":
        nodes[line] = [f"{line}{i}" for i in range(r.randint(1, 12))]
        edges[line] = [(x, y) for x, y in itertools.combinations(nodes[line], 2) if r.random() < 0.3]
    nodes["long"], edges["long"] = [f"l{i:02}" for i in range(20)], [(f"l{i:02}", f"l{i + 1:02}") for i in range(19)]
    nodes["wide"], edges["wide"] = [f"w{i:02}" for i in range(40)], [(f"w{i:02}", f"w{j:02}") for i in range(40) for j in (i + 1, i + 2) if j < 40]
    nodes["ring"], edges["ring"] = ["r1", "r2"], [("r1", "r2"), ("r2", "r1")]
    seen = spark.createDataFrame([(k, n) for k, v in nodes.items() for n in v], "line_id string, node_id string")
    paths, skipped = linegraph.line_paths(seen, line_edges(spark, [(k, *e) for k, v in edges.items() for e in v]), most_paths=30, most_nodes=10)
    got, why = {(x.line_id, tuple(x.nodes)) for x in paths.collect()}, {x.line_id: x.reason for x in skipped.collect()}
    want, gone = set(), set()
    for line in nodes:
        found = list(all_paths(nodes[line], edges[line])) if line not in ("wide", "ring") else []
        if not found or len(found) > 30 or max(map(len, found)) > 10:
            gone.add(line)
        else:
            want |= {(line, p) for p in found}
    assert got == want and set(why) == gone >= {"long", "wide", "ring"} and len(want) > 20
    assert why["long"] == "a path has over 10 nodes"
    many, _ = linegraph.line_paths(seen.filter("line_id = 'wide'"), line_edges(spark, [("wide", *e) for e in edges["wide"][:16]]), most_paths=100, most_nodes=64)
    assert many.count() == len(list(all_paths(nodes["wide"], edges["wide"][:16])))


def test_views_need_states_and_rest_on_every_parent(spark):
    edges = line_edges(spark, [("l", "t", "a"), ("l", "t", "b"), ("l", "a", "r"), ("l", "b", "r"), ("m", "x", "y"), ("m", "y", "z"), ("n", "p", "q")])
    names = [("l", n) for n in "tabr"] + [("m", n) for n in "xyz"] + [("n", n) for n in "pq"]
    nodes = spark.createDataFrame(names, "line_id string, node_id string")
    states = spark.createDataFrame([(n, None if n == "y" else f"{n}@1", [float(i), float(i * i)]) for i, (_, n) in enumerate(names)], "node_id string, state_id string, vector array<double>")
    bridge = spark.createDataFrame([(n, n.upper()) for _, n in names], "node_id string, evidence_id string")
    views, evidence, skipped = surface.line_views(nodes, edges, states, bridge)
    rows = {x.view_id: x for x in views.collect()}
    assert sorted(tuple(x.node_ids) for x in rows.values()) == [("t", "a", "r"), ("t", "b", "r")] and skipped.count() == 0
    held = defaultdict(set)
    for x in evidence.collect():
        held[x.view_id].add(x.evidence_id)
    assert set(held) == set(rows) and all(v == set("TABR") for v in held.values())
    assert all(abs(np.linalg.norm(x.signature) - 1) < 1e-12 for x in rows.values())
    none, _, _ = surface.line_views(nodes.limit(0), edges, states, bridge)
    assert none.count() == 0 and surface.surfaces(none).count() == 0


def test_surfaces_of_separate_components_and_their_bounds(spark):
    r = np.random.default_rng(72)
    rows = []
    for shape in range(5):
        base = r.normal(size=12)
        rows += [(f"v{shape}{i}", f"line{i}", (lambda v: (v / np.linalg.norm(v)).tolist())(base + 0.01 * r.normal(size=12))) for i in range(4)]
    rows += [("same", "line0", rows[0][2])]
    views = spark.createDataFrame(rows, "view_id string, line_id string, signature array<double>")
    found = [tuple(x.view_ids) for x in surface.surfaces(views, 0.98).collect()]
    near = {(a[0], b[0]) for a in rows for b in rows if a[1] != b[1] and np.dot(a[2], b[2]) >= 0.98}
    assert sorted(found) == sorted({tuple(sorted(c)) for s in range(5) for c in [tuple(f"v{s}{i}" for i in range(4))]} | {("same", "v01", "v02", "v03")})
    assert all((a, b) in near for c in found for a, b in itertools.permutations(c, 2))
    with pytest.raises(RuntimeError, match="over 4 views"):
        surface.surfaces(views, 0.98, most_views=4)
    with pytest.raises(Exception, match="over 1 surfaces"):
        surface.surfaces(views, 0.98, most_found=1).collect()


def test_nodes_beyond_the_bound_raise_unless_it_is_asked_for(spark):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(30)], "parent string, child string")
    start = spark.createDataFrame([("n00",)], "start string")
    assert graph.reachable(chain, start, most_hops=30).count() == 31
    for bound in (16, 29):
        with pytest.raises(RuntimeError, match=f"more than {bound} hops"):
            graph.reachable(chain, start, most_hops=bound)
        assert graph.reachable(chain, start, most_hops=bound, bounded=True).count() == bound + 1
    ring = spark.createDataFrame([("a", "b"), ("b", "a")], "parent string, child string")
    assert graph.reachable(ring, spark.createDataFrame([("a",)], "start string"), most_hops=1).count() == 2


# Edges in bulk ------------------------------------------------------------------------------------


def judged_one_by_one(edges, wanted):
    """Verdicts of (line, parent, child, known_at, ordinal) edges, by a search at every boundary."""
    held, out = [list(e) for e in edges], {}

    def reaches(line, a, b, at):
        seen, stack = {a}, [a]
        while stack:
            x = stack.pop()
            for li, p, c, k, r in held:
                if li == line and p == x and k <= at and (r is None or r > at) and c not in seen:
                    seen.add(c)
                    stack.append(c)
        return b in seen

    for line, p, c, k, n in sorted(wanted, key=lambda w: (w[0], w[4])):
        bounds = {k} | {t for e in held if e[0] == line for t in e[3:] if t is not None and t >= k}
        if p == c:
            out[line, n] = "SELF"
        elif reaches(line, p, c, k):
            out[line, n] = "SHORTCUT"
        elif any(reaches(line, c, p, t) for t in bounds):
            out[line, n] = "CYCLE"
        else:
            out[line, n] = "ADDED"
            held.append([line, p, c, k, None])
    return out


EDGE = "line_id string, parent string, child string, known_at int, retired_at int"


def test_a_batch_of_edges_is_judged_as_one_by_one(spark):
    r = random.Random(60)
    edges, wanted = [], []
    for line in range(25):
        names = [f"{line}-{i}" for i in range(r.randint(2, 7))]
        for a, b in itertools.combinations(names, 2):
            if r.random() < 0.35:
                k = r.randint(0, 20)
                edges.append((f"l{line}", a, b, k, r.choice([None, k, k + r.randint(1, 15)])))
        wanted += [(f"l{line}", r.choice(names), r.choice(names), r.randint(0, 30), n) for n in range(1, r.randint(2, 9))]
    want = judged_one_by_one(edges, wanted)
    found = linegraph.judge_edges(spark.createDataFrame(edges, EDGE), spark.createDataFrame(wanted, "line_id string, parent string, child string, known_at int, ordinal int")).collect()
    assert {(x.line_id, x.ordinal): x.verdict for x in found} == want and len(found) == len(wanted)
    assert set(want.values()) == {"SELF", "SHORTCUT", "CYCLE", "ADDED"}


def test_cycles_at_a_later_boundary_only_raise_and_shortcuts_add_nothing(spark):
    edges = spark.createDataFrame([("l", "a", "b", 0, None), ("l", "b", "c", 10, 20), ("l", "c", "d", 15, None)], EDGE)
    ask = lambda *rows: spark.createDataFrame(list(rows), "line_id string, parent string, child string, known_at int, ordinal int")
    verdicts = lambda *rows: [x.verdict for x in linegraph.judge_edges(edges, ask(*rows)).orderBy("ordinal").collect()]
    assert verdicts(("l", "d", "a", 5, 1)) == ["CYCLE"]  # from 15 to 20 all three edges hold
    assert verdicts(("l", "d", "a", 20, 1)) == ["ADDED"]
    assert verdicts(("l", "a", "d", 16, 1), ("l", "a", "d", 25, 2), ("l", "a", "d", 30, 3), ("l", "d", "b", 40, 4)) == ["SHORTCUT", "ADDED", "SHORTCUT", "ADDED"]
    assert verdicts(("l", "a", "d", 25, 1), ("l", "d", "a", 26, 2), ("other", "d", "a", 26, 1)) in (["ADDED", "ADDED", "CYCLE"], ["ADDED", "CYCLE", "ADDED"])
    with pytest.raises(RuntimeError, match="cycle"):
        linegraph.add_edges(edges, ask(("l", "d", "a", 5, 1)))
    with pytest.raises(RuntimeError, match="itself"):
        linegraph.add_edges(edges, ask(("l", "d", "d", 5, 1)))
    after = linegraph.add_edges(edges, ask(("l", "a", "d", 16, 1), ("l", "a", "e", 16, 2)), "f1")
    assert [tuple(x)[:4] for x in after.filter("derivation_fingerprint = 'f1'").collect()] == [("l", "a", "e", 16)] and after.count() == 4
    assert linegraph.add_edges(edges, ask().limit(0)).count() == 3
    long = spark.createDataFrame([("l", f"n{i:03}", f"n{i + 1:03}", i, None) for i in range(40)], EDGE)
    assert [x.verdict for x in linegraph.judge_edges(long, ask(("l", "n040", "n000", 0, 1))).collect()] == ["CYCLE"]


@pytest.mark.parametrize("hops", [1, 2])
def test_spans_go_on_from_a_job_s_last_hop_and_leave_out_a_line_s_last_edge(spark, monkeypatch, hops):
    r = random.Random(61)
    edges, wanted = [], []
    for line in range(12):
        names = [f"{line}-{i}" for i in range(6)]
        edges += [(f"l{line}", a, b, k, r.choice([None, k + r.randint(0, 15)])) for a, b in itertools.combinations(names, 2) if r.random() < 0.5 for k in [r.randint(0, 20)]]
        wanted += [(f"l{line}", r.choice(names), r.choice(names), r.randint(0, 30), n) for n in range(1, r.randint(2, 6))]
    walked, real = [], linegraph.reach_spans
    monkeypatch.setattr(linegraph, "HOPS_A_JOB", hops)
    monkeypatch.setattr(linegraph, "reach_spans", lambda rows, starts: walked.append(sorted(map(tuple, rows.select("line_id", "last").filter("last > 0").collect()))) or real(rows, starts))
    found = linegraph.judge_edges(spark.createDataFrame(edges, EDGE), spark.createDataFrame(wanted, "line_id string, parent string, child string, known_at int, ordinal int")).collect()
    assert {(x.line_id, x.ordinal): x.verdict for x in found} == judged_one_by_one(edges, wanted)
    apart = [(line, n) for line, a, b, _, n in wanted if a != b]
    assert walked[0] == sorted((line, n) for line, n in apart if n < max(m for other, m in apart if other == line))


# Nearline growth ----------------------------------------------------------------------------------


def grown_one_by_one(nodes, edges, wanted, least, most=1, rejoin=False):
    """{line: (joined, current edges)} of blocks that join one after the other."""
    out = {}
    for line in {n[0] for n in nodes}:
        held = {n: (v, s, e) for li, n, v, s, e in nodes if li == line}
        links, joined = {(p, c) for li, p, c in edges if li == line}, []
        for _, n, v, s, e, _ in sorted((w for w in wanted if w[0] == line), key=lambda w: w[5]):
            cos = lambda a, b: float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))
            near = [(m, cos(v, u), a, b) for m, (u, a, b) in held.items() if cos(v, u) >= least]
            before = [x for x in near if x[2] < s and x[3] <= s]
            after = [x for x in near if s < x[2] and e <= x[2]]
            tips = [x for x in before if not any(p == x[0] for p, _ in links)]
            ps = [x[0] for x in sorted(tips or before, key=lambda x: (-x[3], -x[1], x[0]))[:most]]
            cs = [x[0] for x in sorted(after, key=lambda x: (x[2], -x[1], x[0]))[:most]]
            if not ps and not cs:
                continue
            joined.append(n)
            held[n] = (v, s, e)
            links -= {(p, c) for p in ps for c in cs}
            for p, c in [(p, n) for p in ps] + [(n, c) for c in cs]:
                if not rejoin and any(x == c and y != p for y, x in links):
                    continue
                seen, stack = set(), [p]
                while stack:
                    x = stack.pop()
                    for y, z in links:
                        if y == x and z not in seen:
                            seen.add(z)
                            stack.append(z)
                if c not in seen:
                    links.add((p, c))
        out[line] = (joined, links)
    return out


def random_line(r, line, n):
    nodes, edges = [], []
    for i in range(n):
        s = r.randint(0, 400)
        nodes.append((line, f"{line}{i:02}", [r.gauss(0, 1), r.gauss(0, 1), 1.0], s, s + r.randint(0, 5)))
    inside = {x[1]: x for x in nodes}
    for a, b in itertools.combinations(sorted(inside), 2):
        a, b = sorted((a, b), key=lambda x: inside[x][3])
        if inside[a][4] <= inside[b][3] and inside[a][3] < inside[b][3] and r.random() < 0.3 and not any(c == b for _, _, c in edges):
            edges.append((line, a, b))
    return nodes, edges


def at_second(rows, *places):
    from datetime import datetime, timedelta

    return [tuple(datetime(2024, 1, 1) + timedelta(seconds=x) if i in places else x for i, x in enumerate(row)) for row in rows]


NODE = "line_id string, node_id string, vector array<double>, occurred_start timestamp, occurred_end timestamp"


@pytest.mark.parametrize("most, rejoin", [(1, False), (2, True)])
def test_many_blocks_join_a_line_in_order(spark, most, rejoin):
    r = random.Random(59)
    nodes, edges, wanted = [], [], []
    for i in range(12):
        n, e = random_line(r, f"l{i}", r.randint(1, 8))
        nodes, edges = nodes + n, edges + e
        new, _ = random_line(r, f"l{i}", r.randint(1, 8))
        wanted += [(line, f"new-{name}", v, s, t, k) for k, (line, name, v, s, t) in enumerate(new)]
    want = grown_one_by_one(nodes, edges, wanted, 0.3, most, rejoin)
    got = nearline.fold(spark.createDataFrame(at_second(nodes, 3, 4), NODE), line_edges(spark, edges), spark.createDataFrame(at_second(wanted, 3, 4), NODE + ", ordinal long"), 0.3, most, rejoin).collect()
    for line, (joined, links) in want.items():
        here = [x for x in got if x.line_id == line]
        now = {(p, c) for li, p, c in edges if li == line}
        for x in here:
            now = now | {(x.parent, x.child)} if x.change == "ADDED" else now - {(x.parent, x.child)}
        assert [x.child for x in here if x.change == "JOINED"] == joined and now == links
    assert any(x.change == "RETIRED" for x in got)


def test_arriving_states_revise_detach_and_join_in_one_call(spark):
    from pyspark.sql import functions as F

    ts = lambda n: f"timestamp'2024-01-01' + interval {n} hours"
    member = lambda line, b, v, n: f"('{line}', '{line}/{b}', '{b}', '{b}@1', array({v}), {ts(n)}, {ts(n)}, {ts(n)}, cast(null as timestamp))"
    held = [("l", "a", "1D, 0D", 0), ("l", "b", "1D, 0D", 10), ("l", "c", "1D, 0D", 20), ("m", "x", "0D, 1D", 0), ("m", "y", "0D, 1D", 10)]
    members = spark.sql(f"select * from values {', '.join(member(*h) for h in held)} t({', '.join(nearline.MEMBERS)})")
    edges = spark.sql(f"select *, cast(null as timestamp) retired_at from values ('l', 'l/a', 'l/b', {ts(10)}), ('l', 'l/b', 'l/c', {ts(20)}), ('m', 'm/x', 'm/y', {ts(10)}) t(line_id, parent, child, known_at)")
    new = [("b", "b@2", "0D, 1D", 10, 1), ("y", "y@2", "0D, 2D", 11, 2), ("p", "p@1", "1D, 0D", 5, 3), ("q", "q@1", "1D, 0D", 7, 4), ("z", "z@1", "-1D, 0D", 7, 5), ("a", "a@1", "1D, 0D", 0, 6)]
    arriving = spark.sql("select * from values " + ", ".join(f"('{b}', '{st}', array({v}), {ts(n)}, {ts(n)}, {o}L)" for b, st, v, n, o in new) + " t(block_id, state_id, vector, occurred_start, occurred_end, ordinal)")
    at = F.expr(ts(100))
    m, e, changes = nearline.observe(members, edges, arriving, at)
    assert {(x.change, x.child) for x in changes.filter("change in ('KEPT', 'REVALIDATED', 'DETACHED')").collect()} == {("DETACHED", "l/b"), ("REVALIDATED", "m/y"), ("KEPT", "l/a")}
    now = lambda rows, *c: sorted(tuple(x) for x in linegraph.as_of(rows, at, list(c)).collect())
    assert sorted((x.line_id, x.block_id, x.state_id) for x in linegraph.as_of(m, at, ["line_id", "block_id", "state_id"]).collect()) == [
        ("l", "a", "a@1"), ("l", "c", "c@1"), ("l", "p", "p@1"), ("l", "q", "q@1"), ("m", "b", "b@2"), ("m", "x", "x@1"), ("m", "y", "y@2")
    ]
    name = {x.node_id: x.block_id for x in m.collect()}
    links = {(li, name[p], name[c]) for li, p, c in now(e, "line_id", "parent", "child")}
    assert links == {("l", "a", "p"), ("l", "p", "q"), ("l", "q", "c"), ("m", "x", "b"), ("m", "b", "y")}
    before = F.expr(ts(99))
    assert [tuple(x)[1:] for x in linegraph.as_of(e, before, ["line_id", "parent", "child"]).orderBy("parent").collect()] == [("l/a", "l/b"), ("l/b", "l/c"), ("m/x", "m/y")]
    again_m, again_e, told = nearline.observe(m, e, arriving, F.expr(ts(101)))
    assert {x.change for x in told.collect()} == {"KEPT"} and again_m.count() == m.count() and again_e.count() == e.count()
    assert nearline.observe(m, e, arriving.limit(0), at)[2].count() == 0


def shuffled(spark):
    """Bytes that this session has shuffled so far."""
    return spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_views_that_are_alike_are_found_without_copies_of_signatures(spark, monkeypatch):
    draw = np.random.default_rng(1)
    walks = draw.normal(size=(300, 5, 24))
    walks[150:250] = walks[:100] + draw.normal(size=(100, 5, 24)) * draw.uniform(0, 0.5, size=(100, 1, 1))  # about the least cosine, on both sides
    shapes = [(lambda f: (f - f[0]).ravel())(surface.resample(w)) for w in walks] + [draw.normal(size=10) for _ in range(4)]  # and some of another kind
    rows = [(f"v{i}", f"line{i % 140}", (x / np.linalg.norm(x)).tolist()) for i, x in enumerate([*shapes, shapes[-1]])]
    views = materialize(spark.createDataFrame(rows, "view_id string, line_id string, signature array<double>").repartition(2), "views")
    want = {(min(a[0], b[0]), max(a[0], b[0])): np.dot(a[2], b[2]) for a, b in itertools.combinations(rows, 2) if a[1] != b[1] and len(a[2]) == len(b[2]) and np.dot(a[2], b[2]) >= 0.9}
    monkeypatch.setattr(surface, "BLOCK_ROWS", 10)  # as many blocks as a large table has
    before = shuffled(spark)
    found = {(x.a, x.b): x.similarity for x in surface.alike(views, 0.9).collect()}
    assert len(want) > 30 and found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-12 for p in want)
    assert shuffled(spark) - before < 4 * 8 * sum(len(x[2]) for x in rows)


def test_one_walk_counts_paths_and_writes_them_out(spark, monkeypatch):
    made = []
    monkeypatch.setattr(linegraph, "materialize", lambda rows, label="table": made.append(label) or materialize(rows, label))
    links = [("t", "a", "b"), ("t", "a", "c"), ("t", "b", "d"), ("t", "c", "d"), ("t", "d", "e")]
    links += [("hub", f"r{i}", "h") for i in range(9)] + [("hub", "h", "z")] + [("fork", f"f{i}", f"f{j}") for i in range(6) for j in range(i + 1, 6)]
    names = sorted({(line, n) for line, *ends in links for n in ends}) + [("lone", "x")]
    paths, skipped = linegraph.line_paths(spark.createDataFrame(names, "line_id string, node_id string"), line_edges(spark, links), most_paths=4, most_nodes=6)
    assert sorted((x.line_id, *x.nodes) for x in paths.collect()) == [("lone", "x"), ("t", "a", "b", "d", "e"), ("t", "a", "c", "d", "e")]
    assert sorted(map(tuple, skipped.collect())) == [("fork", "over 4 paths"), ("hub", "over 4 paths")]
    assert made.count("walk") == 1


def test_views_move_their_paths_and_not_signatures(spark, monkeypatch):
    draw = np.random.default_rng(2)
    walks = [draw.normal(size=(n, 40)) for n in (3, 4, 3, 20, 3, 4, 3, 20) for _ in range(4)]
    walks += [2 * w + 1 for w in walks] + [w[::-1] + 0.05 * draw.normal(size=w.shape) for w in walks] + [np.ones((3, 40)), np.array([[0.0] * 40, [1.0] * 40, [1.0] * 40])]
    names = [(f"l{i}", f"l{i}/{k:02}", w[k].tolist()) for i, w in enumerate(walks) for k in range(len(w))]
    nodes = materialize(spark.createDataFrame(names, "line_id string, node_id string, vector array<double>").withColumn("state_id", F.col("node_id")), "nodes")
    edges = spark.createDataFrame([(a[0], a[1], b[1]) for a, b in itertools.pairwise(names) if a[0] == b[0]], "line_id string, parent string, child string")
    views, _, _ = surface.line_views(nodes.select("line_id", "node_id"), edges, nodes.drop("line_id"), nodes.select("node_id", F.col("node_id").alias("evidence_id")))
    found = {x.line_id: x.signature for x in views.collect()}
    assert set(found) == {f"l{i}" for i in range(len(walks) - 2)} | {f"l{len(walks) - 1}"}
    for i, w in enumerate(walks):
        if f"l{i}" in found:
            along = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(w, axis=0), axis=1))])
            plain = np.stack([np.interp(np.linspace(0, along[-1], 17), along, w[:, d]) for d in range(40)], 1)
            flat = (plain - plain[0]).ravel()
            assert np.abs(found[f"l{i}"] - flat / np.linalg.norm(flat)).max() < 1e-12
    ids = {x.view_id: x.line_id for x in views.select("view_id", "line_id").collect()}
    pairs = {tuple(sorted((ids[x.a], ids[x.b]))): x.similarity for x in surface.alike(views, 0.9).collect()}
    want = {tuple(sorted((a, b))): np.dot(found[a], found[b]) for a, b in itertools.combinations(found, 2) if np.dot(found[a], found[b]) >= 0.9}
    assert len(want) > 30 and pairs.keys() == want.keys() and all(abs(pairs[p] - want[p]) < 1e-12 for p in want)
    short = [w for w in walks if len(w) <= 4]
    monkeypatch.setattr(surface, "BLOCK_ROWS", 10)
    some = materialize(views.filter(F.size("shape") <= 4), "views")
    before = shuffled(spark)
    assert surface.alike(some, 0.9).count() > 20
    assert shuffled(spark) - before < 8 * 17 * 40 * len(short)  # less than each signature once


def test_long_lines_are_crossed_without_a_job_for_each_few_hops(spark, monkeypatch):
    draw = random.Random(5)
    links = [(f"{u}/{i}", f"{u}/{i + 1}") for u in range(3) for i in range(300)] + [(f"0/{i}", f"1/{i + 5}") for i in (40, 200)] + [("2/7", "1/90"), ("1/30", "r"), ("s", "0/3")]
    names = sorted({n for e in links for n in e})
    gone = set(draw.sample(names, 2)) | {"1/250"}
    hidden = set(gone)
    for _ in links:
        if not (more := {c for p, c in links if p in hidden} - hidden):
            break
        hidden |= more
    edges = spark.createDataFrame(links, "parent string, child string")
    made = []
    monkeypatch.setattr(graph, "materialize", lambda rows, label="table": made.append(label) or materialize(rows, label))
    nodes = spark.createDataFrame([(n,) for n in names], "node_id string")
    seen = linegraph.visible_nodes(nodes.filter(~nodes.node_id.isin(*gone)), edges)
    assert {x.node_id for x in seen.collect()} == set(names) - hidden
    starts = ["0/300", "1/300", "1/120", "r", "alone"]
    found = defaultdict(set)
    for x in linegraph.raw_closure(spark.createDataFrame([(n,) for n in starts], "node_id string"), edges, nodes.withColumn("evidence_id", nodes.node_id)).collect():
        found[x.start].add(x.evidence_id)
    for start in starts[:4]:
        want, front = {start}, {start}
        while front:
            front = {p for p, c in links if c in front} - want
            want |= front
        assert found[start] == want
    assert "alone" not in found and len(made) < 60  # 38 jobs for 300 hops, three times, before
    for more in ([("0/9", "0/2")], [("x", "y"), ("y", "x")], [("2/300", "2/7")], [("z", "z")]):
        with pytest.raises(RuntimeError, match="cycle"):
            linegraph.visible_nodes(nodes, edges.union(spark.createDataFrame(more, edges.schema)))


def test_only_the_best_node_of_a_line_leaves_a_block(spark, monkeypatch):
    draw = np.random.default_rng(2)
    blocks = [(i, draw.integers(1, 4, 3).astype(float).tolist() if i else [0.0] * 3) for i in range(400)] + [(400, [1.0]), (401, None)]
    nodes = [(i % 3, 1000 - i, draw.integers(1, 4, 3).astype(float).tolist()) for i in range(400)] + [(3, 7, [2.0]), (3, 8, [])]
    new = spark.createDataFrame(blocks, "block_id int, vector array<double>").repartition(2)
    held = spark.createDataFrame(nodes, "line_id int, node_id int, vector array<double>").repartition(2)
    cos = lambda u, v: float(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)))
    want = {}
    for b, u in blocks[1:-1]:
        for line in range(4):
            near = [(cos(u, v)) for g, _, v in nodes if g == line and len(v) == len(u)]
            if near and max(near) >= 0.8:
                want[b, line] = max(near)
    monkeypatch.setattr(trajectory, "similar", lambda *a: pytest.fail("a row for each pair that is alike"))
    found = trajectory.line_matches(new, held, 0.8).collect()
    assert {(x.block_id, x.line_id) for x in found} == set(want) and all(abs(x.score - want[x.block_id, x.line_id]) < 1e-12 for x in found)
    vector = {n: v for _, n, v in nodes}
    assert all(abs(cos(dict(blocks)[x.block_id], vector[x.node_id]) - x.score) < 1e-12 for x in found)
