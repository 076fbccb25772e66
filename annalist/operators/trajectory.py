"""Directed trajectories: oriented neighbour edges, paths, and the lines they become."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import identity
from annalist.functions.vector import cosine
from annalist.operators.graph import HOPS_A_JOB, connected_components
from annalist.operators.similarity import BLOCK_ROWS, KNN_SCORES, vectors_of
from annalist.scratch import materialize

K, LEAST_SIMILARITY, LEAST_SUPPORT, MOST_PATHS, MOST_NODES = 4, 0.55, 3, 256, 64
SHARED_BLOCKS, SEED_BLOCKS = 2, 3


def precedes(left_start: Column, left_end: Column, right_start: Column, right_end: Column) -> Column:
    """Strictly before: an earlier start, and an end no later than the other's start."""
    return (left_start < right_start) & (left_end <= right_start)


def orient(edges: DataFrame, spans: DataFrame) -> DataFrame:
    """(parent, child, score) of undirected (a, b, score) edges; overlapping or simultaneous ends drop out."""
    a = spans.select(F.col("id").alias("a"), F.col("occurred_start").alias("a_start"), F.col("occurred_end").alias("a_end"))
    b = spans.select(F.col("id").alias("b"), F.col("occurred_start").alias("b_start"), F.col("occurred_end").alias("b_end"))
    rows = edges.join(a, "a").join(b, "b")
    forth, back = precedes(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")), precedes(F.col("b_start"), F.col("b_end"), F.col("a_start"), F.col("a_end"))
    return rows.filter(forth | back).select(F.when(forth, F.col("a")).otherwise(F.col("b")).alias("parent"), F.when(forth, F.col("b")).otherwise(F.col("a")).alias("child"), "score")


def enumerate_paths(edges: DataFrame, spans: DataFrame, most_paths: int = MOST_PATHS, most_nodes: int = MOST_NODES, least_support: int = LEAST_SUPPORT) -> list[list]:
    """Depth-first paths from roots, in (start, id) order; a path of ``most_nodes`` is cut and resumed
    with an overlap. Fails rather than truncate: beyond ``most_paths`` paths.

    The order in which long paths are resumed is part of the meaning, so this walks one bounded graph
    on the driver: ``edges`` of one discovery, refused beyond most_paths * most_nodes * 64 rows.
    """
    bound = most_paths * most_nodes * 64
    rows = edges.select("parent", "child").limit(bound + 1).collect()
    if len(rows) > bound:
        raise RuntimeError(f"over {bound} edges in one discovery")
    names = edges.select(F.col("parent").alias("id")).union(edges.select("child")).distinct()
    place = {r[0]: (r[1], r[0]) for r in spans.join(names, "id", "left_semi").select("id", "occurred_start").collect()}
    children, has_parent = defaultdict(list), set()
    for p, c in rows:
        children[p].append(c)
        has_parent.add(c)
    for p in children:
        children[p].sort(key=place.__getitem__)
    roots = sorted((p for p in children if p not in has_parent), key=place.__getitem__)
    overlap = min(max(1, least_support - 1), most_nodes - 1)
    out: list[list] = []
    stack = [[r] for r in reversed(roots)]
    while stack:
        if len(out) == most_paths:
            raise RuntimeError(f"over {most_paths} paths")
        path = stack.pop()
        below = children.get(path[-1], [])
        if not below:
            out.append(path)
        elif len(path) == most_nodes:
            out.append(path)
            stack.append(path[-overlap:])
        else:
            stack += [[*path, c] for c in reversed(below) if c not in path]
    return out or [[p] for p in sorted(place, key=place.__getitem__)]


def propose(edges: DataFrame, most_paths: int = MOST_PATHS, most_nodes: int = MOST_NODES, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """(component, nodes): the paths from roots to leaves, of each connected component of a graph whose edges run forward in time.

    A path of ``most_nodes`` is cut and goes on from its last nodes, ``least_support`` - 1 of them, so that neighbouring parts
    overlap. Paths are counted first, as sums over parents, and a component with more than ``most_paths`` of them is refused
    before any is written out; parts that several paths share are there once. HOPS_A_JOB joins a job, nothing on the driver.
    """
    links = materialize(edges.select("parent", "child").na.drop().distinct(), "links")
    parts = materialize(connected_components(links, "parent", "child"), "components")
    along = materialize(links.join(parts.withColumnRenamed("node", "parent"), "parent").select("component", F.col("parent").alias("node"), "child"), "along")
    inner = along.select("component", "node", F.lit(True).alias("inner")).distinct()
    roots = parts.join(links.select(F.col("child").alias("node")), "node", "left_anti").select("component", "node")
    n_nodes = parts.count()

    def follow(rows: DataFrame, onward: Callable[[DataFrame], DataFrame], taken: Callable[[DataFrame], DataFrame]) -> DataFrame:
        found, hops = [], 0
        while not rows.isEmpty():
            steps = [rows]
            for _ in range(HOPS_A_JOB):
                steps.append(onward(steps[-1]))
            done = materialize(reduce(DataFrame.unionByName, [step.withColumn("hop", F.lit(i)) for i, step in enumerate(steps)]), "walk")
            found.append(taken(done.filter(F.col("hop") < HOPS_A_JOB).drop("hop")))
            rows, hops = done.filter(F.col("hop") == HOPS_A_JOB).drop("hop").distinct(), hops + HOPS_A_JOB
            if hops > 2 * n_nodes + HOPS_A_JOB:
                raise RuntimeError("the edges hold a cycle")
        return reduce(DataFrame.unionByName, found) if found else taken(rows)

    full = F.lit(most_paths + 1).cast("long")  # counts stop here
    leaf = lambda rows: rows.join(inner, ["component", "node"], "left_anti")
    add = lambda rows: rows.join(along, ["component", "node"]).groupBy("component", F.col("child").alias("node")).agg(F.least(F.sum("n"), full).alias("n"))
    counts = follow(roots.withColumn("n", F.lit(1).cast("long")), add, leaf).groupBy("component").agg(F.sum("n").alias("n"))
    many = counts.filter(F.col("n") > most_paths)
    if not many.isEmpty() or (n_nodes and roots.isEmpty()):
        raise RuntimeError(f"over {most_paths} paths in one component" if not many.isEmpty() else "the edges hold a cycle")

    overlap = min(max(1, least_support - 1), most_nodes - 1)
    long = F.size("nodes") == most_nodes

    def grow(rows: DataFrame) -> DataFrame:
        at_tip = rows.withColumn("node", F.element_at("nodes", -1)).join(along, ["component", "node"])
        return at_tip.select("component", F.concat(F.when(long, F.slice("nodes", -overlap, overlap)).otherwise(F.col("nodes")), F.array("child")).alias("nodes"))

    whole = lambda rows: rows.withColumn("node", F.element_at("nodes", -1)).join(inner, ["component", "node"], "left").filter(F.col("inner").isNull() | long).select("component", "nodes")
    return follow(roots.select("component", F.array("node").alias("nodes")), grow, whole).distinct()


def maximal_paths(paths: DataFrame, least_support: int = LEAST_SUPPORT) -> DataFrame:
    """Paths (nodes array) of enough nodes that are no contiguous part of a longer one; adds path_id.

    A longer path goes on before the first node or after the last one, so only paths whose first node follows another in some
    path, or whose last one leads to another, meet those that have their first node: of whole paths none does.
    """
    rows = paths.filter(F.size("nodes") >= least_support).distinct().withColumn("text", F.concat(F.lit("|"), F.array_join(F.transform("nodes", lambda n: n.cast("string")), "|"), F.lit("|")))
    part = lambda begin, name: rows.select(F.explode(F.slice("nodes", begin, F.size("nodes") - 1)).alias(name)).distinct()
    ends = rows.withColumn("first", F.element_at("nodes", 1)).withColumn("last", F.element_at("nodes", -1))
    probe = materialize(ends.join(part(2, "first"), "first", "left_semi").unionByName(ends.join(part(1, "last"), "last", "left_semi")).drop("last").distinct(), "probe")
    longer = rows.select(F.explode("nodes").alias("first"), F.col("text").alias("longer"), F.size("nodes").alias("n"))
    inner = probe.join(longer, "first").filter((F.col("n") > F.size("nodes")) & F.col("longer").contains(F.col("text"))).select("text").distinct()
    return rows.join(inner, "text", "left_anti").select(identity("traj_", F.col("text")).alias("path_id"), "nodes")


def described(paths: DataFrame, edges: DataFrame, spans: DataFrame) -> DataFrame:
    """Paths (path_id, nodes, and what else they have) with start, end and mean edge similarity, the order in which they become lines.

    A path of one node has similarity 0. ``edges``: parent, child, score; ``spans``: id, occurred_start, occurred_end.
    """
    steps = paths.select("path_id", F.explode(F.arrays_zip(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))).alias("parent"), F.slice("nodes", 2, F.size("nodes")).alias("child"))).alias("s")).select("path_id", "s.*")
    means = steps.join(edges.groupBy("parent", "child").agg(F.max("score").alias("score")), ["parent", "child"]).groupBy("path_id").agg(F.avg("score").alias("similarity"))
    times = paths.select("path_id", F.explode("nodes").alias("id")).join(spans.select("id", "occurred_start", "occurred_end"), "id").groupBy("path_id").agg(F.min("occurred_start").alias("start"), F.max("occurred_end").alias("end"))
    return paths.join(times, "path_id").join(means, "path_id", "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def identity_candidates(path_blocks: DataFrame, line_blocks: DataFrame, shared: int = SHARED_BLOCKS) -> DataFrame:
    """(path_id, line_id, n_shared): lines that share at least ``shared`` blocks with a path."""
    both = path_blocks.select("path_id", "block_id").distinct().join(line_blocks.select("line_id", "block_id").distinct(), "block_id")
    return both.groupBy("path_id", "line_id").agg(F.count("*").alias("n_shared")).filter(F.col("n_shared") >= shared)


def independent(blocks: Iterable, evidence: dict) -> int:
    """How many of the blocks rest on evidence apart from each other: the components of those that share any.

    A block that ``evidence`` does not name rests on itself.
    """
    if not evidence:
        return len(set(blocks))
    groups: list[set] = []
    for block in blocks:
        mine = set(evidence.get(block) or {("block", block)})
        apart = [g for g in groups if not g & mine]
        groups = [*apart, mine.union(*(g for g in groups if g & mine))]
    return len(groups)


def bootstrap(paths: list[tuple[list, object, object, float]], seed: int = SEED_BLOCKS, shared: int = SHARED_BLOCKS, evidence: dict | None = None) -> list[tuple[str, list]]:
    """Fold of (blocks, start, end, mean similarity) paths into lines: [(line id, blocks)].

    Longest first, then by start, end, similarity and blocks. A path that shares enough blocks with no line seeds one. Of the
    lines with which it shares enough, it extends the one whose shared blocks have the most independent support; where two
    have as much, it stays unresolved. Support counts by :func:`independent`, and is ``shared`` at least, ``seed`` for a seed.
    Sequential by meaning and bounded by the number of paths.
    """
    import hashlib

    lines: list[tuple[str, list]] = []
    holding: dict = defaultdict(set)  # block -> places of the lines that have it: a path meets no others
    held = evidence or {}
    for blocks, _, _, _ in sorted(paths, key=lambda p: (-len(p[0]), p[1], p[2], -p[3], list(map(str, p[0])))):
        met: dict = defaultdict(list)
        for b in blocks:
            for place in holding.get(b, ()):
                met[place].append(b)
        hits = [(place, both) for place, both in met.items() if len(both) >= shared]
        if hits:
            strong = [(n, place) for place, both in hits if (n := independent(both, held)) >= shared]
            most = max((n for n, _ in strong), default=0)
            best = [place for n, place in strong if n == most]
            if len(best) == 1:
                lines[best[0]][1].extend(b for b in dict.fromkeys(blocks) if best[0] not in holding[b])
                for b in blocks:
                    holding[b].add(best[0])
        elif len(blocks) >= seed and independent(blocks, held) >= seed:
            unique = list(dict.fromkeys(blocks))
            for b in unique:
                holding[b].add(len(lines))
            lines.append(("line_" + hashlib.sha256("|".join(map(str, unique)).encode()).hexdigest()[:24], unique))
    return lines


def bootstrap_lines(paths: DataFrame, evidence: DataFrame | None = None, seed: int = SEED_BLOCKS, shared: int = SHARED_BLOCKS) -> DataFrame:
    """(line_id, block_id) from paths (component, nodes, start, end, similarity), each component folded by itself.

    Paths of different components share no block, so none could change what another becomes. ``evidence`` (component,
    block_id, evidence_id) says what blocks rest on; without it each rests on itself. A component is one group: its paths,
    whose number :func:`propose` has bounded, and their evidence.
    """
    kind = paths.schema["nodes"].dataType.elementType.simpleString()
    micros = lambda name: F.coalesce(F.unix_micros(F.col(name).cast("timestamp")), F.lit(-(1 << 63)))  # noqa: E731  pandas has no times after 2262
    rows = paths.select("component", F.col("nodes").alias("blocks"), micros("start").alias("start"), micros("end").alias("end"), "similarity")

    def resting(told: pd.DataFrame, rests: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        for block, item in zip(rests["block_id"], rests["evidence_id"]):
            held.setdefault(block, set()).add(item)
        return fold(told, held)

    def fold(told: pd.DataFrame, held: dict) -> pd.DataFrame:
        lines = bootstrap([(list(r.blocks), r.start, r.end, r.similarity) for r in told.itertuples()], seed, shared, held)
        return pd.DataFrame([(line, b) for line, blocks in lines for b in blocks], columns=["line_id", "block_id"])

    schema = f"line_id string, block_id {kind}"
    if evidence is None:
        return rows.groupBy("component").applyInPandas(lambda told: fold(told, {}), schema)
    rests = evidence.select(F.col("component").alias("part"), "block_id", "evidence_id").distinct()
    return rows.groupBy("component").cogroup(rests.groupBy("part")).applyInPandas(resting, schema)


def similar(points: DataFrame, asked: DataFrame, least: float) -> DataFrame:
    """(src, dst, score): all points (id, vector) of at least this cosine with each asked id, itself left out.

    Both sides are dealt into blocks, one matrix product a pair of blocks; what is less like stays there.
    """
    rows = points.select("id", F.col("vector").cast("array<double>").alias("v")).filter("id is not null and size(v) > 0")
    few = rows.join(asked.select("id").distinct(), "id", "left_semi")
    n, m = rows.count(), few.count()
    parts = max(1, math.ceil(n / BLOCK_ROWS))
    times = max(1, math.ceil(m / BLOCK_ROWS))
    left = few.select(F.pmod(F.xxhash64("id"), F.lit(times)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), F.col("id").alias("src"), F.col("v").alias("u"))
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("ri"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("rj"), F.col("id").alias("dst"), "v")

    def block(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in set(x["u"].map(len)) & set(y["v"].map(len)):
            p, q = x[x["u"].map(len) == size], y[y["v"].map(len) == size]
            a, b = np.stack(p["u"].to_list()), np.stack(q["v"].to_list())
            scale = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            cosine = np.divide(a @ b.T, scale, out=np.zeros_like(scale), where=scale > 0)
            src, dst = p["src"].to_list(), q["dst"].to_list()
            out += [(src[r], dst[c], float(cosine[r, c])) for r, c in zip(*np.nonzero(cosine >= least)) if src[r] != dst[c]]
        return pd.DataFrame(out, columns=["src", "dst", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return left.groupBy("i", "j").cogroup(right.groupBy("ri", "rj")).applyInPandas(block, f"src {kind}, dst {kind}, score double")


def line_matches(new: DataFrame, nodes: DataFrame, least: float = LEAST_SIMILARITY) -> DataFrame:
    """(block_id, line_id, node_id, score): per new block and line the best visible node, ids breaking ties.

    Both sides are dealt into blocks, one matrix product a pair of blocks, some rows at a time; of a block and a line only
    the best node of a pair of blocks leaves it.
    """
    vector = lambda rows: rows.filter("size(vector) > 0").withColumn("vector", F.col("vector").cast("array<double>"))
    b, held = vector(new.select("block_id", "vector")).filter("block_id is not null"), vector(nodes.select("line_id", "node_id", "vector")).filter("node_id is not null")
    times, parts = (max(1, math.ceil(rows.count() / BLOCK_ROWS)) for rows in (b, held))
    left = b.select(F.pmod(F.xxhash64("block_id"), F.lit(times)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("j"), "block_id", F.col("vector").alias("u"))
    right = held.select(F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("i_"), F.pmod(F.xxhash64("node_id"), F.lit(parts)).cast("int").alias("j_"), "line_id", "node_id", F.col("vector").alias("v"))
    kinds = dict(b.dtypes) | dict(held.dtypes)

    def block(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by([("line_id", "ascending"), ("node_id", "ascending")])  # a line's nodes lie side by side, the least id first
        lines = y.column("line_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        (x_size, x_flat), (y_size, y_flat) = vectors_of(x.column("u")), vectors_of(y.column("v"))
        out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for size in np.intersect1d(x_size, y_size):
            rows, those = np.flatnonzero(x_size == size), np.flatnonzero(y_size == size)
            p, q = x_flat[np.repeat(x_size == size, x_size)].reshape(-1, size), y_flat[np.repeat(y_size == size, y_size)].reshape(-1, size)
            begins = np.flatnonzero(np.r_[True, np.diff(lines[those]) != 0])
            p_norm, q_norm = np.linalg.norm(p, axis=1), np.linalg.norm(q, axis=1)
            for start in range(0, len(p), KNN_SCORES // BLOCK_ROWS // 2):
                some = slice(start, start + KNN_SCORES // BLOCK_ROWS // 2)
                scale = p_norm[some][:, None] * q_norm[None, :]
                scores = np.divide(p[some] @ q.T, scale, out=np.zeros_like(scale), where=scale > 0)
                for begin, end in zip(begins, [*begins[1:], len(those)]):
                    at = begin + scores[:, begin:end].argmax(axis=1)  # the first of the best
                    score = scores[np.arange(len(at)), at]
                    kept = np.flatnonzero(score >= least)
                    out.append((rows[kept + start], those[at[kept]], score[kept]))
        i, j, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"block_id": x.column("block_id").take(pa.array(i)), "line_id": y.column("line_id").take(pa.array(j)), "node_id": y.column("node_id").take(pa.array(j)), "score": pa.array(score)})

    schema = ", ".join(f"{c} {kinds[c]}" for c in ("block_id", "line_id", "node_id")) + ", score double"
    scored = left.groupBy("i", "j").cogroup(right.groupBy("i_", "j_")).applyInArrow(block, schema)
    return scored.groupBy("block_id", "line_id").agg(F.max("score").alias("score"), F.min_by("node_id", F.struct(-F.col("score"), F.col("node_id"))).alias("node_id"))


def attachment_neighbours(matches: DataFrame, most: int = 1) -> DataFrame:
    """The predecessors and successors a block attaches to, ``most`` of each per line.

    ``matches``: block_id, line_id, node_id, score, is_frontier, node_start, node_end, block_start,
    block_end. Predecessors: frontier nodes first, then the latest end, score, id; successors: the
    earliest start, then score, id.
    """
    before = precedes(F.col("node_start"), F.col("node_end"), F.col("block_start"), F.col("block_end"))
    after = precedes(F.col("block_start"), F.col("block_end"), F.col("node_start"), F.col("node_end"))
    rows = matches.withColumn("role", F.when(before, "predecessor").when(after, "successor")).filter("role is not null")
    early = F.when(F.col("role") == "successor", F.unix_micros("node_start")).otherwise(-F.unix_micros("node_end"))
    order = Window.partitionBy("block_id", "line_id", "role").orderBy(F.when((F.col("role") == "predecessor") & F.col("is_frontier"), 0).otherwise(1), early, F.desc("score"), "node_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def observe(members: DataFrame, edges: DataFrame, arriving: DataFrame, least: float = LEAST_SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(decisions, to_route) for arriving block states against lines that exist already; nothing is rebuilt.

    ``members``: line_id, node_id, block_id, state_id, vector, occurred_start, occurred_end, the memberships that hold now with
    the state they were made from (null where it holds no more). ``edges``: line_id, parent, child, those that hold now.
    ``arriving``: block_id, state_id, vector, occurred_start, occurred_end, a row per block. Decisions (line_id, node_id,
    block_id, decision): KEPT for an unchanged state; REVALIDATED where every incident edge still runs forward in time and its
    ends are similar enough, or, without edges, the new state is similar to the old; else DETACHED, also where a vector is
    missing. ``to_route`` are the arriving blocks without a membership, or with one that was detached: they go through
    :func:`line_matches` and :func:`attachment_neighbours`, lines that kept them left out, and need a witness to attach.
    """
    new = arriving.select("block_id", F.col("state_id").alias("new_state"), F.col("vector").alias("new_vector"), F.col("occurred_start").alias("new_start"), F.col("occurred_end").alias("new_end"))
    touched = members.join(new, "block_id")
    ends = [("child", "parent"), ("parent", "child")]
    incident = edges.select("line_id", F.col(ends[0][0]).alias("node_id"), F.col(ends[0][1]).alias("other"), F.lit(True).alias("above")).unionAll(
        edges.select("line_id", F.col(ends[1][0]).alias("node_id"), F.col(ends[1][1]).alias("other"), F.lit(False).alias("above"))
    )
    o = members.select("line_id", F.col("node_id").alias("other"), F.col("vector").alias("o_vector"), F.col("occurred_start").alias("o_start"), F.col("occurred_end").alias("o_end"))
    # Only the edges of touched nodes meet their other ends.
    near = incident.join(touched.select("line_id", "node_id", "new_vector", "new_start", "new_end"), ["line_id", "node_id"]).join(o, ["line_id", "other"], "left")
    ordered = F.when(F.col("above"), precedes(F.col("o_start"), F.col("o_end"), F.col("new_start"), F.col("new_end"))).otherwise(precedes(F.col("new_start"), F.col("new_end"), F.col("o_start"), F.col("o_end")))
    holds = F.coalesce(ordered & (cosine(F.col("o_vector"), F.col("new_vector")) >= least), F.lit(False))
    judged = near.groupBy("line_id", "node_id").agg(F.bool_and(holds).alias("edges_hold"))
    alone = F.coalesce(cosine(F.col("vector"), F.col("new_vector")) >= least, F.lit(False))
    decision = (
        F.when(F.col("state_id").isNull(), "DETACHED").when(F.col("state_id") == F.col("new_state"), "KEPT")
        .when(F.col("new_vector").isNotNull() & F.coalesce("edges_hold", alone), "REVALIDATED").otherwise("DETACHED")
    )
    decisions = touched.join(judged, ["line_id", "node_id"], "left").select("line_id", "node_id", "block_id", decision.alias("decision"))
    settled = decisions.groupBy("block_id").agg(F.bool_and(F.col("decision") != "DETACHED").alias("whole")).filter("whole").select("block_id")
    return decisions, arriving.join(settled, "block_id", "left_anti")
