"""Graph primitives that iterate over DataFrames: components, closure, reachability."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.scratch import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for every node of an edge.

    Alternating large and small stars: each round links every node to the smallest it sees, so a
    component of diameter d is a star after about log(d) rounds. Every step is an aggregation with
    partial sums and an equality join; no component is ever gathered in one task. Rounds are cut by
    tables in the shared folder. Self loops give their node; rows with a null end are ignored.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).na.drop()
    alone = ends.filter("u = v").select("u")
    now = materialize(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        then = materialize(small, "edges")
        before, mark = mark, then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("s")).select("s.*")
    loops = alone.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.unionAll(loops).groupBy("node").agg(F.min("component").alias("component"))


#: Hops that one job follows: a plan of so many joins costs far less than so many small tables.
HOPS_A_JOB = 8


def reachable(edges: DataFrame, starts: DataFrame, src: str = "parent", dst: str = "child", most_hops: int = 10_000, bounded: bool = False) -> DataFrame:
    """(start, node, hops): every node that a start reaches along directed edges, itself at 0, by fewest hops.

    Breadth-first, HOPS_A_JOB joins a job, over the newly reached pairs only; ends when a job adds
    none. Raises where a node lies more than ``most_hops`` away, unless ``bounded`` asks for the nodes
    up to there and no others.
    """
    along = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).na.drop().distinct(), "edges")
    front = materialize(starts.select(F.col(starts.columns[0]).alias("start")).na.drop().distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("hops")), "front")
    found = front
    for hop in range(0, most_hops, HOPS_A_JOB):
        step, steps = front.filter(F.col("hops") == hop).select("start", "node"), []
        for more in range(1, min(HOPS_A_JOB, most_hops - hop) + 1):
            step = step.join(along, "node").select("start", F.col("next").alias("node")).distinct()
            steps.append(step.withColumn("hops", F.lit(hop + more)))
        new = reduce(DataFrame.unionAll, steps).groupBy("start", "node").agg(F.min("hops").alias("hops"))
        front = materialize(new.join(found.select("start", "node"), ["start", "node"], "left_anti"), "front")
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    if not bounded:
        last = front.filter(F.col("hops") == most_hops)
        beyond = last.join(along, "node").select("start", F.col("next").alias("node")).join(found.select("start", "node"), ["start", "node"], "left_anti")
        if not beyond.isEmpty():
            raise RuntimeError(f"a node lies more than {most_hops} hops away")
    return found


def descendants(edges: DataFrame, tops: DataFrame, src: str = "parent", dst: str = "child") -> DataFrame:
    """(node): all nodes that lie one edge or more below any of ``tops``."""
    along = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).na.drop().distinct(), "edges")
    step = tops.select(F.col(tops.columns[0]).alias("node")).distinct()
    found = None
    while True:
        steps = []
        for _ in range(HOPS_A_JOB):
            step = step.join(along, "node", "inner").select(F.col("next").alias("node")).distinct()
            steps.append(step)
        new = reduce(DataFrame.unionAll, steps).distinct()
        front = materialize(new if found is None else new.join(found, "node", "left_anti"), "front")
        found = front if found is None else found.unionAll(front)
        if front.isEmpty():
            return found
        step = front


def in_cycle(edges: DataFrame, src: str = "parent", dst: str = "child") -> DataFrame:
    """(node): nodes at the end of walks of any length, so those in a cycle or behind one.

    The ends of walks of n + 1 edges are among those of n; when a job takes none of them off, they stay.
    """
    along = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).na.drop().distinct(), "edges")
    ends, size = along.select("node").distinct(), None
    while True:
        for _ in range(HOPS_A_JOB):
            ends = ends.join(along, "node").select(F.col("next").alias("node")).distinct()
        then = materialize(ends, "ends")
        before, size = size, then.count()
        if size in (0, before):
            return then
        ends = then


def stems(edges: DataFrame, stops: DataFrame, src: str = "parent", dst: str = "child") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stem, rest, lost): a graph without its unbranched parts, which pointers cross in about log(length) joins.

    ``stem`` has (node, top) for each node with one parent that is none of ``stops``: the first node above it that is one, or
    has no parent or several. ``rest`` has (parent, child), the edges to all others, from the tops of their parents: a node lies
    below a top in the graph if it does in ``rest``, or if its own top is that one or does. ``lost`` are nodes with one parent
    each that lie in a cycle of such nodes or behind one.
    """
    along = materialize(edges.select(F.col(src).alias("parent"), F.col(dst).alias("child")).na.drop().distinct(), "edges")
    held = stops.select(F.col(stops.columns[0]).alias("child")).distinct()
    one = along.groupBy("child").agg(F.count("*").alias("n"), F.min("parent").alias("top")).filter("n = 1").join(held, "child", "left_anti")
    now = materialize(one.select(F.col("child").alias("node"), "top", F.lit(False).alias("done")), "stems")
    size = now.count()
    while size:
        above = now.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("done").alias("ends"))
        step = now.filter("not done").join(above, "top", "left").select("node", F.coalesce("next", "top").alias("top"), F.coalesce("ends", F.lit(True)).alias("done"))
        then = materialize(now.filter("done").unionByName(step), "stems")
        discard(now)
        now, before, size = then, size, then.filter("not done").count()
        if size == before:
            break
    stem = now.filter("done").select("node", "top")
    to_others = along.join(now.select(F.col("node").alias("child")), "child", "left_anti")
    rest = to_others.join(stem.withColumnRenamed("node", "parent"), "parent", "left").select(F.coalesce("top", "parent").alias("parent"), "child").distinct()
    return stem, materialize(rest, "rest"), now.filter("not done").select("node")


def acyclic(edges: DataFrame, src: str = "parent", dst: str = "child") -> bool:
    """Whether no walk along the edges comes back to a node."""
    _, rest, lost = stems(edges, edges.select(src).limit(0), src, dst)
    return lost.isEmpty() and in_cycle(rest).isEmpty()


def paths(edges: DataFrame, src: str = "parent", dst: str = "child", most_paths: int | None = 256, most_nodes: int | None = 64) -> DataFrame:
    """(nodes): all paths from nodes without parents to nodes without children of an acyclic graph.

    Fails rather than truncate: beyond ``most_paths`` paths, or a path beyond ``most_nodes`` nodes; None asks for all of
    them, however many. A job follows as many hops as cannot multiply the paths far beyond that; ended paths are set aside.
    """
    along = materialize(edges.select(F.col(src).alias("p"), F.col(dst).alias("c")).na.drop().distinct(), "edges")
    heads = along.select("p").distinct().join(along.select(F.col("c").alias("p")), "p", "left_anti")
    rows = materialize(heads.select(F.array("p").alias("nodes"), F.lit(False).alias("ended")), "paths")
    most = along.groupBy("p").count().agg(F.max("count")).first()[0] or 1
    n_edges = along.count()
    n, ended, length, done = rows.count(), 0, 1, []
    while True:
        room = 4 * max(most_paths or 1 << 16, n)
        hops = HOPS_A_JOB if most == 1 else max(1, min(HOPS_A_JOB, int(math.log(max(most, room / max(n, 1))) / math.log(most))))
        hops = hops if most_nodes is None else min(hops, most_nodes - length + 1)
        for _ in range(hops):
            last = rows.withColumn("p", F.when(~F.col("ended"), F.element_at("nodes", -1)))
            rows = last.join(along, "p", "left").select(F.when(F.col("c").isNull(), F.col("nodes")).otherwise(F.concat("nodes", F.array("c"))).alias("nodes"), F.col("c").isNull().alias("ended"))
        rows = materialize(rows, "paths")
        length += hops
        n, open_, longest = rows.agg(F.count("*"), F.count_if(~F.col("ended")), F.max(F.size("nodes"))).first()
        if most_paths is not None and ended + n > most_paths:
            raise RuntimeError(f"over {most_paths} paths")
        if most_nodes is not None and (longest or 0) > most_nodes:
            raise RuntimeError(f"a path has over {most_nodes} nodes")
        if (longest or 0) > n_edges + 1:
            raise RuntimeError("the edges hold a cycle")
        done.append(rows.filter("ended").select("nodes"))
        if not open_:
            return reduce(DataFrame.unionAll, done)
        ended, n, rows = ended + n - open_, open_, rows.filter(~F.col("ended"))
