"""Line graphs kept as revisions: memberships and edges with the interval in which they were known."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import identity
from annalist.functions.vector import cosine
from annalist.operators.graph import HOPS_A_JOB, acyclic, descendants, paths, reachable, stems
from annalist.operators.visibility import latest
from annalist.scratch import materialize


def as_of(revisions: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """Distinct keys whose revision holds at ``at``: known by then and not retired yet (half-open)."""
    return revisions.filter((F.col("known_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at))).select(*keys).distinct()


def as_identity(revisions: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """As :func:`as_of`, and also what retires at this very moment, unless it lived for no time."""
    closing = (F.col("retired_at") == at) & (F.col("known_at") < at)
    return revisions.filter((F.col("known_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at) | closing)).select(*keys).distinct()


def retire(revisions: DataFrame, targets: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """The revisions with those of ``targets`` that hold at ``at`` retired there."""
    hit = targets.select(*keys).distinct().withColumn("_hit", F.lit(True))
    holds = F.col("_hit") & (F.col("known_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at))
    return revisions.join(hit, keys, "left").withColumn("retired_at", F.when(holds, at).otherwise(F.col("retired_at"))).drop("_hit")


def retire_forward(revisions: DataFrame, at: Column) -> DataFrame:
    """Everything retired from ``at`` on: later revisions live for no time."""
    open_or_later = F.col("retired_at").isNull() | (F.col("retired_at") > at)
    return revisions.withColumn("retired_at", F.when(open_or_later, F.greatest("known_at", at)).otherwise(F.col("retired_at")))


def node_states(states: DataFrame, valid_states: DataFrame, at: Column) -> DataFrame:
    """Per node the highest version known at ``at`` among valid states."""
    known = states.filter(F.col("known_at") <= at).join(valid_states.select("state_id").distinct(), "state_id", "left_semi")
    return latest(known, "node_id", "state_version")


def visible_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes all of whose ancestors are visible too: those below a hidden one go.

    Fails on a cycle: its nodes would never be resolved.
    """
    seen = materialize(nodes.select("node_id").distinct(), "nodes")
    links = materialize(edges.select("parent", "child").na.drop().distinct(), "links")
    gone = materialize(links.select(F.col("parent").alias("node_id")).distinct().join(seen, "node_id", "left_anti"), "gone")
    stem, rest, lost = stems(links, gone)
    if not lost.isEmpty() or not acyclic(rest):
        raise RuntimeError("the edges hold a cycle")
    tops = materialize(gone.union(descendants(rest, gone)).distinct(), "hidden")
    below = stem.join(tops.withColumnRenamed("node_id", "top"), "top", "left_semi").select(F.col("node").alias("node_id"))
    return seen.join(tops.union(below), "node_id", "left_anti")


def frontier(visible: DataFrame, edges: DataFrame) -> DataFrame:
    """Visible nodes without a visible child."""
    inner = edges.join(visible.select(F.col("node_id").alias("child")), "child", "left_semi").select(F.col("parent").alias("node_id")).distinct()
    return visible.join(inner, "node_id", "left_anti")


def frontier_paths(visible: DataFrame, edges: DataFrame, most_paths: int = 256, most_nodes: int = 64) -> DataFrame:
    """All root-to-frontier paths among visible nodes, exact or an error."""
    inside = edges.join(visible.select(F.col("node_id").alias("parent")), "parent", "left_semi").join(visible.select(F.col("node_id").alias("child")), "child", "left_semi")
    lone = visible.join(inside.select(F.explode(F.array("parent", "child")).alias("node_id")), "node_id", "left_anti")
    return paths(inside, most_paths=most_paths, most_nodes=most_nodes).unionByName(lone.select(F.array("node_id").alias("nodes")))


def line_paths(visible: DataFrame, edges: DataFrame, most_paths: int = 256, most_nodes: int = 64) -> tuple[DataFrame, DataFrame]:
    """(paths, skipped): per line all root-to-frontier paths (line_id, nodes), but for lines that have too many or too long ones.

    ``visible``: line_id, node_id; ``edges``: line_id, parent, child. ``skipped`` says (line_id, reason) why a line is left
    out as a whole; the others are complete. One walk counts and writes out: a node's count at a hop is the sum over its
    parents, and it holds its paths while they are ``most_paths`` at most. Beyond that it only counts, as does a node with more
    parents, so a line with very many costs no more than its edges. A line that has a cycle is over any length.
    """
    seen = materialize(visible.select("line_id", "node_id").na.drop().distinct(), "visible")
    end = lambda name: seen.withColumnRenamed("node_id", name)
    inside = edges.select("line_id", "parent", "child").distinct().join(end("parent"), ["line_id", "parent"], "left_semi").join(end("child"), ["line_id", "child"], "left_semi")
    few = F.count("*").over(Window.partitionBy("line_id", "child")) <= most_paths
    along = materialize(inside.select("line_id", F.col("parent").alias("node_id"), "child", few.alias("few")), "inside")
    roots = seen.join(along.select("line_id", F.col("child").alias("node_id")), ["line_id", "node_id"], "left_anti")
    inner = along.select("line_id", "node_id", F.lit(True).alias("inner")).distinct()

    def jobs(first: DataFrame, onward):
        """The states of a walk by hops, HOPS_A_JOB of them a table, until none is left or ``most_nodes`` are passed."""
        now, hop = first, 1
        while hop <= most_nodes:
            steps = [now.withColumn("hop", F.lit(hop))]
            for more in range(1, min(HOPS_A_JOB, most_nodes - hop + 1) + 1):
                steps.append(onward(steps[-1].drop("hop")).withColumn("hop", F.lit(hop + more)))
            done = materialize(reduce(DataFrame.unionAll, steps), "walk")
            hop += len(steps) - 1
            yield done.filter(F.col("hop") < hop)
            now = done.filter(F.col("hop") == hop).drop("hop")
            if now.isEmpty():
                return
        yield now.withColumn("hop", F.lit(hop))

    full = F.lit(most_paths + 1).cast("long")  # counts stop here

    def onward(rows: DataFrame) -> DataFrame:
        met = rows.join(along, ["line_id", "node_id"]).groupBy("line_id", F.col("child").alias("node_id"))
        met = met.agg(F.least(F.sum(F.when(F.col("few"), F.col("n")).otherwise(full)), full).alias("n"), F.flatten(F.collect_list(F.when(F.col("few"), F.col("paths")))).alias("paths"))
        return met.withColumn("paths", F.when(F.col("n") < full, F.transform("paths", lambda nodes: F.concat(nodes, F.array("node_id")))))

    first = roots.select("line_id", "node_id", F.lit(1).cast("long").alias("n"), F.array(F.array("node_id")).alias("paths"))
    walks = reduce(DataFrame.unionAll, jobs(first, onward))
    ends = walks.join(inner, ["line_id", "node_id"], "left").groupBy("line_id").agg(
        F.least(F.sum(F.when(F.col("inner").isNull() & (F.col("hop") <= most_nodes), F.col("n"))), full).alias("n"), F.max("hop").alias("longest")
    )
    lines = seen.select("line_id").distinct().join(ends, "line_id", "left")
    reason = F.when(F.col("longest").isNull() | (F.col("longest") > most_nodes), f"a path has over {most_nodes} nodes").when(F.col("n") > most_paths, f"over {most_paths} paths")
    judged = materialize(lines.select("line_id", reason.alias("reason")), "lines")
    tips = walks.filter(F.col("hop") <= most_nodes).join(inner, ["line_id", "node_id"], "left_anti").join(judged.filter("reason is null"), "line_id", "left_semi")
    return tips.select("line_id", F.explode("paths").alias("nodes")), judged.filter("reason is not null")


def raw_closure(starts: DataFrame, edges: DataFrame, bridge: DataFrame) -> DataFrame:
    """(start, evidence_id): the evidence of each start and all of its ancestors.

    Unbranched parts of the graph are crossed at once (:func:`stems`); raises beyond 10,000 hops in what is left of it.
    """
    begin = starts.select(F.col(starts.columns[0]).alias("start")).na.drop().distinct()
    stem, rest, _ = stems(edges, begin, src="child", dst="parent")  # a cycle that has no child outside leads to no start
    met = materialize(reachable(rest, begin).select("start", "node"), "met")
    up = met.unionByName(met.withColumnRenamed("node", "top").join(stem, "top").select("start", "node"))
    return up.withColumnRenamed("node", "node_id").join(bridge, "node_id").select("start", "evidence_id").distinct()


def reach_spans(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(line_id, start, node, since, until, last): when each start of a line reaches which nodes, and by edges up to which ordinal.

    ``edges``: line_id, parent, child, since, until (null: open), last; ``starts``: line_id, start, since. A path holds while
    all of its edges do, so spans are intersected along it and ``last`` is the greatest of its edges; what no other path of
    the same two ends outlasts by span and ordinal stays. HOPS_A_JOB joins a job, no job per revision boundary.
    """
    along = materialize(edges.select("line_id", F.col("parent").alias("node"), F.col("child").alias("next"), F.col("since").alias("s"), F.col("until").alias("u"), F.col("last").alias("l")), "along")
    key, span = ["line_id", "start", "node"], ["since", "until", "last"]
    first = starts.select("line_id", "start", F.col("start").alias("node"), "since", F.lit(None).cast(along.schema["u"].dataType).alias("until"), F.lit(0).cast("long").alias("last"), F.lit(HOPS_A_JOB).alias("hop"))
    front = found = materialize(first, "front")
    while True:
        step, steps = front.filter(F.col("hop") == HOPS_A_JOB).drop("hop"), []  # the job that made the others has followed them
        for hop in range(1, HOPS_A_JOB + 1):
            on = step.join(along, ["line_id", "node"]).select(
                "line_id", "start", F.col("next").alias("node"), F.greatest("since", "s").alias("since"), F.least("until", "u").alias("until"), F.greatest("last", "l").alias("last")
            )
            step = on.filter("until is null or since < until").groupBy(*key, "since", "until").agg(F.min("last").alias("last"))
            steps.append(step.withColumn("hop", F.lit(hop)))
        least = reduce(DataFrame.unionAll, steps).groupBy(*key, "since", "until").agg(F.min(F.struct("last", "hop")).alias("least"))
        new, old = least.select(*key, "since", "until", "least.*").alias("n"), found.alias("f")
        outlasts = (F.col("f.since") <= F.col("n.since")) & (F.col("f.until").isNull() | (F.col("f.until") >= F.col("n.until"))) & (F.col("f.last") <= F.col("n.last"))
        same = (F.col("f.line_id") == F.col("n.line_id")) & (F.col("f.start") == F.col("n.start")) & (F.col("f.node") == F.col("n.node"))
        front = materialize(new.join(old, same & outlasts, "left_anti"), "front")
        found = found.unionByName(front)
        if front.filter(F.col("hop") == HOPS_A_JOB).isEmpty():
            return found.select(*key, *span)


def judge_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(line_id, parent, child, known_at, ordinal, verdict): what becomes of a batch of edges, one after the other in every line.

    ``edges``: line_id, parent, child, known_at, retired_at. ``wanted``: line_id, parent, child, known_at, and ordinal, the
    order of arrival in a line, from 1, without ties. SELF: both ends are one node. SHORTCUT: the child is reachable at
    ``known_at`` already, by what holds then or was added before it in the batch. CYCLE: the parent is reachable from the
    child then or at any later revision boundary. Else ADDED. Only an ADDED edge counts for those after it.

    All lines and boundaries are answered together from one table of spans. An edge waits for the next round only where its
    verdict hangs on an earlier edge that is undecided itself.
    """
    key, pair = ["line_id", "parent", "child", "known_at", "ordinal"], ["line_id", "start", "node"]
    batch = materialize(wanted.select(*key[:4], F.col("ordinal").cast("long").alias("ordinal")), "wanted")
    walk = lambda rows, until, last: rows.select("line_id", "parent", "child", F.col("known_at").alias("since"), until.cast(edges.schema["retired_at"].dataType).alias("until"), last.alias("last"))
    none, sure = F.lit(None), F.lit(0).cast("long")
    held = walk(edges, F.col("retired_at"), sure)
    decided = [batch.filter("parent = child").withColumn("verdict", F.lit("SELF"))]
    todo = batch.filter("parent != child")
    while not todo.isEmpty():
        asked = todo.groupBy("line_id").agg(F.min("known_at").alias("since"), F.max("ordinal").alias("latest"))
        starts = todo.select("line_id", F.explode(F.array("parent", "child")).alias("start")).distinct().join(asked.drop("latest"), "line_id")
        lines = held.join(asked.drop("latest").withColumnRenamed("since", "asked"), "line_id").filter("until is null or until > asked").drop("asked")
        earlier = todo.join(asked.drop("since"), "line_id").filter("ordinal < latest")  # a line's last edge changes no verdict
        spans = materialize(reach_spans(lines.unionByName(walk(earlier, none, F.col("ordinal"))), starts), "spans")

        way = lambda start, node, forth: F.struct(F.col(start).alias("start"), F.col(node).alias("node"), F.lit(forth).alias("forth"))
        ends = todo.select("line_id", "ordinal", "known_at", F.explode(F.array(way("parent", "child", True), way("child", "parent", False))).alias("way")).select("*", "way.*").drop("way")
        met = ends.join(spans, pair).filter((F.col("last") < F.col("ordinal")) & (F.col("until").isNull() | (F.col("until") > F.col("known_at"))))
        short, back = F.min(F.when(F.col("forth") & (F.col("since") <= F.col("known_at")), F.col("last"))), F.min(F.when(~F.col("forth"), F.col("last")))
        hits = met.groupBy("line_id", "ordinal").agg(short.alias("short"), back.alias("back"))
        verdict = F.when(F.col("short") == 0, "SHORTCUT").when(F.col("short").isNull() & (F.col("back") == 0), "CYCLE").when(F.col("short").isNull() & F.col("back").isNull(), "ADDED")
        judged = materialize(todo.join(hits, ["line_id", "ordinal"], "left").withColumn("verdict", verdict).select(*key, "verdict"), "judged")
        decided.append(judged.filter("verdict is not null"))
        held = held.unionByName(walk(judged.filter("verdict = 'ADDED'"), none, sure))
        todo = judged.filter("verdict is null").drop("verdict")
    return reduce(DataFrame.unionByName, [d.select(*key, "verdict") for d in decided])


def add_edges(edges: DataFrame, wanted: DataFrame, fingerprint: str = "") -> DataFrame:
    """The revisions with a batch of edges more, see :func:`judge_edges`; shortcuts are passed over, cycles and self-references raise."""
    judged = materialize(judge_edges(edges, wanted), "judged")
    bad = judged.filter("verdict in ('CYCLE', 'SELF')").orderBy("line_id", "ordinal").limit(1).collect()
    if bad:
        raise RuntimeError(f"an edge of line {bad[0].line_id} from {bad[0].parent} to {bad[0].child} closes a cycle" if bad[0].verdict == "CYCLE" else f"{bad[0].parent} cannot follow itself")
    new = judged.filter("verdict = 'ADDED'").select("line_id", "parent", "child", "known_at", F.lit(None).cast(edges.schema["retired_at"].dataType).alias("retired_at"), F.lit(fingerprint).alias("derivation_fingerprint"))
    return edges.unionByName(new, allowMissingColumns=True)


def add_edge(edges: DataFrame, line_id: str, parent: str, child: str, known_at: Column, fingerprint: str = "") -> DataFrame:
    """:func:`add_edges` for one edge."""
    at = known_at.cast(edges.schema["known_at"].dataType).alias("known_at")
    return add_edges(edges, edges.sparkSession.range(1).select(F.lit(line_id).alias("line_id"), F.lit(parent).alias("parent"), F.lit(child).alias("child"), at, F.lit(1).alias("ordinal")), fingerprint)


def insert_between(edges: DataFrame, line_id: str, node: str, parent: str | None, child: str | None, at: Column) -> DataFrame:
    """A late block between parent and child: their edge retires, and two edges through the block begin."""
    out = edges
    if parent is not None and child is not None:
        gone = edges.sparkSession.createDataFrame([(line_id, parent, child)], "line_id string, parent string, child string")
        out = materialize(retire(out, gone, ["line_id", "parent", "child"], at), "edges")
    for p, c in ((parent, node), (node, child)):
        if p is not None and c is not None:
            out = materialize(add_edge(out, line_id, p, c, at), "edges")
    return out


def detach(members: DataFrame, edges: DataFrame, nodes: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Revisions of memberships and edges with those of ``nodes`` (line_id, node_id), and the edges at them, retired at ``at``."""
    gone = nodes.select("line_id", "node_id").distinct()
    at_them = edges.join(gone.withColumnRenamed("node_id", "parent"), ["line_id", "parent"], "left_semi").select("line_id", "parent", "child")
    at_them = at_them.unionByName(edges.join(gone.withColumnRenamed("node_id", "child"), ["line_id", "child"], "left_semi").select("line_id", "parent", "child"))
    return retire(members, gone, ["line_id", "node_id"], at), retire(edges, at_them, ["line_id", "parent", "child"], at)


def attach(edges: DataFrame, wanted: DataFrame, spans: DataFrame, rejoin: bool = False) -> DataFrame:
    """(line_id, parent, child, change): what attaching one new node to each of many lines does to the edges that hold now.

    ``wanted``: line_id, node_id, parent, child, rows with the same node for several parents or children, either null where
    there is none. ``spans``: node_id, occurred_start, occurred_end. An edge from a wanted parent to a wanted child RETIRES, as
    the node comes between them; edges to the node and from it are ADDED, but none that would give a child a second parent,
    unless ``rejoin``. Raises where a line gets two nodes at once, a node has edges already, or an edge would run back in time.
    Edges that run forward in time close no cycle, so none is looked for.
    """
    if not wanted.groupBy("line_id").agg(F.count_distinct("node_id").alias("n")).filter("n > 1").isEmpty():
        raise ValueError("one node a line at a time: the next one sees what this one changed")
    known = edges.select("line_id", F.explode(F.array("parent", "child")).alias("node_id"))
    if not wanted.join(known, ["line_id", "node_id"], "left_semi").isEmpty():
        raise ValueError("a node that has edges is not attached again")
    above = wanted.filter("parent is not null").select("line_id", "parent", F.col("node_id").alias("child")).distinct()
    below = wanted.filter("child is not null").select("line_id", F.col("node_id").alias("parent"), "child").distinct()
    p, c = (spans.select(F.col("node_id").alias(end), F.col("occurred_start").alias(f"{end}_start"), F.col("occurred_end").alias(f"{end}_end")) for end in ("parent", "child"))
    timed = above.unionByName(below).join(p, "parent", "left").join(c, "child", "left")
    forward = (F.col("parent_start") < F.col("child_start")) & (F.col("parent_end") <= F.col("child_start"))
    if not timed.filter(~F.coalesce(forward, F.lit(False))).isEmpty():
        raise ValueError("a parent must strictly precede its child")
    keys = ["line_id", "parent", "child"]
    between = wanted.filter("parent is not null").select("line_id", "node_id", "parent").join(wanted.filter("child is not null").select("line_id", "node_id", "child"), ["line_id", "node_id"]).select(*keys)
    gone = edges.select(*keys).distinct().join(between, keys, "left_semi")
    if not rejoin:  # of several wanted parents the smallest, as the node's second is refused like any other
        above = above.groupBy("line_id", "child").agg(F.min("parent").alias("parent")).select(*keys)
        below = below.join(edges.join(gone, keys, "left_anti").select("line_id", "child"), ["line_id", "child"], "left_anti").select(*keys)
    return gone.withColumn("change", F.lit("RETIRED")).unionByName(above.unionByName(below).withColumn("change", F.lit("ADDED")))


def node_id(line: Column, block: Column) -> Column:
    return identity("node_", line, block)


def projection(visible: DataFrame, edges: DataFrame, block: DataFrame, bridge: DataFrame, most_nodes: int = 6) -> tuple[DataFrame, DataFrame]:
    """(nodes, evidence) of a line called for a block: the most similar visible node, and what lies near it.

    Both directions are searched to 3 * most_nodes hops; the ``most_nodes`` nearest by (distance, similarity, id) stay.
    ``visible`` has node_id and vector, ``block`` one row with vector.
    """
    scored = visible.crossJoin(F.broadcast(block.select(F.col("vector").alias("wanted")).limit(1))).withColumn("similarity", cosine(F.col("vector"), F.col("wanted"))).select("node_id", "similarity")
    scored = materialize(scored, "scored")
    anchor = scored.orderBy(F.desc("similarity"), "node_id").limit(1).select("node_id")
    both = edges.select("parent", "child").unionAll(edges.select(F.col("child").alias("parent"), F.col("parent").alias("child")))
    near = reachable(both, anchor, most_hops=3 * most_nodes, bounded=True).withColumnRenamed("node", "node_id").join(scored, "node_id")
    nodes = near.orderBy("hops", F.desc("similarity"), "node_id").limit(most_nodes)
    return nodes.select("node_id", "hops", "similarity"), raw_closure(nodes.select("node_id"), edges, bridge).select("evidence_id").distinct()
