"""Nearline growth: arriving block states applied to lines that exist, as revisions, without a rebuild."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.operators import linegraph, trajectory
from annalist.scratch import materialize

MEMBERS = ["line_id", "node_id", "block_id", "state_id", "vector", "occurred_start", "occurred_end", "known_at", "retired_at"]
EDGES = ["line_id", "parent", "child", "known_at", "retired_at"]


def candidates(nodes: DataFrame, blocks: DataFrame, least: float) -> DataFrame:
    """(block_id, line_id): the lines that a block may meet, by a node like it or by another arriving block that may join first."""
    both = nodes.select(F.concat(F.lit("n/"), "node_id").alias("id"), "vector").dropDuplicates(["id"]).unionByName(blocks.select(F.concat(F.lit("b/"), "block_id").alias("id"), "vector"))
    near = materialize(trajectory.similar(both, blocks.select(F.concat(F.lit("b/"), "block_id").alias("id")), least), "near")
    is_node = F.col("dst").startswith("n/")
    found = near.filter(is_node).select(F.expr("substring(src, 3)").alias("block_id"), F.expr("substring(dst, 3)").alias("node_id")).join(nodes.select("node_id", "line_id"), "node_id").select("block_id", "line_id").distinct()
    peers = near.filter(~is_node).select(F.expr("substring(src, 3)").alias("block_id"), F.expr("substring(dst, 3)").alias("peer"))
    found = front = materialize(found, "candidates")
    while True:
        new = peers.join(front.withColumnRenamed("block_id", "peer"), "peer").select("block_id", "line_id").distinct()
        front = materialize(new.join(found, ["block_id", "line_id"], "left_anti"), "candidates")
        if front.isEmpty():
            return found
        found = found.unionByName(front)


CHANGES = "line_id string, ordinal long, change string, parent string, child string"
#: Changes that leave a task at once, at least.
CHANGE_ROWS = 8192


def fold(nodes: DataFrame, edges: DataFrame, wanted: DataFrame, least: float, most: int = 1, rejoin: bool = False) -> DataFrame:
    """(line_id, ordinal, change, parent, child): what attaching many blocks, one after the other, does to each line.

    ``nodes``: line_id, node_id, vector, occurred_start, occurred_end, those visible now; ``edges``: line_id, parent, child,
    those that hold now; ``wanted``: line_id, node_id, vector, occurred_start, occurred_end, ordinal. A block takes as parents
    the latest-ending like nodes before it, those at the frontier if any is there, and as children the earliest-starting
    ones after it; score and id break ties, ``most`` of each. One without either is passed over. An edge between its
    parent and its child is RETIRED; edges to it and from it are ADDED, but no second parent unless ``rejoin``, and nothing
    that can be reached already. A change refers to the block by its ordinal; JOINED names it, as child.

    The next block sees what this one changed, so a line is one group: its visible nodes and the blocks that may join it.
    Lines nothing may join are not looked at. A task reads its lines one after the other from rows in their order, as most
    lines are short and a call for each would cost far more than its rows.
    """
    lines = wanted.select("line_id").distinct()
    text = lambda c: F.col(c).cast("string").alias(c)
    span = [F.unix_micros(F.col("occurred_start").cast("timestamp")).alias("s"), F.unix_micros(F.col("occurred_end").cast("timestamp")).alias("e")]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    part = lambda rows, kind, *columns: rows.select(text("line_id"), F.lit(kind).alias("kind"), *columns)
    held = part(nodes.join(lines, "line_id", "left_semi"), "node", text("node_id"), none("string", "child"), F.col("vector").cast("array<double>"), *span, none("long", "ordinal"))
    new = part(wanted, "new", text("node_id"), none("string", "child"), F.col("vector").cast("array<double>"), *span, F.col("ordinal").cast("long"))
    along = part(edges.join(lines, "line_id", "left_semi"), "edge", F.col("parent").cast("string").alias("node_id"), text("child"), none("array<double>", "vector"), none("long", "s"), none("long", "e"), none("long", "ordinal"))

    def grow(line: str, rows: list[tuple]) -> list[tuple]:
        known, matrix, spans, out = [], [], {}, []
        below, above = {}, {}

        def link(p, c, there=True):
            for table, a, b in ((below, p, c), (above, c, p)):
                (table.setdefault(a, set()).add if there else table.setdefault(a, set()).discard)(b)

        def reaches(a, b):
            seen, stack = {a}, [a]
            while stack:
                for c in below.get(stack.pop(), ()):
                    if c == b:
                        return True
                    if c not in seen:
                        seen.add(c)
                        stack.append(c)
            return False

        def join(name, vector, s, e):
            v = np.asarray(vector, float)
            known.append(name)
            matrix.append(v / (np.linalg.norm(v) or 1.0))
            spans[name] = (int(s), int(e))

        for _, kind, node, child, *_ in rows:
            if kind == "edge":
                link(node, child)
        for _, kind, node, _, vector, s, e, *_ in rows:
            if kind == "node" and vector is not None and len(vector):
                join(node, vector, s, e)
        for _, kind, node, _, vector, s, e, ordinal, _ in rows:
            if kind != "new":
                continue
            if vector is None or not len(vector) or node in spans:
                continue
            v = np.asarray(vector, float)
            v = v / (np.linalg.norm(v) or 1.0)
            before, after = [], []
            for name, u in zip(known, matrix):
                if len(u) == len(v) and (score := float(u @ v)) >= least:
                    a, b = spans[name]
                    if a < s and b <= s:
                        before.append((-b, -score, name))
                    elif s < a and e <= a:
                        after.append((a, -score, name))
            tips = [x for x in before if not below.get(x[2])]
            parents, children = [x[2] for x in sorted(tips or before)[:most]], [x[2] for x in sorted(after)[:most]]
            if not parents and not children:
                continue
            tell = lambda change, p, c: out.append((line, ordinal, change, p, c))  # noqa: E731,B023
            tell("JOINED", None, node)
            join(node, vector, s, e)
            for p in parents:
                for c in children:
                    if c in below.get(p, ()):
                        link(p, c, False)
                        tell("RETIRED", p, c)
            for p, c in [(p, node) for p in parents] + [(node, c) for c in children]:
                if (rejoin or not above.get(c)) and not reaches(p, c):
                    link(p, c)
                    tell("ADDED", p, c)
        return out

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = [c.split()[0] for c in CHANGES.split(", ")], []
        told = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "ordinal" else pa.string()) for n, c in zip(names, zip(*out))], names=names)
        for line, rows in groupby(rows_of(batches), key=itemgetter(0)):
            out += grow(line, list(rows))
            if len(out) >= CHANGE_ROWS:
                yield told()
                out = []
        if out:
            yield told()

    # The window brings a line's rows together, and their order; after repartition() alone, which nothing then relies on, Spark may part them again.
    place = F.row_number().over(Window.partitionBy("line_id").orderBy("kind", "ordinal", "node_id"))
    return held.unionByName(new).unionByName(along).withColumn("place", place).mapInArrow(lines_of, CHANGES)


def rows_of(batches: Iterator[pa.RecordBatch], vector: str = "vector") -> Iterator[tuple]:
    """Rows as tuples, with the vector, null or not, as a view of its batch's numbers."""
    for batch in batches:
        column = batch.column(vector)
        ends, numbers, there = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False), column.is_valid().to_pylist()
        vectors = (numbers[a:b] if known else None for a, b, known in zip(ends[:-1], ends[1:], there))
        yield from zip(*(vectors if name == vector else batch.column(name).to_pylist() for name in batch.schema.names))


def observe(members: DataFrame, edges: DataFrame, arriving: DataFrame, at: Column, least: float = trajectory.LEAST_SIMILARITY, most: int = 1, rejoin: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, edges, changes): both revision tables after the arriving block states, and what happened.

    ``members``: the columns of ``MEMBERS``; ``edges``: those of ``EDGES``; ids are strings. ``arriving``: block_id, state_id,
    vector, occurred_start, occurred_end, ordinal (the order in which they count). A membership whose relations the new state
    keeps is revised (REVALIDATED), another is closed with its edges (DETACHED), both from ``at`` on; see
    :func:`annalist.operators.trajectory.observe`. What has no membership then goes to every line that has a like node and an
    ordered neighbour for it, see :func:`fold`. Nothing is deleted: intervals close, and an edge that is added and retired in
    one call lives for no time. ``changes``: line_id, change, parent, child, with the node as child where it is not an edge.
    """
    spark = members.sparkSession
    at_table = spark.range(1).select(at.cast(members.schema["known_at"].dataType).alias("at"))
    at = F.lit(at_table.first()[0]).cast(members.schema["known_at"].dataType)
    open_ = (F.col("known_at") <= at) & (F.col("retired_at").isNull() | (F.col("retired_at") > at))
    now, links = materialize(members.filter(open_), "members"), materialize(edges.filter(open_).select("line_id", "parent", "child").distinct(), "edges")
    decided, to_route = trajectory.observe(now.select(*MEMBERS[:7]), links, arriving, least)
    decided, to_route = materialize(decided, "decided"), materialize(to_route, "to_route")

    gone = decided.filter("decision = 'DETACHED'").select("line_id", "node_id")
    members, edges = linegraph.detach(members, edges, gone, at)
    links_left = links.join(gone.withColumnRenamed("node_id", "parent"), ["line_id", "parent"], "left_anti").join(gone.withColumnRenamed("node_id", "child"), ["line_id", "child"], "left_anti")
    kept = decided.filter("decision = 'REVALIDATED'").select("line_id", "node_id", "block_id")
    anew = kept.join(arriving, "block_id").select("line_id", "node_id", "block_id", "state_id", "vector", "occurred_start", "occurred_end", at.alias("known_at"), F.lit(None).cast(members.schema["retired_at"].dataType).alias("retired_at"))
    members = materialize(linegraph.retire(members, kept, ["line_id", "node_id"], at).unionByName(anew), "members")

    there = materialize(members.filter(open_).filter("state_id is not null"), "members")
    hidden = now.filter("state_id is null").join(gone, ["line_id", "node_id"], "left_anti")
    if not hidden.isEmpty():  # nodes below one without a state are not visible
        both = lambda name: F.concat_ws("\u0000", "line_id", name)
        seen = linegraph.visible_nodes(there.select(both("node_id").alias("node_id")), links_left.select(both("parent").alias("parent"), both("child").alias("child")))
        there = materialize(there.withColumn("_key", both("node_id")).join(seen.withColumnRenamed("node_id", "_key"), "_key", "left_semi").drop("_key"), "members")
    retained = decided.filter("decision != 'DETACHED'").select("block_id", "line_id")
    pairs = candidates(there, to_route, least).join(retained, ["block_id", "line_id"], "left_anti")
    wanted = pairs.join(to_route, "block_id").withColumn("node_id", linegraph.node_id(F.col("line_id"), F.col("block_id")))
    changes = materialize(fold(there, links_left, wanted, least, most, rejoin), "changes")

    joined = changes.filter("change = 'JOINED'").select("line_id", F.col("child").alias("node_id")).join(wanted, ["line_id", "node_id"])
    none = F.lit(None).cast(members.schema["retired_at"].dataType)
    members = members.unionByName(joined.select(*MEMBERS[:7], at.alias("known_at"), none.alias("retired_at")))
    key = ["line_id", "parent", "child"]
    edges = linegraph.retire(edges, changes.filter("change = 'RETIRED'").select(*key), key, at)
    last = changes.filter("change in ('ADDED', 'RETIRED')").groupBy(*key).agg(F.max_by("change", F.struct("ordinal", F.col("change") == "RETIRED")).alias("last"), F.max(F.col("change") == "ADDED").alias("added")).filter("added")
    edges = edges.unionByName(last.select(*key, at.alias("known_at"), F.when(F.col("last") == "RETIRED", at).alias("retired_at")), allowMissingColumns=True)
    told = decided.select("line_id", F.col("decision").alias("change"), F.lit(None).cast("string").alias("parent"), F.col("node_id").alias("child"))
    return materialize(members, "members"), materialize(edges, "edges"), told.unionByName(changes.select("line_id", "change", "parent", "child"))
