"""Shapes of paths, and the lines that share one."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import identity
from annalist.operators.graph import connected_components
from annalist.operators.linegraph import line_paths, raw_closure
from annalist.operators.similarity import BLOCK_ROWS, KNN_SCORES, vectors_of
from annalist.scratch import materialize

POINTS, LEAST_COSINE, LEAST_LINES, LEAST_NODES, MOST_VIEWS, MOST_STEPS, MOST_FOUND = 17, 0.95, 3, 3, 512, 100_000, 64
MOST_PATHS, MOST_NODES = 256, 64
#: Waves of a sketch, rows of a block of sketches at most, and signatures that are handled at once.
WAVES, SKETCH_ROWS, SHAPE_ROWS = 2, 65_536, 2048


def resampled(walks: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """(points at equal arc length along each polyline, their lengths) of walks of as many nodes each."""
    steps = np.linalg.norm(np.diff(walks, axis=1), axis=2)
    along = np.concatenate([np.zeros((len(walks), 1)), np.cumsum(steps, axis=1)], axis=1)
    wanted = np.linspace(0, along[:, -1], points, axis=1)
    at = np.clip((along[:, None, :] <= wanted[:, :, None]).sum(axis=2) - 1, 0, steps.shape[1] - 1)
    row, step = np.arange(len(walks))[:, None], np.take_along_axis(steps, at, axis=1)
    share = np.divide(wanted - np.take_along_axis(along, at, axis=1), step, out=np.zeros_like(wanted), where=step != 0)
    return walks[row, at] + share[:, :, None] * (walks[row, at + 1] - walks[row, at]), along[:, -1]


def resample(vectors: np.ndarray, points: int = POINTS) -> np.ndarray | None:
    """Points at equal arc length along a polyline; None where it has no length."""
    found, length = resampled(vectors[None], points) if len(vectors) > 1 else (None, [0.0])
    return None if length[0] <= 0 else found[0]


def outlines(shapes: pa.Array, points: int = POINTS) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(nodes, places, signatures): of shapes of one kind each, those that give a signature, by place, and it.

    A shape is the vectors of a path, or its finished signature alone. Paths without length or with vectors of different
    sizes are left out.
    """
    nodes, inner = pc.fill_null(pc.list_value_length(shapes), 0).to_numpy(zero_copy_only=False), shapes.flatten()
    sizes, flat = pc.fill_null(pc.list_value_length(inner), 0).to_numpy(zero_copy_only=False), inner.flatten().to_numpy(zero_copy_only=False)
    owner, first, out = np.repeat(np.arange(len(nodes)), nodes), np.cumsum(nodes) - nodes, []
    size = np.zeros(len(nodes), int)
    size[nodes > 0] = sizes[first[nodes > 0]]
    size[owner[sizes != size[owner]]] = 0
    begin = np.concatenate([[0], np.cumsum(sizes)])[first]
    for n, d in np.unique(np.column_stack([nodes, size])[size > 0], axis=0):
        those = np.flatnonzero((nodes == n) & (size == d))
        for start in range(0, len(those), SHAPE_ROWS):
            some = those[start : start + SHAPE_ROWS]
            rows = flat[begin[some][:, None] + np.arange(n * d)]
            if n > 1:
                found, length = resampled(rows.reshape(-1, n, d), points)
                rows = (found - found[:, :1]).reshape(len(some), -1)
                norm = np.linalg.norm(rows, axis=1)
                kept = ~(length <= 0) & (norm != 0)
                some, rows = some[kept], rows[kept] / norm[kept][:, None]
            out.append((int(n), some, rows))
    return out


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def in_pieces(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, SHAPE_ROWS):
            yield batch.slice(start, SHAPE_ROWS)


def signatures(paths: DataFrame, points: int = POINTS) -> DataFrame:
    """(view_id, line_id, signature): the resampled path from its own origin, flattened, of length one.

    ``paths``: line_id, node_ids, vectors (array of arrays), and state_ids where a view is one of certain states. Paths
    without length or with vectors of different sizes drop out.
    """

    def shape(batches):
        for some in in_pieces(batches):
            for _, places, found in outlines(some.column("vectors"), points):
                those = some.select(["view_id", "line_id"]).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*those.columns, lists(found)], names=["view_id", "line_id", "signature"])

    vectors = F.when(F.size("vectors") > 1, F.col("vectors").cast("array<array<double>>")).alias("vectors")
    named = paths.select(view_id(paths).alias("view_id"), F.col("line_id").cast("string").alias("line_id"), vectors)
    return named.mapInArrow(shape, "view_id string, line_id string, signature array<double>")


def view_id(paths: DataFrame) -> Column:
    ids = [F.array_join(F.transform(name, lambda n: n.cast("string")), ",") for name in ("node_ids", "state_ids") if name in paths.columns]
    return identity("view_", F.col("line_id"), *ids)


def line_views(
    visible: DataFrame, edges: DataFrame, states: DataFrame, bridge: DataFrame, least_nodes: int = LEAST_NODES, most_paths: int = MOST_PATHS, most_nodes: int = MOST_NODES, points: int = POINTS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(views, evidence, skipped): the views that lines give of themselves, one a root-to-frontier path of enough nodes.

    ``visible``: line_id, node_id; ``edges``: line_id, parent, child; ``states``: node_id, state_id, vector, the state that
    holds at the cutoff; ``bridge``: node_id, evidence_id. ``views`` have view_id, line_id, node_ids, signature; a path with a
    node without state or vector gives none. ``evidence`` is (view_id, evidence_id): all that the path's last node and its
    ancestors rest on, over every parent and not only those of the path. ``skipped`` are the lines with too many or too
    long paths, and why: they show nothing, and what is found without them is partial.

    A signature is ``points`` vectors long, more than most paths: ``shape`` is the vectors of a path of no more nodes, else its
    signature alone. Only that is written and moved, and the signature is made of it where it is read.
    """
    paths, skipped = line_paths(visible, edges, most_paths, most_nodes)
    long = materialize(paths.filter(F.size("nodes") >= least_nodes).select("line_id", F.col("nodes").alias("node_ids")), "paths")
    known = states.filter("state_id is not null and size(vector) > 0").select("node_id", F.struct(F.col("state_id").cast("string").alias("state_id"), F.col("vector").cast("array<double>").alias("vector")).alias("state"))
    each = long.select("line_id", "node_ids", F.posexplode("node_ids").alias("at", "node_id")).join(known, "node_id")
    told = each.groupBy("line_id", "node_ids").agg(F.array_sort(F.collect_list(F.struct("at", "state"))).alias("x")).filter(F.size("x") == F.size("node_ids"))
    rows = told.select("line_id", "node_ids", F.transform("x", lambda s: s["state"]["state_id"]).alias("state_ids"), F.transform("x", lambda s: s["state"]["vector"]).alias("vectors"))
    rows = rows.select(view_id(rows).alias("view_id"), "line_id", "node_ids", F.when(F.size("vectors") > 1, F.col("vectors")).alias("shape"))

    def shorten(batches):
        for some in in_pieces(batches):
            for n, places, found in outlines(some.column("shape"), points):
                those = some.take(pa.array(places))
                if n > points:
                    those = those.set_column(3, "shape", pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32)), lists(found)))
                yield those

    @F.arrow_udf("array<double>")
    def signature(shape: pa.Array) -> pa.Array:
        told = [(places, found) for _, places, found in outlines(shape, points)]
        order = np.concatenate([np.empty(0, int), *(places for places, _ in told)])
        return pa.concat_arrays([lists(found) for _, found in told] or [pa.array([], pa.list_(pa.float64()))]).take(pa.array(np.argsort(order)))

    views = materialize(rows.mapInArrow(shorten, rows.schema), "views")
    tips = views.select("view_id", F.element_at("node_ids", -1).alias("start"))
    closed = raw_closure(tips.select("start").distinct(), edges, bridge)
    return views.select("view_id", "line_id", "node_ids", signature("shape").alias("signature"), "shape"), tips.join(closed, "start").select("view_id", "evidence_id"), skipped


def cliques(neighbours: dict, most_steps: int = MOST_STEPS) -> list[frozenset]:
    """Maximal cliques by branching with a pivot; fails beyond ``most_steps`` branches."""
    found, steps = [], 0
    stack = [(frozenset(), set(neighbours), set())]
    while stack:
        chosen, open_, closed = stack.pop()
        steps += 1
        if steps > most_steps:
            raise RuntimeError(f"over {most_steps} search steps")
        if not open_ and not closed:
            found.append(chosen)
            continue
        pivot = max(sorted(open_ | closed), key=lambda u: len(open_ & neighbours[u]))
        for v in sorted(open_ - neighbours[pivot]):
            stack.append((chosen | {v}, open_ & neighbours[v], closed & neighbours[v]))
            open_ = open_ - {v}
            closed = closed | {v}
    return found


def sketch(signatures: np.ndarray, points: int = POINTS, waves: int = WAVES) -> np.ndarray:
    """Short rows whose products are no less than those of the signatures.

    A path's first waves along its points hold most of it; what they leave out enters by its length, which bounds the product
    of what is left out on both sides, and so does the rounding to single precision. Signatures that no path of so many points
    gave are kept whole.
    """
    size = np.linalg.norm(signatures, axis=1)
    kept = signatures
    if signatures.shape[1] % points == 0:
        base = np.linalg.qr(np.sin(np.outer(np.arange(points) / (points - 1), (np.arange(waves) + 0.5) * np.pi)))[0]
        kept = np.einsum("npd,pw->nwd", signatures.reshape(len(signatures), points, -1), base).reshape(len(signatures), -1)
    left = np.maximum(0, size**2 - np.einsum("ij,ij->i", kept, kept)) + 1e-4 * size**2
    return np.column_stack([kept, np.sqrt(left)]).astype(np.float32)


def alike(views: DataFrame, least: float = LEAST_COSINE, points: int = POINTS) -> DataFrame:
    """(a, b, similarity): pairs of views of different lines whose signatures have at least this cosine, a < b.

    Two steps, neither of which copies whole signatures for each block: products of sketches in blocks of the similarity
    matrix leave a pair that may be alike, and exact products decide where such pairs meet their signatures, made there of
    their ``shape`` where views have one (:func:`line_views`).
    """
    shape = F.col("shape") if "shape" in views.columns else F.array(F.col("signature").cast("array<double>")).alias("shape")
    rows = views.select("view_id", F.col("line_id").cast("string").alias("line_id"), shape)

    def shorten(batches):
        for some in in_pieces(batches):
            for _, places, found in outlines(some.column("shape"), points):
                short, those = sketch(found, points), some.select(["view_id", "line_id"]).take(pa.array(places))
                yield pa.RecordBatch.from_arrays([*those.columns, pa.array(np.full(len(short), found.shape[1], np.int32)), lists(short)], names=["view_id", "line_id", "size", "short"])

    sketches = materialize(rows.mapInArrow(shorten, "view_id string, line_id string, size int, short array<float>"), "sketches")
    n = sketches.count()
    blocks = max(math.ceil(n / SKETCH_ROWS), min(8, math.ceil(n / BLOCK_ROWS)), 1)
    part = F.pmod(F.xxhash64("view_id"), F.lit(blocks)).cast("int")
    left = sketches.withColumn("i", part).withColumn("j", F.explode(F.sequence("i", F.lit(blocks - 1))))
    right = sketches.select(*(F.col(c).alias(f"{c}_") for c in sketches.columns), part.alias("j_")).withColumn("i_", F.explode(F.sequence(F.lit(0), "j_")))

    def block(x: pa.Table, y: pa.Table) -> pa.Table:
        out, y = [], y.rename_columns([c.removesuffix("_") for c in y.column_names])
        if not (x.num_rows and y.num_rows):
            return pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})
        x_size, y_size = (t.column("size").to_numpy() for t in (x, y))
        lines = x.column("line_id").combine_chunks().unique()
        for size in np.intersect1d(x_size, y_size):
            p, q = x.filter(pa.array(x_size == size)), y.filter(pa.array(y_size == size))
            p_line, q_line = (pc.index_in(t.column("line_id"), value_set=lines).fill_null(-1).to_numpy() for t in (p, q))
            u, v = (vectors_of(t.column("short"))[1].reshape(t.num_rows, -1) for t in (p, q))
            at_once = max(1, KNN_SCORES // len(v))
            for start in range(0, len(u), at_once):
                r, c = np.nonzero(u[start : start + at_once] @ v.T >= least)
                r += start
                apart = p_line[r] != q_line[c]
                out.append(pa.table({"a": p.column("view_id").take(pa.array(r[apart])), "b": q.column("view_id").take(pa.array(c[apart]))}))
        return pa.concat_tables(out) if out else pa.table({"a": pa.array([], pa.string()), "b": pa.array([], pa.string())})

    met = left.groupBy("i", "j").cogroup(right.groupBy("i_", "j_")).applyInArrow(block, "a string, b string")
    pairs = materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")  # a block meets itself both ways
    parts = max(1, math.ceil(n / BLOCK_ROWS))
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    placed = pairs.select(place("a").alias("i"), place("b").alias("j"), "a", "b")
    asked = placed.select(F.col("i").alias("i_"), F.col("j").alias("j_"), F.explode(F.array("a", "b")).alias("view_id")).distinct().join(rows.select("view_id", "shape"), "view_id")

    def exact(told: pa.Table, whole: pa.Table) -> pa.Table:
        ids = whole.column("view_id").combine_chunks()
        out, once = np.full(told.num_rows, -np.inf), ids.unique()
        first = pc.index_in(once, value_set=ids).to_numpy()
        i, j = (first[pc.index_in(told.column(c), value_set=once).to_numpy()] for c in ("a", "b"))
        drawn = outlines(whole.column("shape").combine_chunks(), points)
        for size in {found.shape[1] for _, _, found in drawn}:
            same = [(places, found) for _, places, found in drawn if found.shape[1] == size]
            table, row = np.concatenate([found for _, found in same]), np.full(whole.num_rows, -1)
            row[np.concatenate([places for places, _ in same])] = np.arange(len(table))
            those = np.flatnonzero((row[i] >= 0) & (row[j] >= 0))
            for start in range(0, len(those), SHAPE_ROWS):
                some = those[start : start + SHAPE_ROWS]
                out[some] = np.einsum("ij,ij->i", table[row[i[some]]], table[row[j[some]]])
        kept = pa.array(out >= least)
        return pa.table({"a": told.column("a").filter(kept), "b": told.column("b").filter(kept), "similarity": pa.array(out).filter(kept)})

    return placed.groupBy("i", "j").cogroup(asked.groupBy("i_", "j_")).applyInArrow(exact, "a string, b string, similarity double")


def surfaces(views: DataFrame, least: float = LEAST_COSINE, lines: int = LEAST_LINES, most_views: int = MOST_VIEWS, most_found: int = MOST_FOUND) -> DataFrame:
    """(surface_id, view_ids, least_similarity, mean_similarity): maximal sets of views, one per line, all alike.

    Sets lie inside connected components of alike views, so each component is searched by itself. A component of over
    ``most_views`` views, or with more than ``most_found`` sets, is refused.
    """
    schema = "surface_id string, view_ids array<string>, least_similarity double, mean_similarity double"
    pairs = materialize(alike(views, least), "alike")
    parts = materialize(connected_components(pairs), "components")
    large = parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most_views)
    if not large.isEmpty():
        raise RuntimeError(f"over {most_views} views are alike")

    def search(rows: pa.Table) -> pa.Table:
        import hashlib

        near, cosine = defaultdict(set), {}
        for a, b, score in zip(*(rows.column(c).to_pylist() for c in ("a", "b", "similarity"))):
            near[a].add(b)
            near[b].add(a)
            cosine[a, b] = score
        found = sorted(sorted(c) for c in cliques(near) if len(c) >= lines)
        if len(found) > most_found:
            raise RuntimeError(f"over {most_found} surfaces in one component")
        out = []
        for ids in found:
            scores = [cosine[a, b] for k, a in enumerate(ids) for b in ids[k + 1 :]]
            out.append(("surface_" + hashlib.sha256("|".join(ids).encode()).hexdigest()[:24], ids, min(scores), float(np.mean(scores))))
        kinds = {"surface_id": pa.string(), "view_ids": pa.list_(pa.string()), "least_similarity": pa.float64(), "mean_similarity": pa.float64()}
        return pa.table({name: pa.array([row[i] for row in out], kind) for i, (name, kind) in enumerate(kinds.items())})

    return pairs.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").applyInArrow(search, schema)
