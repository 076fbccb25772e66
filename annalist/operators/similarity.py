"""Exact neighbourhoods of vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.vector import hash_embedding
from annalist.scratch import materialize

#: Rows of one block of the distance matrix's side.
BLOCK_ROWS = 4096
#: Rows of a block of :func:`exact_knn`, the largest k with blocks of that size, and scores that are held at once.
KNN_ROWS, KNN_K, KNN_SCORES = 16_384, 256, 1 << 23
#: Components of a block's vectors up to which it may have four times as many rows.
BLOCK_COMPONENTS = 1 << 22
#: Scores of single precision that :func:`nearest` looks at together: so many stay in a core's cache.
NEAR_SCORES = 1 << 20
#: Points that :func:`rising` takes first, cutoffs of a stretch, and parts of the points for which stretches are written out.
FIRST_PART, CUTOFFS, PARTS = 16, 128, 64


def embed(states: DataFrame, given: str | None = "vector", text: str = "content") -> DataFrame:
    """``vector``: the supplied one where it has members, else the hash embedding of the text."""
    made = hash_embedding(text)
    if given and given in states.columns:
        made = F.when(F.size(given) > 0, F.col(given).cast("array<double>")).otherwise(made)
    return states.withColumn("vector", made)


def nearest(queries: np.ndarray, points: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) by place: each query's ``k`` points of largest cosine, ``least`` at least, best first, places breaking ties.

    A product of matrices finds them, some queries at a time. A row is cut into k parts or more; the k-th largest of their
    maxima is no more than the k-th largest score, so what lies below it is left out unsorted. The product is one of single
    precision, whose error is bounded and allowed for; what is not left out is computed again in double precision, pair by
    pair, so that equal vectors have equal scores wherever they stand.
    """
    na, nb = np.linalg.norm(queries, axis=1), np.linalg.norm(points, axis=1)
    unit = lambda rows, size: np.divide(rows, size[:, None], out=np.zeros_like(rows), where=(size > 0)[:, None] & np.isfinite(size)[:, None])
    a, b, endless = unit(queries, na).astype(np.float32), unit(points, nb).astype(np.float32).T, np.flatnonzero(np.isinf(nb))
    n, parts = len(points), max(1, min(len(points), 4 * k))
    width, at_once = n // parts, max(1, NEAR_SCORES // max(1, n))
    error = (points.shape[1] + 8) * 2.0**-23  # of a score of unit vectors, twice what sums of so many rounded products can lose
    found, room = [], np.empty((min(at_once, len(queries)), n), np.float32)
    for start in range(0, len(queries), at_once):
        some = a[start : start + at_once]
        scores = np.matmul(some, b, out=room[: len(some)])
        scores[:, endless] = -np.inf
        floor = np.full(len(scores), least)
        if k < parts:
            tops = scores[:, : parts * width].reshape(len(scores), parts, width).max(axis=2)
            floor = np.maximum(floor, np.partition(tops, parts - k, axis=1)[:, parts - k])
        i, j = np.divmod(np.flatnonzero(scores >= (floor - 2 * error).astype(np.float32)[:, None]), n)
        i += start
        dots = [np.einsum("ij,ij->i", queries[i[p : p + 65536]], points[j[p : p + 65536]]) for p in range(0, len(i), 65536)]
        scale = na[i] * nb[j]
        exact = np.divide(np.concatenate(dots or [np.empty(0)]), scale, out=np.zeros(len(i)), where=scale > 0)
        found.append(best(i[exact >= least], j[exact >= least], exact[exact >= least], k))
    return tuple(np.concatenate([f[c] for f in found] or [np.empty(0, t)]) for c, t in enumerate((np.int64, np.int64, np.float64)))


def best(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each ``i`` the ``k`` rows of largest score, lesser ``j`` first."""
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]][: len(i)])
    kept = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)])) < k
    return i[kept], j[kept], score[kept]


def vectors_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(size of each vector, all their components) of a column of arrays."""
    flat = column.combine_chunks()
    return flat.value_lengths().to_numpy(zero_copy_only=False), flat.flatten().to_numpy(zero_copy_only=False)


def exact_knn(points: DataFrame, k: int, least: float = -1.0, id_col: str = "id", vector_col: str = "vector", queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, similarity, rank): for each query the ``k`` other points of largest cosine, ids breaking ties.

    Points with null or empty vectors are skipped; a zero vector has cosine 0 with everything, and so
    have vectors of different sizes. The distance matrix is computed in blocks: both sides are hashed
    to blocks of about KNN_ROWS rows, or up to four times as many of short vectors, as each row is moved
    once for every block; matrix products a pair of blocks, and only each query's best k of a block leave
    it. Vectors of single precision are moved as such. The result is a table: whoever reads it several
    times computes it once. ``queries`` (default: all points) may be a subset of the points.
    """
    narrow = points.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = points.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v")).filter("id is not null and size(v) > 0")
    asked = rows if queries is None else rows.join(queries.select(F.col(id_col).alias("id")).distinct(), "id", "left_semi")
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    at_most = max(KNN_ROWS, min(4 * KNN_ROWS, BLOCK_COMPONENTS // (longest or 1)))
    blocks = max(math.ceil(n / (at_most if k <= KNN_K else BLOCK_ROWS // 2)), min(8, math.ceil(n / BLOCK_ROWS)), 1)
    id_type = rows.schema["id"].dataType
    part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = asked.select(part.alias("a"), F.explode(every).alias("b"), F.col("id").alias("qid"), F.col("v").alias("qv"))
    right = rows.select(F.explode(every).alias("ra"), part.alias("rb"), F.col("id").alias("pid"), F.col("v").alias("pv"))
    schema = f"src {id_type.simpleString()}, dst {id_type.simpleString()}, similarity double"

    def block(queries: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by("pid")  # places stand for ids where scores are equal
        qid, pid = queries.column("qid").combine_chunks(), points.column("pid").combine_chunks()
        (q_sizes, qv), (p_sizes, pv) = vectors_of(queries.column("qv")), vectors_of(points.column("pv"))
        p_code, q_code = (pc.index_in(ids, value_set=pid.unique()).fill_null(-1).to_numpy(zero_copy_only=False) for ids in (pid, qid))
        out = []
        for size in np.unique(q_sizes):
            qs, ps = np.flatnonzero(q_sizes == size), np.flatnonzero(p_sizes == size)
            if not len(ps):
                continue
            a, b = (flat[np.repeat(sizes == size, sizes)].reshape(-1, size).astype(np.float64) for flat, sizes in ((qv, q_sizes), (pv, p_sizes)))
            i, j, score = nearest(a, b, k + 1, least)
            i, j = qs[i], ps[j]
            other = q_code[i] != p_code[j]
            i, j, score = best(i[other], j[other], score[other], k)
            out.append(pa.table({"src": qid.take(pa.array(i)), "dst": pid.take(pa.array(j)), "similarity": pa.array(score)}))
        return pa.concat_tables(out) if out else pa.table({"src": qid[:0], "dst": pid[:0], "similarity": pa.array([], pa.float64())})

    found = left.groupBy("a", "b").cogroup(right.groupBy("ra", "rb")).applyInArrow(block, schema)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("similarity"), "dst"))
    return materialize(found.withColumn("rank", rank).filter(F.col("rank") <= k), "knn")


def relation_pairs(knn: DataFrame, digits: int = 6) -> DataFrame:
    """(left_id, right_id, similarity): pairs in the top k of either end, the larger similarity rounded."""
    return knn.groupBy(F.least("src", "dst").alias("left_id"), F.greatest("src", "dst").alias("right_id")).agg(F.round(F.max("similarity"), digits).alias("similarity"))


def mutual_edges(knn: DataFrame) -> DataFrame:
    """(a, b, score): reciprocal neighbours, a < b, with the lesser of both similarities."""
    pairs = knn.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.agg(F.count("*").alias("n"), F.min("similarity").alias("score")).filter("n = 2").drop("n")


def centroid(rows: DataFrame, key: str, vector: str = "vector") -> DataFrame:
    """(key, centroid): the mean of each dimension; empty where a group's vectors differ in size."""
    flat = rows.select(key, F.size(vector).alias("size"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = flat.groupBy(key, "i").agg(F.avg("x").alias("x"), F.min("size").alias("low"), F.max("size").alias("high"))
    return means.groupBy(key).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(
        key, F.when(F.col("low") == F.col("high"), F.transform("c", lambda s: s["x"])).otherwise(F.array().cast("array<double>")).alias("centroid")
    )


def rising(queries: np.ndarray, points: np.ndarray, q_time: np.ndarray, p_time: np.ndarray, q_code: np.ndarray, p_code: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) by place: at least those that are among a query's ``k`` best when they enter.

    Points are in time order. What is no later than the query enters with it, so the best k of it stay. Later ones are taken
    in parts that double: a point that is less than the k-th best before its part is left out. Scores of single precision
    choose, some queries at a time, with their error allowed for; what is not left out is computed again in double precision.
    """
    na, nb = np.linalg.norm(queries, axis=1), np.linalg.norm(points, axis=1)
    unit = lambda rows, size: np.divide(rows, size[:, None], out=np.zeros_like(rows), where=(size > 0)[:, None])
    a, b, n = unit(queries, na).astype(np.float32), unit(points, nb).astype(np.float32).T, len(points)
    found = [(np.empty(0, int), np.empty(0, int))]
    at_once, error = max(1, NEAR_SCORES // n), (points.shape[1] + 8) * 2.0**-23  # as in :func:`nearest`
    low = np.float32(least - 2 * error)

    def tops(scores: np.ndarray, so_far: np.ndarray) -> np.ndarray:
        """No more than the k best of each row's scores and of ``so_far``, the least first: a row counts by the maxima of its parts."""
        parts = min(scores.shape[1], 4 * k)
        width = scores.shape[1] // parts
        both = np.concatenate([so_far, scores[:, : parts * width].reshape(len(scores), parts, width).max(axis=2)], axis=1)
        return np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)

    def take(scores: np.ndarray, floor: np.ndarray, row: int, column: int) -> None:
        i, j = np.divmod(np.flatnonzero(scores >= np.maximum(floor - np.float32(2 * error), low)[:, None]), scores.shape[1])
        found.append((i + row, j + column))

    for start in range(0, len(queries), at_once):
        rows = np.arange(start, min(start + at_once, len(queries)))
        scores, none = a[rows] @ b, np.full((len(rows), k), -np.inf, np.float32)
        scores[(q_code[rows][:, None] == p_code[None, :]) | ~(scores >= low)] = -np.inf
        first, last = q_time[rows].min(), q_time[rows].max()
        after, top, begin = scores, none, 0
        if p_time[-1] <= first:
            take(scores, tops(scores, none)[:, 0], start, 0)
            continue
        if p_time[0] <= last:
            before = p_time[None, :] <= q_time[rows][:, None]
            past, after = np.where(before, scores, -np.inf).astype(np.float32), np.where(before, -np.inf, scores).astype(np.float32)
            top = np.sort(np.partition(past, n - k, axis=1)[:, n - k :], axis=1) if n > k else none
            take(past, top[:, 0], start, 0)
        while begin < n:
            part = after[:, begin : max(2 * begin, FIRST_PART)]
            take(part, top[:, 0], start, begin)
            top = tops(part, top)
            begin += part.shape[1]
    i, j = (np.concatenate(c) for c in zip(*found))
    dots = [np.einsum("ij,ij->i", queries[i[p : p + 65536]], points[j[p : p + 65536]]) for p in range(0, len(i), 65536)]
    scale = na[i] * nb[j]
    exact = np.divide(np.concatenate(dots or [np.empty(0)]), scale, out=np.zeros(len(i)), where=scale > 0)
    return i[exact >= least], j[exact >= least], exact[exact >= least]


def prefix_replay(points: DataFrame, k: int, least: float = -1.0, id_col: str = "id", time_col: str = "occurred_at", vector_col: str = "vector", digits: int = 12) -> DataFrame:
    """(cutoff, src, dst, similarity, rank): the kNN of every point among those up to each time.

    Points are dealt into blocks by their place in time, one matrix product a pair of blocks. A pair leaves it only if it is
    among a point's best k of the block at some time (:func:`rising`); the others could enter no list. Of each point's
    pairs a row per change of its list follows, with the span of cutoffs in which it holds, and spans are written out from
    stretches of cutoffs. Vectors of single precision are moved as such.
    """
    narrow = points.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = points.select(F.col(id_col).alias("id"), F.col(time_col).alias("t"), F.col(vector_col).cast("array<float>" if narrow else "array<double>").alias("v"))
    # Times as places in their order: exact whatever their type is.
    at = materialize(rows.select("t").distinct().select("t", F.row_number().over(Window.orderBy("t")).cast("long").alias("place")), "times")
    placed = materialize(rows.join(at, "t").filter("id is not null and size(v) > 0").select("id", "place", "v"), "placed")
    total, last = placed.count(), at.count()
    blocks = max(math.ceil(total / KNN_ROWS), min(8, math.ceil(total / BLOCK_ROWS)), 1)
    stretch = max(1, math.ceil(last / blocks))
    part = F.least(F.floor((F.col("place") - 1) / stretch), F.lit(blocks - 1)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = placed.select(part.alias("a"), F.explode(every).alias("b"), F.col("id").alias("src"), F.col("place").alias("src_t"), F.col("v").alias("qv"))
    right = placed.select(F.explode(every).alias("ra"), part.alias("rb"), F.col("id").alias("dst"), F.col("place").alias("dst_t"), F.col("v").alias("pv"))
    id_type = placed.schema["id"].dataType.simpleString()

    def block(queries: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by([("dst_t", "ascending"), ("dst", "ascending")])
        src, dst = queries.column("src").combine_chunks(), others.column("dst").combine_chunks()
        src_t, dst_t = queries.column("src_t").to_numpy(), others.column("dst_t").to_numpy()
        (q_sizes, qv), (p_sizes, pv) = vectors_of(queries.column("qv")), vectors_of(others.column("pv"))
        once = dst.unique()
        q_code, p_code = (pc.index_in(ids, value_set=once).fill_null(-1).to_numpy(zero_copy_only=False) for ids in (src, dst))
        out = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
        for size in np.intersect1d(q_sizes, p_sizes):
            qs, ps = np.flatnonzero(q_sizes == size), np.flatnonzero(p_sizes == size)
            u, w = (flat[np.repeat(sizes == size, sizes)].reshape(-1, size).astype(np.float64) for flat, sizes in ((qv, q_sizes), (pv, p_sizes)))
            i, j, score = rising(u, w, src_t[qs], dst_t[ps], q_code[qs], p_code[ps], k, least)
            out.append((qs[i], ps[j], score))
        i, j, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"src": src.take(pa.array(i)), "dst": dst.take(pa.array(j)), "similarity": pa.array(score), "src_t": pa.array(src_t[i]), "dst_t": pa.array(dst_t[j])})

    timed = left.groupBy("a", "b").cogroup(right.groupBy("ra", "rb")).applyInArrow(block, f"src {id_type}, dst {id_type}, similarity double, src_t long, dst_t long")
    kind = dict(timed.dtypes)
    schema = f"src {kind['src']}, dst {kind['dst']}, similarity double, rank int, since long, until long"

    def changes(group: pa.Table) -> pa.Table:
        dst, score = group.column("dst").to_pylist(), group.column("similarity").to_pylist()
        enters = [max(a, b) for a, b in zip(group.column("src_t").to_pylist(), group.column("dst_t").to_pylist())]
        places = group.column("dst_t").to_pylist()
        best: list[tuple] = []  # (-similarity, place, dst, cutoff since when it has its rank)
        out: list[tuple] = []
        order = sorted(range(len(dst)), key=lambda i: enters[i])
        n = 0
        while n < len(order):
            now = enters[order[n]]
            come = []
            while n < len(order) and enters[order[n]] == now:
                i = order[n]
                come.append((-score[i], places[i], dst[i], now))
                n += 1
            then = sorted([*best, *come], key=lambda x: x[:3])[:k]
            for rank, old in enumerate(best):
                if then[rank][:3] != old[:3]:
                    out.append((old[2], -old[0], rank + 1, old[3], now))
            best = [old if rank < len(best) and (old := best[rank])[:3] == new[:3] else (*new[:3], now) for rank, new in enumerate(then)]
        out += [(b[2], -b[0], rank + 1, b[3], None) for rank, b in enumerate(best)]
        out.sort(key=lambda o: o[2:4])
        ids = group.schema.field("src").type
        return pa.table({
            "src": pa.array([group.column("src")[0].as_py()] * len(out), ids), "dst": pa.array([o[0] for o in out], ids), "similarity": pa.array([o[1] for o in out], pa.float64()),
            "rank": pa.array([o[2] for o in out], pa.int32()), "since": pa.array([o[3] for o in out], pa.int64()), "until": pa.array([o[4] for o in out], pa.int64()),
        })

    spans = timed.groupBy("src").applyInArrow(changes, schema)
    # A part of the points meets all cutoffs, so no span is moved once for each stretch. A merge join takes a stretch and passes
    # over the part's spans by point and rank: the same cutoffs follow each other again and again, which files hold in little room.
    held = spans.select(F.pmod(F.xxhash64("src"), F.lit(PARTS)).alias("part"), "src", "dst", F.round("similarity", digits).alias("similarity"), "rank", "since", F.coalesce("until", F.lit(last + 1)).alias("until"))
    cuts = at.groupBy(F.floor((F.col("place") - 1) / CUTOFFS).alias("cut")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]).alias("ts"))
    cuts = cuts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))).alias("at"), (F.col("cut") * CUTOFFS + 1).alias("first"), "ts")
    tasks = 4 * PARTS  # so that few parts share one
    begin, end = F.greatest("since", "first"), F.least("until", F.col("first") + CUTOFFS)
    met = cuts.repartition(tasks, "at").hint("merge").join(held.repartition(tasks, "part"), (F.col("at") == F.col("part")) & (begin < end))
    return met.select(F.explode(F.slice("ts", (begin - F.col("first") + 1).cast("int"), (end - begin).cast("int"))).alias("cutoff"), "src", "dst", "similarity", "rank")
