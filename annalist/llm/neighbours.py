"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors of length one are projected to a few dimensions by a Gaussian matrix. Of two vectors at
distance d, the squared projected distance over d squared is chi-square distributed. So a search that
visits points in the order of their projected distance may stop once that exceeds the quantile of the
best distances found so far: a nearer neighbour would be that far off in projection only with the
small probability left over. Leaves of the kd-tree come in the order of their distance, and of a leaf
only the points that pass the test are verified on their whole vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.scratch import materialize

#: Rows of a cell that one task searches; points of a leaf; cells of the routing tree at most.
CELL_ROWS, LEAF_ROWS, MOST_CELLS = 8192, 64, 1024
#: Queries that meet a cell's points in one task at most, on average: a cell is copied to as many tasks as that takes.
TASK_QUERIES = 2048
#: Points the routing tree is fitted on at most.
SAMPLE_ROWS = 16384


def chi_square_quantile(p: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(freedom // 2))

    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def project(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True) @ directions


class Splits:
    """The top of the kd-tree: the cell of a point. Inner nodes split the widest axis at the median."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(2**depth, np.int64), np.full(2**depth, np.inf)
        todo = [(1, sample)]
        for node, points in todo:
            if node < 2**depth and len(points):
                axis = int(np.argmax(np.ptp(points, axis=0)))
                self.axis[node], self.at[node] = axis, np.median(points[:, axis])
                right = points[:, axis] > self.at[node]
                todo += [(2 * node, points[~right]), (2 * node + 1, points[right])]

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - 2**self.depth


class Tree:
    """The kd-tree of one cell, down to leaves, with the box of each leaf."""

    def __init__(self, points: np.ndarray):
        leaves, todo = [], [np.arange(len(points))]
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF_ROWS:
                leaves.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        size = max(map(len, leaves))
        self.rows = np.stack([np.append(r, np.full(size - len(r), -1)) for r in leaves])
        self.low = np.stack([points[r].min(0) for r in leaves])
        self.high = np.stack([points[r].max(0) for r in leaves])


def box_distance(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query from each box."""
    total = np.zeros((len(queries), len(low)))
    for axis in range(queries.shape[1]):
        q = queries[:, axis, None]
        total += np.maximum(np.maximum(low[None, :, axis] - q, q - high[None, :, axis]), 0) ** 2
    return total


def search(points: np.ndarray, keys: np.ndarray, queries: np.ndarray, bound: np.ndarray, directions: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(cosines, rows, verified): the ``k`` best points for each query, row -1 where there are fewer, and
    how many pairs of whole vectors were compared for them.

    ``bound`` is a cosine that the k-th best of a query is known to reach (-1: nothing known).
    """
    projected, asked = project(points, directions), project(queries, directions)
    units, query_units = points / np.linalg.norm(points, axis=1, keepdims=True), queries / np.linalg.norm(queries, axis=1, keepdims=True)
    tree = Tree(projected)
    best, rows = np.full((len(queries), k), -np.inf), np.full((len(queries), k), -1)
    verified = 0
    for at in range(0, len(queries), 256):
        block = np.arange(at, min(at + 256, len(queries)))
        far = box_distance(asked[block], tree.low, tree.high)
        order = np.argsort(far, 1, kind="stable")
        for turn in range(order.shape[1]):
            reach = np.maximum(best[block, -1], bound[block])
            radius = np.where(reach <= -1, np.inf, np.maximum(2 - 2 * reach, 1e-12) * limit)
            going = np.flatnonzero(far[np.arange(len(block)), order[:, turn]] <= radius)
            if not len(going):
                break
            q = block[going]
            found = tree.rows[order[going, turn]]
            apart = ((projected[found] - asked[q][:, None, :]) ** 2).sum(2)
            i, j = np.nonzero((found >= 0) & (apart <= radius[going][:, None]))
            verified += len(i)
            cosine = np.full(found.shape, -np.inf)
            cosine[i, j] = np.einsum("pd,pd->p", units[found[i, j]], query_units[q[i]])
            found = np.where(cosine == -np.inf, -1, found)
            near, who = np.concatenate([best[q], cosine], 1), np.concatenate([rows[q], found], 1)
            top = np.lexsort((np.where(who < 0, np.iinfo(np.int64).max, keys[who]), -near), axis=1)[:, :k]
            best[q], rows[q] = np.take_along_axis(near, top, 1), np.take_along_axis(who, top, 1)
    for i in np.flatnonzero(rows[:, 0] >= 0).tolist():  # the measure itself, on the vectors as they are
        known = rows[i] >= 0
        v = points[rows[i, known]]
        best[i, known] = v @ queries[i] / (np.linalg.norm(v, axis=1) * np.linalg.norm(queries[i]))
    return best, rows, verified


def usable(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v, h) of the rows that take part; vectors whose squares leave the range of doubles are scaled to 1."""
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    rows = rows.filter(~odd).withColumn("most", most).filter("most > 0")
    scaled = F.when((F.col("most") > 1e150) | (F.col("most") < 1e-150), F.transform("v", lambda x: F.try_divide(x, F.col("most")))).otherwise(F.col("v"))
    return rows.select("vec_id", scaled.alias("v")).withColumn("h", F.xxhash64("v"))


def nearest(
    embeddings: DataFrame,
    every: int = 50,
    k: int = 5,
    dims: int = 16,
    confidence: float = 0.9,
    seed: int = 42,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine for each query.

    Queries are the rows whose id is divisible by ``every``; they meet all rows but their own, ties
    going to the smaller id. The score is the cosine of the original vectors in double precision.

    Equal vectors are indexed once with their k + 1 smallest ids, which is all that any query can
    return of them, so a vector that many rows share costs one point. The kd-tree's top is fitted on
    at most SAMPLE_ROWS points and gives at most MOST_CELLS cells; every point is indexed. A cell too
    large for one task is split by hash, and its queries visit each part; a cell with over
    TASK_QUERIES queries is copied, so that no task holds more. Queries search their own cell first;
    the k-th best found there bounds, by the chi-square test at ``confidence``, which other cells'
    boxes they go to. ``dims`` must be even.

    Rows take no part whose id or vector is null, or whose vector is empty, zero, or holds null or
    non-finite components, or has another length than most (the greater of equally frequent ones).
    Rows that repeat an id and vector count once. An empty table gives no rows; other columns are not
    read.
    """
    spark = embeddings.sparkSession
    rows = usable(embeddings, id_col, vector_col)
    lengths = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    first = lengths[0].size
    rows = rows.filter(F.size("v") == first)
    place = F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    points = rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    points = materialize(points.select(F.col("ids")[0].alias("key"), "h", "v", "ids"), "points")
    asked = materialize(rows.filter(F.col("vec_id") % every == 0).select("vec_id", "h", "v").join(points.select("key", "h", "v"), ["h", "v"]).select(F.col("vec_id").alias("query_id"), "key").distinct(), "asked")

    directions = np.random.default_rng(seed).standard_normal((first, dims))
    limit = chi_square_quantile(confidence, dims)
    n = points.count()
    depth = max(0, min(math.ceil(math.log2(max(1, n / CELL_ROWS))), int(math.log2(MOST_CELLS))))
    sample = points.select("v").orderBy(F.xxhash64("key", F.lit(seed))).limit(SAMPLE_ROWS).toArrow() if depth else None
    splits = Splits(project(matrix(sample.column(0), first), directions), depth) if depth else Splits(np.empty((0, dims)), 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = project(matrix(batch.column(1), first), directions)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splits.cells(p)), pa.ListArray.from_arrays(np.arange(0, p.size + 1, dims, np.int32), p.ravel())], names=["key", "v", "ids", "cell", "p"])

    placed = materialize(points.select("key", "v", "ids").mapInArrow(assign, "key long, v array<double>, ids array<long>, cell long, p array<double>"), "placed")
    edges = [f(F.col("p")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").toPandas()  # MOST_CELLS rows at most
    cells, parts = boxes["cell"].to_numpy(), np.ceil(boxes["n"].to_numpy() / (1.5 * CELL_ROWS)).astype(np.int64)
    low, high = boxes[[f"low{i}" for i in range(dims)]].to_numpy(), boxes[[f"high{i}" for i in range(dims)]].to_numpy()
    of_cell = lambda counts: F.element_at(F.create_map(*(F.lit(int(x)) for pair in zip(cells, counts) for x in pair)), F.col("cell").cast("int")).cast("long")
    n_parts = of_cell(parts)
    split = placed.select("cell", F.pmod(F.xxhash64("key"), n_parts).alias("part"), "key", "v", "ids")
    asking = placed.join(asked.select("key").distinct(), "key", "left_semi").select("cell", "key", "v")
    found_schema = "query long, key long, score double, ids array<long>"

    def within(shard: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query": [], "key": [], "score": [], "ids": []}
        if shard.num_rows and queries.num_rows:
            keys = shard.column("key").to_numpy()
            best, who, _ = search(matrix(shard.column("v"), first), keys, matrix(queries.column("to_v"), first), queries.column("to_bound").to_numpy(), directions, k + 1, limit)
            q, j = np.nonzero(who >= 0)
            ids = shard.column("ids").to_pylist()
            out = {"query": queries.column("to_key").to_numpy()[q], "key": keys[who[q, j]], "score": best[q, j], "ids": [ids[i] for i in who[q, j].tolist()]}
        types = {"query": pa.int64(), "key": pa.int64(), "score": pa.float64(), "ids": pa.list_(pa.int64())}
        return pa.table({c: pa.array(out[c], t) for c, t in types.items()})

    def searched(pairs: DataFrame) -> DataFrame:
        """``pairs`` (cell, bound, key): which cells each query visits. Vectors go along only here."""
        counted = {r.cell: r["count"] for r in pairs.groupBy("cell").count().collect()}  # MOST_CELLS rows at most
        slots = of_cell([max(1, -(-counted.get(int(c), 0) // TASK_QUERIES)) for c in cells])
        queries = pairs.join(asking.select("key", "v"), "key").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("part"), F.pmod(F.xxhash64("key", F.lit(1)), slots).alias("slot"), "bound", "key", "v")
        queries = queries.select(*(F.col(c).alias(f"to_{c}") for c in queries.columns))
        shards = split.select("*", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1)).alias("slot"))
        return shards.groupBy("cell", "part", "slot").cogroup(queries.groupBy("to_cell", "to_part", "to_slot")).applyInArrow(within, found_schema)

    best_first = Window.partitionBy("query").orderBy(F.desc("score"), "key")
    at_home = materialize(searched(asking.select("cell", F.lit(-1.0).alias("bound"), "key")), "home")
    reached = at_home.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") == k + 1).select(F.col("query").alias("key"), F.col("score").alias("bound"))
    travellers = asking.join(reached, "key", "left").select("key", "v", "cell", F.coalesce("bound", F.lit(-1.0)).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, bound = matrix(batch.column(1), first), batch.column(3).to_numpy()
            radius = np.where(bound <= -1, np.inf, np.maximum(2 - 2 * bound, 1e-12) * limit)
            go = (box_distance(project(v, directions), low, high) <= radius[:, None]) & (cells[None, :] != batch.column(2).to_numpy()[:, None])
            q, c = np.nonzero(go)
            for at in range(0, len(q), 65536):
                i = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays([pa.array(cells[c[i]].astype(np.int64)), pa.array(bound[q[i]]), batch.column(0).take(pa.array(q[i]))], names=["cell", "bound", "key"])

    found = at_home
    if len(cells) > 1:
        found = at_home.unionAll(searched(materialize(travellers.mapInArrow(route, "cell long, bound double, key long"), "routes")))
    top = found.withColumn("place", F.row_number().over(best_first)).filter(F.col("place") <= k + 1).select(F.col("query").alias("key"), "score", "ids")
    pairs = asked.join(top, "key").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id != query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
