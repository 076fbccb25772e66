"""A catalogue of structure snapshots: which came before which, and what stayed between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import jaccard


def with_previous(catalogue: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The catalogue (snapshot_id, cutoff) with ``previous_id``: of the snapshots with an earlier cutoff the latest, null for the first.

    Snapshots with the same cutoff have the same one before them; of several at one cutoff the greatest id counts. One sorted
    pass over the catalogue, a row a snapshot; ``keys`` set apart catalogues that lie in one table.
    """
    rows = catalogue.dropDuplicates(["snapshot_id", *(keys or [])])
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.unix_micros(F.col("cutoff").cast("timestamp"))).rangeBetween(Window.unboundedPreceding, -1)
    before = F.max(F.struct(F.unix_micros(F.col("cutoff").cast("timestamp")).alias("at"), "snapshot_id")).over(order)
    return rows.withColumn("previous_id", before["snapshot_id"])


def latest_before(catalogue: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked rows (cutoff, exclude_id) with ``snapshot_id``: of the snapshots strictly before the cutoff, but for the
    excluded one, the latest; null where there is none. ``exclude_id`` may be null.

    Both are merged by time and read in one sorted pass, so no ask is matched with the catalogue row by row.
    """
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    held = with_previous(catalogue)
    it = F.struct(micros("cutoff").alias("at"), F.col("snapshot_id"), F.col("twin_id"), F.col("previous_id"))
    # At one cutoff the two greatest ids: one of them is not the excluded one.
    pairs = held.groupBy("cutoff").agg(F.sort_array(F.collect_set("snapshot_id"), False).alias("ids"), F.max("previous_id").alias("previous_id"))
    rows = pairs.select("cutoff", F.col("ids")[0].alias("snapshot_id"), F.get("ids", F.lit(1)).alias("twin_id"), "previous_id")
    here = rows.select(micros("cutoff").alias("at"), it.alias("it"), F.lit(None).cast("long").alias("n"))
    ask = asked.select("cutoff", F.col("exclude_id").cast("string").alias("exclude_id")).withColumn("n", F.monotonically_increasing_id())
    there = ask.select(micros("cutoff").alias("at"), F.lit(None).cast(here.schema["it"].dataType).alias("it"), "n")
    order = Window.partitionBy(F.lit(0)).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    merged = here.unionByName(there).withColumn("best", F.max("it").over(order)).filter("n is not null").select("n", "best")
    # Each snapshot knows the one before it, so one excluded id leads to another answer in one step.
    other = F.coalesce(F.col("best.twin_id"), F.col("best.previous_id"))
    answer = F.when(F.col("best.snapshot_id").eqNullSafe(F.col("exclude_id")), other).otherwise(F.col("best.snapshot_id"))
    return ask.join(merged, "n").select("cutoff", "exclude_id", answer.alias("snapshot_id"))


def stability(observations: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The observations (snapshot_id, structure_id, members) with ``stability``: the Jaccard overlap with the same structure
    in the snapshot before theirs, 0 where there is none. All snapshots in one join.
    """
    order = with_previous(catalogue).select("snapshot_id", "previous_id")
    old = observations.select(F.col("snapshot_id").alias("previous_id"), "structure_id", F.col("members").alias("_old"))
    rows = observations.join(order, "snapshot_id").join(old, ["previous_id", "structure_id"], "left")
    return rows.withColumn("stability", F.when(F.col("_old").isNull(), 0.0).otherwise(jaccard(F.col("members"), F.col("_old"), 1.0))).drop("_old")
