"""Structure snapshots: observations at several scales, their diffs, and groups of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import identity, jaccard
from annalist.functions.vector import cosine
from annalist.operators.graph import connected_components
from annalist.operators.similarity import centroid, exact_knn

SCALES, LEAST, HIGHER_ORDER = (2, 4, 8), 0.75, 0.85


def observations(points: DataFrame, scales: tuple[int, ...] = SCALES, least: float = LEAST, knn: DataFrame | None = None) -> DataFrame:
    """(structure_id, center, k, members, support, dates) of every center at every scale.

    ``points`` has id, vector and occurred_on. The kNN is taken once, at the widest scale.
    """
    near = exact_knn(points, max(scales), least) if knn is None else knn
    near = near.join(points.select(F.col("id").alias("dst"), F.col("occurred_on").alias("dst_on")), "dst")
    per = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "similarity", "dst_on"))).alias("near"))
    rows = points.select(F.col("id").alias("center"), "occurred_on", F.explode(F.array(*map(F.lit, scales))).alias("k")).join(per, F.col("center") == F.col("src"), "left")
    taken = F.filter(F.coalesce("near", F.array().cast(per.schema["near"].dataType)), lambda s: s["rank"] <= F.col("k"))
    rows = rows.withColumn("taken", taken)
    total = F.aggregate("taken", F.lit(0.0), lambda s, x: s + x["similarity"])
    return rows.select(
        identity("obs_", F.col("center"), F.col("k")).alias("structure_id"), "center", "k",
        F.array_sort(F.array_distinct(F.concat(F.array("center"), F.transform("taken", lambda s: s["dst"])))).alias("members"),
        F.when(F.size("taken") > 0, total / F.size("taken")).otherwise(0.0).alias("support"),
        F.array_sort(F.array_distinct(F.concat(F.array("occurred_on"), F.transform("taken", lambda s: s["dst_on"])))).alias("dates"),
    )


def enrich(now: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """Adds stability (Jaccard with the same structure earlier), local_overlap (largest Jaccard with
    another observation) and participation (observations that hold the center).

    Overlaps come from an equality join on exploded members, so only observations that share one meet.
    """
    flat = now.select("structure_id", F.size("members").alias("size"), F.explode("members").alias("member"))
    other = flat.select(F.col("structure_id").alias("other_id"), F.col("size").alias("other_size"), "member")
    shared = flat.join(other, "member").filter("structure_id != other_id").groupBy("structure_id", "other_id").agg(F.count("*").alias("both"), F.first("size").alias("size"), F.first("other_size").alias("other_size"))
    overlap = shared.groupBy("structure_id").agg(F.max(F.col("both") / (F.col("size") + F.col("other_size") - F.col("both"))).alias("local_overlap"))
    holds = flat.groupBy(F.col("member").alias("center")).agg(F.count("*").alias("participation"))
    out = now.join(overlap, "structure_id", "left").join(holds, "center", "left").withColumn("local_overlap", F.coalesce("local_overlap", F.lit(0.0)))
    if earlier is None:
        return out.withColumn("stability", F.lit(0.0))
    old = earlier.select("structure_id", F.col("members").alias("old_members"))
    return out.join(old, "structure_id", "left").withColumn("stability", F.when(F.col("old_members").isNull(), 0.0).otherwise(jaccard(F.col("members"), F.col("old_members"), 1.0))).drop("old_members")


#: Every kind of change that :func:`diff` tells apart.
CHANGE_KINDS = ("new_members", "lost_or_weakened", "stronger", "reconnections", "reorganizations", "linked")


def snapshot_id(points: DataFrame, cutoff: Column, config: str) -> DataFrame:
    """One row: the id of a snapshot over these points, from ids, vectors to nine decimals, cutoff and configuration.

    The points' digests are summed, four parts each, so their order is no matter and no row gathers them.
    """
    whole = F.transform(F.col("vector"), lambda x: F.round(x * 1e9).cast("long").cast("string"))
    each = points.select(F.sha2(F.concat_ws("=", F.col("id").cast("string"), F.array_join(whole, ",")), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    text = F.concat_ws("|", cutoff.cast("string"), F.lit(config), F.count("*").cast("string"), *parts)
    return each.agg(F.concat(F.lit("snapshot_"), F.substring(F.sha2(text, 256), 1, 24)).alias("snapshot_id"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Long table (change_kind, structure_id, added, removed, related) between two sets of observations.

    new_members: new structures or added members; lost_or_weakened: removed members or any lower
    support; stronger: more support by over 1e-9, or added members; reconnections: from one member to
    several; reorganizations: vanished structures and those that overlap them; linked: pairs of groups
    that overlap now and did not before.
    """
    empty = F.array().cast(after.schema["members"].dataType)
    old = before.select("structure_id", F.col("members").alias("old_members"), F.col("support").alias("old_support"))
    both = after.select("structure_id", "members", "support").join(old, "structure_id", "full_outer")
    both = both.withColumns({"added": F.array_except(F.coalesce("members", empty), F.coalesce("old_members", empty)), "removed": F.array_except(F.coalesce("old_members", empty), F.coalesce("members", empty))})
    kept = F.col("members").isNotNull() & F.col("old_members").isNotNull()
    kinds = F.array_compact(F.array(
        F.when(F.col("members").isNotNull() & (F.size("added") > 0), F.lit("new_members")),
        F.when(kept & ((F.size("removed") > 0) | (F.col("support") < F.col("old_support"))), F.lit("lost_or_weakened")),
        F.when(kept & ((F.col("support") > F.col("old_support") + 1e-9) | (F.size("added") > 0)), F.lit("stronger")),
        F.when(kept & (F.size("old_members") == 1) & (F.size("members") > 1), F.lit("reconnections")),
    ))
    own = both.select(F.explode(kinds).alias("change_kind"), "structure_id", "added", "removed", F.array().cast("array<string>").alias("related"))
    gone = both.filter("members is null").select("structure_id", F.explode("old_members").alias("member"), F.col("old_members").alias("removed"))
    holds = after.select(F.col("structure_id").alias("other"), F.explode("members").alias("member"))
    moved = gone.join(holds, "member").groupBy("structure_id", "removed").agg(F.array_sort(F.collect_set("other")).alias("related"))
    moved = moved.select(F.lit("reorganizations").alias("change_kind"), "structure_id", empty.alias("added"), "removed", "related")

    def touching(rows: DataFrame) -> DataFrame:
        flat = rows.select("structure_id", F.explode("members").alias("member"))
        return flat.join(flat.select(F.col("structure_id").alias("other"), "member"), "member").filter("structure_id < other").select("structure_id", "other").distinct()

    linked = touching(after).join(touching(before), ["structure_id", "other"], "left_anti")
    linked = linked.select(F.lit("linked").alias("change_kind"), "structure_id", empty.alias("added"), empty.alias("removed"), F.array("other").alias("related"))
    return own.unionByName(moved).unionByName(linked)


def effective_groups(rows: DataFrame) -> DataFrame:
    """One observation for each member set of two or more: the best by support, then id."""
    names = rows.columns
    several = rows.filter(F.size("members") >= 2).withColumn("members", F.array_sort("members"))
    top = several.groupBy("members").agg(F.max("support").alias("support"))
    return several.join(top, ["members", "support"]).groupBy("members").agg(F.min_by(F.struct(*names), "structure_id").alias("g")).select("g.*")


def sharing(groups: DataFrame) -> DataFrame:
    """(left_id, right_id, shared): groups that share a member, and how many. Only they meet, in an equality join."""
    flat = groups.select("structure_id", F.explode("members").alias("id"))
    return flat.join(flat.select(F.col("structure_id").alias("right_id"), "id"), "id").filter("structure_id < right_id").groupBy(F.col("structure_id").alias("left_id"), "right_id").agg(F.count("*").alias("shared"))


def higher_order(groups: DataFrame, vectors: DataFrame, least: float = HIGHER_ORDER) -> DataFrame:
    """(left_id, right_id, shared, strength): groups that share a member (strength 1 at least), or whose
    centroids are near and that both span two dates or more.

    ``vectors`` has id and vector. Sharing pairs come from :func:`sharing`, which whoever asks for them alone calls; the others
    from the kNN of centroids of groups on several dates, which compares all of them.
    """
    flat = groups.select("structure_id", F.explode("members").alias("id"))
    centers = centroid(flat.join(vectors.select("id", "vector"), "id"), "structure_id")
    shared = sharing(groups)
    c = centers.select(F.col("structure_id").alias("right_id"), F.col("centroid").alias("right_c"))
    scored = shared.join(centers.withColumnRenamed("structure_id", "left_id"), "left_id").join(c, "right_id").select("left_id", "right_id", "shared", F.greatest(F.lit(1.0), cosine(F.col("centroid"), F.col("right_c"))).alias("strength"))
    spread = groups.filter(F.size("dates") >= 2).select("structure_id")
    wide = centers.join(spread, "structure_id").select(F.col("structure_id").alias("id"), F.col("centroid").alias("vector"))
    near = exact_knn(wide, max(1, wide.count() - 1), least).filter("src < dst").select(F.col("src").alias("left_id"), F.col("dst").alias("right_id"), F.lit(0).cast("long").alias("shared"), F.col("similarity").alias("strength"))
    return scored.unionByName(near.join(shared, ["left_id", "right_id"], "left_anti"))


def expand(pairs: DataFrame, groups: DataFrame, bridge: DataFrame) -> DataFrame:
    """(left_id, right_id, evidence): the evidence behind both groups, through frozen states.

    A group's evidence is gathered once, however many pairs it is in.
    """
    rests = groups.select("structure_id", F.explode("members").alias("id")).join(bridge, "id").groupBy("structure_id").agg(F.collect_set("evidence_id").alias("evidence"))
    side = lambda name: rests.select(F.col("structure_id").alias(f"{name}_id"), F.col("evidence").alias(name))
    met = pairs.select("left_id", "right_id").distinct().join(side("left"), "left_id", "left").join(side("right"), "right_id", "left")
    none = F.array().cast(rests.schema["evidence"].dataType)
    both = F.array_sort(F.array_union(F.coalesce("left", none), F.coalesce("right", none)))
    return met.select("left_id", "right_id", both.alias("evidence")).filter(F.size("evidence") > 0)


def regions(points: DataFrame, k: int, least: float, overlap: float, smallest: int) -> tuple[DataFrame, DataFrame]:
    """((id, region), (id, isolated)): connected components of points whose neighbourhoods overlap.

    The second frame lists points left out: isolated ones without a neighbour, and those of regions
    under ``smallest``.
    """
    near = exact_knn(points, k, least)
    every = near.select("src", F.col("dst").alias("member")).unionByName(points.select(F.col("id").alias("src"), F.col("id").alias("member")))
    sizes = every.groupBy("src").agg(F.count("*").alias("n"))
    shared = every.join(every.select(F.col("src").alias("other"), "member"), "member").filter("src < other").groupBy("src", "other").agg(F.count("*").alias("both"))
    pairs = shared.join(sizes, "src").join(sizes.select(F.col("src").alias("other"), F.col("n").alias("m")), "other").filter(F.col("both") / (F.col("n") + F.col("m") - F.col("both")) >= overlap)
    parts = connected_components(pairs, "src", "other")
    large = parts.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") >= smallest).select("component")
    found = parts.join(large, "component", "left_semi").select(F.col("node").alias("id"), F.col("component").alias("region"))
    rest = points.select("id").join(found, "id", "left_anti").join(near.select(F.col("src").alias("id")).distinct().withColumn("near", F.lit(True)), "id", "left")
    return found, rest.select("id", F.col("near").isNull().alias("isolated"))
