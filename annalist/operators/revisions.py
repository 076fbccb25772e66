"""Drafts, accepted revisions, rejections and what an invalidated item takes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import content_hash, identity


def draft_heads(events: DataFrame) -> DataFrame:
    """Latest row of each draft from its append-only events; support arrays lose repeats, in order."""
    names = events.columns
    rows = events.withColumn("support", F.array_distinct("support"))
    return rows.groupBy("worktree_id").agg(F.max_by(F.struct(*names), F.struct("updated_at", "event_id")).alias("d")).select("d.*")


def open_draft(drafts: DataFrame) -> DataFrame:
    """Of each region the oldest open draft: the one that evaluation goes on with."""
    names = drafts.columns
    return drafts.filter("status = 'OPEN'").groupBy("region_id").agg(F.min_by(F.struct(*names), F.struct("updated_at", "worktree_id")).alias("d")).select("d.*")


def support_identity(relation: Column, structures: Column, regions: Column, states: Column, content: Column) -> Column:
    """What counts as one observation: structures and content, or for frontier relations regions, states and content."""
    frontier = relation.isin("ABSORPTION", "BOUNDARY")
    parts = F.when(frontier, F.concat_ws("#", F.array_join(F.array_sort(regions), ","), F.array_join(F.array_sort(states), ","))).otherwise(F.array_join(F.array_sort(structures), ","))
    return identity("support_", relation, parts, content)


def observation_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("worktree_id").agg(F.count_distinct("support_id").alias("observations"))


def promotable(drafts: DataFrame, least_blocks: int = 2, least_structures: int = 2, least_observations: int = 2, frontier_single: int = 1, frontier_several: int = 2) -> DataFrame:
    """Drafts with enough support: n_blocks, n_structures, n_regions, observations, is_frontier."""
    structural = (F.col("n_blocks") >= least_blocks) & (F.col("n_structures") >= least_structures) & (F.col("observations") >= least_observations)
    frontier = F.col("observations") >= F.when(F.col("n_regions") == 1, frontier_single).otherwise(frontier_several)
    return drafts.filter(F.when(F.col("is_frontier"), frontier).otherwise(structural))


def interpret(contents: Column, is_frontier: Column) -> Column:
    """The plain interpreter: what supports a relation, in order and once each; UNKNOWN where it cannot say."""
    said = F.array_distinct(F.filter(F.transform(contents, lambda c: F.trim(c)), lambda c: c != ""))
    return F.when(is_frontier | (F.size(said) == 0), F.lit("UNKNOWN")).otherwise(F.concat(F.lit("Longitudinal relation supported by: "), F.array_join(said, "; ")))


def chain(rows: DataFrame, region: str, order: list[str]) -> DataFrame:
    """Adds revision_number, previous_revision and is_head along each region's append order."""
    w = Window.partitionBy(region).orderBy(*order)
    n = F.row_number().over(w)
    return rows.withColumns({"revision_number": n, "previous_revision": F.when(n > 1, n - 1), "is_head": F.lead(F.lit(1)).over(w).isNull()})


def heads(revisions: DataFrame) -> DataFrame:
    names = revisions.columns
    return revisions.groupBy("region_id").agg(F.max_by(F.struct(*names), "revision_number").alias("r")).select("r.*")


def broken_links(revisions: DataFrame) -> DataFrame:
    """Revisions whose number or back-pointer does not follow the one before."""
    w = Window.partitionBy("region_id").orderBy("revision_number")
    rows = revisions.withColumns({"_n": F.lag("revision_number").over(w), "_id": F.lag("baseline_id").over(w)})
    return rows.filter((F.col("revision_number") != F.coalesce("_n", F.lit(0)) + 1) | ~F.col("previous_baseline_id").eqNullSafe(F.col("_id"))).drop("_n", "_id")


def history(revisions: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` revisions of each region, newest first."""
    w = Window.partitionBy("region_id").orderBy(F.desc("revision_number"))
    return revisions.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("place")


def consolidate(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Adds action and revision_number to proposals (region_id, content, support, authorized).

    NO_CHANGE where both the normalized text and the support set equal the head's; INITIAL_CREATION
    without a head; SUPPORT_UPDATE where only support differs; else MEANINGFUL_UPDATE. Support outside
    the authorized set makes the row fail with UNAUTHORIZED.
    """
    h = current.select("region_id", F.col("content").alias("head_content"), F.col("support").alias("head_support"), F.col("revision_number").alias("head_revision"))
    rows = proposals.join(h, "region_id", "left")
    same_text = content_hash("content") == content_hash("head_content")
    same_support = (F.size(F.array_except("support", "head_support")) == 0) & (F.size(F.array_except("head_support", "support")) == 0)
    action = (
        F.when(F.size(F.array_except("support", "authorized")) > 0, "UNAUTHORIZED").when(F.col("head_revision").isNull(), "INITIAL_CREATION")
        .when(same_text & same_support, "NO_CHANGE").when(same_text, "SUPPORT_UPDATE").otherwise("MEANINGFUL_UPDATE")
    )
    kept = F.coalesce("head_revision", F.lit(0))
    return rows.withColumn("action", action).withColumn("revision_number", F.when(F.col("action").isin("NO_CHANGE", "UNAUTHORIZED"), kept).otherwise(kept + 1)).drop("head_content", "head_support", "head_revision")


def promote(drafts: DataFrame, current: DataFrame) -> DataFrame:
    """New accepted revisions from promotable drafts, ready to be appended."""
    return consolidate(drafts, current).filter(F.col("action").isin("INITIAL_CREATION", "SUPPORT_UPDATE", "MEANINGFUL_UPDATE")).withColumn("baseline_id", identity("baseline_", F.col("region_id"), F.col("revision_number"), content_hash("content")))


def signature(sources: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(sources)), "|"), 256)


def suppress(proposals: DataFrame, rejections: DataFrame) -> DataFrame:
    """Proposals that no standing rejection of the same region, text and sources covers."""
    standing = rejections.filter("reopened_at is null").select("region_id", "content_hash", "support_signature").distinct()
    rows = proposals.withColumns({"content_hash": content_hash("content"), "support_signature": signature(F.col("sources"))})
    return rows.join(standing, ["region_id", "content_hash", "support_signature"], "left_anti")


def reopen(rejections: DataFrame, keys: DataFrame, at: Column) -> DataFrame:
    on = ["region_id", "content_hash", "support_signature"]
    return rejections.join(keys.select(*on).distinct().withColumn("_hit", F.lit(True)), on, "left").withColumn("reopened_at", F.when(F.col("_hit") & F.col("reopened_at").isNull(), at).otherwise(F.col("reopened_at"))).drop("_hit")


def postings(holders: dict[str, DataFrame]) -> DataFrame:
    """(evidence_id, kind, holder_id): the inverted index from evidence to what uses it, to be kept as a table.

    ``holders``: kind -> (holder_id, evidence_ids array) or (holder_id, evidence_id), a row each. Null
    ids and null or empty arrays give no rows; repeats are one.
    """
    out = None
    for kind, rows in holders.items():
        if "evidence_id" not in rows.columns:
            rows = rows.select("holder_id", F.explode("evidence_ids").alias("evidence_id"))
        one = rows.select(F.col("evidence_id").cast("string").alias("evidence_id"), F.lit(kind).alias("kind"), F.col("holder_id").cast("string").alias("holder_id"))
        out = one if out is None else out.unionAll(one)
    return out.filter("evidence_id is not null and holder_id is not null").distinct()


def holders_of(ids: DataFrame, index: DataFrame) -> DataFrame:
    """(kind, holder_id): one lookup in the index, for all kinds at once."""
    wanted = ids.select(F.col("evidence_id").cast("string").alias("evidence_id")).distinct()
    return index.join(wanted, "evidence_id", "left_semi").select("kind", "holder_id").distinct()


def invalidation_closure(ids: DataFrame, holders: dict[str, DataFrame]) -> DataFrame:
    """(kind, holder_id): everything that uses one of the evidence ids, without an index at hand."""
    return holders_of(ids, postings(holders))


def evaluate_candidates(candidates: DataFrame, authorized: DataFrame, rejections: DataFrame, current: DataFrame, arriving: DataFrame) -> DataFrame:
    """Candidates that may become drafts: supported by authorized states only, not rejected, naming an
    arriving state if they are frontier relations, and saying something the head does not.

    ``candidates``: region_id, content, sources, states, is_frontier.
    """
    rows = suppress(candidates, rejections)
    each = rows.select("region_id", "content_hash", F.explode("states").alias("state_id"))
    foreign = each.join(authorized.select("state_id").distinct(), "state_id", "left_anti").select("region_id", "content_hash").distinct()
    fresh = each.join(arriving.select("state_id").distinct(), "state_id", "left_semi").select("region_id", "content_hash").distinct().withColumn("_fresh", F.lit(True))
    rows = rows.join(foreign, ["region_id", "content_hash"], "left_anti").join(fresh, ["region_id", "content_hash"], "left").filter(~F.col("is_frontier") | F.col("_fresh")).drop("_fresh")
    same = current.select("region_id", F.trim("content").alias("_head"))
    return rows.join(same, "region_id", "left").filter(F.col("_head").isNull() | (F.trim("content") != F.col("_head"))).drop("_head")


def intake(proposals: DataFrame, recorded: DataFrame) -> DataFrame:
    """External proposals not recorded yet; the same id with other content is an error, told by ``conflict``."""
    old = recorded.select("proposal_id", F.col("content").alias("_old"))
    return proposals.join(old, "proposal_id", "left").withColumn("conflict", F.col("_old").isNotNull() & (content_hash("content") != content_hash("_old"))).filter(F.col("_old").isNull() | F.col("conflict")).drop("_old")


def queue_materials(new: DataFrame, queue: DataFrame) -> DataFrame:
    """Materials not queued yet, pending: an id that was ever queued is not queued again."""
    return new.dropDuplicates(["material_id"]).join(queue.select("material_id"), "material_id", "left_anti").withColumn("status", F.lit("PENDING"))


def pending(queue: DataFrame, n: int) -> DataFrame:
    return queue.filter("status = 'PENDING'").orderBy("created_at", "material_id").limit(n)


def association_text(contents: Column, most_chars: int = 512) -> Column:
    return F.substring(F.array_join(F.array_distinct(contents), " / "), 1, most_chars)


def derivation_fingerprint(spark, settings: dict[str, str]) -> DataFrame:
    """One row: the fingerprint of a configuration; tables of another fingerprint are stale."""
    rows = spark.createDataFrame(sorted(settings.items()), "name string, value string")
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), "|"), 256).alias("fingerprint"))


def stale(derived: DataFrame, fingerprint: str) -> DataFrame:
    return derived.filter(F.col("derivation_fingerprint") != F.lit(fingerprint))
