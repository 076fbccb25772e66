"""Evidence, its lifecycle, and what is visible at a cutoff on either clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.scratch import materialize


def conflicting(batch: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Ids that come with more than one content, time, key or provenance."""
    every = batch if existing is None else batch.unionByName(existing)
    return every.groupBy("evidence_id").agg(F.count_distinct(F.struct("content", "occurred_at", "known_at", "ordering_key", "provenance")).alias("n")).filter("n > 1").select("evidence_id")


def admit(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``batch`` that are new: canonical, not derived, with a source; repeats are dropped.

    :func:`admit_or_raise` stops the run at conflicts and at rows that this one drops. Provenance is a map of strings.
    """
    p = F.col("provenance")
    valid = p["source"].isNotNull() & (p["canonical"] == "true") & (F.coalesce(p["derived"], F.lit("false")) != "true")
    return with_effective_times(batch).filter(valid).dropDuplicates(["evidence_id"]).join(existing.select("evidence_id"), "evidence_id", "left_anti")


def admit_or_raise(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """New rows as :func:`admit` gives them; raises where a row has no canonical source or an id comes with something else.

    All five parts are compared as they will be stored, so a changed time or key is a conflict too.
    """
    p = F.col("provenance")
    bad = batch.filter((F.coalesce(p["source"], F.lit("")) == "") | ~p["canonical"].eqNullSafe("true") | p["derived"].eqNullSafe("true"))
    if not bad.isEmpty():
        raise ValueError("canonical source provenance is required, and derived cognition is no evidence")
    key = ["evidence_id", "content", "occurred_at", "known_at", "ordering_key", "provenance"]
    text = lambda rows: with_effective_times(rows).select(*key).withColumn("provenance", sorted_json(F.col("provenance")))
    if not conflicting(text(batch), text(existing)).isEmpty():
        raise ValueError("an evidence id was given again with other content, time, key or provenance")
    return admit(batch, existing)


def sorted_json(provenance: Column) -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(provenance))))


def with_effective_times(rows: DataFrame) -> DataFrame:
    """``known_at`` and ``ordering_key`` as they count where none were given."""
    known = rows.withColumn("known_at", F.coalesce("known_at", "occurred_at"))
    return known.withColumn("ordering_key", F.coalesce("ordering_key", F.date_format("known_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def current_valid(evidence: DataFrame) -> DataFrame:
    """Evidence that is valid now, by (ordering_key, evidence_id)."""
    return evidence.filter((F.col("state") == "VALID") & F.col("superseded_by").isNull()).orderBy("ordering_key", "evidence_id")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; unknown keys are dropped silently."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def lookup(rows: DataFrame, wanted, key: str) -> dict:
    """The one row of a key; raises KeyError where there is none."""
    found = rows.filter(F.col(key) == F.lit(wanted)).limit(1).collect()
    if not found:
        raise KeyError(wanted)
    return found[0].asDict(recursive=True)


def lifecycle_state(evidence: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """Current state from the append-only log: the latest event decides; an invalidation clears the successor."""
    last = lifecycle.groupBy("evidence_id").agg(F.max_by(F.struct("event_type", "replacement"), F.struct("event_at", "event_id")).alias("e"))
    state = F.when(F.col("e.event_type") == "INVALIDATED", "INVALID").when(F.col("e.event_type") == "SUPERSEDED", "SUPERSEDED").otherwise("VALID")
    return evidence.join(last, "evidence_id", "left").withColumns({"state": state, "superseded_by": F.when(state == "SUPERSEDED", F.col("e.replacement"))}).drop("e")


def invalidate(lifecycle: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """New log rows for ``ids`` that are not invalidated yet; repeating changes nothing."""
    done = lifecycle.filter("event_type = 'INVALIDATED'").select("evidence_id")
    return ids.select("evidence_id").distinct().join(done, "evidence_id", "left_anti").select("evidence_id", F.lit("INVALIDATED").alias("event_type"), at.alias("event_at"))


def supersede(evidence: DataFrame, lifecycle: DataFrame, replacements: DataFrame, at: Column) -> DataFrame:
    """New log rows that replace ``evidence_id`` by ``replacement``; raises unless both exist and the latter is valid now.

    A replacement that this very call replaces counts as it was before the call.
    """
    now = lifecycle_state(evidence.drop("state", "superseded_by"), lifecycle).select("evidence_id", ((F.col("state") == "VALID") & F.col("superseded_by").isNull()).alias("valid"))
    wanted = replacements.select("evidence_id", "replacement").distinct()
    missing = wanted.join(now.select("evidence_id"), "evidence_id", "left_anti")
    unfit = wanted.join(now.filter("valid").select(F.col("evidence_id").alias("replacement")), "replacement", "left_anti")
    if not missing.isEmpty() or not unfit.isEmpty():
        raise ValueError("both evidences must exist, and the replacement be current-valid")
    return wanted.select("evidence_id", F.lit("SUPERSEDED").alias("event_type"), at.alias("event_at"), "replacement")


def valid_at(evidence: DataFrame, lifecycle: DataFrame, at: Column) -> DataFrame:
    """(evidence_id, valid): known by then, and neither invalidated nor superseded by then.

    Where the log says nothing of an evidence, its current state (``state``, ``superseded_by``) decides.
    One aggregated row per id meets the evidence, so a long history of one id is no skew.
    """
    ends = lifecycle.filter(F.col("event_type").isin("INVALIDATED", "SUPERSEDED")).groupBy("evidence_id").agg(F.min("event_at").alias("ended_at"))
    now = (F.col("state") == "VALID") & F.col("superseded_by").isNull() if "state" in evidence.columns else F.lit(True)
    holds = F.when(F.col("ended_at").isNull(), now).otherwise(F.col("ended_at") > at)
    return evidence.join(ends, "evidence_id", "left").select("evidence_id", ((F.col("known_at") <= at) & holds).alias("valid"))


def transition_valid_at(rows: DataFrame, at: Column) -> DataFrame:
    """Rows valid under a canonical lifecycle: from known_at until their transition; an unknown transition time fails closed."""
    return rows.filter((F.col("known_at") <= at) & (F.col("active") | F.coalesce(at < F.col("transition_at"), F.lit(False))))


def any_valid(blocks: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """(key, valid): a transition holds if any of its blocks does. ``blocks``: key, evidence_id; ``valid``: evidence_id, valid."""
    return blocks.join(valid, "evidence_id", "left").groupBy(key).agg(F.bool_or(F.coalesce("valid", F.lit(False))).alias("valid"))


def latest(states: DataFrame, key: str = "block_id", version: str = "state_version") -> DataFrame:
    """The highest version of each key."""
    names = states.columns
    return states.groupBy(key).agg(F.max_by(F.struct(*names), F.col(version)).alias("s")).select("s.*").select(*names)


def supported(states: DataFrame, bridge: DataFrame, valid: DataFrame, key: str = "state_id") -> DataFrame:
    """States whose every evidence is valid (relational division); missing evidence hides a state.

    The bridge (key, evidence_id) meets the valid ids once, and a partial aggregate decides.
    """
    whole = bridge.join(valid.filter("valid").select("evidence_id", F.lit(1).alias("ok")), "evidence_id", "left").groupBy(key).agg(F.bool_and(F.col("ok").isNotNull()).alias("all_valid"))
    return states.join(whole.filter("all_valid").select(key), key, "left_semi")


def at_logical_cutoff(states: DataFrame, at: Column) -> DataFrame:
    """Per block the highest version that ended by ``at``, of states that are valid now."""
    return latest(states.filter(F.col("occurred_end") <= at))


def at_knowledge_cutoff(states: DataFrame, bridge: DataFrame, evidence: DataFrame, lifecycle: DataFrame, at: Column, current_valid_only: bool = True) -> DataFrame:
    """Per block the highest version that was known by ``at`` and whose every evidence was valid then."""
    known = states.filter(F.col("derived_known_at") <= at)
    if not current_valid_only:
        return latest(known)
    return latest(supported(known, bridge, valid_at(evidence, lifecycle, at)))


def audit(lifecycle: DataFrame, ids: DataFrame) -> DataFrame:
    return lifecycle.join(ids.select("evidence_id").distinct(), "evidence_id", "left_semi").orderBy("evidence_id", "event_at", "event_id")


def split_at(rows: DataFrame, time: str, at: Column, key: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(visible, future): visible rows come in an order that depends on the seed and the key alone."""
    visible = rows.filter(F.col(time) <= at).withColumn("_h", F.xxhash64(F.lit(seed), key))
    return numbered(visible, ["_h", key], "position").drop("_h"), rows.filter(F.col(time) > at)


def no_leak(visible: DataFrame, time: str, at: Column) -> DataFrame:
    """``visible``, or an error where it holds a row later than ``at``."""
    if not visible.filter(F.col(time) > at).isEmpty():
        raise ValueError("rows later than the cutoff are visible")
    return visible


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their place (from 1) in the order of the given columns, which tell all rows apart.

    Sorted ranges are numbered apart and shifted by the rows before them: no task holds them all.
    """
    ranges = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").count().withColumn("_before", F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))  # a row per range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + place).cast("long")).drop("_range", "_before")


def reached_stage(progress: DataFrame, stages: list[str]) -> DataFrame:
    """The furthest stage of each evidence; a stage never goes back."""
    rank = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    return progress.groupBy("evidence_id").agg(F.max(rank).alias("rank")).select("evidence_id", F.element_at(F.array(*map(F.lit, stages)), F.col("rank").cast("int")).alias("stage"))
