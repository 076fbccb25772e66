"""Evidence-based decisions: independent components, profiles, floors and Pareto dominance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.operators.graph import connected_components

#: components, reciprocal components, contexts, variants, and components per variant.
FLOORS = (2, 0, 0, 1, 2)
CANDIDATE = ["decision_key", "candidate_id"]


def with_components(signals: DataFrame) -> DataFrame:
    """``signals`` with ``component``: those of one (decision, candidate, polarity) that share evidence hang together.

    ``signals``: signal_id, decision_key, candidate_id, polarity, raw_evidence_ids. Of the signals with the same evidence
    each is linked to the least, so only evidence that several share makes an edge; a signal without a link is a component
    by itself. Sorted by evidence, a hot one streams through its task.
    """
    scope = F.concat_ws("\x1f", "decision_key", "candidate_id", "polarity")
    name = F.concat(scope, F.lit("\x1f"), F.col("signal_id").cast("string"))
    items = signals.select(scope.alias("scope"), F.col("signal_id").cast("string").alias("b"), F.explode("raw_evidence_ids").alias("e")).filter("e is not null")
    least = F.first("b").over(Window.partitionBy("scope", "e").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
    full = lambda c: F.concat("scope", F.lit("\x1f"), c).alias(c)
    links = items.withColumn("a", least).filter("a != b").select(full("a"), full("b"))
    parts = connected_components(links)
    return signals.withColumn("node", name).join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def evidence_components(signals: DataFrame) -> DataFrame:
    """(signal_id, component) of :func:`with_components`; a signal without evidence is in none."""
    return with_components(signals.filter("size(array_compact(raw_evidence_ids)) > 0")).select("signal_id", "component")


def profiles(signals: DataFrame, components: DataFrame | None = None, per_variant: int = FLOORS[4]) -> DataFrame:
    """Per candidate: supporting components, those with a reciprocal signal, distinct contexts of
    components with one context, variants seen in enough components, contradicting components.

    Without ``components`` they are found here, and no second join of all signals is needed.
    """
    rows = with_components(signals.filter("size(array_compact(raw_evidence_ids)) > 0")) if components is None else signals.join(components, "signal_id")
    support = rows.filter("polarity = 'support'")
    each = support.groupBy(*CANDIDATE, "component").agg(F.bool_or("reciprocal").alias("reciprocal"), F.count_distinct("context_id").alias("n_contexts"), F.min("context_id").alias("context"))
    counts = each.groupBy(CANDIDATE).agg(
        F.count("*").alias("components"), F.count_if("reciprocal").alias("reciprocal_components"),
        F.count_distinct(F.when(F.col("n_contexts") == 1, F.col("context"))).alias("contexts"),
    )
    variants = support.groupBy(*CANDIDATE, "derivation_variant_id").agg(F.count_distinct("component").alias("n")).filter(F.col("n") >= per_variant).groupBy(CANDIDATE).agg(F.count("*").alias("variants"))
    against = rows.filter("polarity = 'contradict'").groupBy(CANDIDATE).agg(F.count_distinct("component").alias("contradictions"))
    every = signals.select(*CANDIDATE).distinct()
    return every.join(counts, CANDIDATE, "left").join(variants, CANDIDATE, "left").join(against, CANDIDATE, "left").na.fill(0)


def eligible(rows: DataFrame, floors: tuple[int, ...] = FLOORS) -> DataFrame:
    return rows.filter((F.col("components") >= floors[0]) & (F.col("reciprocal_components") >= floors[1]) & (F.col("contexts") >= floors[2]) & (F.col("variants") >= floors[3]))


def dominates(a: Column, b: Column) -> Column:
    up = ["components", "reciprocal_components", "contexts", "variants"]
    no_worse, better = a["contradictions"] <= b["contradictions"], a["contradictions"] < b["contradictions"]
    for axis in up:
        no_worse, better = no_worse & (a[axis] >= b[axis]), better | (a[axis] > b[axis])
    return no_worse & better


def undominated(rows: DataFrame) -> DataFrame:
    """The skyline of each decision: candidates that no other of it dominates.

    Candidates with equal profiles are compared as one, so a decision's work grows with its different
    profiles.
    """
    axes = ["components", "reciprocal_components", "contexts", "variants", "contradictions"]
    different = rows.select("decision_key", *axes).distinct()
    top = different.alias("b").join(different.alias("a"), (F.col("a.decision_key") == F.col("b.decision_key")) & dominates(_row("a", axes), _row("b", axes)), "left_anti")
    return rows.join(top, ["decision_key", *axes], "left_semi")


def _row(alias: str, axes: list[str]) -> Column:
    return F.struct(*(F.col(f"{alias}.{x}").alias(x) for x in axes))


def decide(rows: DataFrame, floors: tuple[int, ...] = FLOORS) -> DataFrame:
    """(decision_key, status, winner): RESOLVED where exactly one eligible candidate is undominated."""
    top = undominated(eligible(rows, floors)).groupBy("decision_key").agg(F.count("*").alias("n"), F.min("candidate_id").alias("first"))
    every = rows.select("decision_key").distinct()
    return every.join(top, "decision_key", "left").select("decision_key", F.when(F.col("n") == 1, "RESOLVED").when(F.col("n") > 1, "AMBIGUOUS").otherwise("INSUFFICIENT").alias("status"), F.when(F.col("n") == 1, F.col("first")).alias("winner"))


def merge_ledger(ledger: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both, one row per key with the earliest known_at; it never moves later."""
    return ledger.unionByName(new).groupBy(keys).agg(F.min("known_at").alias("known_at"))


def ledger_at(materials: DataFrame, relations: DataFrame, decisions: DataFrame, valid: DataFrame, at: Column) -> DataFrame:
    """Signals known at ``at`` with all of their evidence valid: decision refs, relations and materials joined.

    ``materials``: material_id, raw_evidence_ids; ``relations``: relation_id, material_id, candidate_id,
    variant, polarity, reciprocal, context_id; ``decisions``: decision_key, relation_id, known_at.
    """
    bad = materials.select("material_id", F.explode("raw_evidence_ids").alias("evidence_id")).join(valid.filter("valid"), "evidence_id", "left_anti").select("material_id").distinct()
    return decisions.filter(F.col("known_at") <= at).join(relations, "relation_id").join(materials, "material_id").join(bad, "material_id", "left_anti")
