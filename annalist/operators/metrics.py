"""Measures of candidate pairs and verdicts against gold annotations. Every result is one row or a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.operators.pairs import meet

PAIR = ["predecessor_id", "successor_id"]


def share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)


def candidate_metrics(candidates: DataFrame, gold: DataFrame, n_blocks: int) -> DataFrame:
    """Recall, reduction, volume and false rate of candidates; ``gold`` has the pair and its relation."""
    true = gold.filter("longitudinal_relation != 'UNRELATED'").select(*PAIR).distinct().withColumn("is_true", F.lit(1))
    found = candidates.groupBy(*PAIR).agg(F.count("*").alias("rows"))
    sums = meet(found, true, PAIR, "full_outer").agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("candidates"), F.count("rows").alias("pairs"),
        F.count("is_true").alias("true_pairs"), F.count_if(F.col("rows").isNotNull() & F.col("is_true").isNotNull()).alias("recalled"),
    )
    possible = n_blocks * (n_blocks - 1) // 2
    return sums.select(
        "candidates", "true_pairs", "recalled",
        share(F.col("recalled"), F.col("true_pairs"), 1.0).alias("recall"),
        (F.lit(0.0) if not possible else (1 - F.col("candidates") / possible) * 100).alias("reduction_pct"),
        (F.lit(0.0) if not n_blocks else F.col("candidates") / n_blocks).alias("per_block"),
        share(F.col("pairs") - F.col("recalled"), F.col("pairs"), 0.0).alias("false_rate"),
    )


def missed(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    return meet(gold.filter("longitudinal_relation != 'UNRELATED'"), candidates.select(*PAIR).distinct(), PAIR, "left_anti")


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """One row per gold label, a column per predicted one. ``pairs``: gold, predicted."""
    return pairs.groupBy("gold").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


def adjudication_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Accuracy and class rates of verdicts; results without a gold pair are ignored."""
    rows = meet(results.select(*PAIR, F.col("relation").alias("r")), gold.select(*PAIR, F.col("longitudinal_relation").alias("g")), PAIR)
    mixed = ((F.col("g") == "CORRECTION_RETRACTION") & (F.col("r") == "STATE_CHANGE")) | ((F.col("g") == "STATE_CHANGE") & (F.col("r") == "CORRECTION_RETRACTION"))
    right = lambda label: F.count_if((F.col("g") == label) & (F.col("r") == label))
    of = lambda label: F.count_if(F.col("g") == label)
    n = F.count("*")
    return rows.agg(
        n.alias("evaluated"), share(F.count_if(F.col("g") == F.col("r")), n, 0.0).alias("accuracy"), share(F.count_if(mixed), n, 0.0).alias("correction_state_confusion"),
        share(right("UNRELATED"), of("UNRELATED"), 1.0).alias("unrelated_rejection"), share(right("PERSISTENCE_CONFIRMATION"), of("PERSISTENCE_CONFIRMATION"), 1.0).alias("persistence_accuracy"),
        share(F.count_if(F.col("r") == "UNKNOWN_RELATION"), n, 0.0).alias("unknown_rate"),
    )


def knowledge_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and closure rates of "a prior unknown was resolved"."""
    g = gold.select(*PAIR, F.col("prior_unknown_resolved").alias("g"), F.col("resolved_dimensions").alias("gd"), F.col("longitudinal_relation").alias("relation"))
    rows = results.select(*PAIR, F.col("prior_unknown_resolved").alias("p"), F.col("resolved_dimensions").alias("pd"))
    rows = meet(rows, g, PAIR)
    is_g, is_p = F.coalesce("g", F.lit(False)), F.coalesce("p", F.lit(False))
    wrong = is_g & is_p & (F.size("gd") > 0) & (F.size("pd") > 0) & ~F.arrays_overlap("gd", "pd")
    tp, fp, fn, n = F.count_if(is_g & is_p), F.count_if(~is_g & is_p), F.count_if(is_g & ~is_p), F.count("*")
    return rows.agg(
        n.alias("evaluated"), share(tp, tp + fp, 1.0).alias("precision"), share(tp, tp + fn, 1.0).alias("recall"), share(fp, n, 0.0).alias("wrong_closure_rate"),
        share(F.count_if(wrong), n, 0.0).alias("wrong_dimension_rate"), F.count_if(is_p & (F.col("relation") == "UNRELATED")).alias("evidence_free_closures"),
    )


def temporal_integrity(candidates: DataFrame, results: DataFrame, views: DataFrame) -> DataFrame:
    """Pairs that run backwards in time, among candidates and among verdicts."""
    at = views.select("memory_id", "received_at")
    p, s = at.toDF("predecessor_id", "p_at"), at.toDF("successor_id", "s_at")
    back = lambda rows, name: meet(meet(rows.select(*PAIR), p, "predecessor_id"), s, "successor_id").agg(F.count_if(F.col("s_at") < F.col("p_at")).alias(name))
    return back(candidates, "reverse_time_errors").crossJoin(back(results, "future_leakage")).withColumn("passed", (F.col("reverse_time_errors") == 0) & (F.col("future_leakage") == 0))


def marginal_value(one: DataFrame, two: DataFrame, gold: DataFrame) -> DataFrame:
    """(predecessor_id, successor_id, found_by): both, only_first, only_second or neither, per true pair."""
    mark = lambda rows, name: rows.select(*PAIR).distinct().withColumn(name, F.lit(True))
    rows = gold.filter("longitudinal_relation != 'UNRELATED'").select(*PAIR).distinct().join(mark(one, "a"), PAIR, "left").join(mark(two, "b"), PAIR, "left")
    a, b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return rows.select(*PAIR, F.when(a & b, "both").when(a, "only_first").when(b, "only_second").otherwise("neither").alias("found_by"))


def miss_reasons(rows: DataFrame, window_seconds: int, least_cosine: float = 0.08, least_score: float = 0.25) -> DataFrame:
    """Adds ``reasons`` to missed pairs that have delta, cosine, common, signals and signal_score."""
    vector = F.col("cosine") < least_cosine
    found = F.array_compact(F.array(
        F.when(F.col("delta") > window_seconds, F.lit("temporal_distance")), F.when(vector, F.lit("vector_miss")), F.when(vector & (F.col("common") < 2), F.lit("lexical_discontinuity")),
        F.when(F.size("signals") == 0, F.lit("boundary_signal_miss")).when(F.col("signal_score") < least_score, F.lit("missing_semantic_anchor")),
    ))
    return rows.withColumn("reasons", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other"))))


#: Provenance keys that would give the answer away. Fixed values.
ORACLE_KEYS = ["thread_id", "oracle_domain", "correction_nature", "gold_relation", "trajectory_label", "grouping_key"]


def falsification(timed: DataFrame, bounded: DataFrame, results: DataFrame, gold: DataFrame, views: DataFrame) -> DataFrame:
    """(test, counted, total, passed): seven tests that could refute the method, one row each.

    ``timed`` are candidates by time alone, ``bounded`` those that were adjudicated, ``results`` the verdicts. ``gold`` has
    one row a pair, ``views`` a map ``provenance``. F1 time alone also finds pairs without a relation; F2 no record carries
    an answer; F3 only candidates are judged; F4 changes and corrections are not confused; F5 a change can close an unknown,
    in gold (total) and in verdicts (counted); F6 neither elapsed time nor persistence closes one; F7 the boundary leaves
    out at least 40 percent of the timed candidates.
    """
    pair = lambda rows: rows.select(*PAIR).distinct()
    true = pair(gold.filter("longitudinal_relation != 'UNRELATED'"))
    n, counted, total = F.count("*"), F.col("counted"), F.col("total")
    both = meet(results.select(*PAIR, F.col("relation").alias("r")), gold.select(*PAIR, F.col("longitudinal_relation").alias("g")), PAIR)
    changes = ["STATE_CHANGE", "CORRECTION_RETRACTION"]
    confused = F.col("g").isin(changes) & F.col("r").isin(changes) & (F.col("g") != F.col("r"))
    closes = F.coalesce("prior_unknown_resolved", F.lit(False))
    quiet = F.col("relation").isin("UNRELATED", "PERSISTENCE_CONFIRMATION")
    carries = F.arrays_overlap(F.map_keys("provenance"), F.array(*map(F.lit, ORACLE_KEYS)))
    two = lambda a, b: a.agg(n.alias("counted")).crossJoin(b.agg(n.alias("total")))  # noqa: E731  (single rows)
    tests = {
        "F1": (two(meet(pair(timed), true, PAIR, "left_anti"), timed), counted > 0),
        "F2": (views.agg(F.count_if(F.coalesce(carries, F.lit(False))).alias("counted"), n.alias("total")), counted == 0),
        "F3": (two(meet(pair(results), pair(bounded), PAIR, "left_anti"), pair(results)), counted == 0),
        "F4": (both.agg(F.count_if(confused).alias("counted"), n.alias("total")), counted == 0),
        "F5": (two(results.filter((F.col("relation") == "STATE_CHANGE") & closes), gold.filter("longitudinal_relation = 'STATE_CHANGE' and prior_unknown_resolved")), (counted > 0) & (total > 0)),
        "F6": (results.agg(F.count_if(quiet & closes).alias("counted"), n.alias("total")), counted == 0),
        "F7": (two(bounded, timed), F.when(total > 0, (1 - counted / total) * 100 >= 40).otherwise(False)),
    }
    out = None
    for name, (rows, passed) in tests.items():
        one = rows.select(F.lit(name).alias("test"), "counted", "total", passed.alias("passed"))
        out = one if out is None else out.unionAll(one)
    return out


def verdict(measures: DataFrame) -> DataFrame:
    """``measures``: recall, accuracy, passed, confusion. Adds SUPPORTED, NOT_SUPPORTED or INCONCLUSIVE."""
    good = (F.col("recall") >= 0.70) & (F.col("accuracy") >= 0.50) & F.col("passed") & (F.col("confusion") <= 0.1)
    bad = (F.col("recall") < 0.50) | (F.col("accuracy") < 0.30) | ~F.col("passed")
    return measures.withColumn("verdict", F.when(good, "SUPPORTED").when(bad, "NOT_SUPPORTED").otherwise("INCONCLUSIVE"))
