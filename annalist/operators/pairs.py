"""Candidate pairs of timed records and their rule-based adjudication."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.functions.text import bigrams

WINDOW_DAYS, LEAST_COSINE, LEAST_SCORE, LEAST_SIGNALS = 45, 0.08, 0.25, 1


@dataclass(frozen=True)
class Cues:
    """Regular expressions that candidate signals look for. Fixed values."""

    plan: str = "计划|打算|准备|约了|下[周个]|明[天年]|将来|以后|预定|需要订|预约"
    outcome: str = "已经|完成|结束|到了|出来了|通过|成功|失败|没过|取消|不行|办好|拿到|收到"
    correction: str = "说错了|更正|纠正|其实|原来|不是.*而是|搞错|弄错|之前说错"
    persistence: str = "还在|仍然|继续|还没|依然|一直|没变|照旧|还是"
    uncertainty: str = "不知道|可能|也许|大概|待定|不确定|等.*结果|审批中|还没.*通知|暗示"
    resolution: str = "确定|正式|结果|通知|批准|决定|明确|确认"


@dataclass(frozen=True)
class Rules:
    """Regular expressions that adjudication looks for. Fixed values."""

    correction: str = "说错|更正|纠正|其实不是|搞错|弄错|之前.*错|原来.*不是"
    explicit_correction: str = "(之前|上次|以前).*?说错|更正通知|纠正"
    cancellation: str = "取消|撤回|不.*了|退出|放弃|作废"
    completion: str = "已经|完成|到了|办好|搞定|拿到|做完|结束|出来了|成功"
    failure: str = "没过|失败|没成功|不行|被拒|落选|没能|未通过"
    persistence: str = "还在|仍然|继续|还没|依然|一直|没变|照旧|还是.*等"
    plan: str = "计划|打算|准备|约了|预定|预约|要去"
    uncertainty: str = "不知道|可能|也许|大概|待定|不确定|等.*结果|审批中|暗示|还没.*通知"
    resolution: str = "确定|正式|结果.*出来|通知|批准|明确|确认|决定|不.*了"
    late_fact: str = "原来|其实|后来才知道|一直不知道"
    implicit_change: str = "变了|换了|改了|跳槽|搬|转|提前|推迟"
    result: str = "结果|检查"
    approval: str = "通过|审批|签证"
    possibility: str = "可能"


def meet(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, both sorted: neither goes through the driver.

    Spark estimates a side by the size of its files and its columns; terms and contents made from few bytes are far
    larger than that, and would be broadcast.
    """
    return left.join(right.hint("merge"), on, how)


def interval_pairs(views: DataFrame, window_seconds: int = WINDOW_DAYS * 86400, scope: list[str] | None = None) -> DataFrame:
    """(predecessor_id, successor_id, delta, score): ordered pairs received at most a window apart.

    ``views`` has memory_id and received_at. A range join by time buckets: each row meets its own
    bucket and the next, so rows far apart never meet. ``scope`` columns must be equal too. Equal
    times go by id.
    """
    scope = scope or []
    at = F.unix_micros(F.col("received_at").cast("timestamp"))
    span = window_seconds * 1_000_000
    rows = views.select(*scope, "memory_id", at.alias("t"), F.floor(at / span).alias("bucket"))
    left = rows.select(*scope, F.col("memory_id").alias("predecessor_id"), F.col("t").alias("p"), F.explode(F.array(F.col("bucket"), F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(*scope, F.col("memory_id").alias("successor_id"), F.col("t").alias("s"), "bucket")
    pairs = meet(left, right, [*scope, "bucket"]).filter(((F.col("p") < F.col("s")) | ((F.col("p") == F.col("s")) & (F.col("predecessor_id") < F.col("successor_id")))) & (F.col("s") - F.col("p") <= span))
    delta = (F.col("s") - F.col("p")) / 1_000_000
    return pairs.select(*scope, "predecessor_id", "successor_id", delta.alias("delta"), (1 - delta / window_seconds).alias("score"))


def term_weights(views: DataFrame, text: str = "content") -> DataFrame:
    """(memory_id, term, weight): each record's bigram bag, of length one."""
    counts = views.select("memory_id", F.explode(bigrams(F.col(text))).alias("term")).groupBy("memory_id", "term").agg(F.count("*").alias("n"))
    lengths = counts.groupBy("memory_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("length"))
    return meet(counts, lengths, "memory_id").select("memory_id", "term", (F.col("n") / F.col("length")).alias("weight"))


def with_cosine(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Adds ``cosine``. Only the terms of the given pairs are multiplied."""
    p = weights.select(F.col("memory_id").alias("predecessor_id"), "term", F.col("weight").alias("w"))
    s = weights.select(F.col("memory_id").alias("successor_id"), "term", F.col("weight").alias("v"))
    dots = meet(meet(pairs.select("predecessor_id", "successor_id"), p, "predecessor_id"), s, ["successor_id", "term"]).groupBy("predecessor_id", "successor_id").agg(F.sum(F.col("w") * F.col("v")).alias("cosine"))
    return meet(pairs, dots, ["predecessor_id", "successor_id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def similar_pairs(pairs: DataFrame, weights: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    return with_cosine(pairs, weights).filter(F.col("cosine") >= least)


def run_bigrams(text: Column) -> Column:
    """Distinct bigrams inside runs of two or more Han characters."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x{4e00}-\x{9fff}]{2,})"), 1)
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))


def with_signals(pairs: DataFrame, views: DataFrame, cues: Cues = Cues()) -> DataFrame:
    """Adds signals (array), signal_score and common (shared Han bigrams) from both contents and both time axes.

    ``views``: memory_id, content, semantic_time, valid_start, valid_end (the last three nullable).
    """
    columns = ["content", "semantic_time", "valid_start", "valid_end"]
    p = views.select(F.col("memory_id").alias("predecessor_id"), *(F.col(c).alias(f"p_{c}") for c in columns))
    s = views.select(F.col("memory_id").alias("successor_id"), *(F.col(c).alias(f"s_{c}") for c in columns))
    rows = meet(meet(pairs, p, "predecessor_id"), s, "successor_id")
    common = F.size(F.array_intersect(run_bigrams(F.col("p_content")), run_bigrams(F.col("s_content"))))
    rows = rows.withColumn("common", common)
    entity = F.col("common") >= 2
    apart = F.abs(F.unix_micros(F.col("p_semantic_time").cast("timestamp")) - F.unix_micros(F.col("s_semantic_time").cast("timestamp")))
    parts = [
        (entity, F.concat(F.lit("entity_overlap:"), F.col("common").cast("string")), F.least(F.lit(0.35), F.col("common") * 0.05)),
        (F.col("p_content").rlike(cues.plan) & F.col("s_content").rlike(cues.outcome), F.lit("plan_outcome_arc"), F.lit(0.3)),
        (F.col("s_content").rlike(cues.correction), F.lit("correction_cue"), F.lit(0.4)),
        (F.col("s_content").rlike(cues.persistence) & entity, F.lit("persistence_cue"), F.lit(0.25)),
        (F.col("p_content").rlike(cues.uncertainty) & F.col("s_content").rlike(cues.resolution), F.lit("uncertainty_resolution_arc"), F.lit(0.35)),
        (apart < 14 * 86400 * 1_000_000, F.lit("semantic_time_proximity"), F.lit(0.15)),
        ((F.col("p_valid_start") <= F.col("s_valid_end")) & (F.col("s_valid_start") <= F.col("p_valid_end")), F.lit("validity_window_overlap"), F.lit(0.2)),
    ]
    score = F.lit(0.0)
    for holds, _, weight in parts:
        score = score + F.when(holds, weight).otherwise(0.0)
    signals = F.array_compact(F.array(*(F.when(holds, name) for holds, name, _ in parts)))
    return rows.select(*pairs.columns, "p_content", "s_content", "common", signals.alias("signals"), score.alias("signal_score"))


def boundary_pairs(pairs: DataFrame, least_cosine: float = LEAST_COSINE, least_score: float = LEAST_SCORE, least_signals: int = LEAST_SIGNALS) -> DataFrame:
    """Pairs (with cosine, signals, signal_score) whose combined score and number of signals suffice."""
    similar = F.col("cosine") >= least_cosine
    score = F.when(similar, F.col("cosine") * 0.3).otherwise(0.0) + F.col("signal_score")
    n = F.size("signals") + similar.cast("int")
    return pairs.withColumn("combined", score).filter((n >= least_signals) & (F.col("combined") >= least_score)).withColumn("score", F.least(F.lit(1.0), "combined")).drop("combined")


def adjudicate(pairs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Adds relation, confidence, prior_unknown_resolved and resolved_dimensions.

    Rules in order: no overlap and no arc; correction; persistence; state change; late fact; and by
    overlap alone. Persistence resolves nothing, and an unrelated pair says nothing.
    """
    p, s = F.col("p_content"), F.col("s_content")

    def bag(text: Column) -> Column:
        return F.array_distinct(F.filter(bigrams(text), lambda b: ~b.startswith("w:")))

    larger = F.greatest(F.size(bag(p)), F.size(bag(s)))
    empty = F.least(F.size(bag(p)), F.size(bag(s))) == 0
    rows = pairs.withColumn("overlap", F.when(empty, 0.0).otherwise(F.size(F.array_intersect(bag(p), bag(s))) / larger))
    overlap = F.col("overlap")
    arc = lambda *names: F.exists("signals", lambda x: F.lit(False) if not names else _any(x, names))
    ends = s.rlike(rules.completion) | s.rlike(rules.failure) | s.rlike(rules.cancellation)
    state_change = (p.rlike(rules.plan) & ends) | (p.rlike(rules.uncertainty) & s.rlike(rules.resolution)) | ((overlap >= 0.08) & arc("plan_outcome", "uncertainty_resolution"))
    cascade = [
        ((overlap < 0.05) & ~arc("plan_outcome", "correction", "persistence", "uncertainty"), "UNRELATED", 0.8),
        (s.rlike(rules.explicit_correction) | s.rlike(rules.correction), "CORRECTION_RETRACTION", 0.85),
        (s.rlike(rules.persistence) & (overlap >= 0.1), "PERSISTENCE_CONFIRMATION", 0.8),
        (state_change, "STATE_CHANGE", 0.85),
        (s.rlike(rules.late_fact) & (overlap >= 0.05), "CORRECTION_RETRACTION", 0.75),
        ((overlap >= 0.15) & s.rlike(rules.implicit_change), "STATE_CHANGE", 0.7),
        (overlap >= 0.15, "UNKNOWN_RELATION", 0.4),
        (overlap < 0.05, "UNRELATED", 0.6),
        (F.lit(True), "UNKNOWN_RELATION", 0.3),
    ]
    verdict = F.coalesce(*(F.when(holds, F.struct(F.lit(r).alias("relation"), F.lit(c).alias("confidence"))) for holds, r, c in cascade))
    rows = rows.withColumn("verdict", verdict).withColumns({"relation": F.col("verdict.relation"), "confidence": F.col("verdict.confidence")}).drop("verdict")
    unsure = p.rlike(rules.uncertainty)
    closed = unsure & (s.rlike(rules.resolution) | s.rlike(rules.completion))
    negative = unsure & ~closed & ~s.rlike(rules.persistence) & (s.rlike(rules.failure) | s.rlike(rules.cancellation))
    persists = unsure & ~closed & s.rlike(rules.persistence)
    settled = F.when(closed | negative, F.lit(True)).when(persists, F.lit(False))
    planned = p.rlike(rules.plan) & ends & settled.isNull()
    resolved = F.coalesce(settled, F.when(planned, F.lit(True)), F.when((F.col("relation") == "CORRECTION_RETRACTION") & ~unsure, F.lit(False)))
    named = F.array_compact(F.array(F.when(p.rlike(rules.result), F.lit("test_result")), F.when(p.rlike(rules.approval), F.lit("approval_status")), F.when(p.rlike(rules.possibility), F.lit("possibility_resolution"))))
    dims = F.when(closed, F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("general_resolution")))).when(negative, F.array(F.lit("outcome_determined"))).when(planned, F.array(F.lit("plan_outcome")))
    none = F.array().cast("array<string>")
    quiet = F.col("relation").isin("PERSISTENCE_CONFIRMATION", "UNRELATED")
    first_stop = (overlap < 0.05) & ~arc("plan_outcome", "correction", "persistence", "uncertainty")
    return rows.withColumn("prior_unknown_resolved", F.when((F.col("relation") == "UNRELATED") | first_stop, F.lit(None).cast("boolean")).when(F.col("relation") == "PERSISTENCE_CONFIRMATION", F.lit(False)).otherwise(resolved)).withColumn("resolved_dimensions", F.when(quiet, none).otherwise(F.coalesce(dims, none)))


def _any(value: Column, prefixes: tuple[str, ...]) -> Column:
    out = value.startswith(prefixes[0])
    for p in prefixes[1:]:
        out = out | value.startswith(p)
    return out
