"""Ordered compilation of evidence into versioned blocks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.functions.text import identity

SAME = ["NEW", "CONTINUE"]


def islands(evidence: DataFrame, lineage: str = "lineage_id", subject: str = "subject") -> DataFrame:
    """One row per touch where consecutive equal subjects of a lineage continue a block.

    Adds block_no, block_id, state_version and state_id. Plain windows over one partitioning by
    lineage: exact wherever no subject contains another.
    """
    order = Window.partitionBy(lineage).orderBy("ordering_key", "evidence_id")
    fresh = F.when(F.lag(subject).over(order).eqNullSafe(F.col(subject)), 0).otherwise(1)
    rows = evidence.withColumn("action", F.when(fresh == 0, "CONTINUE").otherwise("NEW")).withColumn("block_no", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("block_id", identity("sb_", F.col(lineage), F.col("block_no"))).withColumn("state_version", F.row_number().over(Window.partitionBy(lineage, "block_no").orderBy("ordering_key", "evidence_id")))


def block_states(touches: DataFrame, lineage: str = "lineage_id") -> DataFrame:
    """One immutable version per touch: the range so far, when it was known, and its evidence."""
    so_far = Window.partitionBy(lineage, "block_no").orderBy("ordering_key", "evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = touches.select(
        lineage, "block_no", "block_id", "state_version", "subject",
        F.min("occurred_at").over(so_far).alias("occurred_start"),
        F.max("occurred_at").over(so_far).alias("occurred_end"),
        F.max("known_at").over(so_far).alias("derived_known_at"),
        F.collect_list("evidence_id").over(so_far).alias("raw_evidence_ids"),
    )
    return rows.withColumn("state_id", identity("state_", F.col("block_id"), F.col("state_version")))


def supported_states(touches: DataFrame, valid: DataFrame, lineage: str = "lineage_id") -> DataFrame:
    """The versions without their evidence, and ``supported``: whether every evidence so far is valid.

    ``valid`` has evidence_id and valid; an evidence it does not name is not valid. A version's first
    invalid evidence settles all later ones, so a running minimum per block is enough and no version
    carries, or is joined with, all of its evidence.
    """
    so_far = Window.partitionBy(lineage, "block_no").orderBy("ordering_key", "evidence_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = touches.join(valid.select("evidence_id", F.col("valid").alias("_valid")), "evidence_id", "left").select(
        lineage, "block_no", "block_id", "state_version", "subject",
        F.min("occurred_at").over(so_far).alias("occurred_start"),
        F.max("occurred_at").over(so_far).alias("occurred_end"),
        F.max("known_at").over(so_far).alias("derived_known_at"),
        F.bool_and(F.coalesce("_valid", F.lit(False))).over(so_far).alias("supported"),
    )
    return rows.withColumn("state_id", identity("state_", F.col("block_id"), F.col("state_version")))


def bridge(states: DataFrame, key: str = "state_id") -> DataFrame:
    return states.select(key, F.explode("raw_evidence_ids").alias("evidence_id"))


def key_of(subject: str) -> str:
    return "".join(c for c in subject if c.isalnum() or c == "_").casefold()


class Compiler:
    """The fold of one lineage: state is the blocks made so far, the open one, the last key seen and the item that failed.

    ``blocks`` and ``done`` may be anything that answers as a list and a dict do. ``provider`` decides in place of the rules:
    it gets the compiler and the row and gives what :meth:`decide` gives, or raises.
    """

    def __init__(self, lineage: str, state: dict | None = None, provider: Callable | None = None):
        self.lineage = lineage
        self.state = state or {"blocks": [], "open": None, "last": None, "done": {}, "pending": None}
        self.provider = provider or Compiler.decide

    def decide(self, row: dict) -> tuple[str, int | None]:
        """(action, index of the block it touches): rules over declared topics and flags."""
        topics = row.get("topics") or []
        if len(topics) >= 2:
            return "SPLIT", None
        blocks, at = self.state["blocks"], self.state["open"]
        mine = key_of(row["subject"]) if row.get("recap") or at is not None else ""
        same = lambda b: (key := key_of(b["subject"])) in mine or mine in key
        if row.get("recap"):
            matching = sorted((b["occurred_start"], b["block_id"], i) for i, b in enumerate(blocks) if mine and same(b))
            if matching:
                return "RECAP", matching[-1][2]
        if at is not None and mine and same(blocks[at]):
            return "CONTINUE", at
        return "NEW", None

    def touch(self, at: int | None, row: dict, subject: str, content: str) -> dict:
        blocks = self.state["blocks"]
        if at is None:
            blocks.append({"block_id": f"{self.lineage}_{len(blocks) + 1:06d}", "subject": subject, "version": 0, "content": "", "occurred_start": row["occurred_at"], "occurred_end": row["occurred_at"], "known_at": row["known_at"], "evidence": []})
            at = len(blocks) - 1
        b = blocks[at]
        if content not in b["content"] or not b["content"]:
            b["content"] = f"{b['content']}\n{content}" if b["content"] else content
        b["version"] += 1
        b["occurred_start"], b["occurred_end"] = min(b["occurred_start"], row["occurred_at"]), max(b["occurred_end"], row["occurred_at"])
        b["known_at"] = max(b["known_at"], row["known_at"])
        if row["evidence_id"] not in b["evidence"]:
            b["evidence"].append(row["evidence_id"])
        return b

    def process(self, row: dict) -> list[dict]:
        """States that one item makes; none for one that was compiled before; or one row that says why it makes none.

        BLOCKED: an earlier item failed and has not been compiled since. LATE: it comes before what was compiled last. FAILED:
        no decision could be made; nothing has changed but that the item blocks those after it until it is given again.
        """
        key, state = (row["ordering_key"], row["evidence_id"]), self.state
        nothing = lambda action, why=None: [{"action": action, "evidence_id": row["evidence_id"], "failure": why}]
        if row["evidence_id"] in state["done"]:
            if state["pending"] == row["evidence_id"]:
                state["pending"] = None
            return []
        if state["pending"] is not None and state["pending"] != row["evidence_id"]:
            return nothing("BLOCKED")
        if state["last"] is not None and key < tuple(state["last"]):
            return nothing("LATE")
        try:
            action, at = self.provider(self, row)
            if any(row[c] is None or row[c] != row[c] for c in ("occurred_at", "known_at", "subject", "content")) or any(t is None for t in row.get("topics") or []):
                raise ValueError("an item without time, subject, content or topic")
        except Exception as error:
            state["pending"] = row["evidence_id"]
            return nothing("FAILED", str(error))
        if action == "SPLIT":
            touched = {}
            for topic in row["topics"]:
                b = self.touch(None, row, topic, row["content"])
                touched[b["block_id"]] = b
            state["open"] = len(state["blocks"]) - 1
            made = list(touched.values())
        else:
            made = [self.touch(at, row, row["subject"], row["content"])]
            if action == "NEW":
                state["open"] = len(state["blocks"]) - 1
        state["last"], state["pending"] = key, None
        state["done"][row["evidence_id"]] = [b["block_id"] for b in made]
        return [{"action": action, "evidence_id": row["evidence_id"], "block_id": b["block_id"], "state_version": b["version"], "subject": b["subject"], "content": b["content"], "occurred_start": b["occurred_start"], "occurred_end": b["occurred_end"], "derived_known_at": b["known_at"], "raw_evidence_ids": list(b["evidence"])} for b in made]


STATES = (
    "lineage_id string, action string, evidence_id string, block_id string, state_version int, subject string, content string, "
    "occurred_start timestamp, occurred_end timestamp, derived_known_at timestamp, raw_evidence_ids array<string>, failure string"
)
NAMES = [c.split()[0] for c in STATES.split(", ")]
#: Actions that made a state.
MADE = ["NEW", "CONTINUE", "SPLIT", "RECAP"]


def as_frame(made: list[dict]) -> pd.DataFrame:
    """Rows of ``STATES``; what a row does not name is null."""
    columns = {n: [m.get(n) for m in made] for n in NAMES}
    times = ("occurred_start", "occurred_end", "derived_known_at")
    at = pd.to_datetime(pd.Series([t for c in times for t in columns[c]], dtype=object))
    parts = {c: at.iloc[i * len(made) : (i + 1) * len(made)].array for i, c in enumerate(times)}
    numbers = pd.array(columns["state_version"], dtype="Int32")
    return pd.DataFrame({n: parts[n] if n in parts else numbers if n == "state_version" else pd.Series(columns[n], dtype=object) for n in NAMES})


def compile_batch(evidence: DataFrame) -> DataFrame:
    """All actions (NEW, CONTINUE, SPLIT, RECAP, and LATE, FAILED, BLOCKED, which make no state) as one fold per lineage.

    ``evidence`` has lineage_id, evidence_id, ordering_key, subject, content, occurred_at, known_at,
    topics (array) and recap (boolean). One lineage is one group: the fold is sequential by meaning.
    """

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        compiler = Compiler(str(key[0]))
        rows = rows.sort_values(["ordering_key", "evidence_id"], kind="stable")
        made = [{"lineage_id": str(key[0])} | s for r in rows.to_dict("records") for s in compiler.process(r | {"topics": list(r["topics"]) if r["topics"] is not None else []})]
        return as_frame(made)

    return evidence.groupBy("lineage_id").applyInPandas(fold, STATES)
