"""Line dedup: maximal repeated runs of lines, by prefix doubling over line-ID sequences.

A document is the sequence of the IDs of its lines that hold a word. A suffix is named by its first k
IDs; its name for 2k is made of its own for k and of that of the suffix k lines on. Equal names are
one interval of the suffix array, whose longest common prefix is k at least. Each round keeps the
suffixes whose name is not alone, with the earliest suffix of their interval as source, and rounds go
on until none is left. Neighbouring suffixes whose sources are neighbours too are one run: m of them
copy m + k - 1 lines. Of the runs of all rounds those that no other run of the document covers are
maximal; they are a table, and all lines in them are deleted. Names are 128-bit digests, so all
documents agree on them without a global sort; intervals come in the order of names, which deletion
never needs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import id_and_bytes, rows_out, slices
from annalist.llm.substrings import packed, replaced, unpacked
from annalist.scratch import discard, materialize

KEY = ["doc_id", "body_hash"]
SOLID = r"[^\x20\x09-\x0D]"


def longer(length: int, shortest: int) -> int:
    """The next round's prefix: twice as long, but for a stop at ``shortest``."""
    return shortest if length < shortest < 2 * length else 2 * length


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, body_hash, pos, name): a row per line with a word, named by itself."""
    lines = F.filter(F.split(F.col("body").cast("string"), "\n", -1), lambda line: line.rlike(SOLID))
    ids = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "body_hash", F.transform(lines, lambda line: F.unhex(F.md5(line))).alias("ids"))
    return ids.select("doc_id", "body_hash", F.posexplode("ids").alias("pos", "name"))


def intervals(suffixes: DataFrame) -> DataFrame:
    """The suffixes whose name is not alone, and ``first``: the earliest one (by doc_id, body_hash, pos) with the name, null on itself.

    The intervals are a table of their own, a row per name counted before the shuffle, so that the
    join after it can split a hot name.
    """
    place = F.struct("doc_id", "body_hash", "pos")
    found = materialize(suffixes.groupBy("name").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("name", "first"), "intervals")
    rows = suffixes.join(found, "name").select("doc_id", "body_hash", "pos", "name", F.when(place > F.col("first"), F.col("first")).alias("first"))
    out = materialize(rows, "suffixes")
    discard(found)
    return out


def runs_of_round(placed: DataFrame, length: int) -> DataFrame:
    """(doc_id, body_hash, start, end, source, round): the runs that prefixes of ``length`` lines show, ``end`` exclusive."""
    later = placed.filter("first is not null").groupBy(*KEY, "run").agg(F.min(F.struct("pos", "first")).alias("head"), F.max("pos").alias("last"))
    return later.select(*KEY, F.col("head.pos").alias("start"), (F.col("last") + length).cast("int").alias("end"), F.col("head.first").alias("source"), F.lit(length).alias("round"))


def runs_by_round(docs: DataFrame, shortest: int) -> DataFrame:
    """The runs of every round, those that another covers included."""
    w = Window.partitionBy(*KEY).orderBy("pos")
    before = F.struct((F.col("pos") - 1).alias("pos"), F.struct("first.doc_id", "first.body_hash", (F.col("first.pos") - 1).alias("pos")).alias("first"))
    follows = F.coalesce(F.max(F.struct("pos", "first")).over(w.rangeBetween(-1, -1)) == before, F.lit(False))  # rows that repeat a document are peers
    found, length, now = [], 1, intervals(suffixes(docs))
    while True:
        then = longer(length, shortest)
        on = F.max("name").over(w.rangeBetween(then - length, then - length))
        placed = materialize(now.withColumns({"on": on, "head": F.when(follows, 0).otherwise(1)}).withColumn("run", F.sum("head").over(w)).drop("head"), "placed")
        discard(now)
        found.append(materialize(runs_of_round(placed, length), "runs"))
        grown = placed.filter("on is not null").select(*KEY, "pos", F.unhex(F.md5(F.concat("name", "on"))).alias("name"))
        length, now = then, intervals(grown)
        discard(placed)
        if now.isEmpty():
            return reduce(DataFrame.unionAll, found)


def maximal(runs: DataFrame) -> DataFrame:
    """The runs that no other run of their document covers; of equal ones one."""
    before = F.max("end").over(Window.partitionBy(*KEY).orderBy("start", F.desc("end"), "source").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("before", before).filter("before is null or end > before").drop("before")


def maximal_runs(docs: DataFrame, shortest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body_hash, start, length, source): runs of ``shortest`` lines or more that copy an earlier run.

    ``start`` counts the document's lines with a word from 0; ``source`` (doc_id, body_hash, pos) is
    where the earlier copy begins. A run ends where the texts part or where a still earlier copy
    takes over. Cases are those of :func:`repeated_lines`.
    """
    bodies = id_and_bytes(docs, id_col, text_col).withColumn("body_hash", F.xxhash64("body"))
    runs = maximal(runs_by_round(bodies, shortest).filter(F.col("round") >= shortest))
    return runs.select(*KEY, "start", (F.col("end") - F.col("start")).alias("length"), "source")


def repeated_runs(docs: DataFrame, shortest: int) -> DataFrame:
    """(doc_id, body_hash, starts, ends, longest_copy): a document's maximal runs, and the longest prefix of
    the rounds at which one of its suffixes has an earlier copy; ``starts`` is null where only shorter ones have.
    """
    every = runs_by_round(docs, shortest)
    longest = every.groupBy(*KEY).agg(F.max("round").cast("long").alias("longest_copy"))
    runs = maximal(every.filter(F.col("round") >= shortest)).groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    return longest.join(runs, KEY, "left").select(*KEY, F.col("runs.start").alias("starts"), F.col("runs.end").alias("ends"), "longest_copy")


KEPT = {"doc_id": pa.int64(), "body_hash": pa.int64(), "n_deleted": pa.int64(), "n_runs": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}


def without(bodies: DataFrame, texts: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out: dict[str, list] = {k: [] for k in KEPT}
            for doc_id, body_hash, body, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                lines = unpacked(body).split(b"\n")
                solid = np.flatnonzero([bool(line.split()) for line in lines])
                change = np.zeros(len(solid) + 1, np.int64)
                np.add.at(change, np.array(starts), 1)
                np.add.at(change, np.array(ends), -1)
                gone = np.cumsum(change[:-1]) > 0
                runs = int((gone & ~np.append(False, gone[:-1])).sum())
                lost = set(solid[gone].tolist())
                kept = b"\n".join(line for i, line in enumerate(lines) if i not in lost)
                text = kept.decode("utf-8", "replace") if texts else None
                for k, v in zip(KEPT, (doc_id, body_hash, len(lost), runs, hashlib.sha256(kept).hexdigest(), text)):
                    out[k].append(v)
            yield rows_out(KEPT, out)

    return bodies.mapInArrow(run, "doc_id long, body_hash long, n_deleted long, n_runs long, kept_sha256 string, kept string")


def repeated_lines(docs: DataFrame, shortest: int = 2, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body_hash, n_lines, n_deleted, n_runs, longest_copy, kept_sha256, kept) of every document.

    Lines are what ``\\n`` separates; those without a word (by ASCII white space) are passed over and
    always stay. Any ``shortest`` consecutive other lines that also stand earlier (in a smaller
    doc_id, or before in the same document) are deleted, so of each maximal repeated run only the
    first copy stays. ``n_runs`` counts the stretches deleted from a document, each made of maximal
    runs that touch or overlap (:func:`maximal_runs`); ``longest_copy`` is
    the greatest prefix length of the rounds (1, 2, 4 and so on) at which lines of it have an earlier
    copy, 0 if none; ``kept`` is what stays of a changed text if ``texts`` is set, else null. IDs and
    names are 128-bit digests.

    Null and empty texts have no lines; rows with a null doc_id keep all and match nothing; rows that
    repeat both doc_id and text are one document; an empty table gives no rows; other columns are not
    read; very long texts and lines are whole. A hot line is one row per task in the counts.
    """
    bodies = id_and_bytes(docs, id_col, text_col).withColumn("body_hash", F.xxhash64("body"))
    solid = F.size(F.filter(F.split(F.col("body").cast("string"), "\n", -1), lambda line: line.rlike(SOLID))).cast("long")
    whole = bodies.select(*KEY, solid.alias("n_lines"), F.sha2("body", 256).alias("full_sha256"))
    runs = materialize(repeated_runs(bodies, shortest), "runs")
    small = packed(bodies if shortest == 1 else bodies.filter(F.col("body").cast("string").contains("\n")))
    changed = without(small.join(runs.filter("starts is not null"), KEY).select(*KEY, "body", "starts", "ends"), texts).dropDuplicates(KEY)
    return whole.join(changed, KEY, "left").join(runs.select(*KEY, "longest_copy"), KEY, "left").select(
        *KEY, "n_lines",
        F.coalesce("n_deleted", F.lit(0).cast("long")).alias("n_deleted"),
        F.coalesce("n_runs", F.lit(0).cast("long")).alias("n_runs"),
        F.coalesce("longest_copy", F.lit(0).cast("long")).alias("longest_copy"),
        F.coalesce("kept_sha256", "full_sha256").alias("kept_sha256"),
        "kept",
    )


def line_dedup(docs: DataFrame, shortest: int = 2) -> DataFrame:
    """The documents, all columns kept, with repeated runs cut from ``text`` and ``n_chars`` anew.

    Null, empty and very long texts, null doc_ids, repeated rows and ties are as in :func:`repeated_lines`;
    each of several rows alike loses the same lines. An empty table gives no rows.
    """
    return replaced(docs, repeated_lines(docs, shortest, texts=True).filter("n_deleted > 0"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, line, i, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END AS solid
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
), placed AS (
  SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM lines WHERE solid = 1
), listed AS (
  SELECT doc_id, list(md5(line) ORDER BY pos) AS ids FROM placed GROUP BY doc_id
), prefixes AS (
  SELECT doc_id, ids, k, unnest(range(1, len(ids) - k + 2)) AS pos FROM listed, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096]) AS k) WHERE k <= len(ids)
), later AS (
  SELECT doc_id, pos, k, row_number() OVER (PARTITION BY k, md5(array_to_string(ids[pos:pos + k - 1], ',')) ORDER BY doc_id, pos) AS copy FROM prefixes
), longest AS (
  SELECT doc_id, max(k) AS k FROM later WHERE copy > 1 GROUP BY doc_id
), gone AS (
  SELECT doc_id, pos FROM later WHERE k = 1 AND copy > 1
), marked AS (
  SELECT l.doc_id, l.line, l.i, l.solid, p.pos, g.pos IS NOT NULL AS gone
  FROM lines l LEFT JOIN placed p ON l.doc_id = p.doc_id AND l.i = p.i LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos
), runs AS (
  SELECT doc_id, count(*) AS n FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone h WHERE h.doc_id = g.doc_id AND h.pos = g.pos - 1) GROUP BY doc_id
), kept AS (
  SELECT doc_id, sum(solid)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_deleted,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_deleted, 0)::BIGINT AS n_deleted,
       coalesce(r.n, 0)::BIGINT AS n_runs, coalesce(x.k, 0)::BIGINT AS longest_copy, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN runs r ON d.doc_id = r.doc_id LEFT JOIN longest x ON d.doc_id = x.doc_id
"""
