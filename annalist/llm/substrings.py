"""Substring dedup: word windows that repeat across documents, found by level-wise doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import id_and_bytes, rows_out, slices
from annalist.scratch import materialize

#: Odd multipliers and their inverses modulo 2**64, one for each half of a window's hash.
BASE = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASE)
MIX = np.uint64(0xD6E8FEB86659FD93)
EMPTY = hashlib.sha256(b"").hexdigest()


def levels(length: int, least: int = 12) -> list[int]:
    """Window lengths, each at most twice the one before it, from over ``least`` words up to ``length``."""
    out = [length]
    while (half := (out[0] + 1) // 2) > least:
        out.insert(0, half)
    return out


class Windows:
    """Hashes of all windows of a length, from prefix sums over word hashes: two halves of 64 bits."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones((2, 1), np.uint64)

    def grow(self, n: int) -> None:
        if self.power.shape[1] < n:
            for name, bases in (("power", BASE), ("inverse", INVERSE)):
                steps = np.repeat(np.array(bases, np.uint64)[:, None], 2 * n, 1)
                steps[:, 0] = 1
                setattr(self, name, np.cumprod(steps, 1))

    def sums(self, words: list[bytes], halves: int = 1) -> np.ndarray:
        """Prefix sums for the first half of the hashes, or for both."""
        from xxhash import xxh3_128_digest

        n = len(words)
        self.grow(n + 1)
        hashes = np.frombuffer(b"".join(map(xxh3_128_digest, words)), "<u8").reshape(n, 2).T[:halves]
        return np.concatenate([np.zeros((halves, 1), np.uint64), np.cumsum(hashes * self.power[:halves, :n], 1)], 1)

    def at(self, sums: np.ndarray, length: int, half: int = 0) -> np.ndarray:
        """One well-mixed hash for each window start."""
        row = sums[half]
        n = max(0, len(row) - length)
        mixed = (row[length:] - row[:n]) * self.inverse[half, :n] * MIX
        return (mixed ^ mixed >> np.uint64(32)) * MIX

    def pivots(self, halves: np.ndarray, width: int) -> np.ndarray:
        """For each window of the full length: the start of the least of the shorter windows inside it."""
        view = np.lib.stride_tricks.sliding_window_view(halves, width)
        return view.argmin(1) + np.arange(len(view))


SEEN = {
    "doc_id": pa.int64(), "body_hash": pa.int64(), "n_words": pa.int64(), "full_sha256": pa.string(),
    "hashes": pa.list_(pa.int64()),
}


def first_windows(docs: DataFrame, length: int, short: int) -> DataFrame:
    """Per document: its word count and digest, and the different windows of ``short`` words that are pivots in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in SEEN}
            for doc_id, body, body_hash in zip(*(c.to_pylist() for c in batch.columns)):
                words = body.split()
                hashes = np.empty(0, np.int64)
                if len(words) >= length and doc_id is not None:
                    shorter = windows.at(windows.sums(words), short)
                    hashes = np.unique(shorter[windows.pivots(shorter, length - short + 1)]).view(np.int64)
                for k, v in zip(SEEN, (doc_id, body_hash, len(words), hashlib.sha256(b" ".join(words)).hexdigest(), hashes)):
                    out[k].append(v)
            yield rows_out(SEEN, out)

    return docs.mapInArrow(run, "doc_id long, body_hash long, n_words long, full_sha256 string, hashes array<long>")


def packed(docs: DataFrame) -> DataFrame:
    """Bodies in compressed form, to be shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        squeeze = ZstdCompressor(level=3, write_checksum=False).compress
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(squeeze, batch.column(1).to_pylist()), pa.binary()), batch.column(2)], names=["doc_id", "body", "body_hash"])

    return docs.mapInArrow(run, "doc_id long, body binary, body_hash long")


def unpacked(body: bytes) -> bytes:
    from zstandard import ZstdDecompressor

    return ZstdDecompressor().decompress(body)


def longer_windows(bodies: DataFrame, length: int, short: int, then: int) -> DataFrame:
    """(hash, check, doc_id, body_hash): a document's different windows of ``then`` words where those of
    ``short`` words repeat (column ``hashes``); pivots again unless ``then`` is the full length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in slices(batches, 64):
            hashes, checks, ids, prints = [], [], [], []
            for doc_id, body_hash, body, kept in zip(*(c.to_pylist() for c in batch.columns)):
                sums = windows.sums(unpacked(body).split(), 2)
                shorter = windows.at(sums, short)
                inside = np.isin(shorter.view(np.int64), kept)[windows.pivots(shorter, length - short + 1)]
                grown = windows.at(sums, then)
                at = np.flatnonzero(inside)
                if then < length:
                    at = np.unique(windows.pivots(grown, length - then + 1)[inside])
                found, one = np.unique(grown[at], return_index=True)
                hashes.append(found.view(np.int64))
                checks.append(windows.at(sums, then, 1)[at[one]].view(np.int64))
                ids.append(np.full(len(found), doc_id))
                prints.append(np.full(len(found), body_hash))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hashes, checks, ids, prints)], names=["hash", "check", "doc_id", "body_hash"])

    return bodies.mapInArrow(run, "hash long, check long, doc_id long, body_hash long")


KEPT = {"doc_id": pa.int64(), "body_hash": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string()}


def removed(bodies: DataFrame, length: int, texts: bool) -> DataFrame:
    """What stays of each document once its windows with the given ``hashes`` are cut out.

    ``hashes`` has both halves of each: only a window that agrees in all 128 bits goes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for batch in slices(batches, 64):
            out: dict[str, list] = {k: [] for k in KEPT}
            for doc_id, body_hash, body, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpacked(body).split()
                change = np.zeros(len(words) + 1, np.int64)
                sums = windows.sums(words, 2)
                gone = np.array([(h["hash"], h["check"]) for h in hashes], np.int64)
                gone = gone[np.argsort(gone[:, 0])]
                mine = windows.at(sums, length).view(np.int64)
                place = np.minimum(np.searchsorted(gone[:, 0], mine), len(gone) - 1)
                at = np.flatnonzero((gone[place, 0] == mine) & (gone[place, 1] == windows.at(sums, length, 1).view(np.int64)))
                change[at] += 1
                change[at + length] -= 1
                stays = np.cumsum(change[:-1]) == 0
                kept = b" ".join(compress(words, stays.tolist()))
                text = kept.decode("utf-8", "replace") if texts else None
                for k, v in zip(KEPT, (doc_id, body_hash, int(len(words) - stays.sum()), hashlib.sha256(kept).hexdigest(), text)):
                    out[k].append(v)
            yield rows_out(KEPT, out)

    return bodies.mapInArrow(run, "doc_id long, body_hash long, n_removed long, kept_sha256 string, kept string")


def repeated_words(docs: DataFrame, length: int = 50, texts: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, body_hash, n_words, n_removed, kept_sha256, kept): each document without its repeats.

    A word goes if a window of ``length`` consecutive words covers it whose word sequence also starts
    in a document with a smaller doc_id; windows are judged on the input. ``kept`` is the text that
    stays where something was removed and ``texts`` is set, else null.

    Levels (:func:`levels`: 13, 25 and 50 words): windows of the shortest length first, and of these
    only pivots, the least hash inside each full window; equal full windows have equal pivots, so none
    is missed. Pivots found in one document only are dropped, and where others lie, those of up to
    twice the length are made and matched, until the full length is reached or no candidate survives.
    Longer windows could cover no other word. Full windows are compared by hashes of 128 bits.

    A document whose words all equal those of a smaller doc_id is settled by its digest, at no cost
    but a row. Documents with fewer words than ``length`` (empty and null texts too) keep all. Rows
    with a null doc_id keep all and match nothing; repeated rows of one doc_id do not match each
    other; an empty table gives no rows; other columns are not read; very long texts are whole.
    """
    bodies = id_and_bytes(docs, id_col, text_col).withColumn("body_hash", F.xxhash64("body"))
    sizes = levels(length)
    sizes = [length, *sizes] if len(sizes) == 1 else sizes
    seen = materialize(first_windows(bodies, length, sizes[0]), "first-windows")
    whole = seen.select("doc_id", "body_hash", "n_words", "full_sha256")
    # Tables of their own: the joins after them can then split a hot digest or window.
    firsts = materialize(whole.filter(F.col("n_words") >= length).groupBy("full_sha256").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    copies = materialize(whole.join(firsts, "full_sha256").filter("doc_id > first").select("doc_id", "body_hash").distinct(), "copies")
    key = ["doc_id", "body_hash"]

    def repeated(rows: DataFrame, *names: str) -> DataFrame:
        """The windows in several documents, and the smallest of these (low)."""
        return materialize(rows.groupBy(*names).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select(*names, "low"), "repeated")

    def gathered(rows: DataFrame, column) -> DataFrame:
        return rows.groupBy(key).agg(F.collect_list(column).alias("hashes"))

    small = packed(bodies.filter(F.octet_length("body") >= 2 * length - 1))
    found = seen.select(*key, F.explode("hashes").alias("hash"))
    for short, then in zip(sizes, sizes[1:]):
        candidates = gathered(found.join(repeated(found, "hash"), "hash"), "hash")
        if short == sizes[0]:
            candidates = candidates.join(copies, key, "left_anti")
        found = materialize(longer_windows(small.join(candidates, key).select("doc_id", "body_hash", "body", "hashes"), length, short, then), "windows")
    cut = gathered(found.join(repeated(found, "hash", "check"), ["hash", "check"]).filter("doc_id > low"), F.struct("hash", "check"))
    changed = removed(small.join(cut, key).select("doc_id", "body_hash", "body", "hashes"), length, texts).dropDuplicates(key)

    copied = F.col("is_copy").isNotNull()
    return (
        whole.join(copies.withColumn("is_copy", F.lit(True)), key, "left")
        .join(changed, key, "left")
        .select(
            "doc_id", "body_hash", "n_words",
            F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
            F.when(copied, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "full_sha256")).alias("kept_sha256"),
            F.when(copied, F.lit("" if texts else None)).otherwise(F.col("kept")).alias("kept"),
        )
    )


def replaced(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` for the texts that ``plan`` (doc_id, body_hash, kept) names, and ``n_chars`` anew."""
    plan = materialize(plan.select(F.col("doc_id").alias("_id"), F.col("body_hash").alias("_hash"), F.col("kept").alias("_kept")).dropDuplicates(["_id", "_hash"]), "replaced")
    hashed = F.xxhash64(F.coalesce(docs["text"].cast("binary"), F.lit(b"")))
    joined = docs.join(plan, (docs["doc_id"].cast("long") == plan["_id"]) & (hashed == plan["_hash"]), "left")
    new = {"text": F.coalesce(plan["_kept"], docs["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(plan["_kept"].isNotNull(), F.length(plan["_kept"]).cast("long")).otherwise(docs["n_chars"].cast("long"))
    return joined.select(*(new[c].alias(c) if c in new else docs[c] for c in docs.columns))


def substring_dedup(docs: DataFrame, length: int = 50) -> DataFrame:
    """The documents, all columns kept, with repeated windows cut from ``text``.

    Texts that lose nothing stay as they are; of others the kept words are joined by one space.
    """
    return replaced(docs, repeated_words(docs, length, texts=True).filter("n_removed > 0"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 48, 1)::BIGINT)) AS i FROM split)
), firsts AS (
  SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)
), cut AS (
  SELECT w.doc_id, unnest(range(w.i, w.i + 50)) AS i FROM windows w JOIN firsts f ON w.h = f.h AND w.doc_id > f.low
), gone AS (
  SELECT DISTINCT doc_id, i FROM cut
), words AS (
  SELECT s.doc_id, unnest(s.words) AS word, unnest(range(1, len(s.words) + 1)) AS i FROM split s
), kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.i) AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i WHERE g.i IS NULL GROUP BY w.doc_id
)
SELECT s.doc_id, len(s.words)::BIGINT AS n_words, (len(s.words) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
