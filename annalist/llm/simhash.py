"""SimHash near-duplicates found through a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most 3 bits agree in at least 5 of their 8 bytes. The index
therefore keys every fingerprint by 14 sets of four byte positions, the blocks of the quadruple system
on eight points: any five positions hold one of them, so every such pair meets under some key. Where
a pair meets, its shared positional bytes are tallied, pairs below five are dropped, and the Hamming
distance of the rest is verified.

A key's list that is longer than a bound is split: of the bits its fingerprints are not keyed by yet,
cut in four parts, a pair with at most three differing bits agrees in one whole part, so a list for
each part and value loses no pair. Lists still too long are split again, down to single bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import id_and_bytes, slices
from annalist.operators.graph import connected_components
from annalist.scratch import materialize

#: Quadruples of byte positions that sum to zero under exclusive or.
QUADRUPLES = [q for q in combinations(range(8), 4) if reduce(lambda x, y: x ^ y, q) == 0]
MOST_BITS = 3
LEAST_BYTES = 8 - MOST_BITS
#: A list of more fingerprints than this is split.
MOST_LISTED = 4096


def fingerprint(body: bytes, width: int = 3) -> int:
    """The SimHash of the lower-cased words' shingles, repeats included, as a signed 64-bit integer."""
    from xxhash import xxh64_intdigest

    words = body.lower().split()
    if len(words) > width:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    else:
        shingles = [b" ".join(words)] if words else []
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), "<u8")
    if not len(hashes):
        return 0
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every document; texts without a word have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(b, width) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Which of ``many`` are near any of ``one``: bytes shared by position first, bits then."""
    found = np.zeros(len(many), bool)
    step = max(1, 4_000_000 // max(1, len(many)))
    for at in range(0, len(one), step):
        mixed = one[at : at + step, None] ^ many[None, :]
        shared = (np.ascontiguousarray(mixed).view(np.uint8).reshape(*mixed.shape, 8) == 0).sum(2)
        rows, columns = np.nonzero(shared >= LEAST_BYTES)
        close = np.bitwise_count(mixed[rows, columns].view(np.uint64)) <= MOST_BITS
        found[columns[close]] = True
    return found


def stars(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of one key's fingerprints that hang together, each as its first member and the rest.

    Every fingerprint is compared once with those not reached yet; a part of m members gives m - 1
    links, never all of its pairs.
    """
    rest = prints
    while len(rest):
        first, front, rest = rest[:1], rest[:1], rest[1:]
        reached = []
        while len(front) and len(rest):
            hit = near(front, rest)
            front, rest = rest[hit], rest[~hit]
            reached.append(front)
        if reached and len(members := np.concatenate(reached)):
            yield int(first[0]), members


def links(index: DataFrame) -> DataFrame:
    """(a, b) fingerprints that link, a star for each connected part of each key's list.

    ``index`` has (key, fp), all rows of a key in one partition and next to each other. A list holds
    distinct fingerprints that agree in 32 bits, 8 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_prints = np.empty(0, np.int64), np.empty(0, np.int64)

        def closed(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            at = starts[sizes == 2]
            close = np.bitwise_count((prints[at] ^ prints[at + 1]).view(np.uint64)) <= MOST_BITS
            a, b = [prints[at[close]]], [prints[at[close] + 1]]
            for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                for first, members in stars(prints[start : start + size]):
                    a.append(np.full(len(members), first))
                    b.append(members)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

        pieces: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys, prints = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            pieces.append((keys, prints))
            if len(keys) and keys[0] == keys[-1] and (not held_keys.size or keys[0] == held_keys[-1]):
                continue  # one key still
            keys, prints = np.concatenate([held_keys, *(p[0] for p in pieces)]), np.concatenate([held_prints, *(p[1] for p in pieces)])
            pieces = []
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if len(keys) and keys[0] != keys[-1] else 0
            held_keys, held_prints = keys[cut:], prints[cut:]
            yield closed(keys[:cut], prints[:cut])
        yield closed(np.concatenate([held_keys, *(p[0] for p in pieces)]), np.concatenate([held_prints, *(p[1] for p in pieces)]))

    return index.mapInArrow(run, "a long, b long")


def parts_of(free: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The bits cut in one part more than may differ, as even as they go."""
    n = MOST_BITS + 1
    return [part for i in range(n) if (part := free[i * len(free) // n : (i + 1) * len(free) // n])]


def mask(bits: tuple[int, ...]) -> int:
    """The bits as a signed 64-bit integer."""
    return int(np.bitwise_or.reduce(np.array([1 << b for b in bits], np.uint64)).view(np.int64))


def keyed(prints: DataFrame, most: int = MOST_LISTED) -> DataFrame:
    """(key, fp): every fingerprint under each of its keys; lists of more than ``most`` are split by further bits.

    The key of a split list is a hash of its bits' places and values: lists that collide only have
    more pairs verified. Splits end where four bits are left, at 16 fingerprints at most.
    """
    byte = [F.shiftrightunsigned("fp", 8 * j).bitwiseAND(F.lit(255)) for j in range(8)]
    keys = [reduce(lambda k, j: F.shiftleft(k, 8) + byte[j], q, F.lit(n).cast("long")) for n, q in enumerate(QUADRUPLES)]
    free = [tuple(b for j in range(8) if j not in q for b in range(8 * j, 8 * j + 8)) for q in QUADRUPLES]
    entries = F.explode(F.array(*(F.struct(key.alias("key"), F.lit(mask(bits)).alias("free")) for key, bits in zip(keys, free))))
    index, done = prints.select(entries.alias("entry"), "fp").select("entry.*", "fp"), []
    while True:
        long = materialize(index.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key"), "long-lists")
        free = sorted({bits for bits in free if len(bits) > MOST_BITS + 1})
        if not free or long.isEmpty():
            return reduce(DataFrame.unionAll, [*done, index.select("key", "fp")])
        splits, left = [], []
        for bits in free:
            for part in parts_of(bits):
                left.append(tuple(b for b in bits if b not in part))
                splits.append((mask(bits), mask(part), mask(left[-1])))
        done.append(index.join(long, "key", "left_anti").select("key", "fp"))
        table = prints.sparkSession.createDataFrame(splits, "free long, part long, left long")
        grown = index.join(long, "key", "left_semi").join(F.broadcast(table), "free")  # four rows for each set of bits
        key = F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("part")))
        index, free = materialize(grown.select(key.alias("key"), F.col("left").alias("free"), "fp"), "split-lists"), left


def components(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document.

    Equal fingerprints are one entry of the index, so copies cost a row each and nothing more.
    ``component_id`` is the smallest doc_id reachable over links of at most 3 differing bits.

    Null and empty texts have fingerprint zero and link like others; rows with a null doc_id keep a
    null id, link, and never name a component (null if it has no other row); repeated rows are kept;
    an empty table gives no rows; other columns are not read. Whole texts count, however long.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    index = keyed(distinct.select("fp")).repartition("key").sortWithinPartitions("key", "fp")
    parts = connected_components(links(index)).withColumnsRenamed({"node": "fp", "component": "part"})
    linked = distinct.join(parts, "fp")
    named = linked.join(linked.groupBy("part").agg(F.min("first").alias("smallest")), "part").select("fp", "smallest")
    every = distinct.join(named, "fp", "left").select("fp", F.coalesce("smallest", "first").alias("component_id"))
    every = materialize(every, "components")  # a table of its own: the join can then split a hot fingerprint
    return prints.join(every, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """Of each component the document with the smallest doc_id, with all of its columns.

    Rows with a null doc_id stay. Rows that repeat a doc_id are one document. Null and empty texts
    are alike, so one of them stays; an empty table gives no rows; other columns are untouched.
    """
    lost = components(docs, width).filter("doc_id != component_id").select(F.col("doc_id").alias("_lost")).distinct()
    return docs.join(lost, docs["doc_id"].cast("long") == lost["_lost"], "left_anti")
