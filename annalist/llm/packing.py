"""Packing of tokenised documents into training sequences by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import id_and_bytes, kept_in_process, rows_out, slices
from annalist.scratch import materialize

FIELDS = {
    "doc_id": pa.int64(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
    "doc_tokens": pa.int64(), "sequence_id": pa.int64(), "offset": pa.int64(),
}
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: The last pieces of so many partitions are packed together.
PARTITIONS_TOGETHER = 64


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp for ``ways`` windows: the indices of ``sizes`` that share each window.

    Every partial partition is a descending list of window sums (windows that are still empty are
    left out). The two with the largest imbalance merge with opposing order: the fullest window of
    one takes the emptiest of the other.
    """
    heap = [(-s, i, [s], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for tag in range(len(sizes), 2 * len(sizes) - 1):
        _, _, sums_a, sets_a = heapq.heappop(heap)
        _, _, sums_b, sets_b = heapq.heappop(heap)
        shared = max(0, len(sums_a) + len(sums_b) - ways)
        cut_a, cut_b = len(sums_a) - shared, len(sums_b) - shared
        merged = [*zip(sums_a[:cut_a], sets_a), *zip(sums_b[:cut_b], sets_b)]
        merged += [(x + y, s + t) for x, y, s, t in zip(sums_a[cut_a:], reversed(sums_b[cut_b:]), sets_a[cut_a:], reversed(sets_b[cut_b:]))]
        merged.sort(key=lambda w: -w[0])
        sums, sets = [w[0] for w in merged], [w[1] for w in merged]
        heapq.heappush(heap, (sums[-1] * (len(sums) == ways) - sums[0], tag, sums, sets))
    return heap[0][3] if heap else []


def windows(sizes: list[int], ways: int, capacity: int) -> list[list[int]]:
    """Indices of ``sizes``, none over ``capacity``, in near-equal windows of at most ``capacity``.

    ``ways`` windows are dealt; while differencing overfills any, their number rises by one.
    """
    while sizes:
        dealt = differencing(sizes, max(1, ways))
        if max(sum(sizes[i] for i in w) for w in dealt) <= capacity:
            return dealt
        ways += 1
    return []


def byte_classes() -> np.ndarray:
    """Of every Latin-1 character: 0 white space, 1 letter, 2 digit, 3 other, 4 one that no Latin text may hold."""
    kinds = np.full(256, 4, np.uint8)
    kinds[[32, *range(9, 14)]] = 0
    kinds[[*range(33, 127), *range(161, 256)]] = 3
    kinds[[c for c in (*range(33, 127), *range(161, 256)) if chr(c).isalpha()]] = 1
    kinds[[c for c in (*range(33, 127), *range(161, 256)) if chr(c).isnumeric()]] = 2
    return kinds


KINDS = byte_classes()
LOWER = bytes(ord(low) if len(low := chr(c).lower()) == 1 and ord(low) < 256 else c for c in range(256))
ODD = np.flatnonzero(KINDS == 4).astype(np.uint8).tobytes()
#: A character of no Latin text, put at each text's end: a word of its own, whose id is the end's.
END = b"\x00"
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of long words that are remembered, about; then all words are forgotten.
MOST_LONG = 32_000_000


def same_words(eights: np.ndarray, sizes: np.ndarray, chars: np.ndarray, starts: np.ndarray, eights_: np.ndarray, sizes_: np.ndarray, chars_: np.ndarray, starts_: np.ndarray) -> bool:
    """Whether words equal others one by one. The first eight bytes, padded by zeros, settle the short ones; all bytes of the longer are compared."""
    if (eights != eights_).any() or (sizes != sizes_).any():
        return False
    long = np.flatnonzero((sizes > 8) & ((starts != starts_) | (chars is not chars_)))
    for at in range(0, len(long), 65_536):  # some at a time: the places of their bytes are numbers
        part = long[at : at + 65_536]
        size = sizes[part]
        stop = np.cumsum(size)
        step = np.arange(stop[-1]) - np.repeat(stop - size, size)
        if (chars[np.repeat(starts[part], size) + step] != chars_[np.repeat(starts_[part], size) + step]).any():
            return False
    return True


class Encoder:
    """Texts to ids, equal to the tokenizer's own, each text with the end's id after it.

    Latin texts are lower-cased and cut into words by character classes, all texts of a batch at
    once; equal words are found by their hashes and compared byte by byte, and each word is encoded
    once while it is remembered. Other texts, and those that hold the strings of special tokens, go
    through the whole tokenizer, as does a batch in which two different words share a hash.
    """

    def __init__(self, model: str, end_id: int, remembered: int = 1_000_000):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.bare = Tokenizer.from_str(model), Tokenizer.from_str(model)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.bare.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.end_id, self.remembered = end_id, remembered
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.forget()

    def forget(self) -> None:
        self.keys, self.eights = np.empty(0, np.uint64), np.empty(0, np.uint64)
        self.size, self.at, self.long = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8)  # bytes of words of over eight
        self.first, self.count, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def texts(self, bodies: list[bytes]) -> Iterator[np.ndarray]:
        texts = [b.decode("utf-8", "replace") for b in bodies]
        latin: list[bytes | None] = []
        for t in texts:
            try:
                b = t.encode("latin-1")
            except UnicodeEncodeError:
                b = ODD
            latin.append(None if b"<|" in b or len(b.translate(None, ODD)) < len(b) else b)
        found = self.encoded([b for b in latin if b is not None])
        if found is None:
            latin = [None] * len(latin)
        else:
            ids, bounds = found
        at = 0
        for text, b in zip(texts, latin):
            if b is None:
                yield np.array([*self.whole.encode(text, add_special_tokens=False).ids, self.end_id], np.uint32)
            else:
                yield ids[bounds[at] : bounds[at + 1]]
                at += 1

    def encoded(self, latin: list[bytes]) -> tuple[np.ndarray, list[int]] | None:
        """(ids of all texts, where each text's begin and the last one's end)."""
        if not latin:
            return np.empty(0, np.uint32), [0]
        joined = (END.join(latin) + END).translate(LOWER)
        chars = np.frombuffer(joined, np.uint8)
        starts, ends = self.words(chars)
        keys, eights = self.hashes(chars, starts, ends)
        order = np.argsort(keys)
        ranked = keys[order]
        new = np.append(True, ranked[1:] != ranked[:-1])
        group = np.cumsum(new) - 1
        one = order[new]  # of each different word
        sizes = ends - starts
        like = one[group]
        if not same_words(eights[order], sizes[order], chars, starts[order], eights[like], sizes[like], chars, starts[like]):
            return None
        place = self.look_up(joined, starts[one], ends[one], keys[one], eights[one])
        if place is None:
            return None
        of_word = np.empty(len(keys), np.int64)
        of_word[order] = place[group]
        counts = self.count[of_word]
        stop = np.cumsum(counts)
        ids = self.ids[np.repeat(self.first[of_word] - stop + counts, counts) + np.arange(stop[-1])]
        return ids, [0, *stop[chars[starts] == END[0]].tolist()]

    @staticmethod
    def words(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the words begin and end: runs of letters or of other characters, single digits, 's and the like."""
        kind = KINDS[chars]
        begins = np.empty(len(chars), bool)
        begins[0] = kind[0] != 0
        begins[1:] = (kind[1:] != 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2) | (kind[1:] == 4))
        quotes = np.flatnonzero(chars == ord("'"))
        quotes = quotes[begins[quotes]]  # END is last: two more characters can be looked at, or END stops the match
        next_, after = chars[quotes + 1], chars[np.minimum(quotes + 2, len(chars) - 1)]
        short = np.isin(next_, np.frombuffer(b"stmd", np.uint8))
        long = ((next_ == ord("r")) & (after == ord("e"))) | ((next_ == ord("v")) & (after == ord("e"))) | ((next_ == ord("l")) & (after == ord("l")))
        begins[quotes[short | long] + 1] = False
        for at in (quotes[short] + 2, quotes[long & ~short] + 3):
            begins[at] |= kind[at] == 1
        starts = np.flatnonzero(begins)
        stops = np.append(np.flatnonzero(begins[1:] | ((kind[1:] == 0) & (kind[:-1] != 0))) + 1, len(chars))
        return starts, stops[np.searchsorted(stops, starts, side="right")]

    def hashes(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word a hash of all of its characters, and its first eight."""
        n = len(chars)
        if len(self.powers) < n:
            powers, inverses = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
            powers[0] = inverses[0] = 1
            self.powers, self.inverses = np.cumprod(powers), np.cumprod(inverses)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * self.powers[:n], out=sums[1:])
        keys = (sums[ends] - sums[starts]) * self.inverses[starts] * MIX
        keys ^= keys >> np.uint64(32)
        size = ends - starts
        padded = np.append(chars, np.zeros(8, np.uint8))
        eight = np.ndarray(n, "<u8", padded, strides=(1,))[starts]
        eight &= np.uint64(2**64 - 1) >> (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
        return keys * MIX, eight

    def look_up(self, joined: bytes, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, eights: np.ndarray) -> np.ndarray | None:
        """The places of the words in the table, which learns the new ones. ``keys`` ascend."""
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        chars, old, sizes = np.frombuffer(joined, np.uint8), at[known], ends - starts
        if not same_words(eights[known], sizes[known], chars, starts[known], self.eights[old], self.size[old], self.long, self.at[old]):
            return None
        if not known.all():
            if (len(self.keys) + (~known).sum() > self.remembered or len(self.long) > MOST_LONG) and len(self.keys):
                self.forget()
                at, known = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
            new = np.flatnonzero(~known)
            first, count, ids = self.learnt([joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            where = at[new]
            self.first = np.insert(self.first, where, first + len(self.ids))
            self.count = np.insert(self.count, where, count)
            self.eights = np.insert(self.eights, where, eights[new])
            kept = np.where(sizes[new] > 8, sizes[new], 0)
            self.at = np.insert(self.at, where, len(self.long) + np.cumsum(kept) - kept)
            self.size = np.insert(self.size, where, sizes[new])
            self.long = np.concatenate([self.long, *(chars[starts[i] : ends[i]] for i in new[kept > 0].tolist())])
            self.keys = np.insert(self.keys, where, keys[new])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, keys)
        return at

    def learnt(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, count, ids): where each word's ids lie."""
        real = np.array([w != END for w in words])
        text = b" ".join([w for w in words if w != END]).decode("latin-1")
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        stops = np.flatnonzero(self.ends_word[ids]) + 1
        first, count = np.full(len(words), len(ids)), np.ones(len(words), np.int64)
        first[real] = np.append(0, stops[:-1])[: len(stops)]
        count[real] = stops - first[real]
        return first, count, np.append(ids, np.uint32(self.end_id))


Piece = tuple[int, int, int]  # index of the document among those held, start, length


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(offset, length) of pieces of at most ``most``."""
    return [(at, min(most, length - at)) for at in range(0, length, most)]


def packed_partitions(
    docs: DataFrame, model, capacity: int, end_id: int, windows_per_block: int, slack: int, fine: int, fine_share: float
) -> DataFrame:
    """The pieces of each partition: those of whole blocks with their place, the last ones without a sequence_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_process(("packing", model.value, end_id), lambda: Encoder(model.value, end_id))
        first = TaskContext.get().partitionId() << 32
        used = total = finely = 0
        held: list[tuple] = []  # doc_id, ids from `base` on, base, tokens of the whole document
        pieces: list[Piece] = []
        full = capacity - slack
        target = windows_per_block * full

        def emit(sequences: list[list[Piece]], placed: bool = True) -> pa.RecordBatch:
            nonlocal used
            out: dict[str, list] = {k: [] for k in FIELDS}
            for sequence in sequences:
                at = 0
                for i, start, length in sequence:
                    doc_id, ids, base, tokens = held[i]
                    row = (doc_id, start, length, zlib.crc32(ids[start - base : start - base + length]), tokens, first + used if placed else None, at if placed else first)
                    for column, v in zip(out.values(), row):
                        column.append(v)
                    at += length
                used += placed
            return rows_out(FIELDS, out)

        def dealt(pieces: list[Piece], ways: int) -> pa.RecordBatch:
            return emit([[pieces[i] for i in w] for w in windows([p[2] for p in pieces], ways, capacity)])

        for batch in slices(batches, 4096, 2_000_000):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.texts(batch.column(1).to_pylist())):
                tokens = len(ids)
                base = tokens - tokens % capacity
                if base:
                    held.append((doc_id, ids, 0, tokens))
                    yield emit([[(len(held) - 1, at, capacity)] for at in range(0, base, capacity)])
                    held.pop()
                while base < tokens:
                    take = min(tokens - base, target - total)
                    most = fine if finely < fine_share * (total + take) else capacity
                    finely += take if most == fine else 0
                    held.append((doc_id, ids, 0, tokens))
                    pieces += [(len(held) - 1, base + at, size) for at, size in cut(take, most)]
                    total += take
                    base += take
                    if total == target:
                        yield dealt(pieces, windows_per_block)
                        held, pieces, total, finely = [], [], 0, 0
        # The last block: whole windows of it are dealt, the rest, less than one window, is left over.
        left: list[Piece] = []
        rest = total % full
        while rest:
            i, start, length = pieces.pop()
            take = min(rest, length)
            if take < length:
                pieces.append((i, start, length - take))
            left += [(i, start + length - take + at, size) for at, size in cut(take, fine)]
            rest -= take
        yield dealt(pieces, total // full)
        yield emit([left], placed=False)

    return docs.mapInArrow(run, SCHEMA)


def pack(
    docs: DataFrame,
    tokenizer_path: str | None = None,
    capacity: int = 2048,
    end_id: int = 1,
    windows_per_block: int = 32,
    slack: int | None = None,
    fine: int | None = None,
    fine_share: float = 0.08,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: where each run of a document's ids lies.

    Each input partition packs its own rows in blocks of ``windows_per_block`` windows, so texts are
    never shuffled, memory holds one block, and a repeated task gives the same rows. Documents longer
    than a window first fill whole windows; what is left of them is dealt by :func:`windows`. A block
    closes when its windows average ``slack`` tokens (an 80th, unless given) under ``capacity``; its
    last document is cut there. Documents of ``fine_share`` of a block's tokens are cut beforehand,
    into pieces of at most ``fine`` tokens (a 32nd), which differencing needs to even windows out.

    A partition's last tokens, less than a window's, meet those of the 63 partitions beside it as
    piece rows, without texts or ids, and are dealt likewise.

    Null and empty texts are documents of one id (``end_id``); null doc_ids stay null; repeated rows
    are packed each; an empty table gives no rows; other columns are not read. Very long texts are
    cut like others. ``sequence_id`` is the partition's number times 2**32 plus a count, and from
    2**62 on that of a group of last pieces: it depends on the input's partitioning.
    """
    import public_tokenizers

    with open(tokenizer_path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size
    slack = capacity // 80 if slack is None else slack
    fine = max(1, capacity // 32) if fine is None else fine
    if not 0 <= slack < capacity or fine < 1:
        raise ValueError("slack must be from 0 to under capacity, fine at least 1")
    bodies = id_and_bytes(docs, id_col, text_col)
    made = materialize(packed_partitions(bodies, model, capacity, end_id, windows_per_block, slack, fine, fine_share), "packed")

    def together(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("offset", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        sizes = rows.column("length").to_pylist()
        dealt = windows(sizes, -(-sum(sizes) // (capacity - slack)), capacity)
        order = np.array([i for w in dealt for i in w])
        length = np.array(sizes)[order]
        before = np.cumsum(length) - length
        counts = np.array([len(w) for w in dealt])
        offset = before - np.repeat(before[np.cumsum(counts) - counts], counts)
        sequence = np.repeat((((1 << 30) + key[0].as_py()) << 32) + np.arange(len(dealt)), counts)
        out = rows.take(pa.array(order)).select(list(FIELDS)[:5])
        return out.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    last = made.filter("sequence_id is null").withColumn("together", F.shiftright("offset", 32) / PARTITIONS_TOGETHER)
    last = last.withColumn("together", F.floor("together").cast("long"))
    return made.filter("sequence_id is not null").unionAll(last.groupBy("together").applyInArrow(together, SCHEMA))
