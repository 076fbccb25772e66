"""SentencePiece encoding by a batched numpy Viterbi over equal-length words, and decoding.

The models read here are of the BPE kind, where a piece's score says when it is merged, not how
likely it is: the path of greatest total score is not the library's segmentation. What is: the one
path whose every pair of neighbouring pieces is itself the segmentation of the pair's text. So the
lattice's transitions count as 0 where that holds and as minus infinity elsewhere, and the maximum at
each position, with its backpointer, is found over all words of a length at once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from annalist.llm.common import Memo, id_and_bytes, kept_in_process, rows_out, slices

#: How the library writes a space.
SPACE = "▁"
#: A unit never shares a piece with the next: a run of spaces with the word behind it.
UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BASE = np.uint64(0x100000001B3)


class Pieces:
    """A model's pieces with the tables that encoding probes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_proto=model)
        size = library.get_piece_size()
        self.text = [library.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i) or library.is_unused(i))]
        self.bytes = {int(self.text[i][1:-1], 16): i for i in range(size) if library.is_byte(i)}
        self.value = {i: bytes([b]) for b, i in self.bytes.items()}
        self.control = {i for i in range(size) if library.is_control(i)}
        self.unknown = library.unk_id()
        self.score = {self.text[i]: library.get_score(i) for i in plain}
        self.ids = {self.text[i]: i for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("pieces of this model hold spaces inside; units would not be independent")
        self.longest = max(map(len, self.score))
        hashes = self.hashes([self.text[i] for i in plain])
        order = np.argsort(hashes)
        self.keys, self.key_ids = hashes[order], np.array(plain)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        #: Judged pairs: most of them in sorted arrays, the latest in a dict.
        self.codes, self.fits, self.recent = np.array([-1]), np.array([False]), {}
        inner = {(ord(a) + 1) << 32 | (ord(b) + 1) for p in self.score for a, b in zip(p, p[1:])}
        self.inner = np.array(sorted(inner), np.uint64)

    def apart(self, words: list[str]) -> list[list[str]]:
        """Each word cut where no piece spans: between two characters that are neighbours in none."""
        lengths = np.array([len(w) for w in words])
        chars = points(["".join(words)], int(lengths.sum()))[0]
        code = chars[:-1] << np.uint64(32) | chars[1:]
        joined = self.inner[np.minimum(np.searchsorted(self.inner, code), len(self.inner) - 1)] == code
        ends = np.cumsum(lengths)
        joined[ends[:-1] - 1] = False
        cuts = np.append(np.flatnonzero(~joined) + 1, ends[-1])
        text, out, at = "".join(words), [], 0
        bounds, last = cuts.tolist(), np.searchsorted(cuts, ends).tolist()
        first = 0
        for stop in last:
            parts = []
            for end in bounds[first : stop + 1]:
                parts.append(text[at:end])
                at = end
            out.append(parts)
            first = stop + 1
        return out

    def hashes(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), np.uint64)
        for n in {len(w) for w in words}:
            at = [i for i, w in enumerate(words) if len(w) == n]
            h = np.zeros(len(at), np.uint64)
            for column in points([words[i] for i in at], n).T:
                h = h * BASE + column
            out[at] = h
        return out

    def merged(self, text: str) -> list[str]:
        """The segmentation by its definition: the best-scored neighbours merge first, leftmost of equals."""
        none, score = -np.inf, self.score.get
        parts = list(text)
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != none:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = score(parts[i] + parts[i + 1], none)
            if i:
                scores[i - 1] = score(parts[i - 1] + parts[i], none)
        return parts

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether left and right, as one text, are segmented into just these two; judged once a pair."""
        code = left.astype(np.int64) << 32 | right.astype(np.int64)
        unique, inverse = np.unique(code, return_inverse=True)
        at = np.minimum(np.searchsorted(self.codes, unique), len(self.codes) - 1)
        settled = self.codes[at] == unique
        fits = self.fits[at] & settled
        for i in np.flatnonzero(~settled).tolist():
            c = int(unique[i])
            fit = self.recent.get(c)
            if fit is None:
                a, b = self.text[c >> 32], self.text[c & 0xFFFFFFFF]
                fit = self.recent[c] = self.merged(a + b) == [a, b]
            fits[i] = fit
        if len(self.recent) > 20_000:
            if len(self.codes) > 5_000_000:
                self.codes, self.fits = self.codes[:1], self.fits[:1]
            codes = np.concatenate([self.codes, np.fromiter(self.recent, np.int64)])
            order = np.argsort(codes)
            self.codes, self.fits = codes[order], np.concatenate([self.fits, np.fromiter(self.recent.values(), bool)])[order]
            self.recent = {}
        return fits[inverse]


def points(words: list[str], length: int) -> np.ndarray:
    """Code points of equal-length words, a row each; never zero."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length).astype(np.uint64) + np.uint64(1)


#: At most about this many lattice cells are held at once.
CELLS = 600_000


def viterbi(pieces: Pieces, words: list[str]) -> list[list[int]]:
    """Ids of each word. Words of one length advance together, position by position."""
    out: list[list[int]] = [[]] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by_length.setdefault(len(w), []).append(i)
    for n, every in by_length.items():
        step = max(1, CELLS // max(1, n * pieces.longest))
        for block in range(0, len(every) if n else 0, step):
            at = every[block : block + step]
            for i, ids in zip(at, advance(pieces, [words[i] for i in at], n)):
                out[i] = ids
    return out


def advance(pieces: Pieces, words: list[str], n: int) -> list[list[int]]:
    rows, chars = len(words), points(words, n)
    prefix = np.zeros((rows, n + 1), np.uint64)
    for j in range(n):
        prefix[:, j + 1] = prefix[:, j] * BASE + chars[:, j]
    #: At each end: the piece that the best path ends with, and its length; -1 stands for a single
    #: character that is no piece.
    last, back = np.full((rows, n + 1), -2, np.int64), np.ones((rows, n + 1), np.int64)
    power = np.array([pow(int(BASE), k, 1 << 64) for k in range(pieces.longest + 1)], np.uint64)
    for end in range(1, n + 1):
        lengths = np.arange(1, min(pieces.longest, end) + 1)
        keys = np.stack([prefix[:, end] - prefix[:, end - k] * power[k] for k in lengths], 1)
        probe = np.minimum(np.searchsorted(pieces.keys, keys), len(pieces.keys) - 1)
        ids = np.where(pieces.keys[probe] == keys, pieces.key_ids[probe], -2)
        ids[:, 0] = np.where(ids[:, 0] == -2, -1, ids[:, 0])
        before = np.stack([last[:, end - k] for k in lengths], 1)
        score = np.full(ids.shape, -np.inf)
        score[(ids != -2) & ((before < 0) | (ids < 0))] = 0  # at the start, and beside unknown characters, any piece fits
        open_rows = np.arange(rows)
        for k in lengths[::-1] - 1:  # one candidate fits at most, so rows leave as they find it
            ask = open_rows[(ids[open_rows, k] >= 0) & (before[open_rows, k] >= 0)]
            if len(ask):
                score[ask, k] = np.where(pieces.compatible(before[ask, k], ids[ask, k]), 0, -np.inf)
            open_rows = open_rows[score[open_rows, k] < 0]
            if not len(open_rows):
                break
        best = score.shape[1] - 1 - np.argmax(score[:, ::-1], 1)
        last[:, end], back[:, end] = ids[np.arange(rows), best], lengths[best]
    out = []
    for word, ends, steps in zip(words, last.tolist(), back.tolist()):
        found, end = [], n
        while end > 0:
            start = end - steps[end]
            found.append([ends[end]] if ends[end] >= 0 else unknown(pieces, word[start:end]))
            end = start
        out.append([i for ids in reversed(found) for i in ids])
    return out


def unknown(pieces: Pieces, char: str) -> list[int]:
    return [pieces.bytes[b] for b in char.encode("utf-8", "surrogatepass")] if pieces.bytes else [pieces.unknown]


class Encoder:
    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.memo, self.cores = Memo(self.units, 450_000), Memo(self.parts, 450_000)

    def units(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        apart = self.pieces.apart(words)
        look = self.cores.learn(apart)
        return [b"".join(map(look, parts)) for parts in apart]

    def parts(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, "<i4").tobytes() for ids in viterbi(self.pieces, words)]

    def texts(self, bodies: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [UNITS.findall(SPACE + b.decode("utf-8", "replace").replace(" ", SPACE)) if b else [] for b in bodies]
        look = self.memo.learn(split)
        for units in split:
            yield b"".join(map(look, units))


class Decoder:
    """Ids to text. Runs of byte pieces are UTF-8; control pieces are silent; the added space goes."""

    def __init__(self, model: bytes):
        pieces = Pieces(model)
        table = [pieces.value.get(i, b"" if i in pieces.control else t.replace(SPACE, " ").encode()) for i, t in enumerate(pieces.text)]
        table[pieces.unknown] = " ⁇ ".encode()
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.sizes = np.array([len(t) for t in table])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of ids[offsets[i] : offsets[i + 1]]: all pieces' bytes are gathered at once."""
        sizes = self.sizes[ids]
        ends = np.append(0, np.cumsum(sizes))
        data = self.bytes[np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets].tolist()
        return [data[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cuts, cuts[1:])]


def flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of a list column; null lists count as empty."""
    return column.flatten().to_numpy(), np.append(0, np.cumsum(column.value_lengths().fill_null(0).to_numpy()))


ENCODED = {"doc_id": pa.int64(), "ids": pa.list_(pa.int32())}
DECODED = {"doc_id": pa.int64(), "text": pa.string()}


def load(docs: DataFrame, model_path: str | None):
    import public_tokenizers

    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())  # one file of fixed size


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): every whole text as the library encodes it, byte fallback included.

    For models without text normalisation. Null and empty texts have no ids; null doc_ids stay null;
    repeated rows are encoded each; an empty table gives no rows; other columns are not read. A very
    long text is split at spaces; a very long word is one row of a lattice of bounded width.
    """
    model = load(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_process(("sentencepiece", model.value), lambda: Encoder(model.value))
        for batch in slices(batches, 4096, 4_000_000):
            ids = list(encoder.texts(batch.column(1).to_pylist()))
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)])
            values = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=list(ENCODED))

    return id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids). Null ids give a null text."""
    model = load(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept_in_process(("sentencepiece decoder", model.value), lambda: Decoder(model.value))
        for batch in slices(batches):
            texts = [t if known else None for t, known in zip(decoder.texts(*flat(batch.column(1))), batch.column(1).is_valid().to_pylist())]
            yield rows_out(DECODED, {"doc_id": batch.column(0), "text": texts})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_ids, ids, decoded_sha256): the ids, and the digest of the UTF-8 text they decode to."""
    encoded = encode(docs, model_path, id_col, text_col)
    model = load(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = kept_in_process(("sentencepiece decoder", model.value), lambda: Decoder(model.value))
        for batch in slices(batches):
            digests = [hashlib.sha256(t.encode()).hexdigest() for t in decoder.texts(*flat(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).value_lengths().cast(pa.int64()), batch.column(1), pa.array(digests, pa.string())], names=["doc_id", "n_ids", "ids", "decoded_sha256"])

    return encoded.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_sha256 string")
