"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

The bag is a segment of a few consecutive words: the mean of all of its subwords' vectors goes through
a linear softmax, and a text scores as its worst segment, so that one insult in a long text is not
averaged away. A misspelling shares most of its character n-grams, and so its vectors, with the word
it means. A run of letters longer than LONGEST, as in scripts without spaces, is cut into pieces that
are segments each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import Memo, id_and_bytes, rows_out, slices

WORD = re.compile(r"\w+")
BASE = 0x100000001B3
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words of more code points than this are cut into pieces of so many; neighbours share OVERLAP, so no n-gram is lost.
LONGEST, OVERLAP = 24, 5


@dataclass(frozen=True)
class Settings:
    shortest: int = 3  # characters of an n-gram, word boundaries included
    longest: int = 6
    bucket_bits: int = 17
    dims: int = 2
    segment: int = 8  # words of a bag
    epochs: int = 80
    warm_up: int = 50  # epochs in which all segments of a toxic text count as toxic, lightly
    rate: float = 0.15
    calibrate: int = 4  # each so-many-th clean text is not fitted but sets the bias
    clean_share: float = 0.99  # of these, at least this share scores well under 0.3
    each_weight: float = 2.0  # of all segments of clean texts together, against 1 for the worst of each
    seed: int = 7
    train_rows: int = 1000  # at most so many labelled rows of each class are fitted


def words_of(text: str) -> list[list[str]]:
    """The text's words in parts that no segment crosses: pieces of long words are parts of their own."""
    words, step = WORD.findall(text.lower()), LONGEST - OVERLAP
    if not words:
        return []
    if max(map(len, words)) <= LONGEST:
        return [words]
    out: list[list[str]] = [[]]
    for w in words:
        if len(w) <= LONGEST:
            out[-1].append(w)
        else:
            out += [[w[i : i + LONGEST]] for i in range(0, len(w) - OVERLAP, step)]
            out.append([])
    return [part for part in out if part]


def subwords(words: list[str], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): the n-gram buckets of all words, of at most LONGEST characters, one word after the other."""
    marked = [f"<{w}>" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    counts = sum(np.maximum(sizes - n + 1, 0) for n in range(s.shortest, s.longest + 1)) + 1
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.int64)
    shift = np.uint64(64 - s.bucket_bits)
    power = [np.uint64(pow(BASE, n, 1 << 64)) for n in range(s.longest + 1)]
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        chars = np.frombuffer("".join([marked[i] for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(at), size).astype(np.uint64)
        prefix = np.zeros((len(at), size + 1), np.uint64)
        for j in range(size):
            prefix[:, j + 1] = prefix[:, j] * np.uint64(BASE) + chars[:, j] + np.uint64(1)
        grams = [prefix[:, n:] - prefix[:, : size - n + 1] * power[n] for n in range(s.shortest, min(s.longest, size) + 1)]
        keys = np.concatenate([*grams, prefix[:, -1:] * MIX], 1) * MIX >> shift
        out[starts[at][:, None] + np.arange(keys.shape[1])] = keys.astype(np.int64)
    return out, counts


def padded(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts one after the other, each given at least ``width`` places: (place of every word, first place, places)."""
    places = np.maximum(lengths, width)
    first = np.cumsum(places) - places
    before = np.cumsum(lengths) - lengths
    return np.arange(lengths.sum()) + np.repeat(first - before, lengths), first, places


@dataclass
class Model:
    """What scoring needs of the trained layers: a bucket's weight in the logit, and the bias."""

    weights: np.ndarray
    bias: float
    settings: Settings
    constant: float | None = None  # the score where there was nothing to learn

    def plain(self) -> tuple:
        """Arrays and numbers alone: what is broadcast is read where this package may not be installed."""
        return self.weights, self.bias, asdict(self.settings), self.constant

    @classmethod
    def of(cls, plain: tuple) -> Model:
        weights, bias, settings, constant = plain
        return cls(weights, bias, Settings(**settings), constant)

    def sums(self, words: list[str]) -> list[tuple[float, int]]:
        """Of each word: its subwords' weights summed, and their number."""
        if not words:
            return []
        buckets, counts = subwords(words, self.settings)
        return list(zip(np.add.reduceat(self.weights[buckets], np.cumsum(counts) - counts).tolist(), counts.tolist()))

    def worst(self, split: list[list[list[str]]], look) -> np.ndarray:
        """The logit of each text's worst segment; minus infinity without words."""
        parts = np.array([len(text) for text in split], np.int64)
        out = np.full(len(split), -np.inf)
        if not parts.any():
            return out
        width = self.settings.segment
        at, first, places = padded(np.array([len(part) for text in split for part in text], np.int64), width)
        both = np.zeros((int(places.sum()) + width, 2))
        both[at] = [look(w) for text in split for part in text for w in part]
        n = len(both) - width
        total = sum(both[j : n + j] for j in range(width))  # in one order of addition, whatever the batch
        inside = np.arange(n) - np.repeat(first, places) <= np.repeat(places, places) - width
        logits = np.where(inside, total[:, 0] / np.maximum(total[:, 1], 1), -np.inf)
        some = parts > 0
        texts = np.cumsum(parts[some]) - parts[some]
        out[some] = np.maximum.reduceat(np.maximum.reduceat(logits, first), texts) + self.bias
        return out

    def scores(self, texts: list[str], memo: Memo) -> list[float]:
        """Texts without words score 0."""
        split = [words_of(t) for t in texts]
        if self.constant is not None:
            return [self.constant if parts else 0.0 for parts in split]
        worst = self.worst(split, memo.learn(list(chain.from_iterable(split))))
        return np.where(worst == -np.inf, 0.0, 1 / (1 + np.exp(np.minimum(-worst, 700)))).tolist()


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:
    """Full-batch training of embeddings and softmax together, by moving averages of the gradient.

    A step is divided by the root mean square of a whole layer's gradient, not of each weight's own:
    n-grams that many toxic texts share then move further than those that one happens to hold.
    Segments of a part overlap by half. Every segment of a clean text is clean. Of a toxic text only the segment
    that scores worst is taken for toxic, after ``warm_up`` epochs in which all of them are, lightly.
    """
    every = [(parts, y) for t, y in zip(texts, labels) if (parts := words_of(t))]
    clean_texts = [parts for parts, y in every if not y]
    apart = clean_texts[:: s.calibrate] if len(clean_texts) >= 10 * s.calibrate else []
    kept = [(parts, 1) for parts, y in every if y] + [(parts, 0) for i, parts in enumerate(clean_texts) if not apart or i % s.calibrate]
    y = np.array([y for _, y in kept], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << s.bucket_bits), 0.0, s, float(y.mean()) if len(y) else 0.0)
    all_parts = [part for parts, _ in kept for part in parts]
    vocabulary = sorted(set(chain.from_iterable(all_parts)))
    number = {w: i for i, w in enumerate(vocabulary)}
    buckets, counts = subwords(vocabulary, s)
    starts = np.cumsum(counts) - counts
    word_of_bucket = np.repeat(np.arange(len(vocabulary)), counts)
    at, first, places = padded(np.array([len(part) for part in all_parts]), s.segment)
    words = np.full(int(places.sum()), len(vocabulary))  # one more "word", without subwords, fills short texts
    words[at] = [number[w] for w in chain.from_iterable(all_parts)]
    step = max(1, s.segment // 2)
    begins = [np.unique(np.append(np.arange(0, n - s.segment + 1, step), n - s.segment)) for n in places.tolist()]
    segments = words[np.concatenate([f + b for f, b in zip(first.tolist(), begins)])[:, None] + np.arange(s.segment)]
    first_part = np.cumsum([0, *(len(parts) for parts, _ in kept)])[:-1]
    of_doc = np.add.reduceat([len(b) for b in begins], first_part)
    doc_starts = np.cumsum(of_doc) - of_doc
    doc = np.repeat(np.arange(len(kept)), of_doc)
    size = np.append(counts, 0)[segments].sum(1)
    clean = y[doc] == 0
    n_clean, n_toxic = (y == 0).sum(), (y == 1).sum()

    rng = np.random.default_rng(s.seed)
    params = [rng.normal(0, 0.1, (1 << s.bucket_bits, s.dims)), rng.normal(0, 0.5, (s.dims, 2)), np.zeros(2)]
    moving, second = [np.zeros_like(p) for p in params], [0.0] * len(params)
    for epoch in range(1, s.epochs + 1):
        table, out, bias = params
        of_word = np.append(np.add.reduceat(table[buckets], starts), np.zeros((1, s.dims)), 0)
        mean = sum(of_word[segments[:, j]] for j in range(s.segment)) / size[:, None]
        logits = mean @ out + bias
        toxic = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -30, 30)))
        worst = np.maximum.reduceat(toxic, doc_starts)[doc] == toxic
        weight = np.where(clean, (worst + s.each_weight / of_doc[doc]) / n_clean, (worst if epoch > s.warm_up else 1 / of_doc[doc]) / n_toxic)
        error = weight * (toxic - ~clean)
        d_logits = np.stack([-error, error], 1)
        d_mean = d_logits @ out.T / size[:, None]
        flat = segments.ravel()
        d_word = np.stack([np.bincount(flat, np.repeat(d_mean[:, k], s.segment), len(vocabulary) + 1) for k in range(s.dims)], 1)
        d_table = np.stack([np.bincount(buckets, d_word[word_of_bucket, k], 1 << s.bucket_bits) for k in range(s.dims)], 1)
        grads = [d_table, mean.T @ d_logits, d_logits.sum(0)]
        for i, (p, g, m) in enumerate(zip(params, grads, moving)):
            m += 0.1 * (g - m)
            second[i] += 0.01 * (np.mean(g * g) - second[i])
            p -= s.rate * (m / (1 - 0.9**epoch)) / (np.sqrt(second[i] / (1 - 0.99**epoch)) + 1e-12)
    table, out, bias = params
    model = Model(table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]), s)
    if apart:
        worst = model.worst(apart, Memo(model.sums).learn(list(chain.from_iterable(apart))))
        model.bias += min(0.0, float(np.log(0.3 / 0.7) - 1 - np.quantile(worst, s.clean_share)))
    return model


def held_out_part(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("long").cast("string")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Train on labelled rows that are not held out: ``train_rows`` of each class at most, by hash of the id, with whole texts.

    Rows with a null id or label take no part; an id with several labels counts as toxic if any is.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).na.drop()
    known = known.filter(~held_out_part("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id", F.lit(s.seed)), F.col("doc_id")]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(s.train_rows).unionAll(known.filter("toxic = 0").orderBy(*order).limit(s.train_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("body")).filter("body is not null")
    rows = texts.join(F.broadcast(chosen), "doc_id").distinct().select("doc_id", "body", "toxic").collect()  # 2 * train_rows ids at most
    rows = sorted(map(tuple, rows))
    return train([r[1] for r in rows], [r[2] for r in rows], s)


FIELDS = {"doc_id": pa.int64(), "held_out": pa.bool_(), "score": pa.float64(), "predicted": pa.int32()}
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its toxicity from 0 to 1, read from the whole text and nothing else.

    Null and empty texts, and those without a word, score 0; null doc_ids stay null and are not held
    out; repeated rows are scored each; an empty table gives no rows; other columns are not read. A
    very long text has more words to be judged by.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())  # of a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        memo = Memo(model.sums)
        for batch in slices(batches):
            ids, bodies, held = (c.to_pylist() for c in batch.columns)
            scores = model.scores([b.decode("utf-8", "replace") for b in bodies], memo)
            yield rows_out(FIELDS, {"doc_id": ids, "held_out": held, "score": scores, "predicted": [int(x >= threshold) for x in scores]})

    rows = id_and_bytes(docs, id_col, text_col).withColumn("held_out", F.coalesce(held_out_part("doc_id"), F.lit(False)))
    return rows.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents, all columns kept, that score under ``threshold``.

    Null and empty texts stay, whatever their doc_id, which is not looked at; repeated rows are judged
    each; an empty table gives no rows; malformed UTF-8 is judged with U+FFFD in its place and stays
    as it is in what is kept. Texts are judged where they are read; nothing is joined or shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())  # of a fixed number of buckets
    columns = [f.name for f in docs.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.of(shared.value)
        memo = Memo(model.sums)
        for batch in slices(batches):
            bodies = batch.column(columns.index("text")).cast(pa.binary()).to_pylist()
            texts = [(b or b"").decode("utf-8", "replace") for b in bodies]
            clean = [x < threshold for x in model.scores(texts, memo)]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
