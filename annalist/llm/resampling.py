"""Importance resampling towards a target: documents whose word features are likelier there are drawn.

Features are hashed into buckets. The counts of a corpus are one array as long as there are buckets,
summed inside each task before anything is shuffled; gains of the buckets are an array too, and a
document's weight is a mean over it. A draw without replacement gives every document a score, weight
plus Gumbel noise of its id, and takes the highest. Scores are integers within bounds that logarithms
of 64-bit counts set, so their histogram is exact and short: its suffix sums say at which rank each
score begins and at which score the draw ends. Only documents at or above that score are ranked, by
doc_id inside each score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from annalist.llm.common import id_and_bytes, rows_out, slices
from annalist.scratch import materialize

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: Digits, letters (capitals as small ones) and every byte of a character beyond ASCII make words; the rest parts them.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def word_lists(body: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words of a text, some of them at a time, so that a very long one is never a list as a whole."""
    plain, at = body.translate(WORD_BYTES), 0
    while at < len(plain):
        stop = plain.find(b" ", at + size)
        stop = len(plain) if stop < 0 else stop
        words = plain[at:stop].split()
        if words:
            yield words
        at = stop


def buckets_of(body: bytes, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Number of words, and the buckets of every word and of every pair of neighbours, repeats included, in parts."""
    last: list[bytes] = []
    for words in word_lists(body):
        alone, before = list(map(crc32, words)), list(map(crc32, last))
        pairs = map(crc32, map(b" ".__add__, words if last else words[1:]), before + alone)  # a checksum goes on from that of the first word
        yield len(words), np.array([*alone, *pairs], np.int64) % buckets
        last = words[-1:]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, text_col: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket; empty buckets are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            parts = [found for body in batch.column(0).to_pylist() for _, found in buckets_of(body, buckets)]
            if parts:
                sums += np.bincount(np.concatenate(parts), minlength=buckets)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(sums[found])], names=["bucket", "n"])

    bodies = texts.select(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))
    return bodies.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def as_array(counts: DataFrame, buckets: int) -> np.ndarray:
    """Bucket counts on the driver: ``buckets`` numbers at most, however large the corpus."""
    out = np.zeros(buckets, np.int64)
    for bucket, n in counts.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket a thousandfold log ratio of its smoothed shares, floored."""
    all_s, all_t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    ratio = lambda s, t: ((t + 1.0) * (all_s + n)) / ((s + 1.0) * (all_t + n))
    return np.array([math.floor(1000 * math.log(ratio(float(s), float(t)))) for s, t in zip(corpus, target)], np.int64)


def noise(doc_id: int, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


SCORED = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_features": pa.int64(), "weight": pa.int64(), "score": pa.int64()}


def scored(docs: DataFrame, gain: np.ndarray, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row; a null doc_id has weight but no score."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in slices(batches):
            out: dict[str, list] = {k: [] for k in SCORED}
            for doc_id, body in zip(*(c.to_pylist() for c in batch.columns)):
                n_words = n = total = 0
                for more, found in buckets_of(body, len(table)):
                    n_words, n, total = n_words + more, n + len(found), total + int(table[found].sum())
                weight = total // n if n else 0
                for k, v in zip(SCORED, (doc_id, n_words, n, weight, None if doc_id is None else weight + noise(doc_id, seed))):
                    out[k].append(v)
            yield rows_out(SCORED, out)

    return id_and_bytes(docs, id_col, text_col).mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def ranked(scores: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of :func:`scored` with ``rank``: 1, 2, 3 and so on for the highest ``percent`` % of the scores, else null.

    Equal scores go by ascending doc_id; rows that agree in everything are counted before they are
    shuffled and take ranks next to each other. The histogram has a row per score that occurs, some
    hundred thousand at most: 1000 * ln of a ratio of 64-bit counts, plus noise of -3,132 to 22,876.
    """
    fit = F.coalesce((F.col("n_words") >= least_words) & F.col("score").isNotNull(), F.lit(False))
    histogram = scores.filter(fit).groupBy("score").agg(F.count("*").alias("n")).collect()
    histogram.sort(key=lambda row: -row.score)
    before = np.concatenate([[0], np.cumsum([row.n for row in histogram], dtype=np.int64)])
    wanted = int(before[-1]) * percent // 100
    offsets = [(row.score, int(above)) for row, above in zip(histogram, before) if above < wanted]
    if not offsets:
        return scores.withColumn("rank", F.lit(None).cast("long"))
    cutoff = offsets[-1][0]
    high = fit & (F.col("score") >= cutoff)
    begins = scores.sparkSession.createDataFrame(offsets, "score long, above long")
    alike = scores.filter(high).groupBy(*SCORED).agg(F.count("*").alias("_copies"))
    order = Window.partitionBy("score").orderBy("doc_id", "n_features", "weight", "n_words").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("_copies").over(order)
    drawn = alike.join(F.broadcast(begins), "score").withColumn("_last", F.col("above") + upto)
    each = drawn.select(*SCORED, F.explode(F.sequence(F.col("_last") - F.col("_copies") + 1, F.col("_last"))).alias("_rank"))
    taken = each.select(*SCORED, F.when(F.col("_rank") <= wanted, F.col("_rank")).alias("rank"))
    return scores.filter(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(taken)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every document, as drawn towards ``target``'s texts.

    Of the documents with at least ``least_words`` words the highest ``percent`` % (rounded down) of
    the scores are drawn: ``rank`` says in which order, null for the others.

    Null and empty texts have no features and weight 0; they and shorter texts are scored but never
    drawn. A null doc_id has no score and is not drawn. Equal scores go by doc_id; repeated rows are
    scored and drawn each. An empty corpus gives no rows; an empty target counts nothing, so rare
    features win. Very long texts are read whole; malformed UTF-8 counts by its bytes; columns other
    than the two named are not read.
    """
    gain = gains(as_array(bucket_counts(docs, buckets, text_col), buckets), as_array(bucket_counts(target, buckets, text_col), buckets))
    return ranked(materialize(scored(docs, gain, seed, id_col, text_col), "scores"), percent, least_words)


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, 0 AS side, text FROM documents UNION ALL SELECT item_id, 1, text FROM benchmark
), split AS (
  SELECT doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT doc_id, side, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM split
), counted AS (
  SELECT doc_id, side, f, count(*) AS n FROM features GROUP BY 1, 2, 3
), bytes AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM counted)
), sums AS (
  SELECT f, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))) AS c FROM bytes
), hashed AS (
  SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM sums
), placed AS (
  SELECT doc_id, side, bucket, n FROM counted JOIN hashed USING (f)
), total AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t
  FROM range(10000) b(bucket) LEFT JOIN placed USING (bucket) GROUP BY 1
), whole AS (
  SELECT sum(s) AS all_s, sum(t) AS all_t FROM total
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000)) / ((s + 1) * (all_t + 10000))))::BIGINT AS g FROM total, whole
), weighed AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE side = 0 GROUP BY 1
), drawn AS (
  SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (doc_id) WHERE side = 0
), placed_in AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM drawn WHERE fit
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM drawn WHERE fit) * 25 // 100 THEN rank END AS rank
FROM drawn LEFT JOIN placed_in USING (doc_id)
"""
