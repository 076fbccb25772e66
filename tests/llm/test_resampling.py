"""Importance resampling against a plain loop, and the rows its docstring names."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

from annalist.llm import resampling

FIELDS = ("doc_id", "n_features", "weight", "score", "rank")


def by_loop(texts, target, percent=25, least=20, n=10_000):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    def buckets(text):
        w = words(text)
        return [crc32(f.encode()) % n for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s, t = Counter(b for _, x in texts for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = float(sum(s.values())), float(sum(t.values()))
    out, fit = [], []
    for i, x in texts:
        found = [math.floor(1000 * math.log(((t[b] + 1.0) * (all_s + n)) / ((s[b] + 1.0) * (all_t + n)))) for b in buckets(x)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        if score is not None and len(words(x)) >= least:
            fit.append((-score, i, len(out)))
        out.append([i, len(found), weight, score, None])
    for rank, (_, _, at) in enumerate(sorted(fit)[: len(fit) * percent // 100], 1):
        out[at][4] = rank
    return out


def drawn(spark, texts, target, **settings):
    docs = spark.createDataFrame([(i, x, "clash", 1) for i, x in texts], "doc_id long, text string, score string, rank int")
    found = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **settings)
    return sorted((tuple(r[f] for f in FIELDS) for r in found.collect()), key=repr)


def corpus(n=160):
    r = random.Random(12)
    word = lambda: r.choice(["alpha", "Beta", "gamma9", "straße", "ÉCOLE", "delta", "x1", "naïve", "日本"]) + r.choice(["", "1", "b"])
    texts = [(i, r.choice([" ", ", ", "\n", "@"]).join(word() for _ in range(r.randint(0, 60)))) for i in range(n)]
    return texts + [(n, None), (n + 1, ""), (n + 2, "..."), (n + 3, "word " * 5000)], [" ".join(word() for _ in range(40)) for _ in range(5)] + [None, ""]


def test_equals_a_plain_loop(spark):
    texts, target = corpus()
    want = by_loop(texts, target)
    assert drawn(spark, texts, target) == sorted(map(tuple, want), key=repr)
    ranks = [w[4] for w in want if w[4]]
    assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) > 20
    for percent in (0, 100):
        assert drawn(spark, texts, target, percent=percent) == sorted(map(tuple, by_loop(texts, target, percent)), key=repr)


def test_null_ids_repeated_rows_and_empty_tables(spark):
    texts, target = corpus(40)
    texts = [*texts, *[(5, "one two three " * 20)] * 30, (None, "one two three " * 20), (None, None)]
    got, want = drawn(spark, texts, target, percent=50), by_loop(texts, target, 50)
    assert sorted(r[4] for r in got if r[4]) == sorted(r[4] for r in want if r[4])
    assert sorted((r[:4] for r in got), key=repr) == sorted((tuple(r[:4]) for r in want), key=repr)
    assert all(r[4] is None for r in got if r[0] is None)
    assert drawn(spark, [], target) == [] and drawn(spark, texts, []) != []


def test_equal_scores_go_by_doc_id(spark):
    rows = [(i, 25, 0, 0, i % 2) for i in range(20)] + [(50, 3, 0, 0, 9)]
    found = resampling.ranked(spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long"), percent=60)
    assert sorted((r.rank, r.doc_id) for r in found.collect() if r.rank) == list(enumerate([*range(1, 20, 2), 0, 2], 1))


def test_a_long_text_is_read_in_parts():
    r = random.Random(1)
    text = b" ".join(bytes(r.choices(b"abcde", k=r.randint(1, 9))) for _ in range(3000))
    whole = list(resampling.buckets_of(text, 997))
    assert len(whole) == 1
    parts = list(resampling.word_lists(text, 100))
    assert [w for p in parts for w in p] == text.split() and len(parts) > 50
    resampled, original = Counter(), resampling.word_lists
    try:
        resampling.word_lists = lambda body: original(body, 100)
        for _, found in resampling.buckets_of(text, 997):
            resampled.update(found.tolist())
    finally:
        resampling.word_lists = original
    assert resampled == Counter(whole[0][1].tolist())


def test_targets_words_are_preferred(spark):
    texts = [(i, ("the target speaks of rivers and boats " if i < 30 else "the others talk about markets and shares ") * 10) for i in range(300)]
    got = drawn(spark, texts, ["rivers and boats of the target " * 30], percent=10)
    assert sum(r[0] < 30 for r in got if r[4]) >= 15  # three by chance; the noise is as large as a doubled odds ratio
