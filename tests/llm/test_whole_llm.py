"""Rows and parts of texts that an earlier version left out."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from annalist.llm import quality, toxicity
from annalist.llm import queries as llm_queries
from annalist.llm.common import Memo


def written(path, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), f"{path}/{name}.parquet")
    return str(path)


def test_later_copies_of_single_lines_go(spark, tmp_path):
    texts = ["one alone\nan opening line\nb", "x\nan opening line\ny", "one alone", "an opening line\nz\nb", "", None]
    want = ["one alone\nan opening line\nb", "x\ny", "", "z", "", ""]
    n = len(texts)
    d = written(tmp_path, documents={"doc_id": list(range(n)), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["web"] * n, "n_chars": [len(x or "") for x in texts]})
    got = {r.doc_id: (r.n_deleted, r.kept_sha256) for r in llm_queries.QUERIES["op9_line_dedup"](spark, d).collect()}
    assert got == {i: (gone, hashlib.sha256(x.encode()).hexdigest()) for i, (gone, x) in enumerate(zip([0, 1, 1, 2, 0, 0], want))}
    kept = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d).collect()}
    assert [kept[i] or "" for i in range(n)] == want


def test_small_groups_are_judged(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("etaoin") for _ in range(draw.randint(2, 8)))
    rows = [(i, " ".join(word() for _ in range(80)), "de" if i % 2 else "fr", f"s{i % 6}") for i in range(60)]  # ten a group, thirty a language
    rows += [(60, " ".join(word() + "***" for _ in range(80)), "de", "s1"), (61, " ".join(word() for _ in range(80)), None, "alone"), (62, " ".join(word() + "***" for _ in range(80)), "it", "alone")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(r.distance is not None for r in got.values() if not r.base_failed)
    assert {i for i, r in got.items() if not r.kept} == {60, 62}


def test_toxic_parts_of_long_runs_are_scored():
    s = toxicity.Settings()
    weights = np.zeros(1 << s.bucket_bits)
    weights[toxicity.subwords(["poison"], s)[0]] = 1.0
    model = toxicity.Model(weights, 0.0, s)
    score = lambda text: model.worst([toxicity.words_of(text)], Memo(model.sums).learn(toxicity.words_of(text)))[0]
    assert score("x" * 38 + "poison" + "y" * 80) > score("x" * 38 + "qwerty" + "y" * 80) + 0.01
    run = "".join(chr(0x4E00 + i) for i in range(500))
    pieces = toxicity.words_of(run)
    assert all(any(run[i : i + 6] in p for [p] in pieces) for i in range(495)) and toxicity.words_of("short words") == [["short", "words"]]


def test_scores_are_the_worst_average_of_eight_words():
    s = toxicity.Settings()
    model = toxicity.Model(np.random.default_rng(1).normal(size=1 << s.bucket_bits), -0.25, s)
    draw = random.Random(2)
    texts = ["", "...", "one"] + [" ".join("".join(draw.choice("abcde") for _ in range(draw.randint(1, 30))) for _ in range(draw.randint(1, 40))) for _ in range(60)]

    def brute(text):
        worst = None
        for words in toxicity.words_of(text):
            for i in range(max(len(words) - s.segment, 0) + 1):
                bag = np.concatenate([toxicity.subwords([w], s)[0] for w in words[i : i + s.segment]])
                logit = float(np.mean(model.weights[bag])) + model.bias
                worst = logit if worst is None else max(worst, logit)
        return 0.0 if worst is None else 1 / (1 + np.exp(-worst))

    want = [brute(t) for t in texts]
    assert np.allclose(model.scores(texts, Memo(model.sums)), want, atol=1e-12)
    assert [model.scores([t], Memo(model.sums))[0] for t in texts] == model.scores(texts, Memo(model.sums))  # the batch changes no bit


def test_insults_anywhere_in_unspaced_text_are_caught(spark):
    draw = random.Random(5)
    han = [chr(0x4E00 + i) for i in range(400)]
    insults = ["\u8822\u8d27\u7684", "\u767d\u75f4\u554a"]
    texts, labels = [], []
    for i in range(800):
        text = "".join(draw.choice(han) for _ in range(80))
        if i % 4 == 0:
            at = draw.randint(0, 80)
            text = text[:at] + draw.choice(insults) + text[at:]
        texts.append(text)
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts[:600], labels[:600])
    scores = model.scores(texts[600:], Memo(model.sums))
    caught = [x >= 0.3 for x, y in zip(scores, labels[600:]) if y]
    wrong = [x >= 0.3 for x, y in zip(scores, labels[600:]) if not y]
    assert sum(caught) >= 0.9 * len(caught) and sum(wrong) <= 0.05 * len(wrong)


def test_long_repeated_and_null_rows_are_scored_each(spark):
    long = "clean words all along " * 5000
    rows = [(1, long + "worthless"), (1, long + "worthless"), (2, long), (None, "worthless"), (3, None), (4, "")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    draw = random.Random(9)
    said = [" ".join(draw.choice(["clean", "words", "all", "along", "other", "things"]) for _ in range(draw.randint(3, 60))) for _ in range(200)]
    labels = [int(i % 4 == 0) for i in range(200)]
    model = toxicity.train([f"{t} worthless {u}" if y else t for t, u, y in zip(said, reversed(said), labels)], labels)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.predicted) for r in toxicity.score(t, model).collect())
    assert got == [(False, 1, 1), (False, 1, 1), (False, 2, 0), (False, 3, 0), (False, 4, 0), (True, 0, 1)]
    assert sorted(r.doc_id for r in toxicity.drop_toxic(t, model).collect()) == [2, 3, 4]
    assert toxicity.drop_toxic(t.filter("false"), model).count() == 0
