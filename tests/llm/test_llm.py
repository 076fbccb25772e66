import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from annalist.llm import chat, lines, neighbours, packing, quality, queries, sentencepiece, simhash, substrings, toxicity, urlfilter
from annalist.operators.graph import connected_components
from tests.oracle import both

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None, **extra):
    rows = [(i if ids is None else ids[i], t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    out = spark.createDataFrame(rows, DOCS)
    for name in ("body", "hash", "key", "fp", "cell", "words", "starts", "_id", "_kept", "g", "name", "d"):  # names the operators use themselves
        out = out.withColumn(name, F.lit("clash"))
    return out


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def random_texts(seed, n=40):
    r = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(70))
    out = [None, "", "  \n\t ", "one", passage, passage, "é😀 " * 80, "a " * 300]
    for _ in range(n):
        t = " ".join(r.choice("abcdefgh") * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(r.randint(1, 150)))
        if r.random() < 0.5:
            at = r.randint(0, len(t))
            t = t[:at] + " " + " ".join(passage.split()[r.randint(0, 10) : r.randint(55, 70)]) + " " + t[at:]
        out.append(re.sub(" ", lambda m: r.choice([" ", " ", " ", "\n", "  "]), t))
    out += [out[-1], out[-3] + " tail"]
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert got == want


# 1 ------------------------------------------------------------------------------------------------


def best(vectors, q, k=5):
    def cosine(a, b):
        return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))

    return sorted(((-round(cosine(vectors[q], v), 12), i) for i, v in vectors.items() if i != q))[:k]


def test_neighbours_recall_ties_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 150)
    rng = np.random.default_rng(1)
    good = {i: v for i, v in enumerate(rng.normal(size=(900, 12)) + rng.integers(0, 3, (900, 1)))}
    for i in range(300, 420):
        good[i] = good[300]  # one very common vector
    rows = [(i, v.tolist()) for i, v in good.items()]
    rows += [(1000, None), (1050, [0.0] * 12), (1100, [math.nan] * 12), (1150, [None] + [1.0] * 11), (1200, []), (1250, [math.inf] * 12), (1300, [1.0] * 5), (None, [1.0] * 12), rows[50]]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit(1)).withColumn("score", F.lit("x"))
    got = defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 12), r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    assert set(got) == {i for i in good if i % 50 == 0}
    want = {q: best(good, q) for q in got}
    assert sum(len(set(got[q]) & set(want[q])) for q in got) >= 0.9 * 5 * len(got)
    assert got[300] == want[300] == [(-1.0, i) for i in range(301, 306)]


def test_neighbours_prune_and_recall():
    """The share of whole vectors compared, and recall, of one cell: nearly random vectors, and clustered ones."""
    rng = np.random.default_rng(4)
    n, d, k = 4000, 64, 6
    loose = rng.normal(size=(n, d)) + 0.15 * rng.normal(size=(40, d))[rng.integers(0, 40, n)]
    tight = rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.2 * rng.normal(size=(n, d))
    directions = np.random.default_rng(42).standard_normal((d, 16))
    for x, most in ((loose, 0.8), (tight, 0.15)):
        best, who, verified = neighbours.search(x, np.arange(n), x[::50], np.full(n // 50, -1.0), directions, k, neighbours.chi_square_quantile(0.9, 16))
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        exact = np.argsort(-(unit[::50] @ unit.T), axis=1)[:, :k]
        assert np.mean([len(set(a) & set(b)) / k for a, b in zip(exact.tolist(), who.tolist())]) >= 0.9
        assert verified <= most * n * len(exact)


def test_neighbours_of_extreme_values_lengths_and_many_queries(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TASK_QUERIES", 3)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    rng = np.random.default_rng(7)
    good = {i + 1: rng.normal(size=6) * 10.0 ** rng.choice([-200, 0, 200]) for i in range(160)}
    rows = [(0, [1.0, 2.0]), *((i, v.tolist()) for i, v in good.items())]  # the smallest id has an odd length
    got = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=2, confidence=0.999).orderBy("query_id", "rank").collect():
        got[r.query_id].append((-round(r.score, 12), r.vec_id))
    plain = {i: v / np.abs(v).max() for i, v in good.items()}
    assert set(got) == {i for i in good if i % 2 == 0}
    assert sum(len(set(got[q]) & set(best(plain, q))) for q in got) >= 0.97 * 5 * len(got)


def test_neighbours_of_few_and_no_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.nearest(two).collect()] == [(0, 1, 7, round(0.5**0.5, 9))]
    assert neighbours.nearest(two.filter("false")).count() == 0
    assert abs(neighbours.chi_square_quantile(0.95, 2) - 5.991464547) < 1e-6


# 2 ------------------------------------------------------------------------------------------------


def base_counts(text):
    w, windows, covered = words(text), defaultdict(list), set()
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    for at in windows.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 8))
    solid = [line for line in (text or "").split("\n") if words(line)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(solid) - len(set(solid)), len(covered)


def test_quality_counts_and_outliers(spark):
    texts = random_texts(2, 150) + ["x y z\n" * 30, "<b># &| " * 40, "\n\n", "word " * 7, "same words come here again now ok yes " * 2]
    r = random.Random(4)
    texts += [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(2, 8))) for _ in range(80)) for _ in range(150)]
    texts += [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(2, 8))) + "***" for _ in range(80))]
    t = docs(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 9 == 4, None).otherwise(F.col("lang")))
    got = {r.doc_id: r for r in quality.quality(t).collect()}
    for i, text in enumerate(texts):
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == base_counts(text), i
        assert g.base_failed == (g.n_words < 20 or 100 * g.n_repeat_words > 30 * g.n_words)
        assert not (g.base_failed and g.kept)
    assert not got[len(texts) - 1].kept
    assert all(got[i].kept for i in range(len(texts) - 150, len(texts) - 1))
    assert quality.quality(t.filter("false")).count() == 0


def test_quality_distance_is_mahalanobis(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4)) * [0.3, 0.2, 0.1, 0.2]
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, x1 double, x2 double, x3 double, x4 double")
    e = quality.estimate(rows)
    d = np.array([r.d for r in rows.join(e, "g").orderBy("x1").select(quality.distance([F.col(a) for a in quality.AXES]).alias("d")).collect()])
    cov = np.cov(x.T, bias=True) + np.diag([f**2 for f in quality.FLOORS.values()])
    c = (x - x.mean(0))[np.argsort(x[:, 0])]
    assert np.allclose(d, np.einsum("ij,jk,ik->i", c, np.linalg.inv(cov), c))


def test_quality_estimate_is_the_least_determinant_of_random_starts(spark):
    rng = np.random.default_rng(3)
    n, share = 240, 0.75
    x = rng.normal(size=(n, 4)) @ np.array([[0.5, 0.2, 0, 0], [0, 0.3, 0.1, 0], [0, 0, 0.4, 0.2], [0, 0, 0, 0.6]])
    x[:48] += [3, -2, 3, 2]  # a fifth of the rows is elsewhere
    floors = np.diag([f**2 for f in quality.FLOORS.values()])

    def moments(rows):
        return rows.mean(0), np.cov(rows.T, bias=True) + floors

    def far(e):
        return np.einsum("ij,jk,ik->i", x - e[0], np.linalg.inv(e[1]), x - e[0])

    def inner(d, q):
        return d <= np.sort(d)[math.ceil(q * n) - 1]

    least = None
    for _ in range(60):
        e = moments(x[rng.choice(n, 12, replace=False)])
        for _ in range(40):
            e = moments(x[inner(far(e), share)])
        det = np.linalg.slogdet(e[1])[1]
        if least is None or det < least[0]:
            least = (det, e)
    d = far(least[1])
    e = moments(x[d <= np.sort(d)[math.ceil(n / 2) - 1] * quality.INNER / quality.MEDIAN])
    want = far(e) / max(np.sort(far(e))[math.ceil(n / 2) - 1] / quality.MEDIAN, 1)
    rows = spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, x1 double, x2 double, x3 double, x4 double")
    got = np.array([r.d for r in rows.join(quality.fit(rows, 30, share), "g").select("x1", quality.distance([F.col(a) for a in quality.AXES]).alias("d")).orderBy("x1").collect()])
    assert np.allclose(got, want[np.argsort(x[:, 0])], rtol=1e-6)
    assert (want[:48] > quality.CUT).all() and (want[48:] < quality.CUT).all()
    assert abs(math.exp(-quality.CUT / 2) * (1 + quality.CUT / 2) - 1e-6) < 1e-9


def test_quality_of_null_ids_repeated_rows_and_long_texts(spark):
    r = random.Random(12)
    plain = [" ".join("".join(r.choice("etaoin") for _ in range(r.randint(2, 8))) for _ in range(80)) for _ in range(120)]
    t = docs(spark, plain).union(docs(spark, [plain[0], plain[0], plain[1], "word%d " % 5 * 30000], [0, 0, None, 900]))
    got = [(g.doc_id, g.kept, g.n_words) for g in quality.quality(t).collect()]
    assert sorted(k for i, k, _ in got if i == 0) == [True] * 3 and [k for i, k, _ in got if i is None] == [True]
    assert (900, False, 30000) in got and len(got) == 124


# 3 and 9 ------------------------------------------------------------------------------------------


def substring_brute(rows, length=50):
    starts = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            starts[key] = min(i, starts.get(key, i))
    out = {}
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - length + 1):
            if starts[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


def test_substrings_equal_brute_force(spark):
    texts = random_texts(3)
    want = substring_brute(list(enumerate(texts)))
    t = docs(spark, texts).union(docs(spark, ["lone " * 60], [None]))
    got = {r.doc_id: r for r in substrings.repeated_words(t, texts=True).collect()}
    assert {i: (g.n_words, g.n_removed, g.kept_sha256) for i, g in got.items() if i is not None} == {i: w[:3] for i, w in want.items()}
    assert got[None].n_removed == 0 and sum(w[1] for w in want.values()) > 500
    cut = {r.doc_id: r for r in substrings.substring_dedup(t).collect()}
    assert set(cut[0].asDict()) == set(t.columns) and len(cut) == len(texts) + 1
    for i, w in want.items():
        assert cut[i].text == (w[3] if w[1] else texts[i])
        assert cut[i].n_chars == (None if cut[i].text is None else len(cut[i].text))
    assert substrings.repeated_words(t.filter("false")).count() == 0


@pytest.mark.parametrize("length", [3, 30, 110])
def test_substrings_of_other_lengths_and_long_runs(spark, length):
    run = " ".join(f"r{i}" for i in range(400))
    texts = [*random_texts(8, 15), run, "head " + run + " tail", " ".join(run.split()[37:300]) + " x"]
    want = substring_brute(list(enumerate(texts)), length)
    got = {r.doc_id: r for r in substrings.repeated_words(docs(spark, texts), length, texts=True).collect()}
    assert {i: (g.n_words, g.n_removed, g.kept_sha256) for i, g in got.items()} == {i: w[:3] for i, w in want.items()}
    assert substrings.levels(50) == [13, 25, 50] and all(b <= 2 * a for x in range(1, 300) for a, b in zip(substrings.levels(x), substrings.levels(x)[1:]))


def test_repeated_rows_of_a_document_do_not_match_each_other(spark):
    t = docs(spark, ["w%d " % i for i in range(2)] + [" ".join(map(str, range(60)))] * 3, [0, 1, 5, 5, 9])
    assert sorted((r.doc_id, r.n_removed) for r in substrings.repeated_words(t).collect()) == [(0, 0), (1, 0), (5, 0), (5, 0), (9, 60)]


def line_brute(rows, shortest):
    seen, later = {}, defaultdict(set)
    solid = {i: [k for k, line in enumerate((t or "").split("\n")) if words(line)] for i, t in rows}
    for i, t in sorted(rows):
        split = (t or "").split("\n")
        for p in range(len(solid[i]) - shortest + 1):
            key = tuple(split[k] for k in solid[i][p : p + shortest])
            if key in seen:
                later[i].update(solid[i][p : p + shortest])
            seen.setdefault(key, (i, p))
    return {i: "\n".join(line for k, line in enumerate((t or "").split("\n")) if k not in later[i]) for i, t in rows}


@pytest.mark.parametrize("shortest", [1, 2, 3, 5])
def test_lines_equal_brute_force(spark, shortest):
    r = random.Random(shortest)
    texts = [None, "", "\n\n", "a\na\na\na\na\na"] + ["\n".join(r.choice(["a", "b", "c", " ", "", "long line %d" % r.randint(0, 3)]) for _ in range(r.randint(1, 25))) for _ in range(40)]
    texts.append(texts[-1])
    want = line_brute(list(enumerate(texts)), shortest)
    got = {x.doc_id: x for x in lines.repeated_lines(docs(spark, texts), shortest, texts=True).collect()}
    for i, kept in want.items():
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest(), (i, texts[i], kept, got[i].kept)
    cut = {x.doc_id: x.text for x in lines.line_dedup(docs(spark, texts), shortest).collect()}
    assert {i: t or "" for i, t in cut.items()} == want
    longest = defaultdict(int)
    solid = {i: [line for line in (t or "").split("\n") if words(line)] for i, t in enumerate(texts)}
    length = 1
    while any(len(x) >= length for x in solid.values()):
        seen = set()
        for i, x in solid.items():
            for p in range(len(x) - length + 1):
                if tuple(x[p : p + length]) in seen:
                    longest[i] = length
                seen.add(tuple(x[p : p + length]))
        length = lines.longer(length, shortest)
    assert {i: g.longest_copy if g.n_deleted else 0 for i, g in got.items()} == {i: longest[i] if longest[i] >= shortest else 0 for i in got}
    assert [lines.longer(k, 5) for k in (1, 2, 4, 5)] == [2, 4, 5, 10]


@pytest.mark.parametrize("shortest", [1, 3])
def test_maximal_runs_of_lines_are_copies_that_no_other_covers(spark, shortest):
    r = random.Random(shortest)
    block = [f"line {i}" for i in range(45)]
    texts = ["\n".join(block), "\n".join(["own", *block[3:40], "", "end"]), "\n".join([*block[20:31], "own", *block[:7]]), "a\n" * 20, None, ""]
    texts += ["\n".join(r.choice(["a", "b", "c", " ", *block[:3]]) for _ in range(r.randint(1, 25))) for _ in range(30)]
    solid = {i: [line for line in (t or "").split("\n") if words(line)] for i, t in enumerate(texts)}
    runs = lines.maximal_runs(docs(spark, texts), shortest).collect()
    spans = defaultdict(list)
    for x in runs:
        assert x.length >= shortest and (x.source.doc_id, x.source.pos) < (x.doc_id, x.start)
        assert solid[x.doc_id][x.start : x.start + x.length] == solid[x.source.doc_id][x.source.pos : x.source.pos + x.length]
        spans[x.doc_id].append((x.start, x.start + x.length))
    assert not any(a != b and a[0] <= b[0] and b[1] <= a[1] for s in spans.values() for a in s for b in s)
    assert all(len(set(s)) == len(s) for s in spans.values())
    kept = line_brute(list(enumerate(texts)), shortest)
    for i, rows in solid.items():
        gone = {k for a, b in spans[i] for k in range(a, b)}
        assert [x for k, x in enumerate(rows) if k not in gone] == [x for x in kept[i].split("\n") if words(x)]
    assert spans[1] == [(1, 38)] and [(x.length, x.source.doc_id, x.source.pos) for x in runs if x.doc_id == 1] == [(37, 0, 3)]
    assert spans[0] == [] and {(0, 11), (12, 19)} <= set(spans[2])


def test_long_runs_null_ids_and_repeated_rows_of_lines(spark):
    run = [f"line number {i} of a long run" for i in range(70)]
    texts = ["\n".join(["x", *run, "y"]), "\n".join([*run[10:60], "z " * 20000]), "\n".join(run), "\n".join(run), "z " * 20000]
    t = docs(spark, texts, [3, 4, 5, 5, None])
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_lines, r.n_deleted, r.n_runs, r.longest_copy) for r in lines.repeated_lines(t, 4).collect())
    assert got == [((False, 3), 72, 0, 0, 0), ((False, 4), 51, 50, 1, 32), ((False, 5), 70, 70, 1, 64), ((False, 5), 70, 70, 1, 64), ((True, 0), 1, 0, 0, 0)]
    assert lines.line_dedup(t.filter("false"), 1).count() == 0


# 4 ------------------------------------------------------------------------------------------------


def test_sentencepiece_equals_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(0)
    texts = random_texts(4, 20) + ["".join(r.choice("ab e▁\n\t日é😀thinger.,1") for _ in range(r.randint(0, 40))) for _ in range(300)] + ["   lead", "trail   ", "x" * 3000, "don't"]
    coded = sentencepiece.encode(docs(spark, texts))
    got = {x.doc_id: x.ids for x in coded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t or ""), repr(t)
    back = {x.doc_id: x.text for x in sentencepiece.decode(coded).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(texts))
    assert sentencepiece.encode(docs(spark, texts).filter("false")).count() == 0


# 5 ------------------------------------------------------------------------------------------------


def test_url_rules_by_trie_and_by_join(spark):
    urls = [None, "", "no scheme", "http://net", "http://NET/x", "https://a.example.net/en/1?q", "https://a.example.net/en", "https://example.net/fr/", "ftp://x.example.com/de/#f", "http://example.community/de/", "http://my.org/fr/a", "http://org?x=/fr/", "http://borg/fr/", "http://.net/", "://", "http://a.net:80/en/", "http://x.example.com//de/", "http://u@b.example.net/en/a/b", "http://example.net/en//", "http://a://b.org/fr/"]
    t = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))

    def judge(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h), len(p), h + p, v) for h, p, v in urlfilter.DEFAULT_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    want = [(i, *judge(u)) for i, u in enumerate(urls)]
    order = ("page_id", "host", "path", "rule", "verdict")
    assert sorted(tuple(r[c] for c in order) for r in urlfilter.url_filter(t).collect()) == want
    assert sorted(tuple(r[c] for c in order) for r in urlfilter.url_filter(t, trie_rules=2).collect()) == want
    table = spark.createDataFrame(urlfilter.DEFAULT_RULES + [("net", None, "allow")], "host string, path string, verdict string")
    assert sorted(tuple(r[c] for c in order) for r in urlfilter.url_filter(t, table).collect()) == want
    assert urlfilter.url_filter(t.filter("false")).count() == 0


# 6 ------------------------------------------------------------------------------------------------


def fingerprint_brute(text):
    from xxhash import xxh64_intdigest

    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    h = [xxh64_intdigest(" ".join(w[i : i + 3]), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_every_five_positions_hold_an_indexed_quadruple():
    from itertools import combinations

    assert len(simhash.QUADRUPLES) == 14
    assert all(any(set(q) <= set(five) for q in simhash.QUADRUPLES) for five in combinations(range(8), 5))


def component_brute(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_components_equal_brute_force(spark):
    long = [f"W{i} common words" for i in range(300)]
    texts = random_texts(6) + [" ".join(long[:k] + ["x"] + long[k:]) for k in range(0, 300, 20)] + [" ".join(long)] * 5
    got = simhash.components(docs(spark, texts)).collect()
    prints = {i: fingerprint_brute(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    want = component_brute(prints)
    assert {r.doc_id: r.component_id for r in got} == want
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs(spark, texts)).collect()}
    assert kept == set(want.values())
    assert simhash.components(docs(spark, texts).filter("false")).count() == 0


@pytest.mark.parametrize("most", [20, 4096])
def test_long_lists_are_split_and_lose_no_link(spark, most):
    rng = np.random.default_rng(6)
    low = rng.integers(0, 1 << 32, 250, dtype=np.uint64)
    near = [int(x) ^ sum(1 << int(b) for b in rng.choice(32, 3, replace=False)) for x in low[:150]]
    same = 0x0123456700000000
    prints = sorted({same | x for x in [*map(int, low), *near]} | {same ^ (7 << 40) | int(x) for x in low[:40]} | {x << 20 for x in range(300)})
    table = spark.createDataFrame([(x,) for x in prints], "fp long")
    index = simhash.keyed(table, most)
    if most == 20:
        assert index.groupBy("key").count().agg({"count": "max"}).first()[0] <= 20 < simhash.keyed(table).groupBy("key").count().agg({"count": "max"}).first()[0]
    linked = connected_components(simhash.links(index.repartition("key").sortWithinPartitions("key", "fp"))).collect()
    groups = defaultdict(set)
    for r in linked:
        groups[r.component].add(r.node)
    want = defaultdict(set)
    for i, part in component_brute(dict(enumerate(prints))).items():
        want[part].add(prints[i])
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)
    free = tuple(range(32))
    assert sorted(b for part in simhash.parts_of(free) for b in part) == list(free) and len(simhash.parts_of(free)) == 4


def test_simhash_links_over_batches_and_dense_keys(spark):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 2**62, 4)
    prints = {int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 62, k))) for c in center for k in range(7) for _ in range(30)}
    prints |= {int(x) for x in rng.integers(-(2**62), 2**62, 200)}
    ids = {i: p for i, p in enumerate(sorted(prints))}
    index = spark.createDataFrame([(1, p) for p in sorted(prints)], "key long, fp long").coalesce(1).sortWithinPartitions("key", "fp")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 64)
    try:
        links = simhash.links(index).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = component_brute({i: p & (2**64 - 1) for i, p in ids.items()})
    number, root = {p: i for i, p in ids.items()}, {i: i for i in ids}
    for r in links:
        assert len(links) < len(prints)
        a, b = number[r.a], number[r.b]
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        root[max(a, b)] = min(a, b)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    assert {i: find(i) for i in ids} == want


# 7 ------------------------------------------------------------------------------------------------


def test_chat_reads_back_what_it_formats(spark):
    r = random.Random(1)
    bits = ["\\", "</turn>", "<turn>", "### ", "###", ":", "\n", "é", "ok", "<", " "]
    rows = [(c, n, r.choice(["user", "assistant", "sys: tem", None]), None if r.random() < 0.1 else "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for c in range(30) for n in range(r.randint(1, 6))]
    rows += [(99, n, "assistant" if n % 2 else "user", f"turn {n}") for n in range(300)] + [(5, None, "user", "no turn"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    said = defaultdict(list)
    for c, n, role, text in rows:
        said[c].append((n is not None, n or 0, role or "", text or ""))
    got = {g.conv_id: g for g in chat.digests(chat.format_chats(t)).collect()}
    for c, turns in said.items():
        turns.sort()
        loss = "".join(x for *_, role, x in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for *_, role, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_chats(t.filter("false")).count() == 0


def test_chat_detects_templates_that_rewrite_history():
    def last_only(turns, opening=None):
        out = "".join(f"[{r}]{x if n == len(turns) - 1 and opening is None else '...'};" for n, (r, x) in enumerate(turns))
        return out + (f"[{opening}]" if opening is not None else "")

    assert chat.spans([("user", "a"), ("assistant", "b")], last_only)[1] is None
    text, found = chat.spans([("user", "a<turn>"), ("assistant", "")], chat.turn_template)
    assert [text[a:b] for a, b in found] == ["a\\<turn>", ""]


def test_history_rewritten_late_is_detected():
    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(300)]

    def late(first, last):
        return lambda said, opening=None: ("summary\n" if first <= len(said) < last else "") + chat.turn_template(said, opening)

    for n, first, last in ((200, 150, 151), (300, 129, 300), (140, 100, 140), (300, 299, 400), (300, 300, 301)):
        assert chat.spans(turns[:n], late(first, last))[1] is None
    whole, found = chat.spans(turns, chat.turn_template)
    assert [whole[a:b] for a, b in found] == [t for _, t in turns] and chat.spans(turns, chat.turn_template, additive=True) == (whole, found)
    numbered = lambda said, opening=None: "".join(f"{i} {r}: {t}\n" for i, (r, t) in enumerate(said)) + ("" if opening is None else f"{len(said)} {opening}: ")
    assert chat.spans(turns, numbered)[1] is not None and chat.spans(turns[:20], numbered, additive=True)[1] is None


def test_roles_and_texts_are_read_back_from_the_text(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a: b\\"), (None, 3, None, None), (None, 2, "assistant", "x"), (None, 2, "assistant", "x")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(made.withColumn("roles", F.array(F.lit("assistant")))).collect()}
    assert got == {1: (2, 5), None: (3, 2)}
    with pytest.raises(Exception, match="not those of the turns"):
        chat.digests(made.withColumn("starts", F.transform("starts", lambda s: s + 1))).collect()


# 8 ------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_scores(spark):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("etaoinsh") for _ in range(r.randint(3, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        w = [r.choice(vocabulary) for _ in range(r.randint(5, 200))]
        if i % 5 == 0:
            w[r.randrange(len(w))] = r.choice(["worthless", "moronic", "blockhead"])
        texts.append(" ".join(w))
        labels.append((i, int(i % 5 == 0)))
    texts += [None, "", "...", "a w0rthless wortless moronnic x"]
    t = docs(spark, texts).union(docs(spark, ["x"], [None]))
    known = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(t, known)
    rows = {x.doc_id: x for x in toxicity.score(t, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in range(600) if rows[i].held_out} == set(held)
    assert sum(rows[i].predicted == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert [rows[i].score for i in (600, 601, 602)] == [0.0, 0.0, 0.0] and rows[603].predicted == 1
    clean = {x.doc_id for x in toxicity.drop_toxic(t, model).collect()}
    assert clean == {i for i, x in rows.items() if x.score < 0.3}
    assert toxicity.score(t.filter("false"), model).count() == 0


def test_toxicity_without_labels_is_constant(spark):
    t = docs(spark, ["a", ""])
    model = toxicity.fit(t, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [x.score for x in toxicity.score(t, model).collect()] == [0.0, 0.0]


# 10 -----------------------------------------------------------------------------------------------


def check_packing(rows, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity


def test_packing_covers_every_id_once(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = random_texts(10, 60) + ["It's we're ''s <|endoftext|> x<|startoftext|>", "naïve ÀÉ\xa0½ 12", "Ωσς 日本", "long text " * 3000]
    rows = packing.pack(docs(spark, texts), windows_per_block=4, capacity=512).collect()
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    check_packing(rows, want, 512)
    total = sum(map(len, want.values()))
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert sum(512 - n for n in lengths.values() if n & (n - 1)) < 0.08 * total
    assert packing.pack(docs(spark, texts).filter("false")).count() == 0


def test_differencing_balances_and_windows_rise():
    r = random.Random(0)
    sizes = [r.randint(1, 100) for _ in range(400)]
    sums = [sum(sizes[i] for i in w) for w in packing.differencing(sizes, 7)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 1
    found = packing.windows([60, 60, 60], 2, 100)
    assert sorted(i for w in found for i in w) == [0, 1, 2] and len(found) == 3
    assert packing.windows([], 1, 100) == []


def test_packing_of_many_small_partitions_and_repeated_rows(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for t in random_texts(11, 300) if t] + ["x " * 700]
    t = docs(spark, texts).repartition(90)
    rows = packing.pack(t, capacity=512).collect()
    want = {i: np.array([*tokenizer.encode(x, add_special_tokens=False).ids, 1], "<u4") for i, x in enumerate(texts)}
    check_packing(rows, want, 512)
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.sequence_id] += r.length
    assert len(lengths) <= 1.1 * sum(map(len, want.values())) / 512 + 2  # two groups of partitions
    twice = packing.pack(docs(spark, ["one two"] * 3 + [None], [5, 5, None, None])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.start, r.length) for r in twice) == [(False, 5, 0, 3), (False, 5, 0, 3), (True, 0, 0, 1), (True, 0, 0, 3)]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    bodies = [b"some words here", "other words, na\u00efve 'tis the world's".encode(), b"some more"]
    want = [x.tolist() for x in packing.Encoder(model, 1).texts(bodies)]
    monkeypatch.setattr(packing, "MIX", np.uint64(0))  # every hash is 0
    weak = packing.Encoder(model, 1)
    assert [x.tolist() for _ in range(2) for x in weak.texts(bodies)] == want * 2
    small = packing.Encoder(model, 1, remembered=3)
    monkeypatch.undo()
    assert [x.tolist() for _ in range(2) for x in small.texts(bodies)] == want * 2


def test_words_of_equal_polynomial_hashes_are_told_apart():
    """Thue-Morse words and their complements have one polynomial hash modulo 2^64, whatever the base."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read(), 1)
    for bits in (10, 11, 12):
        one = "q" * 8 + "".join("ab"[i.bit_count() % 2] for i in range(1 << bits))
        other = "q" * 8 + "".join("ba"[i.bit_count() % 2] for i in range(1 << bits))
        want = [[*encoder.whole.encode(t, add_special_tokens=False).ids, 1] for t in (one, other)]
        assert want[0] != want[1]
        both = [*want[0][:-1], *want[1]]
        assert [x.tolist() for x in encoder.texts([f"{one} {other}".encode()])] == [both]  # in one text
        assert [x.tolist() for x in encoder.texts([one.encode(), other.encode()])] == want  # in one batch
        encoder.forget()
        assert [[x.tolist() for x in encoder.texts([t.encode()])][0] for t in (one, other, one)] == [want[0], want[1], want[0]]  # against a remembered one


def test_remembered_long_words_have_a_bound(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = packing.Encoder(f.read(), 1)
    monkeypatch.setattr(packing, "MOST_LONG", 1000)
    r = random.Random(3)
    for _ in range(20):
        bodies = [" ".join("".join(r.choice("abcd") for _ in range(r.randint(1, 30))) for _ in range(40)).encode() for _ in range(3)]
        assert [x.tolist() for x in encoder.texts(bodies)] == [[*encoder.whole.encode(b.decode(), add_special_tokens=False).ids, 1] for b in bodies]
        assert len(encoder.long) < 10_000


# Pipeline -----------------------------------------------------------------------------------------


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_pipeline_stage_equals_brute_force(spark):
    import corpus_pipeline

    docs_in = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs_in.collect()}
    frames = []
    step = docs_in
    for name, stage in corpus_pipeline.STAGES:
        step = corpus_pipeline.materialize(stage(spark, step, SF), "stage")
        frames.append(step)
        if name != "packing":
            assert step.columns == docs_in.columns
    toxic, deduped, near, cut, packed = frames
    model = toxicity.fit(docs_in, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id: r.text for r in toxic.collect()}
    assert set(clean) == {r.doc_id for r in toxicity.score(docs_in, model).collect() if r.score < 0.3}
    assert all(clean[i] == seen[i] for i in clean)
    rest = {r.doc_id: r.text for r in deduped.collect()}
    assert {i: t or "" for i, t in rest.items()} == line_brute(list(clean.items()), 1)
    one = {r.doc_id: r.text for r in near.collect()}
    kept = set(component_brute({i: fingerprint_brute(t) for i, t in rest.items()}).values())
    assert one == {i: rest[i] for i in kept}
    want = {i: w[3] if w[1] else one[i] for i, w in substring_brute(list(one.items())).items()}
    assert {r.doc_id: r.text for r in cut.collect()} == want
    assert {r.doc_id for r in packed.collect()} == set(want)
