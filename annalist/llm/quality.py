"""Quality rules and robust multivariate outliers: a minimum covariance determinant per language and
source, in DataFrame operations only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annalist.scratch import discard, materialize

SPACES = r"[\x20\x09-\x0D]+"
#: Least standard deviation of each transformed statistic: finer differences are not told apart.
FLOORS = {"x1": 0.05, "x2": 0.05, "x3": 0.12, "x4": 0.14}
AXES = list(FLOORS)
#: Quantiles of the chi-square distribution with as many degrees of freedom as there are axes.
MEDIAN, INNER = 3.3567, 11.1433
#: Its 99.9999 % quantile: beyond it, not one of a million vectors of a normal group would lie.
CUT = 33.3768


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts that the rules and the vectors are made of, read off the whole text.

    Windows of 8 words are compared by 64-bit hashes within their text. A text where all differ, by
    far the usual case, is told by a hash set; only others sort theirs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), text.alias("body"))
    words = base.withColumn("trimmed", F.btrim("body", F.lit(" \t\n\x0b\f\r"))).withColumn("words", F.when(F.col("trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("trimmed", SPACES, -1)))
    solid = F.filter(F.split("body", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.withColumn("lines", solid).select(
        "doc_id", "lang", "source", "words",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.char_length("body") - F.char_length(F.regexp_replace("body", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    at = F.sequence(F.lit(1), F.size("words") - 7)
    hashed = counted.withColumn("hashes", F.when(F.size("words") >= 8, F.transform(at, lambda i: F.xxhash64(F.slice("words", i, 8)))).otherwise(F.array().cast("array<bigint>"))).drop("words")
    repeats = F.size(F.array_distinct("hashes")) < F.size("hashes")
    ordered = hashed.withColumn("ordered", F.when(repeats, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s, n = F.col("ordered"), F.size("ordered")
    twice = ordered.withColumn("places", F.sort_array(F.transform(F.filter("ordered", lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == x["h"]))), lambda x: x["i"])))
    spans = F.zip_with("places", F.slice("places", 2, F.greatest(F.size("places"), F.lit(1))), lambda a, b: F.least(b - a, F.lit(8)))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: total + x)
    return twice.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistics: word length, and roots of the shares of symbols, repeated lines and words."""
    words = F.greatest("n_words", F.lit(1))
    return (
        stats.withColumn("x1", F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)))
        .withColumn("x2", F.sqrt(F.col("n_symbols") / F.greatest("word_chars", F.lit(1))))
        .withColumn("x3", F.sqrt(F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))))
        .withColumn("x4", F.sqrt(F.col("n_repeat_words") / words))
    )


def distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance from a group's estimate, by the Cholesky factor in its columns."""
    solved: list[Column] = []
    for i, value in enumerate(x):
        rest = reduce(lambda r, k: r - F.col(f"l{i}{k}") * solved[k], range(i), value - F.col(f"m{i}"))
        solved.append(rest / F.col(f"l{i}{i}"))
    return reduce(lambda a, b: a + b, (s * s for s in solved)) / F.col("scale")


def estimate(rows: DataFrame, *keys: str) -> DataFrame:
    """Mean and Cholesky factor of the covariance of each group; the floors' squares are added to its diagonal."""
    p = len(AXES)
    pairs = [(i, k) for i in range(p) for k in range(i + 1)]
    sums = rows.groupBy("g", *keys).agg(*(F.avg(a).alias(f"m{i}") for i, a in enumerate(AXES)), *(F.covar_pop(AXES[i], AXES[k]).alias(f"c{i}{k}") for i, k in pairs))
    for i in range(p):
        sums = sums.withColumn(f"c{i}{i}", F.col(f"c{i}{i}") + F.lit(FLOORS[AXES[i]] ** 2))
    return factored(sums)


def factored(sums: DataFrame) -> DataFrame:
    """The Cholesky factors of the covariances in the columns c.., instead of them."""
    p = len(AXES)
    pairs = [(i, k) for i in range(p) for k in range(i + 1)]
    for i, k in sorted(pairs, key=lambda q: (q[1], q[0])):
        rest = reduce(lambda r, j: r - F.col(f"l{i}{j}") * F.col(f"l{k}{j}"), range(k), F.col(f"c{i}{k}"))
        sums = sums.withColumn(f"l{i}{k}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == k else rest / F.col(f"l{k}{k}"))
    return sums.drop(*(f"c{i}{k}" for i, k in pairs)).withColumn("scale", F.lit(1.0))


def log_det() -> Column:
    return reduce(lambda a, b: a + b, (2 * F.log(f"l{i}{i}") for i in range(len(AXES))))


def kept_rows(rows: DataFrame, label: str = "estimate") -> DataFrame:
    """``rows``, a row per group (and start), as a table of one file.

    A join with the table is then a broadcast where its size allows, and the vectors need no shuffle by group, of which one
    may hold most. Many files of a row each would cost the readers more memory than the rows themselves.
    """
    return materialize(rows.repartition(1), label)


def first_estimates(vectors_once: DataFrame) -> DataFrame:
    """(g, start, estimate): three deterministic starts for each group, with an infinite determinant.

    Start 0: medians and absolute deviations; 1: mean and covariance of all vectors; 2: those of the
    vectors drawn in by the hyperbolic tangent of their distance from the median in deviations.
    """
    p = len(AXES)
    medians = kept_rows(vectors_once.groupBy("g").agg(*(F.percentile_approx(a, 0.5, 10000).alias(f"m{i}") for i, a in enumerate(AXES))), "medians")
    spread = vectors_once.join(medians, "g").groupBy("g").agg(
        *(F.first(f"m{i}").alias(f"m{i}") for i in range(p)),
        *(F.greatest(1.4826 * F.percentile_approx(F.abs(F.col(a) - F.col(f"m{i}")), 0.5, 10000), F.lit(FLOORS[a])).alias(f"l{i}{i}") for i, a in enumerate(AXES)),
    )
    spread = kept_rows(spread)
    discard(medians)
    zero = [F.lit(0.0).alias(f"l{i}{k}") for i in range(p) for k in range(i)]
    drawn = vectors_once.join(spread, "g").select("g", *((F.col(f"m{i}") + F.col(f"l{i}{i}") * F.tanh((F.col(a) - F.col(f"m{i}")) / F.col(f"l{i}{i}"))).alias(a) for i, a in enumerate(AXES)))
    kinds = [spread.select("*", *zero, F.lit(1.0).alias("scale")), estimate(vectors_once), estimate(drawn)]
    every = reduce(DataFrame.unionByName, (kind.withColumn("start", F.lit(i)) for i, kind in enumerate(kinds)))
    return kept_rows(every.withColumn("det", F.lit(float("inf"))))


def fit(vectors_once: DataFrame, steps: int, share: float) -> DataFrame:
    """The minimum covariance determinant estimate of each group.

    Concentration steps, from each start: estimate a group from the ``share`` of its vectors nearest
    the last estimate, until no determinant falls any more (``steps`` at most). Of the starts the one
    with the least determinant wins. A last step takes all vectors inside the 97.5 % ellipse, and
    distances are scaled to the median of the chi-square distribution. Only a row per group and start
    passes from step to step.
    """
    now = first_estimates(vectors_once)
    for _ in range(steps):
        far = vectors_once.join(now.drop("det"), "g").withColumn("d", distance([F.col(a) for a in AXES])).select("g", "start", *AXES, "d")
        bound = kept_rows(far.groupBy("g", "start").agg(F.percentile_approx("d", share, 10000).alias("bound")), "bound")
        then = kept_rows(estimate(far.join(bound, ["g", "start"]).filter(F.col("d") <= F.col("bound")), "start").withColumn("det", log_det()))
        falls = then.join(now.select("g", "start", F.col("det").alias("old")), ["g", "start"]).filter(F.col("det") < F.col("old") - 1e-9)
        settled = falls.isEmpty()
        discard(now)
        discard(bound)
        now = then
        if settled:
            break
    names = [c for c in now.columns if c != "g"]
    best = kept_rows(now.groupBy("g").agg(F.min_by(F.struct(*names), F.struct(F.round("det", 9), "start")).alias("e")).select("g", "e.*").drop("det", "start"))
    far = vectors_once.join(best, "g").withColumn("d", distance([F.col(a) for a in AXES])).select("g", *AXES, "d")
    bound = kept_rows(far.groupBy("g").agg((F.percentile_approx("d", 0.5, 10000) * (INNER / MEDIAN)).alias("bound")), "bound")
    now = kept_rows(estimate(far.join(bound, "g").filter(F.col("d") <= F.col("bound"))))
    far = vectors_once.join(now, "g").withColumn("d", distance([F.col(a) for a in AXES]))
    scale = far.groupBy("g").agg(F.greatest(F.percentile_approx("d", 0.5, 10000) / MEDIAN, F.lit(1.0)).alias("scale"))
    return kept_rows(now.drop("scale").join(scale, "g"))


def shrunk(rows: DataFrame, wide: DataFrame, pools: DataFrame, least: int) -> DataFrame:
    """Estimates of small groups: n of their vectors count n, and the estimate of their pool ``least`` - n.

    A few vectors cannot tell their own outliers, so the n are those inside the 97.5 % ellipse of the pool.
    ``rows``: g and the vectors; ``pools``: g, pool.
    """
    p = len(AXES)

    def moments(rows: DataFrame, tag: str) -> DataFrame:
        cov = {(i, k): reduce(lambda a, b: a + b, (F.col(f"l{i}{j}") * F.col(f"l{k}{j}") for j in range(k + 1))) * F.col("scale") for i in range(p) for k in range(i + 1)}
        return rows.select(F.col("g").alias(f"{tag}g"), *(F.col(f"m{i}").alias(f"{tag}m{i}") for i in range(p)), *(c.alias(f"{tag}c{i}{k}") for (i, k), c in cov.items()))

    far = rows.join(pools, "g").join(wide.withColumnRenamed("g", "pool"), "pool").withColumn("d", distance([F.col(x) for x in AXES]))
    inside = far.filter(F.col("d") <= INNER).select("g", *AXES)
    own = moments(estimate(inside), "o").join(inside.groupBy(F.col("g").alias("og")).agg(F.count("*").alias("n")), "og")
    both = pools.join(own, pools["g"] == F.col("og"), "left").join(moments(wide, "w"), F.col("pool") == F.col("wg"))
    a = F.coalesce("n", F.lit(0)) / F.lit(float(least))
    names = [*(f"m{i}" for i in range(p)), *(f"c{i}{k}" for i in range(p) for k in range(i + 1))]
    return factored(both.select("g", *((a * F.coalesce(f"o{x}", F.lit(0.0)) + (1 - a) * F.col(f"w{x}")).alias(x) for x in names)))


def quality(
    docs: DataFrame,
    cut: float = CUT,
    share: float = 0.75,
    steps: int = 12,
    least: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    A document fails the base rules with under 20 words, or if windows of 8 words found twice or more
    cover over 30 % of its words. Of those that pass, each (language, source) group has its location
    and scatter estimated by minimum covariance determinant, and a document is kept unless its squared
    Mahalanobis distance passes ``cut``. Equal vectors count once in the estimates, so a large group
    of copies cannot take them over. The estimate of a group of fewer than ``least`` different vectors
    is shrunk towards that of its whole language, or of all documents where the language has fewer
    too; so every group is judged, at any size. A corpus of fewer is estimated by groups alone.

    Null languages and sources are groups of their own; null and empty texts have no words and fail;
    null doc_ids stay null; repeated rows are judged each; an empty table gives no rows; other columns
    are not read; texts are whole, however long. No Python runs on the executors.
    """
    stats = materialize(vectors(statistics(docs, id_col, text_col)).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "statistics")
    once = stats.filter("not base_failed").select("lang", "source", *AXES).distinct()
    sizes = once.groupBy("lang", "source").count()
    of_lang, total = sizes.groupBy(F.col("lang").alias("_lang")).agg(F.sum("count").alias("of_lang")), sizes.agg(F.sum("count").alias("total"))
    sized = sizes.join(of_lang, sizes["lang"].eqNullSafe(F.col("_lang")), "left").crossJoin(total)
    pool = F.when(F.col("count") < least, F.when(F.col("of_lang") >= least, F.concat(F.lit("l"), code_of(F.col("lang")))).when(F.col("total") >= least, F.lit("a")))
    groups = kept_rows(sized.select("lang", "source", F.concat_ws("\x01", code_of(F.col("lang")), code_of(F.col("source"))).alias("g"), "count", pool.alias("pool")), "groups")
    names = groups.select("lang", "source", "g")
    pools = groups.filter("pool is not null").select("g", "pool")

    def grouped(rows: DataFrame, how: str, names: DataFrame = names) -> DataFrame:
        return rows.join(names.withColumnsRenamed({"lang": "_lang", "source": "_source"}), rows["lang"].eqNullSafe(F.col("_lang")) & rows["source"].eqNullSafe(F.col("_source")), how).drop("_lang", "_source")

    # The vectors of every group, and again of each pool that a small group is shrunk towards: one fit for all.
    lang_pool = groups.filter("pool != 'a'").select(F.col("lang").alias("_lang"), "pool").distinct()
    by_lang = groups.select("lang", "source").join(lang_pool, F.col("lang").eqNullSafe(F.col("_lang"))).select("lang", "source", F.col("pool").alias("g"))
    by_all = groups.select("lang", "source").join(groups.filter("pool = 'a'").select("pool").distinct()).select("lang", "source", F.col("pool").alias("g"))
    levels = kept_rows(names.unionByName(by_lang).unionByName(by_all), "levels")
    vectors_once = materialize(grouped(once, "inner", levels).select("g", *AXES), "vectors")
    estimates = fit(vectors_once, steps, share)
    small = shrunk(vectors_once.join(pools.select("g"), "g", "left_semi"), estimates, pools, least)
    estimates = kept_rows(estimates.join(pools.select("g"), "g", "left_anti").unionByName(small))
    far = grouped(stats, "left").join(estimates, "g", "left").withColumn("distance", F.when(~F.col("base_failed"), distance([F.col(a) for a in AXES])))
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cut)).alias("kept"), "distance",
    )


def code_of(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column), F.lit("0"))


def oracle_sql(cut: float = CUT, share: float = 0.75, steps: int = 12, least: int = 20) -> str:
    """The same verdicts in DuckDB SQL, with exact order statistics (as ``percentile_approx`` gives for groups under its accuracy)."""
    p = len(AXES)
    pairs = [(i, k) for i in range(p) for k in range(i + 1)]
    axes, means = ", ".join(AXES), ", ".join(f"m{i}" for i in range(p))
    factors = ", ".join(f"l{i}{k}" for i, k in pairs)
    at = lambda x, q: f"list_sort(list({x}))[greatest(ceil({q} * count(*)), 1)::BIGINT]"

    def far(source: str, estimates: str) -> str:
        parts, names = [], []
        for i, a in enumerate(AXES):
            rest = f"({a} - m{i})" + "".join(f" - l{i}{k} * {names[k]}" for k in range(i))
            parts.append(f"({rest}) / l{i}{i} AS y{i}")
            names.append(f"y{i}")
        inner = f"SELECT v.*, e.* EXCLUDE (g) FROM {source} v JOIN {estimates} e ON v.g = e.g"
        for part in parts:
            inner = f"SELECT *, {part} FROM ({inner})"
        return f"SELECT *, ({' + '.join(f'y{i} * y{i}' for i in range(p))}) / scale AS d FROM ({inner})"

    def factored(sql: str, keys: str) -> str:
        for i, k in sorted(pairs, key=lambda q: (q[1], q[0])):
            rest = f"c{i}{k}" + "".join(f" - l{i}{j} * l{k}{j}" for j in range(k))
            sql = f"SELECT *, {f'sqrt(greatest({rest}, 1e-12))' if i == k else f'({rest}) / l{k}{k}'} AS l{i}{k} FROM ({sql})"
        return f"SELECT {keys}, {means}, {factors}, 1.0::DOUBLE AS scale FROM ({sql})"

    def estimates(rows: str, keys: str = "g") -> str:
        sums = ", ".join([*(f"avg({a}) AS m{i}" for i, a in enumerate(AXES)), *(f"covar_pop({AXES[i]}, {AXES[k]})" + (f" + {FLOORS[AXES[i]] ** 2!r}" if i == k else "") + f" AS c{i}{k}" for i, k in pairs)])
        return factored(f"SELECT {keys}, {sums} FROM {rows} GROUP BY {keys}", keys)

    spread = ", ".join(f"greatest(1.4826 * {at(f'abs({a} - m{i})', 0.5)}, {FLOORS[a]}) AS l{i}{i}" for i, a in enumerate(AXES))
    zero = ", ".join(f"0.0::DOUBLE AS l{i}{k}" for i in range(p) for k in range(i))
    columns = f"g, start, {means}, {factors}, scale"
    drawn = ", ".join(f"m{i} + l{i}{i} * tanh(({a} - m{i}) / l{i}{i}) AS {a}" for i, a in enumerate(AXES))
    code = lambda x: f"coalesce('=' || {x}, '0')"
    out = [
        "w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents)",
        "win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 6, 1)::BIGINT)) AS i FROM w))",
        "rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM win) WHERE n > 1)",
        "cov AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY 1)",
        "s AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,"
        " list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id)",
        "t AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM s)",
        "x AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, ln((word_chars + 1) / (n_words + 1)) AS x1, sqrt(n_symbols / greatest(word_chars, 1)) AS x2,"
        " sqrt(n_dup_lines / greatest(n_lines, 1)) AS x3, sqrt(n_repeat_words / greatest(n_words, 1)) AS x4 FROM t)",
        f"once AS (SELECT DISTINCT lang, source, {axes} FROM x WHERE NOT base_failed)",
        "sizes AS (SELECT lang, source, count(*) AS n FROM once GROUP BY 1, 2)",
        f"grp AS MATERIALIZED (SELECT lang, source, {code('lang')} || chr(1) || {code('source')} AS g, n, CASE WHEN n < {least} THEN CASE WHEN sum(n) OVER (PARTITION BY lang) >= {least} THEN 'l' || {code('lang')} WHEN sum(n) OVER () >= {least} THEN 'a' END END AS pool FROM sizes)",
        "levels AS (SELECT lang, source, g FROM grp UNION ALL SELECT a.lang, a.source, b.pool FROM grp a JOIN (SELECT DISTINCT lang, pool FROM grp WHERE pool <> 'a') b ON a.lang IS NOT DISTINCT FROM b.lang UNION ALL SELECT lang, source, 'a' FROM grp WHERE 'a' IN (SELECT pool FROM grp))",
        f"v AS MATERIALIZED (SELECT o.{', o.'.join(AXES)}, n.g FROM once o JOIN levels n ON o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source)",
        f"med AS (SELECT g, {', '.join(f'{at(a, 0.5)} AS m{i}' for i, a in enumerate(AXES))} FROM v GROUP BY g)",
        f"mad AS MATERIALIZED (SELECT g, {', '.join(f'min(m{i}) AS m{i}' for i in range(p))}, {spread}, {zero}, 1.0::DOUBLE AS scale FROM (SELECT v.*, {means} FROM v JOIN med ON v.g = med.g) GROUP BY g)",
        f"drawn AS (SELECT v.g, {drawn} FROM v JOIN mad ON v.g = mad.g)",
        f"e0 AS MATERIALIZED (SELECT {columns} FROM (SELECT *, 0 AS start FROM mad) UNION ALL SELECT {columns} FROM (SELECT *, 1 AS start FROM ({estimates('v')})) UNION ALL SELECT {columns} FROM (SELECT *, 2 AS start FROM ({estimates('drawn')})))",
    ]
    for step in range(steps):
        out += [
            f"f{step} AS MATERIALIZED ({far('v', f'e{step}')})",
            f"b{step} AS (SELECT g, start, {at('d', share)} AS bound FROM f{step} GROUP BY g, start)",
            f"i{step} AS (SELECT f.g, f.start, {', '.join(f'f.{a}' for a in AXES)} FROM f{step} f JOIN b{step} b ON f.g = b.g AND f.start = b.start WHERE f.d <= b.bound)",
            f"e{step + 1} AS MATERIALIZED ({estimates(f'i{step}', 'g, start')})",
        ]
    det = " + ".join(f"2 * ln(l{i}{i})" for i in range(p))
    moments = [f"m{i}" for i in range(p)] + [f"c{i}{k}" for i, k in pairs]
    back = ", ".join([means, *("(" + " + ".join(f"l{i}{j} * l{k}{j}" for j in range(k + 1)) + f") * scale AS c{i}{k}" for i, k in pairs)])
    mixed = ", ".join(f"a * coalesce(o.{x}, 0) + (1 - a) * w.{x} AS {x}" for x in moments)
    out += [
        f"best AS MATERIALIZED (SELECT * EXCLUDE (start, r) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round({det}, 9), start) AS r FROM e{steps}) WHERE r = 1)",
        f"fl AS MATERIALIZED ({far('v', 'best')})",
        f"bl AS (SELECT g, {at('d', 0.5)} * {INNER / MEDIAN!r} AS bound FROM fl GROUP BY g)",
        f"il AS (SELECT f.g, {', '.join(f'f.{a}' for a in AXES)} FROM fl f JOIN bl b ON f.g = b.g WHERE f.d <= b.bound)",
        f"last AS MATERIALIZED ({estimates('il')})",
        f"sc AS (SELECT g, greatest({at('d', 0.5)} / {MEDIAN}, 1.0) AS scale FROM ({far('v', 'last')}) GROUP BY g)",
        "own AS MATERIALIZED (SELECT z.* EXCLUDE (scale), sc.scale FROM last z JOIN sc ON z.g = sc.g)",
        # Small groups: their vectors inside their pool's ellipse, mixed with the pool's moments.
        f"vp AS (SELECT v.g AS small, {', '.join(f'v.{a}' for a in AXES)}, grp.pool AS g FROM v JOIN grp ON v.g = grp.g WHERE grp.pool IS NOT NULL)",
        f"inside AS MATERIALIZED (SELECT small AS g, {axes} FROM ({far('vp', 'own')}) WHERE d <= {INNER})",
        f"om AS (SELECT g, {back} FROM ({estimates('inside')}))",
        f"wm AS (SELECT g, {back} FROM own)",
        "cnt AS (SELECT g, count(*) AS n FROM inside GROUP BY 1)",
        f"small AS ({factored(f'SELECT grp.g, {mixed} FROM (SELECT grp.g, grp.pool, coalesce(cnt.n, 0) / {float(least)!r} AS a FROM grp LEFT JOIN cnt ON cnt.g = grp.g WHERE pool IS NOT NULL) grp LEFT JOIN om o ON o.g = grp.g JOIN wm w ON w.g = grp.pool', 'g')})",
        f"e AS MATERIALIZED (SELECT g, {means}, {factors}, scale FROM own WHERE g NOT IN (SELECT g FROM grp WHERE pool IS NOT NULL) UNION ALL SELECT g, {means}, {factors}, scale FROM small)",
        "y AS (SELECT x.*, grp.g FROM x LEFT JOIN grp ON x.lang IS NOT DISTINCT FROM grp.lang AND x.source IS NOT DISTINCT FROM grp.source)",
        f"far AS (SELECT doc_id, d FROM ({far('y', 'e')}))",
    ]
    return "WITH " + ",\n".join(out) + f"\nSELECT x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(far.d, 0) <= {cut} AS kept FROM x LEFT JOIN far ON far.doc_id = x.doc_id"
