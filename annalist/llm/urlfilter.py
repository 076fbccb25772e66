"""URL allow and block rules: a trie over reversed host labels and path segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import rows_out

FIELDS = {"page_id": pa.int64(), "host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string()}
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
#: (host, path, verdict); a path ends with a slash.
DEFAULT_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: At most this many rules are broadcast as a trie; more are joined.
TRIE_RULES = 200_000

Rule = tuple[str, str, str]


class Trie:
    """Nodes are dicts: host labels from the top-level domain down, then, below "/", path segments.

    A node's None entry is its rule. Walking stops at the deepest node that a url reaches; a longer
    host wins over a longer path.
    """

    def __init__(self, rules: list[Rule]):
        self.root: dict = {}
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("/", {})
            for segment in path.split("/")[1:-1]:
                node = node.setdefault(segment, {})
            kept = node.get(None)
            if kept is None or verdict == "block":  # of two equal rules, block
                node[None] = (host + path, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        segments = path.split("/")[1:-1] if path.startswith("/") else None
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get("/")
            if below is not None and segments is not None:
                best = below.get(None, best)
                for segment in segments:
                    below = below.get(segment)
                    if below is None:
                        break
                    best = below.get(None, best)
        return best


def parts(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    """(page_id, host, path) of every row; both empty for null urls and those without ``://``."""
    rest = F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def by_trie(urls: DataFrame, rules: list[Rule], default: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(Trie(rules).root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie([])
        trie.root = shared.value
        for batch in batches:
            ids, hosts, paths = (c.to_pylist() for c in batch.columns)
            found = [trie.find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield rows_out(FIELDS, {"page_id": ids, "host": hosts, "path": paths, "rule": [f[0] for f in found], "verdict": [f[1] for f in found]})

    return urls.mapInArrow(run, SCHEMA)


def by_join(urls: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same verdicts for rule tables of any size: each url's prefixes meet the rules by equality.

    Distinct (host, path) pairs are judged once, so a hot host costs one row in the join.
    """
    distinct = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    n_labels = F.size(labels)
    segments = F.split("path", "/")
    n_segments = F.when(F.col("path").startswith("/"), F.size(segments) - 1).otherwise(0)
    suffix = F.transform(F.sequence(F.lit(1), n_labels), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(labels, n_labels - n + 1, n), ".").alias("rule_host")))
    prefix = F.when(n_segments > 0, F.transform(F.sequence(F.lit(1), n_segments), lambda n: F.struct(n.alias("level"), F.concat(F.array_join(F.slice(segments, 1, n), "/"), F.lit("/")).alias("rule_path"))))
    keys = distinct.select("host", "path", F.explode(suffix).alias("h"), prefix.alias("p")).select("host", "path", "h.*", F.explode("p").alias("p")).select("host", "path", "depth", "rule_host", "p.*")
    one = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))  # block beats allow
    best = (
        keys.join(one, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), F.struct("depth", "level")).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def url_filter(
    pages: DataFrame,
    rules: list[Rule] | DataFrame | None = None,
    default: str = "allow",
    trie_rules: int = TRIE_RULES,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Verdict of every url: that of the longest rule that fits its host and path, else ``default``.

    ``rules``: (host, path, verdict) triples, or a DataFrame with these columns. Up to ``trie_rules``
    of them are broadcast as a trie; a larger table is joined instead, with the same result.

    Null urls and urls without ``://`` have empty host and path and get ``default``; null ids stay
    null; repeated rows are judged each; an empty table gives no rows; other columns are not read.
    Of equal rules with different verdicts, block counts. Rules with a null field are void; paths
    that do not end with a slash are read as if they did. Very long urls are walked like others.
    """
    urls = parts(pages, id_col, url_col)
    if isinstance(rules, DataFrame):
        table = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).na.drop()
        table = table.withColumn("rule_path", F.when(F.col("rule_path").endswith("/"), F.col("rule_path")).otherwise(F.concat("rule_path", F.lit("/"))))
        few = table.limit(trie_rules + 1).collect()
        if len(few) > trie_rules:
            return by_join(urls, table, default)
        listed = [tuple(r) for r in few]
    else:
        listed = [(h, p if p.endswith("/") else p + "/", v) for h, p, v in (DEFAULT_RULES if rules is None else rules)]
        if len(listed) > trie_rules:
            return by_join(urls, pages.sparkSession.createDataFrame(listed, "rule_host string, rule_path string, rule_verdict string"), default)
    return by_trie(urls, listed, default)


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), split AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(rule_host, rule_path, rule_verdict)
), fits AS (
  SELECT s.page_id, s.host, s.path, r.*,
         row_number() OVER (PARTITION BY s.page_id ORDER BY length(rule_host) DESC NULLS LAST, length(rule_path) DESC) AS place
  FROM split s LEFT JOIN rules r ON (s.host = rule_host OR ends_with(s.host, '.' || rule_host)) AND starts_with(s.path, rule_path)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE place = 1
"""
