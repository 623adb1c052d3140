"""URL filter: one trie over reversed host labels and then path segments, longest match first.

A rule is ``(host, path, verdict)``. It fits its host and every subdomain when the url's path
starts with the rule's path. Where allow and block entries both fit, the longest wins: the one
with more host labels, then the one with the longer path. Urls that no rule fits get the default.

Defined results for odd input: a null url, or one without ``://``, has an empty host and path and
gets the default; an empty table gives an empty result; repeated rows are judged one by one; of
two rules with the same host and path the block entry stays; rules with a null fit nothing; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Up to so many rules the trie goes to every executor; beyond, rules are joined by host suffix.
MAX_TRIE_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


class UrlTrie:
    """Host nodes hold the next label to the left and a path trie of whole segments."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {"hosts": {}, "paths": None}
        for host, path, verdict in sorted((r for r in rules if None not in r), key=lambda r: r[2]):
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node["hosts"].setdefault(label, {"hosts": {}, "paths": None})
            if node["paths"] is None:
                node["paths"] = {"next": {}, "ends": {}, "sizes": []}
            at = node["paths"]
            *whole, rest = path.split("/")
            for segment in whole:
                at = at["next"].setdefault(segment, {"next": {}, "ends": {}, "sizes": []})
            # 'ends': beginnings of the segment that follows; "" fits whatever follows
            at["ends"][rest] = (host + path, verdict)
            if len(rest) not in at["sizes"]:
                at["sizes"] = sorted([*at["sizes"], len(rest)], reverse=True)

    @staticmethod
    def _longest(paths: dict, path: str):
        best, at, segments = None, paths, path.split("/")
        for k, segment in enumerate(segments):
            for n in at["sizes"]:
                if segment[:n] in at["ends"] and len(segment) >= n:
                    best = at["ends"][segment[:n]]
                    break
            at = at["next"].get(segment)
            if at is None or k == len(segments) - 1:
                return best
        return best

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        if node["paths"] is not None:
            best = self._longest(node["paths"], path)
        for label in reversed(host.split(".")) if host else ():
            node = node["hosts"].get(label)
            if node is None:
                break
            if node["paths"] is not None:
                best = self._longest(node["paths"], path) or best
        return best


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    at = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(at, PARTS, 1), UPPER, LOWER),
        "path": F.regexp_extract(at, PARTS, 2),
    })


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", key: str = "page_id", max_trie_rules: int = MAX_TRIE_RULES) -> DataFrame:
    """``key, host, path, rule, verdict`` for each row of ``pages``.

    A DataFrame of rules (host, path, verdict) is counted first; up to ``max_trie_rules`` it becomes
    a broadcast trie, beyond that :func:`judge_by_join` does the same work with shuffles.
    """
    if isinstance(rules, DataFrame):
        some = rules.select("host", "path", "verdict").limit(max_trie_rules + 1).collect()
        if len(some) > max_trie_rules:
            return judge_by_join(pages, rules, default, key)
        rules = [tuple(r) for r in some]
    elif len(rules) > max_trie_rules:
        frame = pages.sparkSession.createDataFrame(rules, "host string, path string, verdict string")
        return judge_by_join(pages, frame, default, key)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    def look_up(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for host, path in parts:
            found = [find(h, p) or (None, default) for h, p in zip(host, path)]
            yield pd.DataFrame(found, columns=["rule", "verdict"], dtype=object)

    udf = F.pandas_udf(look_up, "rule string, verdict string")
    return (
        with_parts(pages.select(F.col(f"`{key}`"), F.col("`url`")))
        .withColumn("found", udf("host", "path"))
        .select(F.col(f"`{key}`"), "host", "path", "found.rule", "found.verdict")
    )


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id") -> DataFrame:
    """The same for rule lists too large to broadcast: distinct (host, path) pairs meet rules by host suffix."""
    asked = with_parts(pages.select(F.col(f"`{key}`"), F.col("`url`")))
    labels = F.split("host", r"\.")
    suffixes = F.concat(
        F.array(F.lit("")),
        F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
        ),
    )
    each = rules.dropna(subset=["host", "path", "verdict"]).groupBy(F.col("host").alias("r_host"), F.col("path").alias("r_path")).agg(F.max("verdict").alias("r_verdict"))
    best = (
        asked.select("host", "path").distinct()
        .withColumn("r_host", F.explode(suffixes))
        .join(each, "r_host")
        .where(F.expr("startswith(path, r_path)"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("r_host").alias("a"), F.length("r_path").alias("b"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("m"))
        .select("host", "path", "m.rule", "m.verdict")
    )
    return asked.join(best, ["host", "path"], "left").select(
        F.col(f"`{key}`"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
