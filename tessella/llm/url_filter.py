"""URL filters (operator 3): a trie over reversed host labels, then path segments, broadcast to the scan.

Rules come as (verdict, "host/path") text. The longest fitting rule wins, by the length of its whole text; of
two of one length, the one of more host labels; of an allow and a block entry with the same text, block. The trie is broadcast while its
entries take at most BROADCAST_BYTES; larger lists go by a join on the host suffixes and path prefixes that
occur among the rules' lengths.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BROADCAST_BYTES = 64 << 20

RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
DEFAULT = "allow"


class Ends(dict):
    """(verdict, rule) by the start of a segment that ends a rule's path; and the lengths of those starts, longest first."""

    def __init__(self):
        self.lengths: list[int] = []

    def add(self, start: str, verdict: str, rule: str) -> None:
        if self.get(start, ("",))[0] != "block":
            self[start] = (verdict, rule)
        self.lengths = sorted({*self.lengths, len(start)}, reverse=True)

    def longest(self, segment: str) -> tuple[str, str] | None:
        return next((self[segment[:n]] for n in self.lengths if n <= len(segment) and segment[:n] in self), None)


class Trie:
    """Host labels from the right, then path segments; the end of a rule's path is a prefix of a segment."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.hosts: dict = {}
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            node = node.setdefault(None, {})  # no label is None: below it stand paths
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, Ends()).add(last, verdict, rule)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        if not path:
            return None
        node, best, segments = self.hosts, None, path.split("/")[1:]
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            found = self._below(node[None], segments) if None in node else None
            if found and (best is None or len(found[1]) >= len(best[1])):
                best = found
        return best

    @staticmethod
    def _below(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            if None in node:
                best = node[None].longest(segment) or best
            node = node.get(segment)
            if node is None:
                break
        return best


def host_of(url: Column) -> Column:
    return common.ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, default: str = DEFAULT, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without `://`, has an empty host and path, no rule and the default verdict. Ids may be
    null or repeated: each row is judged alone. Other columns are not read.
    """
    seen = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    if sum(len(rule) + 64 for _, rule in rules) > broadcast_bytes:
        return _by_join(seen, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def found(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        hits = [trie.value.find(h, p) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [x and x[1] for x in hits], "verdict": [x[0] if x else default for x in hits]}, dtype=object)

    return seen.withColumn("_found", found("host", "path")).select("page_id", "host", "path", "_found.rule", "_found.verdict")


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    kept: dict[str, str] = {}
    for verdict, rule in rules:
        kept[rule] = "block" if "block" in (verdict, kept.get(rule)) else verdict
    return spark.createDataFrame([(r, v) for r, v in kept.items()], "rule string, verdict string")


def _by_join(seen: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """The same answers for rule lists of any size: each distinct (host, path) is cut into the suffixes and prefixes that a rule could have."""
    listed = rules_table(seen.sparkSession, rules)
    depths = F.array(*[F.lit(n) for n in sorted({r.partition("/")[0].count(".") + 1 for _, r in rules})])
    lengths = F.array(*[F.lit(n) for n in sorted({len(r.partition("/")[2]) + 1 for _, r in rules})])
    labels = F.size(F.split("host", r"\."))
    urls = seen.filter(F.col("path") != "").select("host", "path").distinct()
    keys = (
        urls.withColumn("_d", F.explode(F.filter(depths, lambda d: d <= labels)))
        .withColumn("_n", F.explode(F.filter(lengths, lambda n: n <= F.length("path"))))
        .withColumn("rule", F.concat(F.expr("substring_index(host, '.', -_d)"), F.expr("substring(path, 1, _n)")))
    )
    best = keys.join(listed, "rule").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("_l"), "_d", "rule", "verdict")).alias("_best"))
    return seen.join(best, ["host", "path"], "left").select("page_id", "host", "path", "_best.rule", F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))
