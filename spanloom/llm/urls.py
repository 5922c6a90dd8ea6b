"""URL allow and block lists, decided by the longest matching entry of a trie.

The trie has host labels from the right, then path segments; the last segment of
an entry may be a prefix of the url's ("/en/1" fits "/en/17"). It is broadcast:
`max_rules` bounds its size, and a larger list is joined instead, on the host's
suffixes. A longer host wins, then a longer path, then block before allow.

A url is matched in time linear in its length: only its first segments, as many
as the longest entry has, are taken, and prefixes up to the longest entry's.

Defined cases: columns of the input named like the result's are replaced; a null url or one without ``://`` has an empty host and path and
gets the default verdict, as does any url that no entry fits; host and path are
taken literally (ports, user names and empty labels are parts of the host); very
long urls are judged whole; equal rows are judged alike; an empty table gives an
empty table; of entries that fit as long, the block wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Rule = tuple[str, str, str]  # host, path, verdict


def url_host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nested dictionaries: host labels from the right under None, then whole path segments, then prefixes of the next one.

    "ends" are the last parts of entries, "most" the length of the longest of them.
    """

    def __init__(self, rules: list[Rule]) -> None:
        self.root: dict = {}
        self.labels = self.segments = 0
        for host, path, verdict in sorted(rules, key=lambda r: r[2] != "allow"):  # block last, so that it stays
            node, labels = self.root, host.split(".")
            for label in reversed(labels):
                node = node.setdefault(label, {})
            *whole, last = path.split("/")
            self.labels, self.segments = max(self.labels, len(labels)), max(self.segments, len(whole))
            node = node.setdefault(None, {})
            for segment in whole:
                node = node.setdefault(("/", segment), {})
            node.setdefault("ends", {})[last] = (host + path, verdict)
            node["most"] = max(node.get("most", 0), len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        hosts, node = [], self.root
        for label in reversed(host.rsplit(".", self.labels)[-self.labels :] if self.labels else []):
            node = node.get(label)
            if node is None:
                break
            if None in node:
                hosts.append(node[None])
        segments = path.split("/", self.segments + 1)
        for node in reversed(hosts):
            best = None
            for k, segment in enumerate(segments):
                ends = node.get("ends")
                for n in range(min(len(segment), node["most"]), -1, -1) if ends else ():
                    if segment[:n] in ends:
                        best = ends[segment[:n]]
                        break
                node = node.get(("/", segment)) if k + 1 < len(segments) else None
                if node is None:
                    break
            if best:
                return best
        return None


_OUT = ("host", "path", "rule", "verdict")


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow", max_rules: int = 200_000) -> DataFrame:
    """The rows of pages with host, path, rule (null if none fits) and verdict."""
    url = F.col(url_col).cast("string")
    split = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in _OUT], url_host(url).alias("host"), url_path(url).alias("path"))
    if len(rules) > max_rules:
        frame = pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, verdict string")
        return judge_by_join(split, frame, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("struct<rule: string, verdict: string>")
    def match(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = trie.value.find
        for host, path in parts:
            yield pd.DataFrame([find(h, p) or (None, default) for h, p in zip(host, path)], columns=["rule", "verdict"])

    hit = split.withColumn("__hit", match("host", "path"))
    return hit.select(*[F.col(f"`{c}`") for c in split.columns], "__hit.rule", "__hit.verdict")


def judge_by_join(split: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As judge, for lists of any size: (host, path, ...) joined to (rule_host, rule_path, verdict) on each suffix of the host."""
    urls = split.select("host", "path").distinct()  # entries meet a url's first path parts, so that few of a host's entries do
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, -n, n), ".")))
    hits = urls.withColumn("rule_host", suffix).join(rules, "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    first = F.row_number().over(W.partitionBy("host", "path").orderBy(F.desc(F.length("rule_host")), F.desc(F.length("rule_path")), F.desc("verdict")))
    best = hits.withColumn("_n", first).filter("_n = 1").select("host", "path", F.concat("rule_host", "rule_path").alias("rule"), "verdict")
    return split.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
