"""URL filter: a trie over reversed host labels, then path segments.

A rule ``(host, path, verdict)`` fits its host and every subdomain when the
URL's path starts with the rule's path. The longest fitting rule (characters of
host and path together, then the longer host, then ``block``) gives the verdict.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A trie of more characters than this is not broadcast; the join form takes over.
MAX_BROADCAST_CHARS = 8_000_000
OUT = "host string, path string, rule string, verdict string"


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def rank(self) -> tuple:
        return len(self.text), len(self.host), self.verdict == "block", self.text


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3:]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:cut].partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


class UrlTrie:
    """Nodes are dicts: labels of the host from the right, then path segments.

    The last segment of a rule's path may be a part of the URL's segment, so it
    hangs on its parent node as a prefix to test and not as an edge.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            *whole, last = rule.path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            node.setdefault("ends", []).append((last, rule))

    def best(self, host: str, path: str) -> Rule | None:
        found: Rule | None = None
        segments = path.split("/")
        node = self.root
        for label in reversed(host.split(".")):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            at = node
            for segment in segments:
                for last, rule in at.get("ends", ()):
                    if segment.startswith(last) and (found is None or rule.rank > found.rank):
                        found = rule
                at = at.get("segments", {}).get(segment)
                if at is None:
                    break
        return found


def judge_urls(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url",
               max_broadcast_chars: int = MAX_BROADCAST_CHARS) -> DataFrame:
    """``pages`` with the columns ``host, path, rule, verdict`` (which replace
    columns of these names). Null URLs, and URLs without ``://``, have an empty
    host and path, which no rule fits; they get ``default``. Repeated rows are
    judged alike, and an empty table gives an empty one.

    The trie goes to every task while its size allows; a larger rule set is
    joined by host suffix instead, with the same result.
    """
    rules = [Rule(*r) for r in rules]
    bad = [r for r in rules if not r.host or r.verdict not in ("allow", "block")]
    if bad:
        raise ValueError(f"rules need a host and allow or block: {bad[:3]}")
    if sum(len(r.text) for r in rules) > max_broadcast_chars:
        return _judge_by_join(pages, rules, default, url)
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(OUT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tree = trie.value
        for urls in batches:
            rows = []
            for u in urls:
                host, path = split_url(u)
                rule = tree.best(host, path) if host else None
                rows.append((host, path, rule.text if rule else None, rule.verdict if rule else default))
            yield pd.DataFrame(rows, columns=["host", "path", "rule", "verdict"])

    found = judge(F.col(url).cast("string"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return pages.select(*rest, found.alias("_found")).select(*rest, "_found.*")


def _judge_by_join(pages: DataFrame, rules: list[Rule], default: str, url: str) -> DataFrame:
    """Rule sets too large to send whole: the distinct (host, path) pairs meet
    the rules on each suffix of the host; one aggregate keeps the longest."""
    spark = pages.sparkSession
    full = F.coalesce(F.col(url).cast("string"), F.lit(""))
    cut = F.regexp_extract(full, r"(?s)^.*?://([^?#]*)", 1)
    path = F.when(F.instr(cut, "/") > 0, F.expr("substring(_cut, instr(_cut, '/'))")).otherwise("")
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = (pages.select(*rest, cut.alias("_cut"))
             .withColumns({"path": path, "host": F.translate(F.substring_index("_cut", "/", 1),
                                                             "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                             "abcdefghijklmnopqrstuvwxyz")}).drop("_cut"))
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict, list(r.rank[:2])) for r in rules],
                                  "rule_host string, rule_path string, rule string, verdict string, lens array<int>")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    best = (split.select("host", "path").where("host <> ''").distinct()
            .withColumn("rule_host", F.explode(suffixes)).join(table, "rule_host")
            .where(F.expr("startswith(path, rule_path)"))
            .groupBy("host", "path")
            .agg(F.max(F.struct("lens", F.col("verdict") == "block", "rule", "verdict")).alias("top"))
            .select("host", "path", "top.rule", "top.verdict"))
    return (split.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
            .select(*rest, "host", "path", "rule", "verdict"))
