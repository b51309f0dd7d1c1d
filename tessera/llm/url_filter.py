"""Allow and block lists for URLs as one trie over reversed host labels and
path segments.

A rule is ``(host, path, verdict)``.  It fits its host and every subdomain,
when the URL's path starts with the rule's path; the longest fitting rule wins:
more host labels first, then the longer path, then ``block`` over ``allow``.
The trie is built on the driver and broadcast, so its number of rules is
bounded by ``MAX_RULES``; a longer list is refused and belongs in
``match_by_join``, which gives the same rows by equi-joins on host suffixes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

MAX_RULES = 500_000
ALLOW, BLOCK = "allow", "block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


class UrlTrie:
    """Nodes are ``[children, ends]``: children by label or segment; ends holds
    rules that stop inside the next segment as ``(rest of path, rule, verdict)``."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: list = [{}, None]
        for host, path, verdict in rules:
            node = self.root
            for label in reversed(host.lower().split(".")) if host else ():
                node = node[0].setdefault(label, [{}, None])
            # The path trie of a host hangs below a key that no label can be.
            node = node[0].setdefault("/", [{}, None])
            *whole, last = path.split("/")
            for segment in whole:
                node = node[0].setdefault(segment, [{}, None])
            node[1] = node[1] or {}
            held = node[1].get(last)
            if held is None or verdict == BLOCK:
                node[1][last] = (host + path, verdict)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        labels = host.split(".")
        while True:
            if "/" in node[0]:
                best = self._path(node[0]["/"], path) or best
            if not labels or (node := node[0].get(labels.pop())) is None:
                return best

    @staticmethod
    def _path(node: list, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for segment in segments:
            if node[1]:
                for n in range(len(segment), -1, -1):
                    if (hit := node[1].get(segment[:n])) is not None:
                        best = hit
                        break
            if (node := node[0].get(segment)) is None:
                break
        return best


def match(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row; ``rule`` is null and
    ``verdict`` is ``default`` where no rule fits.  Repeated rows give repeated
    results; an empty table gives an empty one."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a trie is broadcast up to {MAX_RULES}: use match_by_join")
    trie = pages.sparkSession.sparkContext.broadcast(UrlTrie(rules))
    host, path = parts(F.col(url_col))

    def make():
        find = trie.value.match

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hits = [find(h, p) or (None, default) for h, p in zip(hosts, paths)]
            yield {"page_id": batch.column("page_id"), "host": hosts, "path": paths, "rule": [h[0] for h in hits], "verdict": [h[1] for h in hits]}

        return work

    found = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    return arrow_map(found, make, f"page_id {found.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")


def match_by_join(pages: DataFrame, rules: DataFrame, default: str = ALLOW, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The same rows for rule tables ``(host, path, verdict)`` of any size.

    Pages are first reduced to distinct (host, path); each host is expanded to
    its suffixes (as many as it has labels) and equi-joined to the rules.
    """
    host, path = parts(F.col(url_col))
    cut = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = cut.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    rule = rules.select(F.lower("host").alias("suffix"), F.col("path").alias("rule_path"), "verdict", F.concat("host", "path").alias("rule"))
    rank = F.struct(F.length("suffix"), F.length("rule_path"), (F.col("verdict") == BLOCK).cast("int"))
    best = (
        wide.join(rule, "suffix").filter(F.col("path").startswith(F.col("rule_path")))
        .groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("hit"))
    )
    return cut.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
