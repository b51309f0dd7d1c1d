"""Secret scan: all rules in one deterministic automaton over bytes.

The automaton (see ``automaton``) passes once over all bytes of a batch for
all rules and tells which rules match in which texts.  Only these texts are
read again, from their ends, by the automaton of the mirrored rules: it accepts
where matches start.  From the leftmost start the rule's own anchored automaton
gives the longest match, then the search goes on behind it.
"""

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules
from .common import arrow_map, small_batches, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` gives leftmost, longest, non-overlapping spans; those with
    fewer than ``least`` bytes after their longest ``head`` are dropped after
    they are matched.  Patterns are of ASCII; ``fold`` ignores its case."""

    kind: str
    pattern: str
    head: str = ""
    least: int = 0
    fold: bool = False


_KEY = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: Fixed rules of the contract, then those that are added.
BASE = (
    Rule("assign", _KEY + r"([A-Za-z0-9+/_.=-]+)", head=_KEY, least=6, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + ADDED


@dataclass(frozen=True)
class Machines:
    """``ends`` searches for all rules, ``starts`` backwards; each rule has its
    anchored automaton and that of its head."""

    ends: Automaton
    starts: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton | None, ...]


@lru_cache(maxsize=8)
def combined(rules: tuple[Rule, ...]) -> Machines:
    pairs = [(r.pattern, r.fold) for r in rules]
    whole = tuple(compile_rules([p], anchored=True) for p in pairs)
    heads = tuple(compile_rules([(r.head, r.fold)], anchored=True) if r.head else None for r in rules)
    return Machines(compile_rules(pairs), compile_rules(pairs, backwards=True), whole, heads)


def _spans(text: bytes, firsts: list[int], lasts: list[int], rule: Rule, whole: Automaton, head: Automaton | None) -> Iterator[tuple[int, int]]:
    """Byte spans of one rule, which matches from every place of the stretches from ``firsts``
    to ``lasts`` and from no other."""
    at = 0
    while (i := bisect_left(lasts, at)) < len(lasts):
        start = max(at, firsts[i])
        at = whole.longest(text, start)
        value = head.longest(text[start : at - 1], 0) if head else 0
        if at - start - value >= rule.least:
            yield start, at


def _stretches(text: bytes, machine: Automaton, rules: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each rule the first and the last place of each stretch of places where it starts to
    match.  In a long run of hexadecimal digits nearly every place does: they are one stretch."""
    held: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(rules)]
    for places, bits in machine.segments(text[::-1]):
        for k in range(rules):
            own = places[bits >> k & 1 == 1]
            if len(own):
                cuts = np.flatnonzero(np.diff(own) > 1)
                held[k].append((own[np.append(0, cuts + 1)], own[np.append(cuts, len(own) - 1)]))
    out = []
    for parts in held:
        first, last = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        # A stretch that a segment's end cuts is one.
        new = np.append(True, first[1:] > last[:-1] + 1)[: len(first)]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:] - 1, len(first) - 1)[: len(begin)]
        out.append((len(text) - 1 - last[end][::-1], len(text) - 1 - first[begin][::-1]))
    return out


def _finder(rules: tuple[Rule, ...], machines: Machines):
    def find(texts: list[bytes]) -> list[list[tuple[str, int, int]]]:
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        begins, hit = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]), set()
        for ends, _ in machines.ends.segments(b"\n".join(texts)):
            hit.update((np.unique(np.searchsorted(begins, ends, "right")) - 1).tolist())
        if not hit:
            return found
        order = sorted(hit)
        some = [texts[i] for i in order]
        stretches = _stretches(b"\n".join(some), machines.starts, len(rules))
        begins = np.cumsum([0, *(len(t) + 1 for t in some)])
        for i, text in enumerate(some):
            hits = []
            for k, (first, last) in enumerate(stretches):
                lo, hi = np.searchsorted(first, begins[i : i + 2])
                if hi > lo:
                    own = _spans(text, (first[lo:hi] - begins[i]).tolist(), (last[lo:hi] - begins[i]).tolist(), rules[k], machines.whole[k], machines.heads[k])
                    hits += [(a, k, b) for a, b in own]
            # Code points: bytes that do not continue one.
            point = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, dtype=np.int32) if not text.isascii() else None
            at = (lambda x: int(point[x - 1]) if x else 0) if point is not None else int
            found[order[i]] = [(rules[k].kind, at(a), at(b)) for a, k, b in sorted(hits)]
        return found

    return find


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row, spans an array of ``kind, start, end`` (code
    points) by start, then kind in the order of ``rules``.

    Null and empty texts have no spans; repeated rows and ids each give their own
    row; whole texts of any length are read, in segments, and memory grows with the
    text and its spans, not with the places where a rule could start.  Other columns, whatever
    their names, are not read.  An empty table gives an empty one.
    """
    machines = combined(rules)

    def make():
        find = _finder(rules, machines)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            spans = find(batch.column("text").cast(pa.binary()).to_pylist())
            yield {"doc_id": batch.column("doc_id"), "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in spans]}

        return work

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(given, make, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def masked(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mask``.

    All rows and columns stay; a null text stays null, and ``size_col``, where
    it is given and exists, holds the new length of changed texts.
    """

    machines = combined(rules)
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = _finder(rules, machines)
        for texts in batches:
            out = list(texts)
            at = 0
            while at < len(out):  # bounded bytes a pass
                end, size = at, 0
                while end < len(out) and (end == at or size < 8 << 20):
                    size += len(out[end] or "")
                    end += 1
                for i, spans in enumerate(find([(t or "").encode() for t in out[at:end]]), at):
                    if spans:
                        out[i] = masked(out[i], [(a, b) for _, a, b in spans], mask)
                at = end
            yield pd.Series(out, dtype=object)

    names = docs.columns
    clean = docs.withColumn(text_col, cleaned(F.col(text_col)))
    if size_col and size_col in names:
        clean = clean.withColumn(size_col, F.when(F.col(text_col).contains(mask), F.length(text_col)).otherwise(F.col(size_col)).cast(docs.schema[size_col].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in names])
