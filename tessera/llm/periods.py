"""Periodic runs of words by maximal pairs.

A maximal pair is two places whose common words can be extended neither to the
left nor to the right.  Two equal stretches of ``L`` words at a distance ``d``
with ``L >= (power - 1) * d`` overlap into a stretch of ``L + d`` words of period
``d``, and the pair being maximal, no neighbouring word extends it.  So the
maximal pairs that meet this bound are the runs, each once for its period and
once for every multiple of it that still fits; the least one counts.

Pairs come from the LCP-interval tree of the suffixes, bottom up: where two
children of an interval meet, a suffix of the smaller one looks for partners in
the classes of other left words of the larger one.  Occurrences of a stretch
within ``L / (power - 1)`` words of each other stand in one arithmetic progression,
in which only the first can have another left word and only the last another
right word; so the outermost place in reach is the only possible partner, and
each suffix asks twice an interval instead of walking through its neighbours.

All documents of an Arrow batch share one suffix order, built with numpy; only
suffixes that can be an end of a pair enter the tree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_or_empty

RUNS = "array<struct<start:long,length:long,period:long>>"
#: Two odd multipliers for hashes of word sequences; equal hashes only ever add suffixes.
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shortest_pair(least: int, power: int) -> int:
    """The fewest common words of a pair that makes a run."""
    return min(max(least - d, (power - 1) * d) for d in range(1, least + 1))


class _Places:
    """Sorted places of one tree interval, in blocks, so that adding one costs
    little whatever their number."""

    BLOCK = 1024

    def __init__(self, place: int):
        self.blocks, self.size = [[place]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, place: int) -> None:
        at = max(0, bisect_right(self.blocks, place, key=lambda b: b[0]) - 1)
        block = self.blocks[at]
        insort(block, place)
        self.size += 1
        if len(block) > self.BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]

    def first_from(self, low: int) -> int | None:
        """The smallest place at ``low`` or behind it."""
        at = max(0, bisect_right(self.blocks, low, key=lambda b: b[0]) - 1)
        block = self.blocks[at]
        i = bisect_left(block, low)
        if i < len(block):
            return block[i]
        return self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None

    def last_to(self, high: int) -> int | None:
        """The largest place at ``high`` or before it."""
        at = bisect_right(self.blocks, high, key=lambda b: b[0]) - 1
        if at < 0:
            return None
        block = self.blocks[at]
        return block[bisect_right(block, high) - 1]


def maximal_pairs(order: list[int], lcp: list[int], left: dict[int, int], least: int, power: int) -> list[tuple[int, int, int]]:
    """``(place, words in common, distance)`` of the maximal pairs that make runs.

    ``order`` are places in suffix order, ``lcp[i]`` the words that place i has in
    common with place i - 1, and ``left`` the class of the word before each place.
    """
    found, shortest = [], shortest_pair(least, power)

    def meet(one: _Places, other: _Places, common: int) -> _Places:
        """Pairs with one end in each, then both as one, the smaller added to the larger."""
        large, small = (one, other) if one.size >= other.size else (other, one)
        reach = common // (power - 1)
        for x in small:
            first = large.first_from(x - reach)
            if first is not None and first < x and left[first] != left[x] and common + x - first >= least:
                found.append((first, common, x - first))
            last = large.last_to(x + reach)
            if last is not None and last > x and left[last] != left[x] and common + last - x >= least:
                found.append((x, common, last - x))
        for x in small:
            large.add(x)
        return large

    open_: list[tuple[int, _Places]] = []  # intervals around the current place, by words in common
    now: _Places | None = None
    for place, common in zip([*order, -1], [*lcp, 0]):
        while open_ and open_[-1][0] > common:
            words, places = open_.pop()
            now = meet(places, now, words)
        if common < shortest:
            open_.clear()
        elif open_ and open_[-1][0] == common:
            open_[-1] = common, meet(open_[-1][1], now, common)
        else:
            open_.append((common, now))
        now = _Places(place)
    return found


def _grams(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of ``width`` words from each place on (the last places are padded)."""
    out = np.zeros(len(words), np.uint64)
    padded = np.concatenate([words, -1 - np.arange(width)]).astype(np.uint64)
    for k in range(width):
        out = (out ^ padded[k : k + len(words)]) * _MIX[0]
        out ^= out >> np.uint64(29)
        out *= _MIX[1]
    return out


def _times(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    starts = np.flatnonzero(new)
    counts = np.diff(np.append(starts, len(keys)))
    out = np.empty(len(keys), np.int64)
    out[order] = np.repeat(counts, counts)
    return out


def _smaller(keys: np.ndarray) -> np.ndarray:
    """For each key how many of all are smaller."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    return out


def _levels(words: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... words from each place, until all differ.
    Every place must have a word behind it, or be one, that occurs once."""
    n, width = len(words), 1
    levels = [_smaller(words).astype(np.int32)]
    while True:
        rank = levels[-1].astype(np.int64)
        # Only places that share their rank need a finer one.
        shared = np.flatnonzero(_times(rank) > 1)
        if not len(shared):
            return levels
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - width)] = rank[width:] + 1
        mine = rank[shared]
        within = _smaller(mine * (n + 1) + behind[shared]) - _smaller(mine)
        rank[shared] = mine + within
        levels.append(rank.astype(np.int32))
        width *= 2


def _common(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the places of ``a`` and ``b`` have in common."""
    a, b, out = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    n = len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n)
        same[same] = levels[k][a[same]] == levels[k][b[same]]
        out[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return out


def runs_of(words: np.ndarray, docs: np.ndarray, least: int = 6, power: int = 4) -> np.ndarray:
    """Rows ``start, length, period`` of all runs of a sequence of word numbers,
    sorted; ``docs`` tells each word's document, and no run crosses documents."""
    none = np.zeros((0, 3), np.int64)
    shortest = shortest_pair(least, power)
    if len(words) < least:
        return none
    # A word of its own ends each document.
    ends = np.flatnonzero(np.diff(docs)) + 1
    symbol = words.astype(np.int64) + 1
    text = np.insert(symbol, ends, -1 - np.arange(len(ends)))
    text = np.concatenate([[-2 - len(ends)], text, [-1 - len(ends)]])
    place = np.insert(np.arange(len(words)), ends, -1)
    place = np.concatenate([[-1], place, [-1]])
    doc = np.concatenate([[-1], np.insert(docs, ends, -1), [-1]]).astype(np.int64)
    gram = _grams(text, shortest) ^ (doc.astype(np.uint64) * _MIX[1])
    times = _times(gram)
    # An end of a pair has a stretch that occurs again in its document, and not always after the same word.
    with_left = (gram ^ (np.concatenate([[0], text[:-1]]).astype(np.uint64) * _MIX[0])) * _MIX[1]
    wanted = (times > 1) & (place >= 0)
    if not wanted.any():
        return none
    ends_of_pairs = wanted & (_times(with_left) < times)
    # Words of such stretches, each block of neighbours ended by a word of its own.
    cover = np.zeros(len(text) + 1, np.int64)
    starts = np.flatnonzero(wanted)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + shortest, len(text)), -1)
    kept = np.flatnonzero((np.cumsum(cover[:-1]) > 0) & (place >= 0))
    gaps = np.flatnonzero(np.diff(kept) > 1) + 1
    lone = -len(text) - 3 - np.arange(len(gaps) + 1)
    # The document is part of a word, so that documents have separate trees.
    block = doc[kept] * (int(symbol.max()) + 1) + text[kept]
    reduced = np.append(np.insert(block, gaps, lone[:-1]), lone[-1])
    origin = np.append(np.insert(kept, gaps, -1), -1)
    levels = _levels(reduced)
    chosen = np.flatnonzero((origin >= 0) & ends_of_pairs[origin])
    order = chosen[np.argsort(levels[-1][chosen], kind="stable")]
    lcp = np.concatenate([[0], _common(levels, order[:-1], order[1:])])[: len(order)]
    # Suffixes that share too few words with both neighbours are in no pair.
    near = np.maximum(lcp, np.append(lcp, 0)[1:]) >= shortest
    places, lcp = origin[order[near]], lcp[near]
    left = dict(zip(places.tolist(), text[places - 1].tolist()))
    pairs = maximal_pairs(places.tolist(), lcp.tolist(), left, least, power)
    if not pairs:
        return none
    found = np.array([(place[i], common + d, d) for i, common, d in pairs], np.int64)
    # Multiples of a run's period come behind it.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    found = found[np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(axis=1)])]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Words that are in no run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) == 0


def periodic_runs(docs: DataFrame, least: int = 6, power: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, runs, collapsed`` of every row of ``docs``.

    ``runs`` are all stretches of words with smallest period ``period`` and at least
    ``least`` words and ``power`` periods that no neighbouring word extends, by start,
    then period.  ``collapsed`` is the text with each run cut to its first period:
    the words in no run behind its first period, joined by one space.  Words are what
    ASCII blanks separate.

    Null and empty texts have no runs and collapse to an empty text.  Repeated rows,
    repeated and null ids give a row each; an empty table gives an empty one; other
    columns, whatever their names, are not read.  Whole texts are taken; the memory of
    a task is some hundred bytes for each word of a batch (or of one longer text).
    """
    if power < 3 or least < power:
        raise ValueError("runs need a power of three or more and at least so many words")

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            sizes = np.array([len(t) for t in texts], np.int64)
            flat = pa.array([w for t in texts for w in t], pa.binary())
            words = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            found = runs_of(words, np.repeat(np.arange(len(texts)), sizes), least, power)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            first = np.searchsorted(found[:, 0], begins)
            runs, collapsed = [], []
            for i, text in enumerate(texts):
                own = found[first[i] : first[i + 1]] - [begins[i], 0, 0]
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own.tolist()])
                collapsed.append(b" ".join(compress(text, _kept_words(len(text), own)) if len(own) else text).decode())
            yield {"doc_id": batch.column("doc_id"), "runs": runs, "collapsed": collapsed}

        return work

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(given, make, f"doc_id long, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with runs of known place in a tenth of the texts, by a rule on the id:
    with ``h`` the CRC-32 of the decimal id and ``g = h div 10``, where ``h % 10 = 0`` each
    word i of n from ``a = g % n`` on becomes word ``a + (i - a) % p`` with
    ``p = 1 + (n - a) div (3 + g % 8)``.  Null ids and texts without words stay."""
    word = r"[^\\x20\\x09-\\x0D]"
    hashed = f"crc32(cast(`{id_col}` as string))"
    # Each transform of an array of one names values, so that none is computed twice.
    made = f"""transform(array(named_struct('w', regexp_extract_all(`{text_col}`, '{word}+', 0), 'g', {hashed} div 10)), s ->
        transform(array(named_struct('w', s.w, 'g', s.g, 'a', s.g % size(s.w))), t ->
        transform(array(named_struct('w', t.w, 'a', t.a, 'p', 1 + (size(t.w) - t.a) div (3 + t.g % 8))), v ->
        array_join(transform(v.w, (x, i) -> if(i < v.a, x, v.w[cast(v.a + (i - v.a) % v.p as int)])), ' '))[0])[0])[0]"""
    chosen = F.expr(f"{hashed} % 10 = 0 and `{text_col}` rlike '{word}'")
    return docs.withColumn(text_col, F.when(chosen, F.expr(made)).otherwise(F.col(text_col)))
