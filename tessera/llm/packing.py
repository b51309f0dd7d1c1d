"""Best-two-fit packing of token pieces into sequences.

Only lengths matter for packing, and there are at most ``capacity`` of them.
So Spark counts the pieces of each length, the driver plans on those counts
(never more numbers than ``capacity``) and gets patterns with multiplicities,
and every piece finds its place from its rank among pieces of its length.
Ranks come from windows over (length, salt) cells with running offsets, so a
very common length is dealt over many tasks.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from tokenizers import Tokenizer

from .common import arrow_map, text_or_empty, written

CAPACITY = 1024
END_ID = 2
CELL_ROWS = 20_000  # most pieces of one length that a window sorts at once, about
SALTS = 1 << 16
CACHED = 200_000  # distinct words whose ids a worker keeps
#: Fixed value: how byte-level BPE splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class _Irregular(Exception):
    """A part that cannot be encoded apart from its neighbours."""


class _Words(dict):
    """Ids of ``" " + word`` as little-endian bytes, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Irregular
        if len(self) >= CACHED:
            self.clear()
        ids = self[word] = np.array(self.encode(" " + word), "<u4").tobytes()
        return ids


class ByteBpe:
    """Ids of a byte-level BPE vocabulary file, as little-endian bytes.

    A split of the text always begins at a space before a non-space, so words
    between single spaces are encoded apart and remembered.  Texts with special
    tokens go through the tokenizer itself.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        if any(vocab["".join(pair)] != 256 + i for i, pair in enumerate(pairs)):
            raise ValueError("ids do not follow the order of the merges")
        self.whole = Tokenizer.from_file(path)
        self.encode = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = _Words(self.encode)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        try:
            return np.array(self.encode(first), "<u4").tobytes() + b"".join(map(self.words.__getitem__, rest))
        except _Irregular:
            return np.array(self.encode(text), "<u4").tobytes()


_LOADED: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a file, one for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: the ids of each text and
    ``end_id``; more than ``capacity`` ids are cut into full pieces, the first
    of which takes the remainder.  A null or empty text is ``[end_id]``."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        coder = tokenizer(tokenizer_path)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            ids, out = batch.column("doc_id").to_pylist(), defaultdict(list)
            for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                packed = coder.ids(text) + end
                n, at, k = len(packed) // 4, 0, 0
                size = (n - 1) % capacity + 1
                while at < n:
                    for name, value in (("doc_id", doc_id), ("piece", k), ("start", at), ("length", size), ("ids_crc32", zlib.crc32(packed[4 * at : 4 * (at + size)]))):
                        out[name].append(value)
                    at, k, size = at + size, k + 1, capacity
            yield out

        return work

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return arrow_map(given, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, how often)`` that use up ``counts[length]`` pieces.

    Each pattern is filled greedily with the longest piece that fits; then its
    shortest piece is replaced by two others if they fit the gap that this
    opens more tightly.  A pattern is repeated until a length runs short, so
    their number depends on the capacity and not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    capacity, plan = len(left) - 1, []
    spare = np.arange(capacity + 1)
    while left.any():
        now = left.copy()
        bin_: list[int] = []
        gap = capacity
        while True:
            fits = np.flatnonzero(now[: gap + 1])
            if not len(fits):
                break
            bin_.append(int(fits[-1]))
            now[fits[-1]] -= 1
            gap -= bin_[-1]
        if gap and len(bin_) > 1:
            room = gap + bin_[-1]
            below = np.maximum.accumulate(np.where(now > 0, spare, 0))  # longest piece up to here
            one = np.flatnonzero(now[: room + 1])
            two = below[np.minimum(one, room - one)]
            two = np.where((two == one) & (now[one] < 2), np.where(one > 0, below[one - 1], 0), two)
            sums = np.where(two > 0, one + two, 0)
            if len(sums) and sums.max() > bin_[-1]:
                k = int(sums.argmax())
                bin_[-1:] = [int(one[k]), int(two[k])]
        used = np.bincount(bin_, minlength=capacity + 1)
        times = int((left[used > 0] // used[used > 0]).min())
        left -= times * used
        plan.append((bin_, times))
    return plan


@dataclass
class Places:
    """For each length: the first rank of each pattern's share, that pattern's
    first sequence, and the offsets of the length's copies in it."""

    lows: dict[int, np.ndarray]
    bases: dict[int, np.ndarray]
    offsets: dict[int, list[list[int]]]

    @classmethod
    def of(cls, plan: list[tuple[list[int], int]]) -> Places:
        lows, bases, offsets = defaultdict(list), defaultdict(list), defaultdict(list)
        used: dict[int, int] = defaultdict(int)
        base = 0
        for lengths, times in plan:
            at, own = 0, defaultdict(list)
            for n in lengths:
                own[n].append(at)
                at += n
            for n, offs in own.items():
                lows[n].append(used[n])
                bases[n].append(base)
                offsets[n].append(offs)
                used[n] += times * len(offs)
            base += times
        return cls({n: np.array(x) for n, x in lows.items()}, {n: np.array(x) for n, x in bases.items()}, dict(offsets))

    def place(self, length: int, rank: int) -> tuple[int, int]:
        k = int(np.searchsorted(self.lows[length], rank, "right")) - 1
        offs = self.offsets[length][k]
        nth, copy = divmod(rank - int(self.lows[length][k]), len(offs))
        return int(self.bases[length][k]) + nth, offs[copy]


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows of ``pieces``; read twice."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    places = Places.of(best_two_fit(counts))
    # Half a partition's share at most, so that a common length is not one task's work.
    share = counts.sum() // (2 * int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1
    salts = min(SALTS, int(counts.max() // min(CELL_ROWS, share)) + 1)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    cells = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(cells, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            found = [places.place(n, r) for n, r in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist())]
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield out | {"sequence_id": [f[0] for f in found], "offset": [f[1] for f in found]}

        return work

    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return arrow_map(chosen, make, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its place: sequences hold at most ``capacity`` ids
    and have no gaps.  Rows with equal or null ids are packed like any other."""
    return pack(written(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces"), capacity)
