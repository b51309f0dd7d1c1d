"""Removal of long repeated substrings by prefix-free parsing.

A rolling hash over the symbols of every text marks triggers: a window of
``length`` symbols is anchored at the place where the hash of a few symbols is
the least of the window.  That depends on content alone, so equal passages have
the same triggers and are cut into the same phrases.  The windows anchored at
one trigger are a *cell*.  It carries the hash of the passage behind the anchor
(``k``, the parse's context) and of all that its windows cover (``h``, the phrase
with its context):

* ``k`` is found in one place only: no window of the cell repeats;
* ``(k, h)`` is found elsewhere: every window of the cell repeats;
* otherwise one cell for each ``(k, h)`` is parsed again with denser triggers,
  down to single windows, where the hash of the window itself decides.

So only the ragged ends of repeated passages are looked at symbol by symbol.
Symbols are bytes for what is removed, and words for passages that documents
share.  The suffix order itself is never written out: which windows have an equal
one needs no order, and the dictionary of a corpus that is mostly not repetitive
has nearly as many suffixes as the corpus has bytes (see the README).

``k`` has 64 bits, modulo 2**64; ``h`` has 62 bits from two residues modulo a prime,
so two different passages of equal context pass for one with a chance under 1e-12.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeySet, arrow_map, join_unique, small_batches, text_or_empty, written

LENGTH = 400  # bytes
PASSAGE = 51  # words: over 50
SEED = 97
SEGMENT = 1 << 20  # symbols that are parsed at once
ARRAY = 1 << 14  # ranges in one array: more are dealt over several rows
WORDS = 10  # levels of words begin here, those of bytes at 0
PLACE_BITS = 21  # of a place in a segment with its margin
PRIME = (1 << 31) - 1
MASK = (1 << 64) - 1


def levels(length: int, words: bool = False) -> list[int]:
    """Symbols of context at each level; the last has single windows.  A word tells
    more than a byte, so contexts of words can be shorter and so fewer."""
    return [length // 6 if words else length * 9 // 25, length * 47 // 50, length]


class Rolling:
    """Polynomial prefix hashes modulo 2**64, or a prime where one is given; the
    hash of a span does not depend on where it stands."""

    def __init__(self, base: int, prime: int | None = None):
        self.prime, self.size = prime, prime or 1 << 64
        self.base = base % self.size if prime else base | 1
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _run(self, base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:  # twice as many each time
            more = out * np.uint64(pow(base, len(out), self.size))
            out = np.concatenate([out, more % np.uint64(self.prime) if self.prime else more])
        return out

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.powers) < n + 1:
            self.powers, self.inverse = self._run(self.base, n + 1), self._run(pow(self.base, -1, self.size), n + 1)
        out = np.zeros(n + 1, np.uint64)
        if self.prime:
            p = np.uint64(self.prime)
            np.cumsum(values % p * self.powers[:n] % p, out=out[1:])  # below 2**53
        else:
            np.cumsum(values * self.powers[:n], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.prime:
            p = np.uint64(self.prime)
            return (prefix[end] - prefix[start]) % p * self.inverse[start] % p
        return (prefix[end] - prefix[start]) * self.inverse[start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Parser:
    """Values of bytes and words, and the cells of windows over them."""

    def __init__(self, length: int = LENGTH, passage: int = PASSAGE, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, MASK, 256, dtype=np.uint64)
        a, b, c = (int(x) for x in rng.integers(1 << 20, MASK, 3, dtype=np.uint64))
        self.fast, self.exact = Rolling(a), (Rolling(b, PRIME), Rolling(c, PRIME))
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.length = {0: length, WORDS: passage}

    def word_values(self, data: np.ndarray) -> np.ndarray:
        """A hash of each run of bytes that are no white space."""
        out, at = [np.zeros(0, np.uint64)], 0
        while at < len(data):
            end = at + SEGMENT
            while end < len(data) and not self.space[data[end]]:
                gap = self.space[data[end : end + SEGMENT]]
                end += int(gap.argmax()) if gap.any() else SEGMENT
            part = data[at:end]
            edge = np.diff(np.concatenate([[True], self.space[part], [True]]).astype(np.int8))
            out.append(mixed(self.fast.spans(self.fast.prefixes(self.value[part]), np.flatnonzero(edge < 0), np.flatnonzero(edge > 0))))
            at = end
        return np.concatenate(out)

    def cells(self, level: int, values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """``piece, first, last, k, h`` of the cells of pieces of ``sizes`` symbols, which
        stand in ``values`` one after the other; windows lie within a piece."""
        length = self.length[level // WORDS * WORDS]
        context, ends = levels(length, level >= WORDS)[level % WORDS], np.cumsum(sizes)
        one, exact = self.fast.prefixes(values), [r.prefixes(values) for r in self.exact]
        piece = np.repeat(np.arange(len(sizes)), sizes)[: max(0, len(values) - length + 1)]
        at = np.flatnonzero(ends[piece] - np.arange(len(piece)) >= length)  # window starts
        piece = piece[at]
        if context == length:
            first = last = anchor = at
        else:
            anchor = self._anchors(one, len(values), length - context, max(2, context // 9))[at]
            new = np.ones(len(at), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
            begins = np.flatnonzero(new)
            first, last = at[begins], at[np.append(begins[1:], len(at)) - 1] if len(at) else at
            anchor, piece = anchor[begins], piece[begins]
        k = mixed(self.fast.spans(one, anchor, anchor + context)) + np.uint64(level)
        a, b = (r.spans(p, first, last + length) for r, p in zip(self.exact, exact))
        shape = ((anchor - first).astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64)
        h = mixed((a << np.uint64(31) | b) ^ mixed(shape))
        begin = (ends - sizes)[piece]
        return piece, first - begin, last - begin, k.view(np.int64), h.view(np.int64)

    def _anchors(self, one: np.ndarray, n: int, reach: int, gram: int) -> np.ndarray:
        """For each start, the place up to ``reach`` on with the least hash of ``gram``
        symbols, the last of equal ones."""
        size = reach + 1
        key = np.full(-(-(n + size) // size) * size, MASK, np.uint64)
        place = np.arange(max(0, n - gram + 1))
        low = np.uint64((1 << PLACE_BITS) - 1)
        key[: len(place)] = mixed((one[gram:] - one[: len(place)]) * self.fast.inverse[: len(place)]) & ~low | (low - place.astype(np.uint64))
        blocks = key.reshape(-1, size)
        onward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return (low - (np.minimum(backward[:n], onward[reach : reach + n]) & low)).astype(np.int64)


class _Batch:
    """Pieces of one level that wait to be parsed together."""

    def __init__(self, parser: Parser, level: int):
        self.parser, self.level, self.length = parser, level, parser.length[level // WORDS * WORDS]
        self.values, self.of, self.low, self.held = [], [], [], 0

    def add(self, row: int, values: np.ndarray, first: int, last: int) -> Iterator[dict]:
        """Windows that start at ``first..last`` of the row's ``values``."""
        for lo in range(first, last + 1, SEGMENT):
            part = values[lo : min(last + 1, lo + SEGMENT) + self.length - 1]
            if self.held + len(part) > SEGMENT and self.held:
                yield self.flush()
            self.values.append(part)
            self.of.append(row)
            self.low.append(lo)
            self.held += len(part)

    def flush(self) -> dict:
        symbols = np.concatenate(self.values)
        if self.level < WORDS:
            symbols = self.parser.value[symbols]
        piece, first, last, k, h = self.parser.cells(self.level, symbols, np.array([len(v) for v in self.values]))
        of, low = np.array(self.of)[piece], np.array(self.low)[piece]
        self.values, self.of, self.low, self.held = [], [], [], 0
        return {"row": of, "level": np.full(len(of), self.level), "first": first + low, "last": last + low, "k": k, "h": h}


def _joined(ranges: pa.StructArray) -> Iterator[tuple[int, int, int]]:
    """Ranges of a level that touch, as one, in order: they are parsed anew in any case."""
    level, first, last = (ranges.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("level", "first", "last"))
    order = np.argsort((level << 40) + first)
    begin, upto = ((level << 40) + first)[order], np.maximum.accumulate(((level << 40) + last)[order])
    new = np.concatenate([[True], begin[1:] > upto[:-1] + 1])
    starts = np.flatnonzero(new)
    ends = upto[np.append(starts[1:], len(begin)) - 1]
    low = (1 << 40) - 1
    return zip((begin[starts] >> 40).tolist(), (begin[starts] & low).tolist(), (ends & low).tolist())


def _parse(rows: DataFrame, length: int, passage: int) -> DataFrame:
    """Cells of ``uid, text, ranges`` rows; without ranges, of whole texts."""

    def make():
        parser = Parser(length, passage)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            uid, waiting = batch.column("uid"), {}

            def cells(row: int, level: int, values: np.ndarray, first: int, last: int) -> Iterator[dict]:
                if level not in waiting:
                    waiting[level] = _Batch(parser, level)
                for found in waiting[level].add(row, values, first, last):
                    yield found | {"uid": uid.take(pa.array(found["row"]))}

            ranges = batch.column("ranges")
            for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                data = np.frombuffer(text, np.uint8)
                if not ranges[row].is_valid:
                    words = parser.word_values(data) if len(data) >= 2 * passage - 1 else data[:0]
                    own = [(0, 0, len(data) - length), (WORDS, 0, len(words) - passage)]
                else:
                    own = list(_joined(ranges[row].values))
                    words = parser.word_values(data) if own[-1][0] >= WORDS else None
                for level, first, last in own:
                    yield from cells(row, level, data if level < WORDS else words, first, last)
            for b in waiting.values():
                if b.held:
                    found = b.flush()
                    yield found | {"uid": uid.take(pa.array(found["row"]))}

        return work

    return arrow_map(rows, make, "uid binary, level int, first int, last int, k long, h long", slice_bytes=2 << 20)


def _decide(found: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """``(repeated, open)``: cells whose windows all repeat, and one cell for each
    ``(k, h)`` of the contexts that need a denser parse, at the next level; ``last``
    tells that the cells are single windows, where none is open.

    Windows of bytes repeat in any other place, those of words in another text."""
    place = F.when(F.col("level") < WORDS, F.xxhash64("uid", "level", "first")).otherwise(F.xxhash64("uid"))
    # Most contexts of a corpus occur once; a Bloom filter keeps their cells from
    # every further shuffle.
    often = KeySet(found.groupBy("k").agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").select("k"), "k", "contexts")
    near = written(often.maybe(found).withColumn("place", place).withColumn("kh", F.xxhash64("k", "h")), "near")
    phrases = near.groupBy("k", "h", "kh").agg(F.count(F.lit(1)).alias("n_rows"), F.min("place").alias("low"), F.max("place").alias("high"))
    if last:
        known = phrases.filter("low <> high").withColumn("again", F.lit(True)).withColumn("open", F.lit(False))
    else:
        phrases = written(phrases, "phrases")
        by_k = phrases.groupBy("k").agg(F.count(F.lit(1)).alias("n_phrases"), F.min("low").alias("k_low"), F.max("high").alias("k_high")).filter("k_low <> k_high")
        known = join_unique(phrases, written(by_k, "by_k"), "k", phrases.count(), count="n_phrases", how="inner")
        known = known.withColumn("again", F.expr("low <> high")).withColumn("open", F.expr("n_phrases > 1")).filter("again or open")
    known = written(known.select("kh", F.col("k").alias("k2"), F.col("h").alias("h2"), "n_rows", "low", "again", "open"), "known")
    met = join_unique(near, known, "kh", near.count(), how="inner").filter("k = k2 and h = h2")
    met = written(met.select("uid", "level", "first", "last", "again", F.expr("open and place = low").alias("open")).filter("again or open"), "met")
    return met.filter("again"), None if last else met.filter("open").select("uid", (F.col("level") + 1).alias("level"), "first", "last")


def _spans(cells: DataFrame, length: int) -> DataFrame:
    """``uid, spans``: the disjoint spans of bytes that the windows of cells cover, in
    order, each as ``start * 2**32 + end``."""
    dealt = cells.select("uid", "first", "last").repartition("uid").sortWithinPartitions("uid", "first")

    def merged(rows: pa.Table) -> pa.RecordBatch:
        uid = rows.column("uid").combine_chunks().dictionary_encode()
        uid = uid if isinstance(uid, pa.DictionaryArray) else uid.chunk(0)
        of, start = uid.indices.to_numpy().astype(np.int64), rows.column("first").to_numpy().astype(np.int64)
        end = rows.column("last").to_numpy().astype(np.int64) + length
        shift = of << 32  # texts do not overlap
        upto = np.maximum.accumulate(end + shift) - shift
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (start[1:] > upto[:-1])
        begins = np.flatnonzero(new)
        packed = (start[begins] << 32) + upto[np.append(begins[1:], len(of)) - 1]
        bounds = np.searchsorted(of[begins], np.arange(len(uid.dictionary) + 1))
        return pa.RecordBatch.from_arrays([uid.dictionary, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(packed))], ["uid", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:  # sorted: a text may span batches, so its rows are held
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            own = held.column("uid")
            cut = pc.index(pc.equal(own, own[-1]), True).as_py()
            if cut:
                yield merged(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield merged(held)

    small_batches(cells.sparkSession)
    return dealt.mapInArrow(run, "uid binary, spans array<long>")


def _row_key(digest: Column, doc_id: Column) -> Column:
    """A key of a row's own: of its text and id; rows that repeat both share it."""
    return F.substring(F.unhex(F.sha2(F.concat(digest, F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 256)), 1, 16)


class Repeats:
    """What repeats in a table of documents.

    ``rows``: ``uid, rep, doc_id, digest, n_bytes, n_rows`` of every row, ``n_rows``
    with its text; ``spans``: for the ``uid`` of each parsed text with repeated
    bytes, their spans; ``shared``: the ``rep`` of texts
    that share a passage of ``passage`` words with another row.  Of equal texts one
    row (``rep``) speaks for the others in the parse.
    """

    def __init__(self, docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text"):
        self.length, self.passage = length, passage
        given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
        digest = F.unhex(F.sha2("text", 256))
        self.given = given.withColumn("digest", digest).withColumn("uid", _row_key(F.col("digest"), F.col("doc_id")))
        sizes = written(self.given.select("uid", "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
        groups = written(sizes.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("low")), "groups")
        named = join_unique(sizes, groups, "digest", sizes.count()).withColumn("rep", _row_key(F.col("digest"), F.col("low"))).drop("low")
        self.rows = written(named, "named")
        copied = self.rows.filter("n_rows > 1")
        self.speaking = self.given.select("uid", "text").filter(F.octet_length("text") >= min(length, 2 * passage - 1))
        self._find(copied.filter("uid <> rep").select("uid").distinct(), copied.filter("uid = rep").select("uid").distinct())

    def _find(self, silent: DataFrame, copied: DataFrame) -> None:
        first = KeySet(silent, "uid", "silent").without(self.speaking)
        whole = first.withColumn("ranges", F.lit(None).cast("array<struct<level:int,first:int,last:int>>"))
        cells = written(_parse(whole, self.length, self.passage), "cells")
        found, again = _decide(cells, False)
        for last in (False, True):
            dealt = again.groupBy("uid", F.expr(f"first div {ARRAY}").alias("deal"))
            asked = KeySet(dealt.agg(F.collect_list(F.struct("level", "first", "last")).alias("ranges")).drop("deal"), "uid", "open")
            more, again = _decide(written(_parse(asked.join(self.speaking), self.length, self.passage), "cells"), last)
            found = found.unionByName(more)
        self.spans = _spans(found.filter(F.col("level") < WORDS), self.length)
        # Copies share all they have: a text with a first window of words.
        wordy = KeySet(copied, "uid", "copied").join(cells.filter((F.col("level") == WORDS) & (F.col("first") == 0)).select("uid"), "left_semi")
        self.shared = found.filter(F.col("level") >= WORDS).select("uid").unionByName(wordy).distinct()

    def cut(self, texts: bool = False) -> DataFrame:
        """``uid, n_removed, n_spans, kept_sha256`` (or ``kept``, the bytes that are left)
        of the parsed texts with repeated bytes; copies repeat as a whole in any case."""

        def make():
            def work(batch: pa.RecordBatch) -> Iterator[dict]:
                out: dict[str, list] = {c: [] for c in ("n_removed", "n_spans", "kept" if texts else "kept_sha256")}
                spans = batch.column("spans")
                for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    both = spans[row].values.to_numpy()
                    lows, highs = (both >> 32).tolist(), (both & 0xFFFFFFFF).tolist()
                    kept = b"".join(text[a:b] for a, b in zip([0, *highs], [*lows, len(text)]))
                    for c, v in zip(out, (sum(highs) - sum(lows), len(lows), kept if texts else hashlib.sha256(kept).hexdigest())):
                        out[c].append(v)
                yield {"uid": batch.column("uid")} | out

            return work

        kind = "kept binary" if texts else "kept_sha256 string"
        return arrow_map(KeySet(self.spans, "uid", "spans").join(self.speaking), make, f"uid binary, n_removed long, n_spans long, {kind}")


def repeat_report(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shared_passage`` of every row.

    Every byte covered by a ``length``-byte string that also starts anywhere else in
    the input is removed, the first occurrence too.  ``shared_passage`` tells whether
    the text holds ``passage`` words in a row (runs of bytes that are no white space)
    that another row holds, too.  A null text is empty; texts shorter than ``length``
    stay.  Repeated rows are copies of each other.  Rows may share an id, or have
    none: each has the result of its own text.  Texts of any length are parsed in
    segments; an empty table gives an empty one, and other columns are not read.
    """
    found = Repeats(docs, length, passage, id_col, text_col)
    sizes = found.rows.filter("uid = rep").select("rep", "n_rows").distinct()
    # Rows that repeat both id and text are cut alike.
    some = found.cut().dropDuplicates(["uid"]).join(found.shared.withColumn("shared", F.lit(True)), "uid", "full").withColumnRenamed("uid", "rep")
    told = written(some.join(sizes, "rep"), "told")
    rows = join_unique(found.rows, told.withColumnRenamed("n_rows", "rep_rows"), "rep", found.rows.count(), count="rep_rows")
    copies = F.expr(f"n_rows > 1 and n_bytes >= {length}")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copies, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copies, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copies, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        F.coalesce("shared", F.lit(False)).alias("shared_passage"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` of every row with its repeated bytes removed; bytes of a
    character that is cut in two are replaced by U+FFFD.  Nulls, equal ids and
    repeated rows are as in ``repeat_report``."""
    found = Repeats(docs, length, PASSAGE, id_col, text_col)
    cut = found.cut(texts=True)
    copied = f"n_rows > 1 and n_bytes >= {length}"
    part = cut.join(found.rows.filter(f"not ({copied})").select("uid", "doc_id"), "uid").select("doc_id", F.expr("decode(kept, 'UTF-8')").alias("text"))
    copies = found.rows.filter(copied)
    changed = copies.select("uid").unionByName(cut.select("uid")).distinct()
    return KeySet(changed, "uid", "changed").without(found.given).select("doc_id", "text").unionByName(part).unionByName(copies.select("doc_id", F.lit("").alias("text")))
