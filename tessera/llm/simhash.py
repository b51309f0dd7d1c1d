"""SimHash near-duplicate groups by pigeonhole blocks.

A fingerprint is cut into ``blocks`` blocks of bits; two fingerprints that
differ in at most ``distance`` bits agree on at least ``blocks - distance`` of
them.  Every choice of that many blocks is a join key, so a join on the keys
meets every close pair, and the Hamming distance is verified there.  For groups a
block gives a spanning forest of its close pairs, not the pairs.
Only distinct fingerprints are joined: copies of one fingerprint share its row,
and pairs are never formed inside such a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KeySet, arrow_map, join_unique, released_shuffles, small_batches, written
from .components import components

BITS = 64
SEED = 42
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEGMENT = 1 << 20  # bytes of a text whose shingles are in memory at once


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    """Unsigned XXH64 of each shingle of ``width`` words, repeats included, a
    segment at a time; a shorter text is one shingle, one without words none."""
    carry: list[bytes] = []
    done, at, hash_ = False, 0, xxhash.xxh64_intdigest
    lowered = text.translate(LOWER)
    while at < len(lowered):
        end = at + SEGMENT
        while end < len(lowered) and lowered[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = carry + lowered[at:end].split()
        at = end
        if len(words) >= width:
            hashes = [hash_(x, SEED) for x in map(b" ".join, zip(*[words[i:] for i in range(width)]))]
            yield np.array(hashes, np.uint64)
            done = True
            words = words[len(words) - width + 1 :]
        carry = words
    if carry and not done:
        yield np.array([hash_(b" ".join(carry), SEED)], np.uint64)


def fingerprint(text: bytes, width: int = 4) -> int:
    ones, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for at in range(0, len(bits), 32768):
            ones += np.add.reduce(bits[at : at + 32768], axis=0, dtype=np.uint16)
    if not total:
        return 0
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row; null texts are empty."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", width) for t in texts], np.uint64).view(np.int64)
            yield {"doc_id": batch.column("doc_id"), "fp": fps}

        return work

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(given, make, "doc_id long, fp long")


def plan_blocks(distinct: int, distance: int) -> int:
    """Blocks such that a random key meets few others: the fewest with at least
    ``log2(distinct) + 2`` key bits.  It changes the work, never the result."""
    for blocks in range(distance + 2, BITS + 1):
        if (blocks - distance) * (BITS // blocks) >= np.log2(max(2, distinct)) + 2 or comb(blocks + 1, distance) > 400:
            return blocks
    return BITS


def block_keys(fp: Column, blocks: int, distance: int) -> Column:
    """Array of ``struct(choice, key)``, one for each choice of agreeing blocks."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [F.shiftrightunsigned(F.shiftleft(fp, BITS - hi), BITS - hi + lo) for lo, hi in zip(cuts, cuts[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(block[i])
        keys.append(F.struct(F.lit(k).alias("choice"), key.alias("key")))
    return F.array(*keys)


def close_pairs(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``(a, b)``: all node pairs of ``(fp, node)`` rows within ``distance`` bits; as many
    as there are, so for groups take ``close_forest``."""
    blocks = blocks or plan_blocks(distinct.count(), distance)
    keyed = distinct.select("fp", "node", F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k")).select("fp", "node", "k.choice", "k.key")
    one, two = keyed.alias("x"), keyed.alias("y")
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    met = one.join(two, (F.col("x.choice") == F.col("y.choice")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & near)
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def close_forest(distinct: DataFrame, distance: int = 4, blocks: int | None = None) -> DataFrame:
    """``(a, b)`` node pairs within ``distance`` bits that connect what ``close_pairs``
    connects, fewer than there are rows in the blocks."""
    blocks = blocks or plan_blocks(distinct.count(), distance)
    # Two keys of one hash share a block, which adds comparisons and no false pair.
    keys = F.transform(block_keys(F.col("fp"), blocks, distance), lambda k: F.xxhash64(k["choice"], k["key"]))
    return _forest(_dealt(distinct.select("node", F.col("fp").alias("s0"), keys.alias("buckets")), ("s0",)), distance, ("s0",))


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest id reachable over links of at most
    ``distance`` bits.  Equal fingerprints link, also those of empty texts
    (zero).  Rows with a null id take part in no link unless their fingerprint
    is shared with an id; otherwise their component is null.
    """
    fps = written(fingerprints(docs, width, id_col, text_col), "fingerprints")
    groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_rows")), "distinct")
    linked = components(close_forest(groups.filter("node is not null").select("fp", "node"), distance))
    named = written(groups.join(linked, "node", "left").select("fp", "n_rows", F.coalesce("component", "node").alias("component_id")), "named")
    rows = join_unique(fps, named, "fp", fps.count())
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similarity of shingles as such.  Two texts whose shingle sets have Jaccard
# similarity s are at an angle of at most acos(2s / (1 + s)), and a bit of the
# SimHash of the sets differs with probability angle / pi.  Random choices of bits
# are the blocks.  In a block the first SKETCH bits, all that travels there, give
# candidates, of which one spanning forest a block is kept: its components hold every
# candidate pair.  Inside a component all pairs are held against all bits and then
# against the shingle sets, which decide.

WIDE = 512
SKETCH = 128
SKETCH_WORDS = ("s0", "s1")
SHARED = 10  # a block has 2^SHARED rows or so: wider blocks miss more pairs, so more of them travel
BLOCK = 4096
MARGIN = 3  # standard deviations of the distance of a pair just at the similarity: one in 700 such pairs lies beyond
SAMPLE = 16  # one row in so many tells which buckets are large
PAIRS = 1 << 24  # pairs of rows that one step through the blocks takes together
CHUNK, CHUNK_BYTES = 512, 16 << 20  # texts, and bytes of shingle sets, of half a comparison inside a component
SUBSETS_SEED = 7


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; segments are joined as they come, so
    what is held is 8 bytes a distinct shingle and one segment."""
    held = np.zeros(0, np.uint64)
    for hashes in shingle_hashes(text, width):
        held = np.union1d(held, hashes)
    return held


def set_fingerprint(hashes: np.ndarray, bits: int = WIDE) -> bytes:
    """SimHash of ``bits`` bits over a set of shingle hashes; further words are mixed
    from a shingle's hash."""
    ones = np.zeros(bits, np.int64)
    odd = np.arange(1, bits // BITS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096, None] + odd
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1), axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes)).tobytes()


def wide_fingerprint(text: bytes, width: int, bits: int = WIDE) -> bytes:
    return set_fingerprint(shingle_set(text, width), bits)


class WidePlan:
    """Blocks of ``block_bits`` random bits, and as many as it takes for a pair
    just at the similarity to share one with probability ``1 - miss``."""

    def __init__(self, distinct: int, similarity: float, bits: int = WIDE, miss: float = 0.003):
        share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        self.sketch, self.distance = (int(n * share + MARGIN * np.sqrt(n * share * (1 - share))) for n in (SKETCH, bits))
        self.block_bits = max(4, int(np.ceil(np.log2(max(2, distinct)))) - SHARED)
        self.blocks = int(np.ceil(np.log(miss) / np.log1p(-((1 - share) ** self.block_bits))))
        rng = np.random.default_rng(SUBSETS_SEED)
        self.chosen = np.stack([rng.choice(bits, self.block_bits, replace=False) for _ in range(self.blocks)])
        self.weights = 1 << np.arange(self.block_bits, dtype=np.int64)

    def keys(self, packed: list[bytes]) -> np.ndarray:
        signs = np.unpackbits(np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1), axis=1)
        return signs[:, self.chosen] @ self.weights + (np.arange(self.blocks, dtype=np.int64) << self.block_bits)


def _keyed(distinct: DataFrame, plan: WidePlan) -> DataFrame:
    """``node, s0, s1, buckets``: the sketch as longs and the keys of all blocks."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            fps = batch.column("fp").to_pylist()
            words = np.frombuffer(b"".join(fps), np.int64).reshape(len(fps), -1)
            yield {"node": batch.column("node"), "s0": words[:, 0], "s1": words[:, 1], "buckets": list(plan.keys(fps))}

        return work

    return written(arrow_map(distinct.select("node", "fp"), make, "node long, s0 long, s1 long, buckets array<long>", slice_bytes=1 << 18), "keyed")


def _halves(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows with ``chunk`` of ``chunks`` (null: one), once for each pair of chunks
    ``i <= j`` that they take part in."""
    other = F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)).alias("other")
    return rows.select("*", other).select(key, F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", *columns)


def _dealt(keyed: DataFrame, words: tuple[str, ...] = SKETCH_WORDS) -> DataFrame:
    """``bucket, i, j, chunk, node`` and ``words``: buckets of more than about BLOCK rows are
    dealt out as pairs of chunks, so that none is one task's work.  A sample of the rows
    tells their sizes, which change the chunks but never the pairs: all rows are dealt."""
    rows = keyed.select("node", *words, F.explode("buckets").alias("bucket"))
    some = rows.filter(F.pmod(F.xxhash64("node", F.lit(SUBSETS_SEED)), F.lit(SAMPLE)) == 0).groupBy("bucket").count()
    large = some.filter(F.col("count") > BLOCK / SAMPLE).select("bucket", F.ceil(F.col("count") * SAMPLE / BLOCK).cast("int").alias("chunks"))
    rows = rows.join(written(large, "large"), "bucket", "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("node"), "chunks").cast("int"), F.lit(0)))
    return _halves(rows, "bucket", "node", *words)


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def _forest(dealt: DataFrame, distance: int, words: tuple[str, ...] = SKETCH_WORDS) -> DataFrame:
    """``a, b``: for each block a spanning forest of its pairs within ``distance`` bits of
    ``words``, so fewer edges than rows, however many pairs are close."""
    ordered = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def edges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket, i, j = (rows.column(c).to_numpy() for c in ("bucket", "i", "j"))
        first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        sizes = np.diff(np.append(first, len(bucket)))
        start = 0
        while start < len(first):  # whole blocks with about PAIRS pairs
            stop = max(start + 1, int(np.searchsorted(np.cumsum(sizes[start:] ** 2), PAIRS, "right")) + start)
            yield some(rows.slice(first[start], int(sizes[start:stop].sum())), sizes[start:stop])
            start = stop

    def some(rows: pa.Table, sizes: np.ndarray) -> pa.RecordBatch:
        i, j, chunk, node = (rows.column(c).to_numpy() for c in ("i", "j", "chunk", "node"))
        bits = [rows.column(c).to_numpy().view(np.uint64) for c in words]
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(node))
        whole, split = i == j, bool((i != j).any())
        root, ends = np.arange(len(node)), ([], [])
        x, step = np.flatnonzero(left > 1), 1
        while len(x):
            y = x + step
            ok = root[x] != root[y]  # joined rows are not compared again
            if split:
                ok &= whole[x] | (chunk[x] != chunk[y])
            a, b = x[ok], y[ok]
            near = np.flatnonzero(sum(np.bitwise_count(w[a] ^ w[b]) for w in bits) <= distance)
            if len(near):
                flat = root.tolist()
                for p, q in zip(a[near].tolist(), b[near].tolist()):
                    if (rp := _find(flat, p)) != (rq := _find(flat, q)):
                        flat[rp] = rq
                        ends[0].append(p)
                        ends[1].append(q)
                root = np.array(flat)
                while (root[root] != root).any():
                    root = root[root]
            step += 1
            x = x[left[x] > step]
        return pa.RecordBatch.from_arrays([pa.array(node[np.array(e, np.int64)]) for e in ends], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:  # sorted: a block may span batches, so its rows are held
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            last = [held.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cut = np.flatnonzero(np.any([k != k[-1] for k in last], axis=0))
            if len(cut):
                yield from edges(held.slice(0, cut[-1] + 1))
                held = held.slice(cut[-1] + 1)
        if held is not None and held.num_rows:
            yield from edges(held)

    small_batches(dealt.sparkSession)
    return ordered.mapInArrow(run, "a long, b long")


def _links(candidates: DataFrame, distance: int, docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """``a, b``: spanning forests of the links inside the components of ``candidates``
    (``node, component``).

    The sets of a component's texts go to tasks as pairs of chunks of about CHUNK texts
    or CHUNK_BYTES, so a text travels as often as its component has chunks, not partners.
    Every pair of texts is held against ``distance``, close ones first, and then
    by the sets, unless its ends are joined already.  Of ids with several texts one
    pair of texts is enough.
    """

    def shingles():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            sets = [shingle_set(t or b"", width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield {"node": batch.column("node"), "fp": [set_fingerprint(x) for x in sets], "own": [x.tobytes() for x in sets]}

        return work

    def common(x: np.ndarray, y: np.ndarray) -> int:
        if not len(x) or not len(y):
            return 0
        return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))

    def joined(rows: pa.Table) -> pa.Table:
        node, chunk = rows.column("node").to_numpy(), rows.column("chunk").to_numpy()
        across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        words = np.frombuffer(b"".join(rows.column("fp").to_pylist()), np.uint64).reshape(len(node), -1)
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("own").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        met: list[tuple[np.ndarray, ...]] = []
        for x in range(len(node) - 1):
            apart = np.bitwise_count(words[x + 1 :] ^ words[x]).sum(1, dtype=np.int32)
            least, most = np.minimum(sizes[x + 1 :], sizes[x]), np.maximum(sizes[x + 1 :], sizes[x])
            ok = (apart <= distance) & (least >= similarity * most - 1e-9) & (node[x + 1 :] != node[x])
            if across:
                ok &= chunk[x + 1 :] != chunk[x]
            y = np.flatnonzero(ok)
            met.append((apart[y], np.full(len(y), x, np.int32), (y + x + 1).astype(np.int32)))
        names, at = np.unique(node, return_inverse=True)
        root, ends = list(range(len(names))), ([], [])
        if met:
            apart, a, b = (np.concatenate(c) for c in zip(*met))
            order = np.argsort(apart, kind="stable")
            for p, q in zip(a[order].tolist(), b[order].tolist()):
                if (rp := _find(root, int(at[p]))) == (rq := _find(root, int(at[q]))):
                    continue
                both = common(sets[p], sets[q])
                if both >= similarity * (sizes[p] + sizes[q] - both) - 1e-9:
                    root[rp] = rq
                    ends[0].append(node[p])
                    ends[1].append(node[q])
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    known = KeySet(candidates, "node", "candidates")
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").alias("node"), "text")
    held = arrow_map(known.maybe(texts), shingles, "node long, fp binary, own binary").groupBy("node", "fp").agg(F.first("own").alias("own"))
    sets = written(held.join(known.keys, "node"), "sets")
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("own")).alias("bytes"))
    chunks = F.ceil(F.greatest(F.col("n_rows") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("int")
    large = written(sizes.select("component", "n_rows", F.greatest(chunks, F.lit(1)).alias("chunks")).filter("chunks > 1"), "large")
    rows = join_unique(sets, large, "component", sets.count()).withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("node", "fp"), "chunks").cast("int"), F.lit(0)))
    return _halves(rows, "component", "node", "fp", "own").groupBy("component", "i", "j").applyInArrow(joined, "a long, b long")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, component_id`` of every row: the smallest id reachable over pairs
    whose sets of shingles have the Jaccard ``similarity`` or more.

    Fingerprints give the candidates; the sets decide on each link.  A null text is empty; texts without words are copies of each other.  Rows
    with a null id link to nothing and get a null component.
    """

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield {"doc_id": batch.column("doc_id"), "fp": [wide_fingerprint(t or b"", width) for t in texts]}

        return work

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with released_shuffles(docs.sparkSession):
        fps = written(arrow_map(given, make, "doc_id long, fp binary"), "wide")
        groups = written(fps.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n_rows")), "distinct")
        some = groups.filter("node is not null")
        plan = WidePlan(some.count(), similarity)
        candidates = components(_forest(_dealt(_keyed(some, plan)), plan.sketch))
        linked = components(_links(candidates, plan.distance, given, width, similarity))
        named = written(groups.join(linked, "node", "left").select("fp", "n_rows", F.coalesce("component", "node").alias("component_id")), "named")
    return join_unique(fps, named, "fp", fps.count()).select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are near-duplicates of one with a smaller id.

    All columns stay.  Rows with a null id, and rows that share an id with the
    one that stays, are kept.
    """
    found = similar_groups(docs, width, similarity, id_col, text_col)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return KeySet(gone, id_col, "gone").without(docs)
