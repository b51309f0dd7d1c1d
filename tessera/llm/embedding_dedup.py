"""Embedding near-dedup with rotated binary codes.

A unit vector is turned by random rotations and only the signs are kept (its
code), with a correction factor: the inner product of the vector with its own
code.  For a code and another vector, ``<code, vector> / factor`` estimates the
cosine without bias, with an error that shrinks with the number of bits; where
the estimate plus its bound misses the threshold the pair is dropped, and only
the others are recomputed in double precision.

Pairs meet in buckets: runs of code bits are bucket keys (bands).  A bucket of
more than ``BLOCK`` vectors is dealt over tasks as pairs of chunks, and what a
block emits is linear in its vectors: link counts and a spanning forest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_unique, written
from .components import components

BLOCK = 512
SEED = 20_240_501
SIGMAS = 4.5  # width of the confidence bound
MISS = 0.002  # chance that a pair just at the threshold shares no bucket


@dataclass(frozen=True)
class Plan:
    dims: int
    threshold: float
    band_bits: int
    bands: int
    rotations: int

    @classmethod
    def of(cls, distinct: int, dims: int, threshold: float) -> Plan:
        """Bands of about log2(n) - 2 bits and as many of them as MISS asks for."""
        bits = int(np.clip(np.ceil(np.log2(max(2, distinct))) - 2, 6, 24))
        agree = (1 - np.arccos(threshold) / np.pi) ** bits
        bands = int(np.ceil(np.log(MISS) / np.log1p(-agree)))
        return cls(dims, threshold, bits, bands, -(-bits * bands // dims))

    def matrix(self) -> np.ndarray:
        """dims x (rotations * dims): orthogonal blocks, scaled to keep lengths."""
        rng = np.random.default_rng(SEED)
        blocks = [np.linalg.qr(rng.standard_normal((self.dims, self.dims)))[0] for _ in range(self.rotations)]
        return (np.concatenate(blocks, axis=1) / np.sqrt(self.rotations)).astype(np.float32)

    def bound(self, factor: np.ndarray) -> np.ndarray:
        """How far an estimate of a cosine at the threshold may fall short."""
        bits = self.rotations * self.dims
        return SIGMAS * np.sqrt((1 - factor**2) / factor**2) * np.sqrt(max(1e-6, 1 - self.threshold**2) / max(1, bits - 1)) + 1e-4


def _usable(x) -> bool:
    if not x or any(v is None for v in x):
        return False
    a = np.asarray(x, np.float64)
    return bool(np.isfinite(a).all() and a.any())


def _prepared(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, digest, vec``: the components as doubles in bytes, or nulls."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            rows = batch.column("vec").to_pylist()
            packed = [np.asarray(x, np.float64).tobytes() if _usable(x) else None for x in rows]
            yield {"vec_id": batch.column("vec_id"), "digest": [p and hashlib.blake2b(p, digest_size=16).digest() for p in packed], "vec": packed}

        return work

    return arrow_map(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec")), make, "vec_id long, digest binary, vec binary")


def _units(packed: list[bytes], dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(packed), np.float64).reshape(-1, dims)
    x = x / np.abs(x).max(1, keepdims=True)  # neither over- nor underflows below
    return x / np.sqrt(np.square(x).sum(1, keepdims=True))


def _coded(distinct: DataFrame, plan: Plan) -> DataFrame:
    """Adds the packed code, its factor and the bucket keys of all bands."""
    matrix = plan.matrix()
    weights = (1 << np.arange(plan.band_bits, dtype=np.int64))[::-1]

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            turned = _units(batch.column("vec").to_pylist(), plan.dims).astype(np.float32) @ matrix
            signs = turned > 0
            used = signs[:, : plan.bands * plan.band_bits].reshape(len(signs), plan.bands, plan.band_bits)
            keys = used @ weights + (np.arange(plan.bands, dtype=np.int64) << plan.band_bits)
            yield {
                "node": batch.column("node"), "n_rows": batch.column("n_rows"), "vec": batch.column("vec"),
                "code": [c.tobytes() for c in np.packbits(signs, axis=1)], "factor": np.abs(turned).sum(1) / np.sqrt(turned.shape[1]), "buckets": list(keys),
            }

        return work

    return arrow_map(distinct.select("node", "n_rows", "vec"), make, "node long, n_rows long, vec binary, code binary, factor float, buckets array<long>")


def _blocks(coded: DataFrame) -> DataFrame:
    """One row per vector and block it takes part in: ``bucket, i, j, chunk``.

    A bucket of up to BLOCK vectors is one block.  A larger one has chunks of
    about BLOCK and a block for each two of them, so no pair is lost.
    """
    light = coded.select("node", F.explode("buckets").alias("bucket"))
    large = written(light.groupBy("bucket").count().filter(F.col("count") > BLOCK).select("bucket", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks")), "large")
    rows = coded.select("*", F.explode("buckets").alias("bucket")).drop("buckets").join(large, "bucket", "left")
    rows = rows.withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("node"), "chunks").cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("chunks"), F.lit(1)) - 1)).alias("other")
    return rows.select("*", other).select("bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "node", "n_rows", "vec", "code", "factor")


def _linked(blocks: DataFrame, plan: Plan) -> DataFrame:
    """``a, b, add``: ``b`` set on edges of spanning forests; else ``add`` counts
    the rows that node ``a`` links to in a block.  A pair counts in its first
    common band only."""
    matrix, bits = plan.matrix(), plan.rotations * plan.dims
    dealt = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(rows: dict, out: dict) -> None:
        band, across = int(rows["bucket"][0]) >> plan.band_bits, rows["i"][0] != rows["j"][0]
        units = _units(rows["vec"], plan.dims)
        signs = np.unpackbits(np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(units), -1), axis=1)[:, :bits]
        factor = np.asarray(rows["factor"], np.float32)
        codes = (signs.astype(np.float32) * 2 - 1) / np.sqrt(bits)
        estimate = codes @ (units.astype(np.float32) @ matrix).T / factor[:, None]
        near = np.triu(estimate + plan.bound(factor)[:, None] >= plan.threshold, 1)
        if across:
            chunk = np.asarray(rows["chunk"])
            near &= chunk[:, None] != chunk[None, :]
        x, y = np.nonzero(near)
        exact = np.einsum("ij,ij->i", units[x], units[y]) >= plan.threshold
        x, y = x[exact], y[exact]
        if not len(x):
            return
        used = signs[:, : plan.bands * plan.band_bits].reshape(len(signs), plan.bands, plan.band_bits)
        first = np.array([(used[a] == used[b]).all(1).argmax() == band for a, b in zip(x, y)])
        x, y = x[first], y[first]
        weight, node = np.asarray(rows["n_rows"]), rows["node"]
        add = np.bincount(x, weight[y], len(node)) + np.bincount(y, weight[x], len(node))
        for k in np.flatnonzero(add):
            out["a"].append(node[k])
            out["b"].append(None)
            out["add"].append(int(add[k]))
        root = list(range(len(node)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a, b in zip(x.tolist(), y.tolist()):
            if (ra := find(a)) != (rb := find(b)):
                root[ra] = rb
                out["a"].append(node[a])
                out["b"].append(node[b])
                out["add"].append(0)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("add", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:  # sorted: a block may span batches, so its rows are held
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            keys = [held.column(c).to_numpy() for c in ("bucket", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            if len(cuts):
                yield from flush(held.slice(0, cuts[-1]), [0, *cuts])
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from flush(held, [0, held.num_rows])

    def flush(rows: pa.Table, cuts: list) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"a": [], "b": [], "add": []}
        columns = {c: rows.column(c).to_pylist() for c in rows.column_names}
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                compare({c: v[lo:hi] for c, v in columns.items()}, out)
        if out["a"]:
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return dealt.mapInArrow(run, "a long, b long, add long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    A row whose vector is null, empty, zero or holds null or non-finite
    components has no link and is its own component.  Only vectors of equal
    length are compared.  Equal vectors are one node with a row count; a row
    links to the other rows of its node and to all rows of linked nodes.

    Nodes are numbered apart from the ids, so ids may repeat or be null: rows of one id
    with different vectors are different nodes, and rows with a null id link, too.  The
    component is the smallest id of its rows that have one, else null; a null id is kept
    only there.  Other columns, whatever their names, are not read.
    """
    rows = written(_prepared(vectors, id_col, vector_col), "vectors")
    grouped = rows.filter("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n_rows"), F.first("vec").alias("vec"))
    distinct = written(grouped.withColumn("node", F.monotonically_increasing_id()), "distinct")
    edges, adds = None, None
    # One pass for each vector length; a table has one length, or very few.
    sizes = [r[0] for r in distinct.select(F.expr("length(vec) div 8").alias("d")).distinct().collect()]
    for dims in sizes:
        own = distinct.filter(F.length("vec") == 8 * dims)
        plan = Plan.of(own.count(), dims, threshold)
        found = written(_linked(_blocks(_coded(own, plan)), plan), "linked")
        edge, add = found.filter("b is not null").select("a", "b"), found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("add").alias("add"))
        edges, adds = (edge, add) if edges is None else (edges.unionByName(edge), adds.unionByName(add))
    if edges is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    linked = components(edges)
    firsts = written(linked.join(distinct.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("n_rows")), "firsts")
    placed = join_unique(linked, firsts, "component", linked.count(), how="inner").select("node", "first")
    named = distinct.select("digest", "node", "least", "n_rows").join(placed, "node", "left").join(adds, "node", "left")
    component = F.when(F.col("first").isNull(), F.col("least")).otherwise(F.col("first"))
    named = written(named.select("digest", "n_rows", (F.col("n_rows") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"), component.alias("component_id")), "named")
    lone = rows.filter("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    some = join_unique(rows.filter("digest is not null").select("vec_id", "digest"), named, "digest", rows.count())
    return some.select("vec_id", "n_links", "component_id").unionByName(lone).withColumn("kept", F.expr("vec_id <=> component_id"))
