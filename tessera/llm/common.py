"""Helpers the operators share: written intermediate tables, joins that
survive hot keys, and Arrow batch plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of the rows is joined by broadcast; there
#: can be at most 1 / HOT_SHARE such keys, whatever the input size.
HOT_SHARE = 1 / 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Without the setting a temporary folder is made for a local master; on a
    cluster, where executors do not share the driver's folders, it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, is computed once
    (``checkpoint()`` runs its plan twice) and carries size statistics.
    """
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark removes a query's shuffle files at its end, not when the driver next collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, the shuffle files of each query go when it ends: for chains of written
    tables, where no later query reads them."""
    before = spark.conf.get(RELEASE, "false")
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.set(RELEASE, before)


def join_unique(rows: DataFrame, unique: DataFrame, key: str, total: int, count: str = "n_rows", how: str = "left") -> DataFrame:
    """Left (or inner) join of ``rows`` to ``unique`` (one row per ``key``, with the
    number of rows of that key in ``count``) whose tasks stay even.

    Keys that hold at least HOT_SHARE of ``total`` rows number at most 256,
    so they are broadcast; every other key is small against a task's share.
    """
    hot = unique.filter(F.col(count) >= F.lit(max(2.0, total * HOT_SHARE)))
    cold = unique.filter(F.col(count) < F.lit(max(2.0, total * HOT_SHARE)))
    beside = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rows.join(F.broadcast(hot), key, "inner").unionByName(beside)


#: Bits of one bitmap, 512 longs, and the most a filter may have: its bitmaps are
#: broadcast and never exceed MAX_BITS / 8 = 32 MiB.
BUCKET_BITS = 32768
MAX_BITS = 1 << 28


def filter_bits(keys: int, each: int = 16) -> int:
    """Slots of a Bloom filter: a power of two, at most MAX_BITS."""
    return min(MAX_BITS, 1 << (max(BUCKET_BITS, keys * each) - 1).bit_length())


def bitmaps(slots: DataFrame, bits: int) -> DataFrame:
    """``(bucket, bitmap)`` of a table of set ``slot`` numbers below ``bits``: the words
    of a bucket as an array of longs, zeros too."""
    zeros = slots.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    ones = slots.select(F.expr("slot div 64").alias("word"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bits"))
    words = ones.unionByName(zeros).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    held = F.sort_array(F.collect_list(F.struct("word", "bits")))
    return words.groupBy(F.expr(f"word div {BUCKET_BITS // 64}").alias("bucket")).agg(F.transform(held, lambda w: w["bits"]).alias("bitmap"))


def tested(rows: DataFrame, maps: DataFrame, slots: list[Column], name: str = "maybe") -> DataFrame:
    """Adds ``name``: whether all ``slots`` are set in the broadcast bitmaps."""
    kept = rows.columns
    side = maps.select(F.col("bucket").alias("_bucket"), F.col("bitmap").alias("_bitmap"))
    for i, slot in enumerate(slots):
        rows = rows.withColumn("_slot", slot).join(F.broadcast(side), F.expr(f"_slot div {BUCKET_BITS} = _bucket"), "left")
        hit = F.expr(f"1 = getbit(_bitmap[cast((_slot % {BUCKET_BITS}) div 64 as int)], cast(_slot % 64 as int))")
        rows = rows.withColumn(f"_hit{i}", F.coalesce(hit, F.lit(False))).drop("_slot", "_bucket", "_bitmap")
    every = F.lit(True)
    for i in range(len(slots)):
        every = every & F.col(f"_hit{i}")
    return rows.select(*kept, every.alias(name))


class KeySet:
    """A written table of distinct keys with a Bloom filter of bounded size, so
    that rows whose key is surely not in it need no shuffle."""

    def __init__(self, keys: DataFrame, key: str, name: str = "keys"):
        self.keys, self.key = written(keys, name), key
        self.bits = filter_bits(self.keys.count())
        slots = self.keys.select(F.explode(F.array(*self._slots())).alias("slot"))
        self.maps = written(bitmaps(slots, self.bits), "bitmaps")

    def _slots(self) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(i), F.col(self.key)), F.lit(self.bits)) for i in range(2)]

    def _split(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        known = tested(rows, self.maps, self._slots(), "_maybe")
        return known.filter("_maybe").drop("_maybe"), known.filter("not _maybe").drop("_maybe")

    def maybe(self, rows: DataFrame) -> DataFrame:
        """All rows whose key is in the table, and a few others; no shuffle."""
        return self._split(rows)[0]

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        """Inner or left semi join of ``rows`` with the table on its key."""
        return self._split(rows)[0].join(self.keys, self.key, how)

    def left(self, rows: DataFrame) -> DataFrame:
        """Left join of ``rows`` with the table; rows surely not in it only get nulls."""
        maybe, surely_not = self._split(rows)
        return maybe.join(self.keys, self.key, "left").unionByName(surely_not, allowMissingColumns=True)

    def without(self, rows: DataFrame) -> DataFrame:
        """Rows whose key is not in the table (null keys stay)."""
        maybe, surely_not = self._split(rows)
        return surely_not.unionByName(maybe.join(self.keys.select(self.key), self.key, "left_anti"))


#: Most bytes of an Arrow batch between the JVM and a Python worker.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches, so that a worker's memory depends on
    BATCH_BYTES (or one longer row) and not on 10,000 rows of any length."""
    now = spark.conf.get(BATCH, "64m").rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(now[-1].lower(), 1)
    if not 0 < int(now.rstrip("kmgKMG")) * unit <= BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], Iterator[dict]]],
    schema: str,
    slice_bytes: int = 8 << 20,
) -> DataFrame:
    """``mapInArrow`` over slices of bounded size.

    ``make`` is called once per task and returns a function from a record
    batch to column dicts.  Batches are cut so that a slice holds about
    ``slice_bytes`` (a single longer row makes a slice of its own).
    """
    small_batches(df.sparkSession)
    target = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in _parsed(df.sparkSession, schema)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, slice_bytes):
                for out in work(part):
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in target], schema=target)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    if not batch.num_rows:
        return
    if batch.nbytes <= size:
        yield batch
        return
    start = 0
    lengths = [sum(c.slice(i, 1).nbytes for c in batch.columns) for i in range(batch.num_rows)]
    held = 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def _parsed(spark: SparkSession, schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fields


def _arrow(kind):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(taken: list[str], name: str) -> str:
    """``name``, lengthened until no column of ``taken`` has it (case-blind)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name
