"""Deterministic uniforms and ranks that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HEX = 13  # hexadecimal digits of a uniform: 52 bits, exact in a double


def u(seed: int, salt: str, *ids: Column | str) -> Column:
    """A uniform in [0, 1) of ``(seed, salt, ids)``, the same in any engine with md5."""
    cols = [F.col(i) if isinstance(i, str) else i for i in ids]
    text = F.concat_ws("::", F.lit(str(seed)), F.lit(salt), *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, HEX), 16, 10).cast("double") / F.lit(float(16**HEX))


def exact_rank(df: DataFrame, keys: list[str], order: str, ties: list[str], name: str = "rank", buckets: int | None = None) -> DataFrame:
    """Zero-based rank by ``order`` (a uniform) within ``keys``, without putting
    a whole key in one task: rows are ranked within buckets of the uniform, and
    a running count of the few (key, bucket) cells gives the offsets.  Without
    ``buckets`` there are four for each shuffle partition, 64 at least, so that more
    machines get smaller ones."""
    buckets = buckets or max(64, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = df.withColumn("_bucket", F.floor(F.col(order) * buckets).cast("int"))
    cells = own.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    offsets = cells.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    within = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(order, *ties))
    ranked = own.withColumn("_nth", within).join(offsets, [*keys, "_bucket"])
    return ranked.withColumn(name, (F.col("_first") + F.col("_nth") - 1).cast("long")).drop("_bucket", "_nth", "_first")


#: Most elements of an array that a row is expanded by.
BLOCK = 1 << 16


def numbered(df: DataFrame, n: str, name: str, keys: list[str]) -> DataFrame:
    """Each row ``n`` times, ``name`` from 0 to ``n - 1``.  Rows are dealt by ``keys`` in
    blocks of BLOCK, so no task and no array holds a large row's copies whole."""
    start = F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1, F.lit(BLOCK).cast("long"))))
    blocks = df.select("*", start.alias("_from")).repartition(*keys, "_from")
    own = F.sequence("_from", F.least(F.col("_from") + BLOCK, F.col(n).cast("long")) - 1)
    return blocks.select("*", F.explode(own).alias(name)).drop("_from")


#: Rounds of a keyed permutation: each moves half of the places.
ROUNDS = 24


def permutation_keys(seed: int, salt: str, n: Column | str, *ids: str) -> Column:
    """The keys of a permutation of 0 to ``n - 1``: one random place for each round."""
    size = F.col(n) if isinstance(n, str) else n
    return F.array(*[F.floor(u(seed, f"{salt}-key{i}", *ids) * size).cast("long") for i in range(ROUNDS)])


def permuted(place: Column | str, n: Column | str, keys: Column | str, seed: int, salt: str, *ids: str) -> Column:
    """Where a pseudo-random permutation of 0 to ``n - 1``, keyed by ``(seed, salt, ids)``, puts
    ``place``.  A round pairs each place x with ``key - x`` modulo n and swaps the pair if a
    hash of its larger member says so; it holds for any n, so no value is tried again."""
    place, size, held = (F.col(c) if isinstance(c, str) else c for c in (place, n, keys))
    own = [F.lit(str(seed)), F.lit(f"{salt}-swap"), *[F.col(i).cast("string") for i in ids]]

    def swap(x: Column, i: Column) -> Column:
        other = F.pmod(F.get(held, i) - x, size)
        text = F.concat_ws("::", *own, i.cast("string"), F.greatest(x, other).cast("string"))
        return F.when(F.substring(F.md5(text), 1, 1) < "8", other).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), place.cast("long"), swap)
