"""Exact ranks and running sums in the order of any values, skewed ones too.

Rows are dealt to tasks by ranges of (keys, order), so a large key is cut at its own
values and no task holds a key whole.  The ranges come from a sample and could fall
otherwise when computed again; so the dealt rows are written once, with the number of
their range, and the sums of the few (key, range) cells give each range its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.scratch import folder

Order = list[str | Column]


def running(df: DataFrame, keys: list[str], order: Order, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``keys`` (nulls are
    one key) that come before in ``order``.  Rows of a key should differ in ``order``; equal
    ones follow each other in any order, and lie in one task."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = folder(spark, "ordered")
    df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    cells = dealt.groupBy(*keys, "_range").agg(F.sum(value).alias("_sum"))
    so_far = lambda window: F.coalesce(F.sum("_sum" if window is over else value).over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    over = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy("_range")
    starts = cells.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), so_far(over).alias("_start"))
    within = dealt.withColumn("_within", so_far(W.partitionBy(*keys, "_range").orderBy(*order)))
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return within.join(starts, same).select(*df.columns, (F.col("_start") + F.col("_within")).alias(name))


def rank(df: DataFrame, keys: list[str], order: Order, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: how many rows of the same ``keys`` come before in ``order``."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name).drop("_one")
