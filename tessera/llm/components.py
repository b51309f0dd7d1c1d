"""Connected components by repeated contraction, entirely on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, jumps: int = 2) -> DataFrame:
    """``(a, b)`` long pairs -> ``(node, component)``: the smallest id reachable.

    Each round hooks every vertex to its smallest neighbour, follows those
    pointers ``jumps`` times, renames the edges and drops loops and repeats,
    so the edge table shrinks geometrically.  Rounds are written tables in the
    shared folder.  Loops and null ends are ignored; only nodes that have an
    edge to another node are returned.  Skewed pointers (one node that very
    many others point to) are left to adaptive skew joins: the pointer table
    is unique on its key.
    """
    left = written(_clean(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    found: DataFrame | None = None
    while not left.isEmpty():
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        for _ in range(jumps):
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            parent = parent.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up"))
        parent = written(parent, "parents")
        if found is None:
            found = parent.select("node", F.col("up").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "up")
            found = found.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        of_a = parent.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        of_b = parent.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        renamed = left.join(of_a, "a").join(of_b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        left = written(_clean(renamed), "edges")
    if found is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return written(found, "components")


def _clean(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
