"""Checks on splits: exact cover, conflicts, alignment, expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exact_cover(central: DataFrame, split: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: repeated, missing and extra ids, and whether all are 0."""
    both = central.groupBy(id_col).agg(F.lit(1).alias("in_a")).join(split.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")), id_col, "full")
    out = both.agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("in_a").isNull()).alias("extra"))
    return out.withColumn("ok", F.expr("repeated + missing + extra = 0"))


def conflicting_labels(df: DataFrame, id_col: str = "id") -> DataFrame:
    return df.groupBy(id_col).agg(F.countDistinct("label").alias("labels"), F.count(F.lit(1)).alias("rows")).filter("labels > 1")


def unit_alignment(questions: DataFrame, annotations: DataFrame, clients: int, least_units: int, groups: DataFrame | None = None, least_groups: int = 0, unit: str = "image_id") -> DataFrame:
    """Per client: units, questions, questions without annotation (issue), annotations without
    question (warning), and whether the sizes suffice.  With ``groups`` (``unit, grp``) also
    ``coverage``, the groups that its units have, and ``coverage_share`` of all groups."""
    q = questions.select("client", "question_id", unit)
    a = annotations.select("client", "question_id").distinct()
    own = q.groupBy("client").agg(F.countDistinct(unit).alias("units"), F.count(F.lit(1)).alias("questions"))
    bare = q.join(a, ["client", "question_id"], "left_anti").groupBy("client").agg(F.count(F.lit(1)).alias("unannotated"))
    lost = a.join(q.select("client", "question_id").distinct(), ["client", "question_id"], "left_anti").groupBy("client").agg(F.count(F.lit(1)).alias("unasked"))
    base = questions.sparkSession.range(clients).select(F.col("id").cast("int").alias("client"))
    out = base.join(own, "client", "left").join(bare, "client", "left").join(lost, "client", "left").na.fill(0)
    ok = (F.col("unannotated") == 0) & (F.col("units") >= least_units)
    if groups is None:
        return out.withColumn("ok", ok)
    # Units of a client are few against its questions: one row each meets its group.
    met = q.select("client", F.col(unit).alias("unit")).distinct().join(groups.select("unit", "grp"), "unit")
    seen = met.groupBy("client").agg(F.countDistinct("grp").alias("coverage"))
    total = groups.agg(F.countDistinct("grp").alias("_groups"))
    both = out.join(seen, "client", "left").na.fill(0, ["coverage"]).join(F.broadcast(total))
    share = F.when(F.col("_groups") > 0, F.col("coverage") / F.col("_groups")).otherwise(0.0)
    return both.withColumn("coverage_share", share).withColumn("ok", ok & (F.col("coverage") >= least_groups)).drop("_groups")


def repair_report(before: DataFrame, after: DataFrame, clients: int, label: str = "label", id_col: str = "id") -> DataFrame:
    """One row on a repaired assignment: ``rows`` and those ``moved``, ``routes`` (pairs of clients
    that rows moved between), ids on one side only (``lost``, ``added``), and the smallest client,
    the fewest labels of a client and the empty clients ``before`` and ``after``."""

    def sizes(df: DataFrame, when: str) -> DataFrame:
        cells = df.groupBy("client", label).agg(F.count(F.lit(1)).alias("n"))
        per = cells.groupBy("client").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
        all_ = df.sparkSession.range(clients).select(F.col("id").cast("int").alias("client")).join(per, "client", "left").na.fill(0, ["n", "k"])
        return all_.agg(F.min("n").alias(f"smallest_{when}"), F.min("k").alias(f"fewest_labels_{when}"), F.count_if(F.col("n") == 0).alias(f"empty_{when}"))

    both = before.select(id_col, F.col("client").alias("a")).join(after.select(id_col, F.col("client").alias("b")), id_col, "full")
    routes = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    away = F.col("a") != F.col("b")
    report = routes.agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(away, F.col("n"))), F.lit(0)).alias("moved"), F.count_if(away).alias("routes"),
        F.coalesce(F.sum(F.when(F.col("b").isNull(), F.col("n"))), F.lit(0)).alias("lost"), F.coalesce(F.sum(F.when(F.col("a").isNull(), F.col("n"))), F.lit(0)).alias("added"),
    )
    return report.join(sizes(before, "before")).join(sizes(after, "after"))


def failed_rules(df: DataFrame, rules: dict[str, Column], *by: str) -> DataFrame:
    """``rule, rows``: how many rows break each rule; a rule is what must hold."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(*by, F.explode(broken).alias("rule")).groupBy(*by, "rule").agg(F.count(F.lit(1)).alias("rows"))


def expected_counts(df: DataFrame, expected: dict[str, int], column: str = "split") -> DataFrame:
    """``split, rows, expected, ok`` of every split on either side."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected long")
    have = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    both = have.join(F.broadcast(want), column, "full").select(column, F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("expected", F.lit(0)).alias("expected"))
    return both.withColumn("ok", F.col("rows") == F.col("expected"))


def split_check(df: DataFrame, labels: list[str], clients: int) -> DataFrame:
    """Per ``stat, modal`` setting: rows, clients with rows, empty clients, rows
    without any modality, unknown labels, aligned rows with a gap."""
    none = F.col("img").isNull() & (F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0)
    gap = F.col("img").isNull() | (F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0)
    return df.groupBy("stat", "modal").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("client").alias("with_rows"), (clients - F.countDistinct("client")).alias("empty_clients"), F.count_if(none).alias("both_missing"),
        F.count_if(~F.coalesce(F.col("label").isin(labels), F.lit(False))).alias("bad_labels"), F.count_if(gap & (F.col("modal") == "aligned")).alias("aligned_gaps"),
    )


def id_set_checks(questions: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row: repeated question ids on both sides, and the set differences."""
    repeats = lambda df: df.agg((F.count("question_id") - F.countDistinct("question_id")).alias("n"))
    ids = lambda df: df.select("question_id").distinct()
    q, a = ids(questions), ids(annotations)
    q_only = q.subtract(a).agg(F.count(F.lit(1)).alias("questions_only"))
    a_only = a.subtract(q).agg(F.count(F.lit(1)).alias("annotations_only"))
    return repeats(questions).withColumnRenamed("n", "repeated_questions").join(repeats(annotations).withColumnRenamed("n", "repeated_annotations")).join(q_only).join(a_only)
