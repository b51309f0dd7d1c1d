"""Joins between sample, question, annotation and instance tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as T


def last_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row with the greatest ``ordinal`` of each key."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(ordinal)).alias("_r"))
    return top.select(*keys, "_r.*")


def first_per_key(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(ordinal)).alias("_r"))
    return top.select(*keys, "_r.*")


def primary_answer(answers: DataFrame, normal: Column | None = None) -> DataFrame:
    """``question_id, answer, n_answers`` of rows ``question_id, answer, ordinal``:
    the most common normalised answer, as it was first written; ties go to the
    answer that came first, then the greater one."""
    own = answers.withColumn("_n", T.vqa_answer("answer") if normal is None else normal)
    groups = own.groupBy("question_id", "_n").agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("first"), F.min_by("answer", "ordinal").alias("raw"))
    rank = F.struct(F.col("n"), -F.col("first"), F.col("raw"))
    return groups.groupBy("question_id").agg(F.max_by("raw", rank).alias("answer"), F.sum("n").alias("n_answers"))


def questions_with_answers(questions: DataFrame, annotations: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions left joined to their last annotation; the answer is the
    annotation's own choice, else (null or blank) the primary one of its answers."""
    one = last_per_key(annotations, ["question_id"], "ordinal").select("question_id", F.col("choice"))
    both = questions.join(one, "question_id", "left").join(primary_answer(answers), "question_id", "left")
    own = F.when(F.trim("choice") != "", F.col("choice"))
    return both.withColumn("answer", F.coalesce(own, F.col("answer"))).withColumn("annotated", F.col("choice").isNotNull() | F.col("n_answers").isNotNull())


def with_category(instances: DataFrame, categories: DataFrame, unknown: str = "unknown") -> DataFrame:
    """Adds ``supercategory``; categories are a small dimension, and Spark
    broadcasts them if their size allows."""
    return instances.join(categories, "category_id", "left").withColumn("supercategory", F.coalesce("supercategory", F.lit(unknown)))


def records_of(assignment: DataFrame, records: DataFrame, id_col: str = "id") -> DataFrame:
    return assignment.join(records, id_col)


def expand_units(assignment: DataFrame, questions: DataFrame, annotations: DataFrame, unit: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """All questions of the assigned units, and the annotations of those questions."""
    chosen = assignment.join(questions, unit)
    return chosen, annotations.join(chosen.select("question_id", "client"), "question_id")


def id_differences(central: DataFrame, split: DataFrame, id_col: str = "id", examples: int = 5) -> DataFrame:
    """``side, n, examples``: ids that only one of two tables has."""
    a, b = central.select(id_col).distinct(), split.select(id_col).distinct()
    sides = a.join(b, id_col, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, id_col, "left_anti").withColumn("side", F.lit("extra")))
    ranked = sides.withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(64)))
    # The smallest ids of 64 salted groups hold the smallest of all.
    near = ranked.withColumn("_r", F.row_number().over(W.partitionBy("side", "_b").orderBy(id_col))).filter(F.col("_r") <= examples)
    few = near.withColumn("_k", F.row_number().over(W.partitionBy("side").orderBy(id_col))).filter(F.col("_k") <= examples)
    lists = few.groupBy("side").agg(F.array_sort(F.collect_list(id_col)).alias("examples"))
    base = central.sparkSession.createDataFrame([("missing",), ("extra",)], "side string")
    return base.join(sides.groupBy("side").agg(F.count(F.lit(1)).alias("n")), "side", "left").join(lists, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"), "examples")


def label_conflicts(a: DataFrame, b: DataFrame, most: int = 10, id_col: str = "id") -> DataFrame:
    """The first ids that both tables have with different labels."""
    both = a.select(id_col, F.col("label").alias("label_a")).join(b.select(id_col, F.col("label").alias("label_b")), id_col)
    return both.filter("label_a <> label_b").orderBy(id_col).limit(most)


def overlap(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def missing_paths(refs: DataFrame, listing: DataFrame, roots: list[str], path: str = "path") -> DataFrame:
    """References whose path exists under none of the roots."""
    wide = refs.filter(F.col(path).isNotNull()).withColumn("_try", F.explode(F.array(*[F.concat(F.lit(r), F.col(path)) for r in roots])))
    found = wide.join(listing.select(F.col("path").alias("_try")).distinct(), "_try", "left_semi").select("id").distinct()
    return refs.filter(F.col(path).isNotNull()).join(found, "id", "left_anti")


def score_drop(scores: DataFrame, baseline: str) -> DataFrame:
    """``dataset, setting, drop``: the baseline's score less the setting's, to one digit."""
    base = F.broadcast(scores.filter(F.col("setting") == baseline).select("dataset", F.col("score").alias("base")))
    return scores.join(base, "dataset").select("dataset", "setting", F.round(F.col("base") - F.col("score"), 1).alias("drop"))
