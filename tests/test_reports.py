"""Diagnostics, batch weights, round times, coverage and annotations on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E
from tessera.operators import joins as J
from tessera.operators import validate


def test_abnormal_outputs(spark):
    rows = [("cat", "cat", "cat"), ("cat", "Cat!", "cat"), ("dog", "it is a dog", "dog"), ("dog", " ", "UNK"), ("dog", None, None), ("cow", "who knows", "Not sure")]
    got = E.abnormal_outputs(spark.createDataFrame(rows, "gt string, raw string, pred string"), ["cat", "dog", "hen"]).first()
    assert (got["n"], got["raw_empty"], got["out_of_set"], got["fallback"], got["unknown"]) == (6, 2, 3, 1, 2)
    assert got["missing_labels"] == ["hen"] and got["fallback_share"] == pytest.approx(1 / 6)
    empty = E.abnormal_outputs(spark.createDataFrame([], "gt string, raw string, pred string"), ["cat"]).first()
    assert empty["n"] == 0 and empty["raw_empty_share"] == 0 and empty["missing_labels"] == ["cat"]


def test_batch_means_are_weighted_by_size(spark):
    rows = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, None), (1, 10.0, None), (2, 4.0, 0.0), (2, 4.0, 1.0), (2, 4.0, 1.0)], "b int, x double, y double")
    got = E.batch_weighted(rows, ["b"], ["x", "y"]).first()
    assert got["x"] == pytest.approx(26 / 6) and got["y"] == pytest.approx(3 / 4) and got["batches"] == 3


def test_round_times_need_a_start_and_an_end(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(0, "start", at(5)), (0, "start", at(9)), (0, "step", at(99)), (0, "end", at(11)), (1, "start", at(20)), (2, "end", at(30)), (3, "start", at(50)), (3, "end", at(40))]
    got = {r["round"]: (r["seconds"], r["mean_seconds"]) for r in E.round_times(spark.createDataFrame(rows, "round int, event string, ts timestamp"), "start", "end").collect()}
    assert got == {0: (6.0, 3.0), 1: (None, 3.0), 2: (None, 3.0), 3: (0.0, 3.0)}


def test_alignment_counts_groups(spark):
    q = spark.createDataFrame([(0, 1, 10), (0, 2, 11), (0, 3, 11), (1, 4, 12)], "client int, question_id int, image_id int")
    a = q.select("client", "question_id").unionByName(spark.createDataFrame([(1, 99)], "client int, question_id int"))
    groups = spark.createDataFrame([(10, "x"), (11, "y"), (12, "x"), (13, "z")], "unit int, grp string")
    got = {r["client"]: (r["units"], r["unasked"], r["coverage"], round(r["coverage_share"], 3), r["ok"]) for r in validate.unit_alignment(q, a, 3, 1, groups, 2).collect()}
    assert got == {0: (2, 0, 2, 0.667, True), 1: (1, 1, 1, 0.333, False), 2: (0, 0, 0, 0.0, False)}


def test_last_annotation_and_own_choice_win(spark):
    q = spark.range(1, 5).select(F.col("id").alias("question_id"))
    notes = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "old"), (2, 2, " "), (3, 5, None)], "question_id long, ordinal int, choice string")
    answers = spark.createDataFrame([(1, "a", 1), (2, "The Cat", 1), (2, "dog", 2), (2, "cat", 3), (3, "b", 1)], "question_id long, answer string, ordinal int")
    got = {r["question_id"]: (r["answer"], r["annotated"]) for r in J.questions_with_answers(q, notes, answers).collect()}
    assert got == {1: ("new", True), 2: ("The Cat", True), 3: ("b", True), 4: (None, False)}
