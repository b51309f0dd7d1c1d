"""Ranks of skewed values, client pairs from bits, bounded shards, batches by length."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.order import rank, running
from tessera.operators import evaluate as E
from tessera.operators import state as A
from tessera.operators import tokens as K
from tessera.sources import sinks
from tessera.sources.scratch import folder


def test_ranks_of_one_large_class_with_skewed_scores(spark):
    rng = random.Random(4)
    rows = [(i, "big" if i % 100 else "small", rng.choice([0.0, 1e-300, rng.paretovariate(0.3), -1e300])) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, k string, s double").repartition(3)
    got = {r["id"]: r["rank"] for r in rank(df, ["k"], ["s", "id"]).collect()}
    for k in ("big", "small"):
        order = sorted((s, i) for i, x, s in rows if x == k)
        assert [got[i] for _, i in order] == list(range(len(order)))
    # No task holds the large class whole: it lies in several ranges.
    plan = df.repartitionByRange(4, "k", "s", "id").select(F.spark_partition_id().alias("p"), "k").filter("k = 'big'").distinct().count()
    assert plan >= 3


def test_running_sums_with_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, 6), ("a", 1, 7), ("a", None, 8)], "k string, o int, v int")
    assert sorted((r["v"], r["x"]) for r in running(df, ["k"], [F.asc_nulls_last("o")], "v", "x").collect()) == [(5, 0), (6, 5), (7, 0), (8, 7)]
    assert running(df.limit(0), ["k"], ["o"], "v", "x").count() == 0 and rank(df.limit(0), [], ["o"]).count() == 0


def test_auc_of_a_class_with_nearly_all_rows(spark):
    rng = random.Random(2)
    rows = [("x" if i % 100 else "y", [a := rng.choice([0.9, rng.random() ** 9]), 1 - a]) for i in range(3000)]
    df = spark.createDataFrame(rows, "gt string, score_vector array<double>")
    got = {r["label"]: r["auc"] for r in E.class_auc(E.valid_scores(df, ["x", "y"]), ["x", "y"]).collect()}
    for label, k in (("x", 0), ("y", 1)):
        pos, neg = ([s[k] / sum(s) for g, s in rows if (g == label) == yes] for yes in (True, False))
        wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
        assert got[label] == pytest.approx(wins / len(pos) / len(neg))


def test_critical_masks_of_values_that_differ_when_computed_again(spark):
    # Sums of floats depend on the order in which shuffled rows arrive.
    again = F.udf(lambda x: x * (1 + random.SystemRandom().random() * 1e-12), "double").asNondeterministic()
    df = spark.createDataFrame([(c, k, p, float(p * 7 % 20 + 1)) for c in range(8) for k in ("a", "b") for p in range(20)], "client int, key string, pos int, v double")
    rows = df.select("client", "key", "pos", again("v").alias("w")).withColumn("d", F.col("w") * 0.5)
    got = sorted((r["client"], r["key"], r["pos"]) for r in A.critical_mask(rows, 0.3).filter("mask").collect())
    assert got == [(c, k, p) for c in range(8) for k in ("a", "b") for p in range(20) if p * 7 % 20 >= 14]


def test_overlap_of_masks_of_values_that_differ_when_computed_again(spark):
    again = F.udf(lambda x: x * (1 + random.SystemRandom().random() * 1e-12), "double").asNondeterministic()
    df = spark.createDataFrame([(c, "k", p, float((p + 2 * c) % 20 + 1)) for c in range(6) for p in range(20)], "client int, key string, pos int, v double")
    rows = df.select("client", "key", "pos", again("v").alias("w")).withColumn("d", F.col("w") * 0.5)
    held = {c: {p for p in range(20) if (p + 2 * c) % 20 >= 14} for c in range(6)}
    got = {(r["i"], r["j"]): r["overlap"] for r in A.mask_overlap(A.critical_mask(rows, 0.3)).collect()}
    assert got == {(i, j): pytest.approx(len(held[i] & held[j]) / 6) for i in held for j in held if i != j}


def test_client_pairs_from_bits(spark):
    rng = random.Random(3)
    held = {(c, k, p): rng.random() < 0.4 for c in range(5) for k in ("a", "b") for p in (*range(300), 4095, 4096, 70_000) if rng.random() < 0.8 and (c, k) != (4, "b")}
    df = spark.createDataFrame([(*x, m) for x, m in held.items()], "client int, key string, pos int, mask boolean")
    got = {(r["i"], r["j"]): (r["cells"], r["differ"], r["ones"]) for r in A.client_pairs(df).collect()}
    over = {(r["i"], r["j"]): r["overlap"] for r in A.mask_overlap(df).collect()}
    for i in range(5):
        for j in range(5):
            both = [x for x in held if x[0] == i and (j, *x[1:]) in held]
            if i != j:
                differ, ones = sum(held[x] != held[j, *x[1:]] for x in both), sum(held[x] for x in both)
                assert got[i, j] == (len(both), differ, ones) and over[i, j] == pytest.approx(1 - differ / (2 * ones))
    assert len(got) == 20


def test_client_pairs_with_null_masks_and_with_none_set(spark):
    rng = random.Random(5)
    held = {(c, "k", p): None if c == 3 or rng.random() < 0.3 else c != 2 and rng.random() < 0.4 for c in range(5) for p in (*range(100), 5000)}
    held |= {(5, "k", p): False if held[2, "k", p] is not None else None for p in range(100)}
    df = spark.createDataFrame([(*x, m) for x, m in held.items()], "client int, key string, pos int, mask boolean")
    got = {(r["i"], r["j"]): (r["cells"], r["known"], r["differ"], r["ones"]) for r in A.client_pairs(df).collect()}
    over = {(r["i"], r["j"]): r["overlap"] for r in A.mask_overlap(df).collect()}
    for i, j in ((i, j) for i in range(6) for j in range(6) if i != j):
        both = [(m, held[j, *x[1:]]) for x, m in held.items() if x[0] == i and (j, *x[1:]) in held]
        known = [(a, b) for a, b in both if a is not None and b is not None]
        differ, ones = sum(a != b for a, b in known), sum(bool(a) for a, _ in both)
        assert got[i, j] == (len(both), len(known), differ, ones)
        want = None if not known else 1 - differ / (2 * ones) if ones else float("-inf") if differ else float("nan")
        assert over[i, j] == (want if want is None else pytest.approx(want, nan_ok=True))
    assert over[2, 0] == float("-inf") and over[2, 5] != over[2, 5] and over[3, 0] is None and len(over) == 30


def test_customised_average_of_collaborators(spark):
    state = spark.createDataFrame([(c, "k", p, float(10 * c + p)) for c in range(4) for p in range(3) if (c, p) != (2, 1)], "client int, key string, pos int, value double")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (3, 2)], "i int, j int")
    got = {(r["client"], r["pos"]): r["custom"] for r in A.customised(state, pairs).collect()}
    value = {(r["client"], r["pos"]): r["value"] for r in state.collect()}
    for c, circle in ((0, (0, 1, 2)), (1, (1,)), (2, (2,)), (3, (3, 2))):
        for p in range(3):
            own = [value[j, p] for j in circle if (j, p) in value]
            assert got.get((c, p)) == (pytest.approx(sum(own) / len(own)) if own else None)


def test_shards_hold_no_more_rows_than_they_may(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(1).cast("int").alias("client_id"))
    path = folder(spark, "shards")
    sinks.client_shards(rows, path, 3, rows_per_file=150)
    seen, sizes = {}, []
    for base, _, files in os.walk(path):
        for f in sorted(x for x in files if x.endswith(".json")):
            own = [r["id"] for r in spark.read.schema("id long").json(f"{base}/{f}").collect()]
            sizes.append(len(own))
            seen.setdefault(base, []).extend(own)
    assert max(sizes) <= 150 and sorted(i for v in seen.values() for i in v) == list(range(2000))
    from tessera.functions.rng import u

    order = {r["id"]: r["u"] for r in rows.select("id", u(3, "order", "id").alias("u")).collect()}
    for own in seen.values():
        assert own == sorted(own, key=order.get) and (len(own) < 5 or own != sorted(own))


def test_batches_by_length_fill_up_least(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(1, 9) for _ in range(rng.choice([0, 1, 3, 40, 41, 200]))]) for i in range(230)]
    df = spark.createDataFrame(rows, "id long, input_ids array<int>").repartition(5)
    own, width = dict(rows), {}
    got = K.batches(df, 16, 120, by_length=True, left=True).collect()
    for r in got:
        ids = own[r["id"]][:120]
        assert r["input_ids"] == [0] * (len(r["input_ids"]) - len(ids)) + ids and r["mask"] == [0] * (len(r["mask"]) - len(ids)) + [1] * len(ids)
        width.setdefault(r["batch"], set()).add(len(r["input_ids"]))
    order = sorted(own, key=lambda i: (-len(own[i]), i))
    assert {r["id"]: r["batch"] for r in got} == {i: k // 16 for k, i in enumerate(order)}
    assert all(len(w) == 1 for w in width.values()) and [width[b] for b in sorted(width)] == [{min(120, len(own[order[16 * b]]))} for b in range(15)]
    prompts = K.prompt_batches(df.select("id", F.col("input_ids").alias("prompt"), F.lit(1).alias("answer")), 16).collect()
    for b in range(15):
        part = sorted((r for r in prompts if r["batch"] == b), key=lambda r: r["place"])
        assert [r["id"] for r in part] == sorted(range(16 * b, min(230, 16 * b + 16)), key=lambda i: (-len(own[i]), i))
        assert len({len(r["prompt"]) for r in part}) == 1 and all(r["prompt"][len(r["prompt"]) - len(own[r["id"]]) :] == own[r["id"]] for r in part)
