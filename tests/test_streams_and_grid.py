"""Streams with late rows, restarts and repeated batches; the grid of settings."""

import datetime as dt
import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import modality, split
from tessera.sources import sinks
from tessera.sources.scratch import folder
from tessera.streaming import streams as R

KEYS = ["round", "client"]


def put(path, name, rows):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name}.json", "w") as f:
        for minute, r, c, loss in rows:
            ts = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)
            f.write(json.dumps({"event": "step", "context": {"round": r, "client": c, "loss": loss, "ts": ts.isoformat()}}) + "\n")


def run(spark, path, out, checkpoint):
    R.running_totals(R.trace(spark, path).select("event", "context.*"), KEYS, R.LOSSES, out, checkpoint, late="1 hour", width="1 hour").awaitTermination()
    return {(r["round"], r["client"]): (r["n"], r["loss"]) for r in R.read_totals(spark, out, KEYS, ["n", "loss"]).collect()}


def summed(*parts):
    n, loss = Counter(), Counter()
    for part in parts:
        for _, r, c, x in part:
            n[r, c] += 1
            loss[r, c] += x
    return {k: (n[k], pytest.approx(loss[k])) for k in n}


def test_late_rows_restart_and_repeated_batch(spark):
    path, out, ck = (folder(spark, x) for x in ("log", "out", "ck"))
    first = [(m, m % 3, m % 2, m / 8) for m in range(300)]
    put(path, "a", first)
    assert run(spark, path, out, ck) == summed(first)
    # A restart: rows of an open window count, rows of windows that the watermark (300 - 60) has passed do not.
    second = [(m, 1, 1, 0.5) for m in (250, 299, 301, 400)]
    put(path, "b", [*second, (10, 2, 0, 99.0), (170, 2, 0, 99.0)])
    want = summed(first, second)
    assert run(spark, path, out, ck) == want
    # The last batch runs again, as after a failure between its write and its commit: nothing changes.
    commits = sorted((int(f) for f in os.listdir(f"{ck}/commits") if f.isdigit()))
    before = sorted(os.listdir(out))
    for f in (str(commits[-1]), f".{commits[-1]}.crc"):
        if os.path.exists(f"{ck}/commits/{f}"):
            os.remove(f"{ck}/commits/{f}")
    assert run(spark, path, out, ck) == want and sorted(os.listdir(out)) == before
    third = [(1000, 5, 0, 1.0)]
    put(path, "c", third)
    assert run(spark, path, out, ck) == summed(first, second, third)


def test_a_stream_without_rows_gives_an_empty_table(spark):
    path, out, ck = (folder(spark, x) for x in ("log", "out", "ck"))
    os.makedirs(path)
    assert run(spark, path, out, ck) == {}


def test_windows_of_a_stream_are_those_of_the_batch(spark):
    path, out, ck = (folder(spark, x) for x in ("log", "out", "ck"))
    rows = [(m * 7, m % 3, m % 2, 0.25) for m in range(200)]
    put(path, "a", rows)
    run(spark, path, out, ck)
    table = spark.read.schema(R.TRACE).json(path).select("event", "context.*")
    batch = sorted(map(tuple, R.windowed(table, KEYS, R.LOSSES, "1 hour").collect()))
    assert sorted(map(tuple, R.read_totals(spark, out, KEYS, ["n", "loss"], by_window=True).collect())) == batch


def test_grid_of_settings(spark):
    labels = ["a", "b"]
    base = spark.range(4000).select("id", F.element_at(F.array(*map(F.lit, labels)), (F.col("id") % 2 + 1).cast("int")).alias("label"), F.lit("i").alias("img"), F.lit("t").alias("text"))
    modals = modality.modal_settings([0.3, 0.5], [(1, 3)], [0.6])
    own, placed = split.placements(base, labels, 4, [0.5], 7)
    stats = ["iid", "dir_0.5"]
    grid = modality.setting_grid(own.select("id", "label", "img", "text", placed.alias("p")), F.col("p"), modality.settings_table(spark, stats, modals, 4, 7), 7).drop("p")
    rows = grid.groupBy("stat", "modal").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.avg(F.col("img").isNull().cast("int")).alias("no_img"), F.count_if(F.col("img").isNull() & F.col("text").isNull()).alias("none")).collect()
    assert len(rows) == 10 and all(r["n"] == r["ids"] == 4000 and r["none"] == 0 for r in rows)
    for r in rows:
        want = {"aligned": 0, "missing_0.3": 0.255, "missing_0.5": 0.375, "hybrid_0.6": 0.4 - 0.08}.get(r["modal"])
        assert want is None or abs(r["no_img"] - want) < 0.035
    sizes = grid.filter("stat = 'iid' and modal = 'aligned'").groupBy("client", "label").count().collect()
    assert {r["count"] for r in sizes} == {500}
    # Settings draw apart: what is missing in one split is not what is missing in the other.
    both = grid.filter("modal = 'missing_0.5'").groupBy("id").agg(F.collect_set(F.col("img").isNull()).alias("x")).filter("size(x) = 2").count()
    assert both > 1000
    cross = grid.filter("modal = 'cross_1_3'").groupBy("stat", "client").agg(F.count("img").alias("i"), F.count("text").alias("t")).collect()
    assert Counter((r["stat"], r["i"] > 0) for r in cross) == {("iid", True): 1, ("iid", False): 3, ("dir_0.5", True): 1, ("dir_0.5", False): 3} and all((r["i"] > 0) != (r["t"] > 0) for r in cross)
    path = folder(spark, "grid")
    sinks.setting_shards(grid, path, 1, rows_per_file=900)
    back = spark.read.json(path)
    assert back.count() == 40_000 and back.groupBy("stat", "modal").count().count() == 10
    assert max(r["count"] for r in back.groupBy(F.input_file_name()).count().collect()) <= 900
