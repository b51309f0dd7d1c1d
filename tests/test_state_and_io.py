"""Server rules, sources, sinks and streams on small tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import state as A
from tessera.plans import catalog
from tessera.registry import Registry
from tessera.sources import readers, sinks
from tessera.sources.scratch import folder
from tessera.streaming.streams import Hooks

ROWS = [(0, c, "k", p, float(c + p)) for c in range(3) for p in range(4)]


def state(spark, weight):
    return spark.createDataFrame([(*r, weight(r[1])) for r in ROWS], "round int, client int, key string, pos int, value double, sample_num double")


def test_equal_weights_are_the_mean(spark):
    s = state(spark, lambda c: 5.0)
    got = {r["pos"]: r["value"] for r in A.weighted_average(s, ["key", "pos"]).collect()}
    assert got == {p: pytest.approx(1 + p) for p in range(4)}


def test_equal_steps_make_normalised_averaging_plain(spark):
    s = state(spark, lambda c: 1.0 + c)
    clients = A.local_steps(s.select("client", "sample_num").distinct().withColumn("tau", F.lit(3.0)))
    before = s.groupBy("key", "pos").agg(F.lit(0.5).alias("w"))
    got = {r["pos"]: r["w"] for r in A.normalised_average(s.drop("sample_num"), before, clients).collect()}
    want = {r["pos"]: r["value"] for r in A.weighted_average(s, ["key", "pos"]).collect()}
    assert got == pytest.approx(want)


def test_rule_by_name():
    assert [A.pick_rule(n) for n in ("FedAdagrad-fedprox-adaptive", "fedprox", "SCAFFOLD-fedadam", "fedavgm")] == ["adagrad", "average", "scaffold", "momentum"]


def test_first_momentum_is_the_first_change(spark):
    changes = spark.createDataFrame([(0, "k", 0, 1.0), (1, "k", 0, 0.0)], "round int, key string, pos int, d double")
    assert A.server_rule(changes, "momentum").first()["w"] == pytest.approx(1.9)


def test_client_without_a_weight_keeps_its_control(spark):
    rows = spark.createDataFrame([(0.1, 0.05, 1.0, 0.5), (0.1, 0.05, 1.0, None)], "ci double, c double, w_before double, w_after double")
    assert [r["c_new"] for r in A.client_control(rows, 10, 0.1).collect()] == [pytest.approx(0.55), pytest.approx(0.1)]


@pytest.fixture(scope="module")
def odd_vectors(spark, tmp_path_factory):
    """Vectors of zeros only for client 3, with nulls at other places for each client."""
    rng, path = random.Random(6), tmp_path_factory.mktemp("odd")

    def vector(i):
        return [0.0 if i % 10 == 3 else None if (p + i % 10) % 4 == 0 else rng.uniform(-1, 1) for p in range(64)]

    rows = spark.createDataFrame([(i, vector(i), i // 10 % 3) for i in range(300)], "vec_id long, embedding array<float>, label int")
    rows.toPandas().to_parquet(path / "embeddings.parquet")
    return str(path)


def both_ways(spark, name, folder):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return [sorted(repr(tuple(r)) for r in rows) for rows in (catalog.queries()[name](spark, folder).collect(), c.execute(catalog.oracle_sql()[name]).fetchall())]


@pytest.mark.parametrize("name", ["a13_critical_mask", "a14_mask_overlap", "j09_pairwise_clients"])
def test_masks_of_zeros_and_nulls_match_sql(spark, odd_vectors, name):
    got, want = both_ways(spark, name, odd_vectors)
    assert got == want and len(got) >= 90


@pytest.mark.parametrize("name", ["a01_weighted_average", "a13_critical_mask", "a14_mask_overlap", "a15_customised_average", "a16_masked_merge", "j09_pairwise_clients"])
def test_null_short_and_long_vectors_match_sql(spark, tmp_path, name):
    rng, lengths = random.Random(7), {2: 0, 3: 40, 4: 80}
    rows = [(i, None if i % 10 == 5 else [rng.uniform(-1, 1) for _ in range(lengths.get(i % 10, 64))], i // 50 % 3) for i in range(300)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").toPandas().to_parquet(tmp_path / "embeddings.parquet")
    got, want = both_ways(spark, name, str(tmp_path))
    assert got == want and len(got) >= 90


def test_shards_are_refused_and_missing_ones_reported(spark):
    path = folder(spark, "t")
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, client_id int")
    sinks.client_shards(rows, path)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.client_shards(rows, path)
    flat = folder(spark, "t")
    for c in (0, 2):
        rows.filter(f"client_id = {c}").select("id").coalesce(1).write.json(f"{flat}/x{c}")
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(flat).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for c in (0, 2):
        part = [s.getPath() for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{flat}/x{c}/part-*.json"))][0]
        fs.rename(part, jvm.org.apache.hadoop.fs.Path(f"{flat}/client_{c}.jsonl"))
    with pytest.raises(FileNotFoundError, match=r"\[1\]"):
        readers.client_shards(spark, flat, "id long", 3)


def test_broken_lines_are_kept_apart(spark):
    path = folder(spark, "t")
    spark.createDataFrame([('{"id": 1}',), ("{broken",), ("",)], "value string").write.text(path)
    rows = readers.jsonl(spark, path, "id long").cache()
    assert rows.filter("_corrupt_record is null").count() == 1 and rows.filter("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception):
        readers.jsonl(spark, path, "id long", strict=True).collect()


def test_registry_and_hooks():
    r = Registry("task", "one")
    r.register("One")(len)
    assert r.get("ONE") is len and r.get() is len
    with pytest.raises(KeyError, match="known: one"):
        r.get("two")
    seen = []
    Hooks().on("end", lambda e, c: seen.append((e, c))).emit("end", round=1)
    assert seen == [("end", {"round": 1})]
