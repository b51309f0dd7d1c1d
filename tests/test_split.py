"""Invariants of the splits, and that results do not depend on partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.rng import exact_rank, permutation_keys, permuted, u
from tessera.operators import modality, split

LABELS = ["a", "b", "c"]


def data(spark, n=3000):
    return spark.range(n).select("id", F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("id") % 7 % 3 + 1).cast("int")).alias("label"))


def test_exact_rank_is_row_number(spark):
    own = data(spark).withColumn("_u", u(1, "x", "id"))
    got = {r["id"]: r["rank"] for r in exact_rank(own, ["label"], "_u", ["id"]).collect()}
    rows = sorted((r["label"], r["_u"], r["id"]) for r in own.collect())
    seen, want = {}, {}
    for label, _, i in rows:
        want[i] = seen.get(label, 0)
        seen[label] = want[i] + 1
    assert got == want


def test_split_does_not_depend_on_partitions(spark):
    shares = split.dirichlet_shares(LABELS, 5, 0.5, 3)
    rows = lambda df: sorted(map(tuple, split.dirichlet_assign(df, shares, 3).select("id", "client").collect()))
    one = rows(data(spark).coalesce(1))
    assert one == rows(data(spark).repartition(64)) and len(one) == 3000


def test_dirichlet_split_follows_the_shares(spark):
    shares = split.dirichlet_shares(LABELS, 5, 0.5, 3)
    counts = split.dirichlet_assign(data(spark, 30000), shares, 3).groupBy("label", "client").count().collect()
    n = split.label_counts(data(spark, 30000))
    chi = {k: 0.0 for k in LABELS}
    for r in counts:
        want = n[r["label"]] * shares[r["label"]][r["client"]]
        chi[r["label"]] += (r["count"] - want) ** 2 / max(want, 1e-9)
    assert max(chi.values()) < 25


def test_round_robin_sizes_are_even(spark):
    sizes = [r["count"] for r in split.stratified_round_robin(data(spark), 7, 1).groupBy("client").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= len(LABELS)


def test_repairs_cover_all_rows_and_reach_their_floor(spark):
    own = split.dirichlet_assign(data(spark), split.dirichlet_shares(LABELS, 8, 0.1, 5), 5)
    matrix = split.count_matrix(own, 8, LABELS)
    floor = 100
    moves = split.small_client_plan(matrix, floor)
    out = split.apply_moves(own, moves, LABELS, 5)
    sizes = {r["client"]: r["count"] for r in out.groupBy("client").count().collect()}
    assert sum(sizes.values()) == 3000 == out.select("id").distinct().count()
    assert len(sizes) == 8 and min(sizes.values()) >= floor


def test_constraint_plan_meets_its_limits():
    matrix = np.array([[50, 0, 0, 0], [0, 3, 90, 40], [2, 60, 0, 0], [0, 0, 0, 0]])
    moves, unmet = split.constraint_plan(matrix, 2, 20)
    now = matrix.copy()
    for src, g, dst, k in moves:
        now[src, g] -= k
        now[dst, g] += k
    assert not unmet and now.min() >= 0 and now.sum() == matrix.sum()
    assert (now.sum(1) >= 20).all() and ((now > 0).sum(1) >= 2).all()


def test_empty_clients_get_one_row():
    moves = split.empty_client_plan(np.array([[0, 0], [5, 5], [0, 0]]), ["a", "b"])
    assert sorted((s, d, k) for s, _, d, k in moves) == [(1, 0, 1), (1, 2, 1)]


def test_too_many_samples_are_refused(spark):
    with pytest.raises(ValueError):
        split.uniform_sampling(data(spark, 30), 4, 10)
    with pytest.raises(ValueError):
        split.sample("nothing", data(spark, 3), LABELS, 2)


def test_masks_never_leave_a_row_without_modality(spark):
    rows = spark.range(20000).select("id", F.lit("i").alias("img"), F.lit("t").alias("text"))
    for masked in (modality.bernoulli(rows, 0.3, 1), modality.hybrid(rows, 0.6, 1)):
        assert masked.filter("img is null and text is null").count() == 0
    missing = modality.bernoulli(rows, 0.3, 1).filter("img is null").count() / 20000
    assert abs(missing - (0.3 - 0.3**2 / 2)) < 0.012


def test_exact_missing_rounds_half_to_even(spark):
    rows = spark.range(25).select("id", F.lit(0).alias("client"), F.lit("i").alias("img"), F.lit("t").alias("text"))
    assert modality.exact_missing(rows, 0.1, "image", 1).filter("img is null").count() == 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_keyed_permutations_are_permutations(spark, n):
    own = spark.range(n).select("id", F.lit(n).alias("n"), F.lit(5).alias("client")).withColumn("keys", permutation_keys(3, "p", "n", "client"))
    out = [r["at"] for r in own.select(permuted("id", "n", "keys", 3, "p", "client").alias("at")).collect()]
    assert sorted(out) == list(range(n)) and (n < 50 or sum(a == i for i, a in enumerate(out)) < n / 4)


def test_clients_draw_independently(spark):
    """Overlaps of two clients that draw k of n rows follow the hypergeometric law."""
    n, k, clients = 400, 60, 60
    rows = split.iid_sampling(spark.range(n), clients, k, 9).collect()
    held = [set() for _ in range(clients)]
    for r in rows:
        held[r["client"]].add(r["id"])
    assert all(len(h) == k for h in held)
    overlaps = [len(held[a] & held[b]) for a in range(clients) for b in range(a)]
    mean, var = k * k / n, k * k / n * (1 - k / n) * (n - k) / (n - 1)
    assert abs(np.mean(overlaps) - mean) < 0.3 and 0.8 < np.var(overlaps) / var < 1.25
    times = np.bincount([r["id"] for r in rows], minlength=n)
    assert 0.75 < times.var() / (clients * k / n * (1 - k / n)) < 1.3


def test_draws_take_only_rows_of_their_label(spark):
    own = data(spark, 2000)
    wanted = spark.createDataFrame([(c, label, k) for c in range(3) for label, k in (("a", 0), ("b", 50), ("c", 5000))], "client int, label string, k long")
    rows = split.draw(own, wanted, 3).join(own.withColumnRenamed("label", "own"), "id").collect()
    sizes = {}
    for r in rows:
        assert r["label"] == r["own"]
        sizes.setdefault((r["client"], r["label"]), []).append(r["id"])
    assert {k: len(v) for k, v in sizes.items()} == {(c, x): n for c in range(3) for x, n in (("b", 50), ("c", 5000))}
    assert all(len(set(v)) == 50 for (_, x), v in sizes.items() if x == "b")


def test_no_sample_number_asks_for_an_equal_part(spark):
    own = data(spark, 300)
    for name in ("uniform", "iid", "pathological", "dirichlet"):
        n = {r["client"]: r["count"] for r in split.sample(name, own, LABELS, 4, alpha=2 if name == "pathological" else 0.5).groupBy("client").count().collect()}
        assert n == {c: 37 * 2 if name == "pathological" else 75 for c in range(4)}


def test_domains_are_sampled_apart(spark):
    own = data(spark, 900).withColumn("domain", F.concat(F.lit("d"), (F.col("id") % 2).cast("string")))
    for name in split.SAMPLERS:
        for test in (False, True):
            rows = split.domain_sampling(name, own, ["d1", "d0"], 3, LABELS, 0 if test else 60, 1, 4, test).collect()
            by = {}
            for r in rows:
                by.setdefault(r["client"], []).append(r["id"])
                assert r["id"] % 2 == (1 if r["client"] < 3 else 0)
            assert sorted(by) == list(range(6)) and {len(v) for v in by.values()} == {450 if test else 60}
            if test:
                assert sorted(by[0]) == sorted(by[1]) and sorted(by[4]) == sorted(by[5])
    with pytest.raises(ValueError):
        split.domain_sampling("uniform", own, ["d1"], 3, LABELS, 200)


def test_retried_quotas_reach_the_floor_or_are_the_best_draw():
    counts = {"a": 500, "b": 300, "c": 200}
    for clients, alpha, retries in ((4, 0.5, 100), (8, 0.05, 5), (3, 100.0, 1)):
        got = split.retried_quotas(counts, clients, alpha, 11, retries)
        draws = [split.multinomial_quotas(counts, split.dirichlet_shares(sorted(counts), clients, alpha, 11 + k), 11 + k) for k in range(retries)]
        size = lambda quotas: np.bincount([c for _, c, lo, hi in quotas for _ in range(hi - lo)], minlength=clients)
        floor = split.smallest_allowed(1000, clients)
        if any(size(q).min() >= floor for q in draws):
            assert got == next(q for q in draws if size(q).min() >= floor)
        else:
            assert size(got).min() == max(size(q).min() for q in draws)
        for label, n in counts.items():  # every row once
            cuts = sorted((lo, hi) for x, _, lo, hi in got if x == label and hi > lo)
            assert cuts[0][0] == 0 and cuts[-1][1] == n and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:]))


def test_copies_of_a_row_do_not_depend_on_blocks(spark, monkeypatch):
    from tessera.functions import rng

    monkeypatch.setattr(rng, "BLOCK", 8)
    own = rng.numbered(spark.createDataFrame([("a", 17), ("b", 8), ("c", 0)], "k string, n long"), "n", "i", ["k"]).collect()
    assert sorted((r["k"], r["i"]) for r in own) == [("a", i) for i in range(17)] + [("b", i) for i in range(8)]
