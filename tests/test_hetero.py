"""Published client tables must give their known figures."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import draws
from tessera.functions.rng import u
from tessera.operators import hetero as H

#: Client sizes, label-1 counts, and mean KL, max KL, CV, Gini.
GOLDEN = {
    "iid": ([850] * 10, [305] * 10, (0.0, 0.0, 0.0, 0.0)),
    "dir_1.0": ([1118, 396, 310, 747, 910, 402, 1188, 1040, 204, 2185], [77, 352, 146, 658, 347, 349, 275, 472, 131, 243], (0.240363, 0.611595, 0.694277, 0.348965)),
    "dir_0.5": ([1400, 1031, 202, 1293, 789, 219, 207, 1194, 1403, 762], [139, 148, 96, 1284, 6, 185, 207, 894, 3, 88], (0.413440, 1.024925, 0.581482, 0.306682)),
    "dir_0.1": ([496, 286, 53, 2632, 696, 891, 1403, 703, 496, 844], [0, 0, 7, 0, 0, 292, 721, 703, 483, 844], (0.489898, 1.024925, 0.853093, 0.400659)),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_known_figures(spark, name):
    sizes, ones, want = GOLDEN[name]
    rows = [(c, str(k), n) for c, (s, o) in enumerate(zip(sizes, ones)) for k, n in ((0, s - o), (1, o))]
    counts = spark.createDataFrame(rows, "client int, label string, n long")
    kl = H.kl_to_global(counts)
    mean, top = kl.agg(F.avg("kl"), F.max("kl")).first()
    size = counts.groupBy("client").agg(F.sum("n").alias("n_client"))
    got = (mean, top, H.variation(size).first()[0], H.gini(size).first()[0])
    assert got == pytest.approx(want, abs=2e-6)


def test_log_gamma_is_that_of_the_library(spark):
    import math

    xs = [0.01, 0.02, 0.5, 0.99, 1.0, 1.5, 3.0, 10.0, 171.0, 5000.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(H.lgamma(F.col("x"))).collect()]
    assert got == pytest.approx([math.lgamma(x) for x in xs], rel=1e-10, abs=1e-10)


def matrix(spark, cells):
    return spark.createDataFrame([(c, str(k), n) for c, row in enumerate(cells) for k, n in enumerate(row)], "client int, label string, n long")


def test_normal_quantile(spark):
    from statistics import NormalDist

    us = [1e-15, 1e-9, 1e-4, 0.01, 0.0749, 0.0751, 0.3, 0.5, 0.7, 0.93, 0.99, 0.999999]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in us], "u double").selectExpr(draws.normal("u")).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(x) for x in us], rel=1e-12, abs=1e-12)


def cumulated(n, p):
    """Exact cumulated probabilities of a binomial."""
    import math

    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p) for k in range(n + 1)]
    out, total = [], 0.0
    for x in logs:
        total += math.exp(x)
        out.append(total)
    return out


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (7, 0.5), (60, 0.9), (140, 0.5), (2000, 0.01), (5000, 0.7), (40000, 0.002)])
def test_binomials_are_quantiles(spark, n, p):
    us = [(k + 0.5) / 4000 for k in range(4000)]
    df = spark.createDataFrame([(n, p, x) for x in us], "n long, p double, u double")
    got = [r[0] for r in df.selectExpr(draws.binomial("n", "p", "u")).collect()]
    cdf = cumulated(n, p)
    seen = [0] * (n + 1)
    for k in got:
        seen[k] += 1
    worst, total = 0.0, 0
    for k, c in enumerate(seen):
        total += c
        worst = max(worst, abs(total / 4000 - cdf[k]))
    assert worst < (0.0005 if n * p * (1 - p) < draws.WIDE else 0.004)


def test_multinomials_and_gammas_have_their_moments(spark):
    shares = [0.5, 0.3, 0.15, 0.05]
    df = spark.range(4000).withColumn("p", F.array(*map(F.lit, shares))).withColumn("us", F.array(*[u(1, f"m{j}", "id") for j in range(4)]))
    for n in (9, 10**9):
        rows = [r[0] for r in df.withColumn("n", F.lit(n)).select(F.expr(draws.multinomial("n", "p", "us"))).collect()]
        assert all(sum(r) == n and min(r) >= 0 for r in rows)
        for j, p in enumerate(shares):
            own = [r[j] for r in rows]
            mean = sum(own) / 4000
            var = sum((k - mean) ** 2 for k in own) / 4000
            assert mean == pytest.approx(n * p, abs=4 * (n * p * (1 - p) / 4000) ** 0.5) and var == pytest.approx(n * p * (1 - p), rel=0.1)
    for shape in (0.05, 0.5, 2.0):
        of = lambda kind, more="": f"(cast(conv(substring(md5(concat_ws('::', '{kind}', cast(id as string){more})), 1, 13), 16, 10) as double) / {draws.number(16**13)})"
        own = [r[0] for r in spark.range(6000).withColumn("shape", F.lit(shape)).select(F.expr(draws.gamma("shape", of("z", ", cast(i as string)"), of("u", ", cast(i as string)"), of("p")))).collect()]
        mean = sum(own) / 6000
        assert mean == pytest.approx(shape, abs=5 * (shape / 6000) ** 0.5) and sum((x - mean) ** 2 for x in own) / 6000 == pytest.approx(shape, rel=0.25)


def test_draws_cost_the_same_for_any_number_of_rows(spark):
    """A split of 10**12 rows is held against its null in the time of a small one."""
    counts = matrix(spark, [[5 * 10**11, 3 * 10**11, 1], [0, 0, 0], [10**11, 10**11, 7]])
    got = H.null_kl(counts, 20, 7).orderBy("client").collect()
    assert [r["client"] for r in got] == [0, 2] and all(0 <= r["mean_null"] < 1e-9 < r["kl"] for r in got)
    one = sorted(map(tuple, H.null_draws(counts, 4, 7).collect()))
    assert one == sorted(map(tuple, H.null_draws(counts.repartition(7), 4, 7).collect())) and len(one) == 8


def test_grid_finds_the_alpha_of_a_split(spark):
    from tessera.operators import split

    for alpha in (0.1, 2.0):
        labels = [str(k) for k in range(6)]
        cells = {(c, label): 0 for c in range(10) for label in labels}
        for label, c, lo, hi in split.multinomial_quotas({x: 4000 for x in labels}, split.dirichlet_shares(labels, 10, alpha, 5), 5):
            cells[c, label] += hi - lo
        counts = spark.createDataFrame([(c, label, n) for (c, label), n in cells.items()], "client int, label string, n long")
        got = H.grid_stability(counts, [0.05, 0.1, 0.5, 2.0], 60, 40, 1).first()
        assert got["alpha"] == alpha and got["low"] <= alpha <= got["high"] and got["same"] > 0.5


@pytest.mark.parametrize(
    ("cells", "want"),
    [
        ([[100, 100]] * 8, ("weak", "near-IID")),
        ([[200, 0], [0, 200]] * 4, ("strong", "label skew")),
        ([[400, 400], [20, 20], [100, 100], [5, 5]] * 2, (None, "quantity skew")),
        ([[900, 5], [1, 40], [3, 500], [30, 0]] * 2, ("strong", "mixed")),
    ],
)
def test_classes_follow_the_counts(spark, cells, want):
    got = H.classify(matrix(spark, cells), H.alpha_grid(40), 60, 1).first()
    strength, kind = want
    assert got["kind"] == kind and strength in (None, got["strength"])


def test_repair_report_of_moved_lost_and_added_rows(spark):
    from tessera.operators import validate

    before = spark.createDataFrame([(i, "ab"[i % 2], 0 if i < 8 else 1) for i in range(10)], "id long, label string, client int")
    after = spark.createDataFrame([(i, "ab"[i % 2], 2 if i in (0, 1) else 0 if i < 8 else 1) for i in range(1, 11)], "id long, label string, client int")
    got = validate.repair_report(before, after, 3).first().asDict()
    assert got == {"rows": 11, "moved": 1, "routes": 1, "lost": 1, "added": 1, "smallest_before": 0, "fewest_labels_before": 0, "empty_before": 1, "smallest_after": 1, "fewest_labels_after": 1, "empty_after": 0}
