"""How uneven a split is: dense counts, divergences, null tests, concentration.

Input is an assignment ``client, label`` (one row per sample) or its dense
counts.  Everything after the first groupBy is clients x labels cells.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import draws
from ..functions.rng import u


def dense_counts(df: DataFrame, clients: int, labels: list[str], label: str = "label") -> DataFrame:
    """``client, label, n`` with zero-filled cells, empty clients too."""
    spark = df.sparkSession
    grid = spark.range(clients).select(F.col("id").cast("int").alias("client"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    counts = df.groupBy("client", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["client", "label"], "left").select("client", "label", F.coalesce("n", F.lit(0)).alias("n"))


def shares(counts: DataFrame) -> DataFrame:
    """Adds ``p`` (share in the client), ``q`` (share overall) and ``n_client``."""
    by_client = counts.groupBy("client").agg(F.sum("n").alias("n_client"))
    by_label = counts.groupBy("label").agg(F.sum("n").alias("n_label"))
    total = counts.agg(F.sum("n").alias("n_all"))
    out = counts.join(F.broadcast(by_client), "client").join(F.broadcast(by_label), "label").join(F.broadcast(total))
    p = F.when(F.col("n_client") > 0, F.col("n") / F.col("n_client")).otherwise(0.0)
    return out.select("client", "label", "n", "n_client", p.alias("p"), (F.col("n_label") / F.col("n_all")).alias("q"))


def kl_to_global(counts: DataFrame) -> DataFrame:
    """``client, n_client, kl``: natural-log divergence of a client's labels."""
    cell = F.when((F.col("p") > 0) & (F.col("q") > 0), F.col("p") * F.log(F.col("p") / F.col("q"))).otherwise(0.0)
    return shares(counts).groupBy("client").agg(F.max("n_client").alias("n_client"), F.sum(cell).alias("kl"))


def divergences(counts: DataFrame, eps: float = 1e-12) -> DataFrame:
    """``client, kl, js, l1`` against the global mix, shares floored at ``eps``."""
    s = shares(counts).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda a, b: F.when(F.col(a) > 0, F.col(a) * F.log(F.col(a) / F.greatest(F.col(b), F.lit(eps)))).otherwise(0.0)
    return s.groupBy("client").agg(F.sum(part("p", "q")).alias("kl"), (0.5 * F.sum(part("p", "m")) + 0.5 * F.sum(part("q", "m"))).alias("js"), F.sum(F.abs(F.col("p") - F.col("q"))).alias("l1"))


def gini(sizes: DataFrame, value: str = "n_client") -> DataFrame:
    """One row ``gini`` of one value per client; 0 where all are 0."""
    ranked = sizes.withColumn("_i", F.row_number().over(W.orderBy(value)))
    total, n = F.sum(value), F.count(F.lit(1))
    return ranked.agg(F.when(total > 0, 2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(0.0).alias("gini"))


def variation(sizes: DataFrame, value: str = "n_client") -> DataFrame:
    """One row ``cv``: sample deviation over mean, 0 where the mean is 0."""
    return sizes.agg(F.when(F.avg(value) > 0, F.coalesce(F.stddev_samp(value), F.lit(0.0)) / F.avg(value)).otherwise(0.0).alias("cv"))


def dominance(counts: DataFrame, least: float = 0.5) -> DataFrame:
    """``client, top1, top2, dominant``: the two largest shares of each client."""
    order = W.partitionBy("client").orderBy(F.desc("p"), "label")
    ranked = shares(counts).withColumn("_r", F.row_number().over(order))
    top = lambda k: F.coalesce(F.max(F.when(F.col("_r") == k, F.col("p"))), F.lit(0.0))
    return ranked.groupBy("client").agg(top(1).alias("top1"), top(2).alias("top2")).withColumn("dominant", F.col("top1") > least)


def client_coverage(counts: DataFrame) -> DataFrame:
    return counts.groupBy("client").agg(F.count_if(F.col("n") > 0).alias("covered"), F.count_if(F.col("n") == 0).alias("missing"))


def label_coverage(counts: DataFrame) -> DataFrame:
    return counts.groupBy("label").agg(F.count_if(F.col("n") > 0).alias("clients_with"), F.count_if(F.col("n") == 0).alias("clients_without"))


def over_expression(counts: DataFrame) -> DataFrame:
    """``client, label, delta``: the label whose share exceeds the global one most."""
    delta = F.struct(F.round(F.col("p") - F.col("q"), 12).alias("delta"))
    best = shares(counts).groupBy("client").agg(F.min_by(F.struct("label", (F.col("p") - F.col("q")).alias("delta")), F.struct(-delta["delta"], F.col("label"))).alias("b"))
    return best.select("client", "b.label", "b.delta")


def class_shares(counts: DataFrame) -> DataFrame:
    """``label, client, share`` of each class over the clients."""
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("label"))).select("label", "client", "share")


def null_draws(counts: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """``sim, client, kl_null``: each client's labels are redrawn ``sims`` times from the
    global mix.  A draw is a multinomial of the client's size, so its cost does not
    depend on how many rows the client has."""
    mix = F.transform(F.array_sort(F.collect_list(F.struct("label", "q"))), lambda x: x["q"])
    own = shares(counts).groupBy("client").agg(F.max("n_client").alias("n_client"), mix.alias("q")).filter("n_client > 0")
    runs = own.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).repartition("client", "sim")
    runs = runs.withColumn("us", F.transform(F.sequence(F.lit(0), F.size("q") - 1), lambda j: u(seed, "null", "sim", "client", j)))
    drawn = runs.select("sim", "client", "n_client", "q", F.expr(draws.multinomial("n_client", "q", "us")).alias("ks"))
    cell = "if(k > 0, k / n_client * ln(k / n_client / p), 0e0)"
    return drawn.select("sim", "client", F.expr(f"aggregate(zip_with(ks, q, (k, p) -> {cell}), 0e0, (a, b) -> a + b)").alias("kl_null"))


def _against_null(sims: int) -> list[Column]:
    seen, null = F.col("kl"), F.col("kl_null")
    return [F.max(seen).alias("kl"), F.avg(null).alias("mean_null"), F.stddev_samp(null).alias("sd_null"), ((1 + F.count_if(null >= seen)) / (sims + 1)).alias("p_value")]


def _z() -> Column:
    return F.when(F.col("sd_null") > 0, (F.col("kl") - F.col("mean_null")) / F.col("sd_null")).otherwise(0.0)


def null_kl(counts: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """``client, kl, mean_null, sd_null, p_value, z`` of each client against ``null_draws``."""
    joined = null_draws(counts, sims, seed).join(F.broadcast(kl_to_global(counts)), "client")
    return joined.groupBy("client").agg(*_against_null(sims)).withColumn("z", _z())


def null_mean_kl(counts: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """One row ``kl, mean_null, sd_null, p_value, low, high, z`` of the mean over clients
    that hold rows; ``low`` and ``high`` bound 95 % of the null means."""
    seen = kl_to_global(counts).filter("n_client > 0").agg(F.avg("kl").alias("kl"))
    means = null_draws(counts, sims, seed).groupBy("sim").agg(F.avg("kl_null").alias("kl_null")).join(F.broadcast(seen))
    ends = [F.percentile("kl_null", p).alias(name) for name, p in (("low", 0.025), ("high", 0.975))]
    return means.agg(*_against_null(sims), *ends).withColumn("z", _z())


def null_sizes(counts: DataFrame, sims: int, seed: int = 0) -> DataFrame:
    """One row: observed CV and Gini, and their p-values under uniform sizes."""
    sizes = counts.groupBy("client").agg(F.sum("n").alias("n_client"))
    seen = variation(sizes).join(gini(sizes))
    both = sizes.agg(F.sum("n_client").alias("total"), F.count(F.lit(1)).cast("int").alias("c"))
    runs = both.select("total", "c", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).repartition("sim")
    runs = runs.withColumn("us", F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: u(seed, "size", "sim", j)))
    drawn = runs.select("sim", F.posexplode(F.expr(draws.multinomial("total", "array_repeat(1e0 / c, c)", "us"))).alias("client", "n"))
    full = drawn.select("sim", "client", "n")
    ranked = full.withColumn("i", F.row_number().over(W.partitionBy("sim").orderBy("n", "client")))
    n = F.count(F.lit(1))
    stats = ranked.groupBy("sim").agg((F.stddev_samp("n") / F.avg("n")).alias("cv0"), (2 * F.sum(F.col("i") * F.col("n")) / (n * F.sum("n")) - (n + 1) / n).alias("gini0"))
    p = lambda a, b: ((1 + F.count_if(F.col(a) >= F.col(b) - 1e-12)) / (sims + 1))
    return stats.join(F.broadcast(seen)).agg(F.max("cv").alias("cv"), F.max("gini").alias("gini"), p("cv0", "cv").alias("p_cv"), p("gini0", "gini").alias("p_gini"))


#: Coefficients of the Lanczos series, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """Log gamma for positive x; below 1 by ``lgamma(x + 1) - ln x``."""
    y = F.when(x < 1, x + 1).otherwise(x) - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(series) - F.when(x < 1, F.log(x)).otherwise(0.0)


def alpha_grid(k: int = 500, low: float = 0.02, high: float = 5.0) -> list[float]:
    return [float(round(a, 12)) for a in np.exp(np.linspace(np.log(low), np.log(high), k))]


def class_likelihood(counts: DataFrame, alphas: list[float]) -> DataFrame:
    """``label, alpha, ll``: Dirichlet-multinomial log-likelihood of a class's
    client counts (without the multinomial coefficient)."""
    spark = counts.sparkSession
    grid = F.broadcast(spark.createDataFrame([(a,) for a in alphas], "alpha double"))
    width = counts.select("client").distinct().agg(F.count(F.lit(1)).alias("c"))
    cells = counts.join(grid).groupBy("label", "alpha").agg(F.sum(lgamma(F.col("n") + F.col("alpha")) - lgamma(F.col("alpha"))).alias("s"), F.sum("n").alias("total"))
    a = F.col("alpha") * F.col("c")
    return cells.join(F.broadcast(width)).select("label", "alpha", (F.col("s") + lgamma(a) - lgamma(a + F.col("total"))).alias("ll"))


def concentration(counts: DataFrame, alphas: list[float]) -> DataFrame:
    """One row ``alpha, ll, low, high``: the maximum and its profile interval."""
    ll = class_likelihood(counts, alphas).groupBy("alpha").agg(F.sum("ll").alias("ll"))
    best = ll.agg(F.max("ll").alias("top"))
    return ll.join(F.broadcast(best)).agg(F.max_by("alpha", "ll").alias("alpha"), F.max("ll").alias("ll"), F.min(F.when(F.col("ll") >= F.col("top") - 1.92, F.col("alpha"))).alias("low"), F.max(F.when(F.col("ll") >= F.col("top") - 1.92, F.col("alpha"))).alias("high"))


def bootstrap_concentration(counts: DataFrame, alphas: list[float], labels: list[str], draws: int, seed: int = 0) -> DataFrame:
    """One row ``mean, low, high``: classes are resampled with replacement."""
    ll = class_likelihood(counts, alphas)
    k = len(labels)
    picks = counts.sparkSession.range(draws).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j"))
    picks = picks.withColumn("at", F.floor(u(seed, "boot", "b", "j") * k).cast("int"))
    names = F.array(*[F.lit(x) for x in labels])
    times = picks.select("b", F.element_at(names, F.col("at") + 1).alias("label")).groupBy("b", "label").agg(F.count(F.lit(1)).alias("m"))
    summed = F.broadcast(times).join(ll, "label").groupBy("b", "alpha").agg(F.sum(F.col("m") * F.col("ll")).alias("ll"))
    best = summed.groupBy("b").agg(F.max_by("alpha", F.struct(F.round("ll", 9), -F.col("alpha"))).alias("alpha"))
    return best.agg(F.avg("alpha").alias("mean"), F.percentile("alpha", 0.025).alias("low"), F.percentile("alpha", 0.975).alias("high"))


def observed(counts: DataFrame) -> DataFrame:
    """One row ``mean_kl, missing, dominant`` of a split: mean KL of all clients (an empty one
    has 0), share of empty cells, share of clients with a label of more than half their rows."""
    cell = F.when(F.col("n") > 0, F.col("p") * F.log(F.col("p") / F.col("q"))).otherwise(0.0)
    per = shares(counts).groupBy("client").agg(F.sum(cell).alias("kl"), F.avg((F.col("n") == 0).cast("int")).alias("missing"), F.max("p").alias("top"))
    return per.agg(F.avg("kl").alias("mean_kl"), F.avg("missing").alias("missing"), F.avg((F.col("top") > 0.5).cast("int")).alias("dominant"))


def simulate_grid(counts: DataFrame, alphas: list[float] | DataFrame, sims: int, seed: int = 0, salt: str = "grid") -> DataFrame:
    """``alpha, sim, mean_kl, missing, dominant`` of ``sims`` Dirichlet splits for each alpha.

    Shares of a label over the clients are gamma variates over their sum, and its rows fall on
    them by a multinomial: a few operations a client, whatever the number of rows.  ``alphas``
    may be a table with that column.
    """
    spark = counts.sparkSession
    grid = alphas.select("alpha") if isinstance(alphas, DataFrame) else spark.createDataFrame([(float(a),) for a in alphas], "alpha double")
    sizes = shares(counts).groupBy("label").agg(F.sum("n").alias("n"), F.max("q").alias("q"), F.count(F.lit(1)).cast("int").alias("clients"))
    runs = grid.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).join(F.broadcast(sizes)).repartition("alpha", "sim", "label")
    ids = "cast(alpha as string), cast(sim as string), label, cast(c as string)"
    uniform = lambda kind, more="": f"(cast(conv(substring(md5(concat_ws('::', '{seed}', '{salt}-{kind}', {ids}{more})), 1, 13), 16, 10) as double) / {draws.number(16**13)})"
    attempt = ", cast(i as string)"
    gamma = draws.gamma("alpha", uniform("z", attempt), uniform("u", attempt), uniform("power"))
    # One after the other, each named in an array of one: nothing is computed twice.
    gammas = f"transform(sequence(0, clients - 1), c -> {gamma})"
    parts = f"transform(array({gammas}), g -> transform(g, x -> x / aggregate(g, 0e0, (a, b) -> a + b)))[0]"
    us = f"transform(sequence(0, clients - 1), c -> {uniform('split')})"
    dealt = runs.select("alpha", "sim", "label", "q", "n", F.expr(parts).alias("parts"), F.expr(us).alias("us"))
    cells = dealt.select("alpha", "sim", "label", "q", F.posexplode(F.expr(draws.multinomial("n", "parts", "us"))).alias("client", "k"))
    per = cells.withColumn("nc", F.sum("k").over(W.partitionBy("alpha", "sim", "client"))).withColumn("p", F.when(F.col("nc") > 0, F.col("k") / F.col("nc")).otherwise(0.0))
    cell = F.when(F.col("k") > 0, F.col("p") * F.log(F.col("p") / F.col("q"))).otherwise(0.0)
    by_client = per.groupBy("alpha", "sim", "client").agg(F.sum(cell).alias("kl"), F.avg((F.col("k") == 0).cast("int")).alias("missing"), F.max("p").alias("top"))
    return by_client.groupBy("alpha", "sim").agg(F.avg("kl").alias("mean_kl"), F.avg("missing").alias("missing"), F.avg((F.col("top") > 0.5).cast("int")).alias("dominant"))


def grid_score(simulated: DataFrame, seen: DataFrame) -> DataFrame:
    """``alpha, score`` and the means and deviations of the simulated figures: the Euclidean
    z-distance of what was ``observed`` (one row) from each alpha."""
    names = ("mean_kl", "missing", "dominant")
    per = simulated.groupBy("alpha").agg(*[F.avg(c).alias(c) for c in names], *[F.greatest(F.stddev_samp(c), F.lit(1e-9)).alias(f"sd_{c}") for c in names])
    return _scored(per, seen).drop(*[f"seen_{c}" for c in names])


def _scored(per: DataFrame, seen: DataFrame) -> DataFrame:
    names = ("mean_kl", "missing", "dominant")
    both = per.join(F.broadcast(seen.select(*[F.col(c).alias(f"seen_{c}") for c in names], *[c for c in seen.columns if c not in names])))
    z = [F.pow((F.col(f"seen_{c}") - F.col(c)) / F.col(f"sd_{c}"), 2) for c in names]
    return both.withColumn("score", F.sqrt(z[0] + z[1] + z[2]))


def grid_stability(counts: DataFrame, alphas: list[float], sims: int, boots: int, seed: int = 0) -> DataFrame:
    """One row ``alpha, low, high, same``: the alpha of the grid that is nearest to the split,
    and of ``boots`` splits simulated with it the 95 % interval of their nearest alphas and the
    share that gives it again."""
    scores = grid_score(simulate_grid(counts, alphas, sims, seed), observed(counts))
    best = scores.agg(F.min_by("alpha", F.struct(F.round("score", 6), "alpha")).alias("alpha"))
    again = simulate_grid(counts, best, boots, seed, "boot").withColumnRenamed("alpha", "best")
    nearest = _scored(scores.drop("score"), again).groupBy("sim", "best").agg(F.min_by("alpha", F.struct(F.round("score", 6), "alpha")).alias("alpha"))
    ends = [F.percentile("alpha", p).alias(name) for name, p in (("low", 0.025), ("high", 0.975))]
    return nearest.agg(F.max("best").alias("best"), *ends, F.avg((F.col("alpha") == F.col("best")).cast("int")).alias("same")).withColumnRenamed("best", "alpha")


def skew_class(alpha: Column, z: Column, label_p: Column, cv_p: Column, gini_p: Column) -> Column:
    """Strength of the label skew, its kind by the null tests."""
    strength = F.when((alpha >= 1.0) & (z < 2.0), "weak").when((alpha <= 0.3) | (z >= 4.0), "strong").otherwise("medium")
    label, size = label_p < 0.05, (cv_p < 0.05) | (gini_p < 0.05)
    kind = F.when(label & size, "mixed").when(label, "label skew").when(size, "quantity skew").otherwise("near-IID")
    return F.struct(strength.alias("strength"), kind.alias("kind"))


def dirichlet_consistent(mean_coverage: Column, nonzero: Column, alpha: Column) -> Column:
    """Whether a split looks like a Dirichlet one: coverage, filled cells, alpha."""
    return (mean_coverage >= 2.0) & (nonzero >= 0.35) & alpha.between(0.2, 0.8)


def classify(counts: DataFrame, alphas: list[float], sims: int, seed: int = 0) -> DataFrame:
    """One row ``strength, kind, consistent``: the skew of a split from its likeliest
    alpha, the null tests of mean KL and sizes, and the cells that hold rows."""
    filled = counts.agg((F.count_if(F.col("n") > 0) / F.countDistinct("label")).alias("coverage"), F.avg((F.col("n") > 0).cast("int")).alias("nonzero"))
    facts = concentration(counts, alphas).select("alpha").join(null_mean_kl(counts, sims, seed)).join(null_sizes(counts, sims, seed)).join(filled)
    found = facts.select(skew_class(F.col("alpha"), F.col("z"), F.col("p_value"), F.col("p_cv"), F.col("p_gini")).alias("c"), dirichlet_consistent(F.col("coverage"), F.col("nonzero"), F.col("alpha")).alias("consistent"))
    return found.select("c.*", "consistent")
