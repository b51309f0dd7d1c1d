"""Queries of the heterogeneity and validation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import draws
from ..functions.rng import u
from ..operators import hetero as H
from ..operators import split, validate
from .q_split import grid, sql_grid
from .views import ASSIGNED, CLIENTS, COUNTS, IDS, LABELS, QA, SAMPLES, SEED, SHARES, UNITS, answers, assigned, ids, query, questions, samples, sql_assigned, sql_u, table, values


def counts(spark, d):
    return H.dense_counts(assigned(spark, d), CLIENTS, LABELS)


def sizes(spark, d):
    return counts(spark, d).groupBy("client").agg(F.sum("n").alias("n_client"))


SIZES = f"{COUNTS}, sizes AS (SELECT client, sum(n)::BIGINT AS n_client FROM counts GROUP BY client)"
KL = "CASE WHEN p > 0 AND q > 0 THEN p * ln(p / q) ELSE 0 END"


@query("h01_dense_counts", f"WITH {COUNTS} SELECT client, label, n FROM counts")
def _(spark, d):
    return counts(spark, d)


@query("h02_split_meta", f"""WITH {SAMPLES}, {sql_assigned('samples')} SELECT coalesce(client, -1) AS client, coalesce(label, 'all') AS label, count(*) AS n, count(*) FILTER (WHERE img IS NOT NULL) AS with_img FROM assigned GROUP BY GROUPING SETS ((client, label), (client), (label), ())""")
def _(spark, d):
    own = split.dirichlet_assign(samples(spark, d), SHARES, SEED)
    n, img = F.count(F.lit(1)).alias("n"), F.count_if(F.col("img").isNotNull()).alias("with_img")
    return own.groupingSets([["client", "label"], ["client"], ["label"], []], "client", "label").agg(n, img).select(F.coalesce("client", F.lit(-1)).alias("client"), F.coalesce("label", F.lit("all")).alias("label"), "n", "with_img")


@query("h03_label_histogram", f"WITH {IDS} SELECT l.label, count(i.id) AS n FROM (SELECT unnest({LABELS + ['xx']!r}) AS label) l LEFT JOIN ids i USING (label) GROUP BY l.label")
def _(spark, d):
    base = spark.createDataFrame([(x,) for x in [*LABELS, "xx"]], "label string")
    n = ids(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return base.join(F.broadcast(n), "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


PATTERN = "CASE WHEN img IS NOT NULL AND length(trim(text)) > 0 THEN '11' WHEN img IS NOT NULL THEN '10' WHEN length(trim(text)) > 0 THEN '01' ELSE '00' END"


@query("h04_client_stats", f"""WITH {SAMPLES}, {sql_assigned('samples')}, p AS (SELECT *, {PATTERN} AS pattern FROM assigned), g AS (SELECT client, pattern, count(*) AS k FROM p GROUP BY ALL)
    SELECT p.client, count(*) AS n, count(img) AS with_img, round(avg(CASE WHEN img IS NULL THEN 1.0 ELSE 0.0 END), 9) AS img_missing,
           count(*) FILTER (WHERE quality IS NULL) AS missing_fields, (SELECT arg_max(pattern, (k, pattern)) FROM g WHERE g.client = p.client) AS top_pattern FROM p GROUP BY p.client""")
def _(spark, d):
    own = split.dirichlet_assign(samples(spark, d), SHARES, SEED)
    has_text = F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    pattern = F.concat(F.col("img").isNotNull().cast("int").cast("string"), has_text.cast("int").cast("string"))
    cells = own.withColumn("pattern", pattern).groupBy("client", "pattern").agg(
        F.count(F.lit(1)).alias("k"), F.count("img").alias("i"), F.count_if(F.col("quality").isNull()).alias("m")
    )
    out = cells.groupBy("client").agg(F.sum("k").alias("n"), F.sum("i").alias("with_img"), F.sum("m").alias("missing_fields"), F.max_by("pattern", F.struct("k", "pattern")).alias("top_pattern"))
    return out.withColumn("img_missing", F.round(1 - F.col("with_img") / F.col("n"), 9)).select("client", "n", "with_img", "img_missing", "missing_fields", "top_pattern")


@query("h05_summary", f"WITH {SIZES} SELECT min(n_client) AS least, max(n_client) AS most, round(avg(n_client), 6) AS mean, round(stddev_pop(n_client), 6) AS sd FROM sizes")
def _(spark, d):
    return sizes(spark, d).agg(F.min("n_client").alias("least"), F.max("n_client").alias("most"), F.round(F.avg("n_client"), 6).alias("mean"), F.round(F.stddev_pop("n_client"), 6).alias("sd"))


@query("h06_kl", f"WITH {COUNTS} SELECT client, max(nc)::BIGINT AS n_client, round(sum({KL}), 9) AS kl FROM shares GROUP BY client")
def _(spark, d):
    return H.kl_to_global(counts(spark, d)).select("client", "n_client", F.round("kl", 9).alias("kl"))


@query("h07_divergences", f"""WITH {COUNTS}, m AS (SELECT *, (p + q) / 2 AS m FROM shares)
    SELECT client, round(sum(CASE WHEN p > 0 THEN p * ln(p / greatest(q, 1e-12)) ELSE 0 END), 9) AS kl,
           round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END), 9) AS js, round(sum(abs(p - q)), 9) AS l1 FROM m GROUP BY client""")
def _(spark, d):
    return H.divergences(counts(spark, d)).select("client", *[F.round(c, 9).alias(c) for c in ("kl", "js", "l1")])


@query("h08_gini", f"WITH {SIZES} SELECT round(2 * sum(i * n_client) / (count(*) * sum(n_client)) - (count(*) + 1) / count(*), 9) AS gini FROM (SELECT n_client, row_number() OVER (ORDER BY n_client) AS i FROM sizes)")
def _(spark, d):
    return H.gini(sizes(spark, d)).select(F.round("gini", 9).alias("gini"))


@query("h09_cv", f"WITH {SIZES} SELECT round(stddev_samp(n_client) / avg(n_client), 9) AS cv FROM sizes")
def _(spark, d):
    return H.variation(sizes(spark, d)).select(F.round("cv", 9).alias("cv"))


@query("h10_dominance", f"""WITH {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY p DESC, label) AS r FROM shares)
    SELECT client, round(max(CASE WHEN r = 1 THEN p END), 9) AS top1, round(max(CASE WHEN r = 2 THEN p END), 9) AS top2, max(CASE WHEN r = 1 THEN p END) > 0.5 AS dominant FROM r GROUP BY client""")
def _(spark, d):
    return H.dominance(counts(spark, d)).select("client", F.round("top1", 9).alias("top1"), F.round("top2", 9).alias("top2"), "dominant")


@query("h11_coverage", f"""WITH {COUNTS} SELECT 'client' AS side, client::VARCHAR AS name, count(*) FILTER (WHERE n > 0) AS covered, count(*) FILTER (WHERE n = 0) AS missing FROM counts GROUP BY client
    UNION ALL SELECT 'label', label, count(*) FILTER (WHERE n > 0), count(*) FILTER (WHERE n = 0) FROM counts GROUP BY label""")
def _(spark, d):
    c = counts(spark, d)
    a = H.client_coverage(c).select(F.lit("client").alias("side"), F.col("client").cast("string").alias("name"), "covered", "missing")
    return a.unionByName(H.label_coverage(c).select(F.lit("label").alias("side"), F.col("label").alias("name"), F.col("clients_with").alias("covered"), F.col("clients_without").alias("missing")))


@query("h12_over_expression", f"WITH {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY client ORDER BY round(p - q, 12) DESC, label) AS r FROM shares) SELECT client, label, round(p - q, 9) AS delta FROM r WHERE r = 1")
def _(spark, d):
    return H.over_expression(counts(spark, d)).select("client", "label", F.round("delta", 9).alias("delta"))


@query("h13_class_shares", f"WITH {COUNTS} SELECT label, client, round(n / sum(n) OVER (PARTITION BY label), 9) AS share FROM counts")
def _(spark, d):
    return H.class_shares(counts(spark, d)).select("label", "client", F.round("share", 9).alias("share"))


SIMS = 2000


def sql_multinomial(name: str, source: str, n: str, parts: list[str], uniforms: list[str]) -> str:
    """CTEs ``{name}_0`` ... of ``source``, each with one more count ``k0``, ``k1``, ... of how ``n``
    trials fall on ``parts``; the last is ``name``."""
    out = [f"{name}_0 AS (SELECT *, ({n})::BIGINT AS left_, 1e0 AS mass_ FROM {source})"]
    for j, (p, u_) in enumerate(zip(parts, uniforms)):
        last = j == len(parts) - 1
        k = "left_" if last else draws.binomial("left_", "p_", "u_", spark=False)
        own = f"SELECT *, ({p})::DOUBLE AS q_, CASE WHEN mass_ <= 0 THEN 0 ELSE least(1e0, ({p}) / mass_) END AS p_, {u_} AS u_ FROM {name}_{j}"
        drawn = f"SELECT *, {k} AS k{j} FROM ({own})"
        out.append(f"{name}{'' if last else f'_{j + 1}'} AS (SELECT * EXCLUDE (left_, mass_, q_, p_, u_), left_ - k{j} AS left_, mass_ - q_ AS mass_ FROM ({drawn}))")
    return ", ".join(out)


NULL_KL = f"""q AS (SELECT list(q ORDER BY label) AS q FROM (SELECT label, max(q) AS q FROM shares GROUP BY label)),
    size AS (SELECT client, max(nc) AS nc FROM shares GROUP BY client HAVING max(nc) > 0),
    null_runs AS (SELECT client, nc, sim, q FROM size CROSS JOIN (SELECT range::INT AS sim FROM range({SIMS})) CROSS JOIN q),
    {sql_multinomial('nulls', 'null_runs', 'nc', [f'q[{j + 1}]' for j in range(len(LABELS))], [sql_u(SEED, 'null', 'sim', 'client', str(j)) for j in range(len(LABELS))])},
    sim_kl AS (SELECT client, sim, {' + '.join(f'CASE WHEN k{j} > 0 THEN k{j} / nc * ln(k{j} / nc / q[{j + 1}]) ELSE 0 END' for j in range(len(LABELS)))} AS kl0 FROM nulls), seen AS (SELECT client, sum({KL}) AS kl FROM shares GROUP BY client),
    sim_mean AS (SELECT sim, avg(kl0) AS kl0 FROM sim_kl GROUP BY sim), seen_mean AS (SELECT avg(kl) AS kl FROM seen JOIN size USING (client)),
    mean_test AS (SELECT max(kl) AS kl, avg(kl0) AS mean_null, (max(kl) - avg(kl0)) / stddev_samp(kl0) AS z, (1 + count(*) FILTER (WHERE kl0 >= kl)) / {SIMS + 1} AS p_value,
        quantile_cont(kl0, 0.025) AS low, quantile_cont(kl0, 0.975) AS high FROM sim_mean CROSS JOIN seen_mean)"""
NULL_SIZES = f"""sizes AS (SELECT client, sum(n)::BIGINT AS n_client FROM counts GROUP BY client),
    size_runs AS (SELECT range::INT AS sim, (SELECT sum(n_client)::BIGINT FROM sizes) AS total FROM range({SIMS})),
    {sql_multinomial('sized_runs', 'size_runs', 'total', [f'1e0 / {CLIENTS}'] * CLIENTS, [sql_u(SEED, 'size', 'sim', str(j)) for j in range(CLIENTS)])},
    full_ AS (SELECT sim, unnest(range({CLIENTS})) AS client, unnest([{', '.join(f'k{j}' for j in range(CLIENTS))}]) AS n FROM sized_runs),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY n, client) AS i FROM full_),
    st AS (SELECT sim, stddev_samp(n) / avg(n) AS cv0, 2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*) AS g0 FROM ranked GROUP BY sim),
    seen_sizes AS (SELECT stddev_samp(n_client) / avg(n_client) AS cv, 2 * sum(i * n_client) / (count(*) * sum(n_client)) - (count(*) + 1) / count(*) AS g FROM (SELECT n_client, row_number() OVER (ORDER BY n_client) AS i FROM sizes)),
    size_test AS (SELECT max(cv) AS cv, max(g) AS gini, (1 + count(*) FILTER (WHERE cv0 >= cv - 1e-12)) / {SIMS + 1} AS p_cv, (1 + count(*) FILTER (WHERE g0 >= g - 1e-12)) / {SIMS + 1} AS p_gini FROM st CROSS JOIN seen_sizes)"""


@query("h14_null_kl", f"""WITH {COUNTS}, {NULL_KL}
    SELECT client, round(max(kl), 8) AS kl, round(avg(kl0), 8) AS mean_null, round((1 + count(*) FILTER (WHERE kl0 >= kl)) / {SIMS + 1}, 8) AS p_value FROM sim_kl JOIN seen USING (client) GROUP BY client""")
def _(spark, d):
    return H.null_kl(counts(spark, d), SIMS, SEED).select("client", *[F.round(c, 8).alias(c) for c in ("kl", "mean_null", "p_value")])


@query("h14b_null_mean_kl", f"WITH {COUNTS}, {NULL_KL} SELECT round(kl, 8) AS kl, round(mean_null, 8) AS mean_null, round(z, 4) AS z, round(p_value, 8) AS p_value, round(low, 8) AS low, round(high, 8) AS high FROM mean_test")
def _(spark, d):
    return H.null_mean_kl(counts(spark, d), SIMS, SEED).select(*[F.round(c, 4 if c == "z" else 8).alias(c) for c in ("kl", "mean_null", "z", "p_value", "low", "high")])


@query("h15_null_sizes", f"WITH {COUNTS}, {NULL_SIZES} SELECT round(cv, 8) AS cv, round(gini, 8) AS gini, round(p_cv, 8) AS p_cv, round(p_gini, 8) AS p_gini FROM size_test")
def _(spark, d):
    return H.null_sizes(counts(spark, d), SIMS, SEED).select(*[F.round(c, 8).alias(c) for c in ("cv", "gini", "p_cv", "p_gini")])


ALPHAS = H.alpha_grid(60)
LL = f"""{COUNTS}, {values('alphas', 'alpha', [(a,) for a in ALPHAS])},
    ll AS (SELECT label, alpha, sum(lgamma(n + alpha) - lgamma(alpha)) + lgamma(alpha * {CLIENTS}) - lgamma(alpha * {CLIENTS} + sum(n)) AS ll FROM counts CROSS JOIN alphas GROUP BY label, alpha)"""


@query("h16_concentration", f"""WITH {LL}, s AS (SELECT alpha, sum(ll) AS ll FROM ll GROUP BY alpha), t AS (SELECT max(ll) AS top FROM s)
    SELECT round(arg_max(alpha, ll), 9) AS alpha, round(max(ll), 5) AS ll, round(min(alpha) FILTER (WHERE ll >= top - 1.92), 9) AS low, round(max(alpha) FILTER (WHERE ll >= top - 1.92), 9) AS high FROM s CROSS JOIN t""")
def _(spark, d):
    return H.concentration(counts(spark, d), ALPHAS).select(F.round("alpha", 9).alias("alpha"), F.round("ll", 5).alias("ll"), F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("h17_concentration_bootstrap", f"""WITH {LL}, picks AS (SELECT b, j, floor({sql_u(SEED, 'boot', 'b', 'j')} * 4)::INT AS k FROM (SELECT range AS b, unnest(range(4)) AS j FROM range(50))),
    times AS (SELECT b, list_extract({LABELS!r}, k + 1) AS label, count(*) AS m FROM picks GROUP BY ALL), s AS (SELECT b, alpha, sum(m * ll) AS ll FROM times JOIN ll USING (label) GROUP BY ALL),
    best AS (SELECT b, arg_max(alpha, (round(ll, 9), -alpha)) AS alpha FROM s GROUP BY b)
    SELECT round(avg(alpha), 8) AS mean, round(quantile_cont(alpha, 0.025), 8) AS low, round(quantile_cont(alpha, 0.975), 8) AS high FROM best""")
def _(spark, d):
    return H.bootstrap_concentration(counts(spark, d), ALPHAS, LABELS, 50, SEED).select(*[F.round(c, 8).alias(c) for c in ("mean", "low", "high")])


#: The alphas that a split is held against.
GRID = [0.05, 0.1, 0.2, 0.3, 0.5, 0.8, 1.0, 2.0]
GRID_SIMS, BOOTS = 100, 400


def sql_simulated(name: str, alphas: str, sims: int, salt: str) -> str:
    """CTEs of ``hetero.simulate_grid``: ``name(alpha, sim, mean_kl, missing, dominant)``."""
    at = ("alpha", "sim", "label", "c")
    z, taken = draws.normal("uz"), draws.gamma_taken("alpha", "z", "uu")
    parts = [f"g[{c + 1}] / total" for c in range(CLIENTS)]
    return f"""{name}_runs AS (SELECT alpha, sim, label, n, q FROM {alphas} CROSS JOIN (SELECT range::INT AS sim FROM range({sims})) CROSS JOIN label_sizes),
    {name}_tries AS (SELECT alpha, sim, label, c, i, {sql_u(SEED, salt + '-z', *at, 'i')} AS uz, {sql_u(SEED, salt + '-u', *at, 'i')} AS uu, {sql_u(SEED, salt + '-power', *at)} AS up FROM {name}_runs CROSS JOIN (SELECT range AS c FROM range({CLIENTS})) CROSS JOIN (SELECT range AS i FROM range({draws.ATTEMPTS}))),
    {name}_z AS (SELECT * , {z} AS z FROM {name}_tries),
    {name}_gamma AS (SELECT alpha, sim, label, c, coalesce(arg_min({draws.gamma_attempt('alpha', 'z')}, i) FILTER (WHERE {taken}), alpha + {draws.number(2 / 3)}) * pow(max(up), 1e0 / alpha) AS g FROM {name}_z GROUP BY alpha, sim, label, c),
    {name}_parts AS (SELECT alpha, sim, label, list(g ORDER BY c) AS g, list_sum(list(g ORDER BY c)) AS total FROM {name}_gamma GROUP BY alpha, sim, label),
    {name}_source AS (SELECT p.*, r.n, r.q FROM {name}_parts p JOIN {name}_runs r USING (alpha, sim, label)),
    {sql_multinomial(name + '_dealt', name + '_source', 'n', parts, [sql_u(SEED, salt + '-split', 'alpha', 'sim', 'label', str(c)) for c in range(CLIENTS)])},
    {name}_cells AS (SELECT alpha, sim, label, q, unnest(range({CLIENTS})) AS client, unnest([{', '.join(f'k{c}' for c in range(CLIENTS))}]) AS k FROM {name}_dealt),
    {name}_per AS (SELECT *, CASE WHEN sum(k) OVER w > 0 THEN k / sum(k) OVER w ELSE 0 END AS p FROM {name}_cells WINDOW w AS (PARTITION BY alpha, sim, client)),
    {name}_client AS (SELECT alpha, sim, client, sum(CASE WHEN k > 0 THEN p * ln(p / q) ELSE 0 END) AS kl, avg((k = 0)::INT) AS missing, max(p) AS top FROM {name}_per GROUP BY ALL),
    {name} AS (SELECT alpha, sim, avg(kl) AS mean_kl, avg(missing) AS missing, avg((top > 0.5)::INT) AS dominant FROM {name}_client GROUP BY ALL)"""


FIGURES = ("mean_kl", "missing", "dominant")
SCORED = f"""{COUNTS}, label_sizes AS (SELECT label, sum(n)::BIGINT AS n, max(q) AS q FROM shares GROUP BY label), {values('alphas', 'alpha', [(a,) for a in GRID])}, {sql_simulated('grid_', 'alphas', GRID_SIMS, 'grid')},
    seen_client AS (SELECT client, sum({KL}) AS kl, avg((n = 0)::INT) AS missing, max(p) AS top FROM shares GROUP BY client),
    seen_all AS (SELECT avg(kl) AS seen_mean_kl, avg(missing) AS seen_missing, avg((top > 0.5)::INT) AS seen_dominant FROM seen_client),
    per_alpha AS (SELECT alpha, {', '.join(f'avg({c}) AS {c}, greatest(stddev_samp({c}), 1e-9) AS sd_{c}' for c in FIGURES)} FROM grid_ GROUP BY alpha),
    scores AS (SELECT p.*, sqrt({' + '.join(f'power((seen_{c} - {c}) / sd_{c}, 2)' for c in FIGURES)}) AS score FROM per_alpha p CROSS JOIN seen_all)"""


@query("h18_alpha_grid", f"WITH {SCORED} SELECT alpha, round(score, 4) AS score, {', '.join(f'round({c}, 8) AS {c}' for c in FIGURES)} FROM scores")
def _(spark, d):
    own = counts(spark, d)
    return H.grid_score(H.simulate_grid(own, GRID, GRID_SIMS, SEED), H.observed(own)).select("alpha", F.round("score", 4).alias("score"), *[F.round(c, 8).alias(c) for c in FIGURES])


@query("h19_grid_stability", f"""WITH {SCORED}, best AS (SELECT arg_min(alpha, (round(score, 6), alpha)) AS alpha FROM scores), {sql_simulated('boot_', 'best', BOOTS, 'boot')},
    near AS (SELECT b.sim, arg_min(s.alpha, (round(sqrt({' + '.join(f'power((b.{c} - s.{c}) / s.sd_{c}, 2)' for c in FIGURES)}), 6), s.alpha)) AS alpha FROM boot_ b CROSS JOIN scores s GROUP BY b.sim)
    SELECT (SELECT alpha FROM best) AS alpha, round(quantile_cont(alpha, 0.025), 8) AS low, round(quantile_cont(alpha, 0.975), 8) AS high, round(avg((alpha = (SELECT alpha FROM best))::INT), 8) AS same FROM near""")
def _(spark, d):
    return H.grid_stability(counts(spark, d), GRID, GRID_SIMS, BOOTS, SEED).select("alpha", *[F.round(c, 8).alias(c) for c in ("low", "high", "same")])


@query("h20_skew_class", f"""WITH {LL}, {NULL_KL}, {NULL_SIZES}, s AS (SELECT alpha, sum(ll) AS ll FROM ll GROUP BY alpha), a AS (SELECT arg_max(alpha, ll) AS a FROM s),
    filled AS (SELECT sum((n > 0)::INT) / count(DISTINCT label) AS coverage, avg((n > 0)::INT) AS nonzero FROM counts),
    facts AS (SELECT a, z, coverage, nonzero, p_value < 0.05 AS label_skew, p_cv < 0.05 OR p_gini < 0.05 AS size_skew FROM a CROSS JOIN mean_test CROSS JOIN size_test CROSS JOIN filled)
    SELECT CASE WHEN a >= 1 AND z < 2 THEN 'weak' WHEN a <= 0.3 OR z >= 4 THEN 'strong' ELSE 'medium' END AS strength,
        CASE WHEN label_skew AND size_skew THEN 'mixed' WHEN label_skew THEN 'label skew' WHEN size_skew THEN 'quantity skew' ELSE 'near-IID' END AS kind,
        coverage >= 2 AND nonzero >= 0.35 AND a BETWEEN 0.2 AND 0.8 AS consistent FROM facts""")
def _(spark, d):
    return H.classify(counts(spark, d), ALPHAS, SIMS, SEED)


UNIT_SPLIT = f"{UNITS}, {QA}, placed AS (SELECT DISTINCT image_id, floor({sql_u(SEED, 'unit', 'image_id')} * 10)::INT AS client FROM questions), asked AS (SELECT * FROM questions JOIN placed USING (image_id))"


def asked(spark, d):
    return questions(spark, d).withColumn("client", F.floor(u(SEED, "unit", "image_id") * 10).cast("int"))


@query("h21_unit_stats", f"WITH {UNIT_SPLIT} SELECT a.client, count(DISTINCT image_id) AS images, count(DISTINCT a.question_id) AS questions, count(n.ordinal) AS annotations FROM asked a LEFT JOIN answers n USING (question_id) GROUP BY a.client")
def _(spark, d):
    per = answers(spark, d).groupBy("question_id").agg(F.count(F.lit(1)).alias("k"))
    own = asked(spark, d).join(per, "question_id", "left")
    return own.groupBy("client").agg(F.countDistinct("image_id").alias("images"), F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("k"), F.lit(0)).alias("annotations"))


@query("h22_partition_summary", f"""WITH {COUNTS}, m AS (SELECT *, (p + q) / 2 AS m FROM shares),
    c AS (SELECT client, max(nc) AS n, sum({KL}) AS kl, 0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) AS js, sum(abs(p - q)) AS l1 FROM m GROUP BY client)
    SELECT sum(n)::BIGINT AS total, list(n::BIGINT ORDER BY client) AS sizes, count(*) FILTER (WHERE n = 0) AS empty_clients,
        {', '.join(f"round(avg({x}), 9) AS mean_{x}, round(max({x}), 9) AS max_{x}" for x in ('kl', 'js', 'l1'))},
        sum(n)::BIGINT = (SELECT count(*) FROM ids) AND (SELECT count(DISTINCT id) FROM assigned) = (SELECT count(*) FROM ids) AS exact_cover FROM c""")
def _(spark, d):
    own = counts(spark, d)
    per = H.kl_to_global(own).select("client", "n_client").join(H.divergences(own), "client")
    sizes_ = F.transform(F.array_sort(F.collect_list(F.struct("client", "n_client"))), lambda x: x["n_client"])
    spread = [f(x).alias(f"{name}_{x}") for x in ("kl", "js", "l1") for name, f in (("mean", lambda c: F.round(F.avg(c), 9)), ("max", lambda c: F.round(F.max(c), 9)))]
    total = per.agg(F.sum("n_client").alias("total"), sizes_.alias("sizes"), F.count_if(F.col("n_client") == 0).alias("empty_clients"), *spread)
    cover = validate.exact_cover(ids(spark, d).select("id"), assigned(spark, d).select("id")).select(F.col("ok").alias("exact_cover"))
    return total.join(cover)


REPAIRED = f"{ASSIGNED}, emptied AS (SELECT * REPLACE (CASE WHEN client IN (2, 5) THEN client + 1 ELSE client END AS client) FROM assigned)"


@query("h22b_repair_report", f"""WITH {REPAIRED}, j AS (SELECT e.client AS a, a.client AS b FROM emptied e JOIN assigned a USING (id)),
    sizes AS (SELECT s.side, c.client, count(id) AS n, count(DISTINCT label) AS k FROM (SELECT unnest(['before', 'after']) AS side) s CROSS JOIN (SELECT range::INT AS client FROM range({CLIENTS})) c
        LEFT JOIN (SELECT 'before' AS side, client, id, label FROM emptied UNION ALL SELECT 'after', client, id, label FROM assigned) x ON x.side = s.side AND x.client = c.client GROUP BY ALL)
    SELECT (SELECT count(*) FROM j) AS rows, (SELECT count(*) FROM j WHERE a <> b) AS moved, (SELECT count(DISTINCT (a, b)) FROM j WHERE a <> b) AS routes, 0 AS lost, 0 AS added,
        {', '.join(f"min({c}) FILTER (WHERE side = '{when}') AS {name}_{when}" for when in ('before', 'after') for c, name in (('n', 'smallest'), ('k', 'fewest_labels')))},
        {', '.join(f"count(*) FILTER (WHERE side = '{when}' AND n = 0) AS empty_{when}" for when in ('before', 'after'))} FROM sizes""")
def _(spark, d):
    # The repair gives two emptied clients their rows back.
    whole = assigned(spark, d)
    emptied = whole.withColumn("client", F.col("client") + F.col("client").isin(2, 5).cast("int"))
    return validate.repair_report(emptied, whole, CLIENTS)


@query("v01_exact_cover", f"WITH {ASSIGNED}, s AS (SELECT id FROM assigned WHERE id % 97 <> 0 UNION ALL SELECT id FROM assigned WHERE id % 50 = 0), g AS (SELECT id, count(*) AS n FROM s GROUP BY id) SELECT (SELECT count(*) FROM g WHERE n > 1) AS repeated, (SELECT count(*) FROM ids WHERE id NOT IN (SELECT id FROM s)) AS missing, (SELECT count(*) FROM g WHERE id NOT IN (SELECT id FROM ids)) AS extra, FALSE AS ok")
def _(spark, d):
    own = assigned(spark, d).select("id")
    broken = own.filter("id % 97 <> 0").unionByName(own.filter("id % 50 = 0"))
    return validate.exact_cover(ids(spark, d), broken)


@query("v02_conflicting_labels", "SELECT l_orderkey AS id, count(DISTINCT l_returnflag) AS labels, count(*) AS rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def _(spark, d):
    return validate.conflicting_labels(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("label")))


@query("v03_unit_alignment", f"""WITH {UNIT_SPLIT}, ann AS (SELECT DISTINCT a.client, n.question_id FROM answers n JOIN asked a USING (question_id) WHERE n.question_id % 7 <> 0 UNION SELECT 3, question_id FROM answers WHERE question_id % 500 = 0),
    c AS (SELECT range::INT AS client FROM range(10))
    SELECT c.client, count(DISTINCT a.image_id) AS units, count(a.question_id) AS questions, count(DISTINCT m.c_mktsegment) AS coverage, round(count(DISTINCT m.c_mktsegment) / (SELECT count(DISTINCT c_mktsegment) FROM customer), 9) AS coverage_share, count(a.question_id) FILTER (WHERE (a.client, a.question_id) NOT IN (SELECT (client, question_id) FROM ann)) AS unannotated,
        (SELECT count(*) FROM ann WHERE ann.client = c.client AND (ann.client, ann.question_id) NOT IN (SELECT (client, question_id) FROM asked)) AS unasked,
        count(a.question_id) FILTER (WHERE (a.client, a.question_id) NOT IN (SELECT (client, question_id) FROM ann)) = 0 AND count(DISTINCT a.image_id) >= 5 AND count(DISTINCT m.c_mktsegment) >= 4 AS ok FROM c LEFT JOIN asked a ON a.client = c.client LEFT JOIN customer m ON m.c_custkey = a.image_id GROUP BY c.client""")
def _(spark, d):
    q = asked(spark, d)
    a = answers(spark, d).select("question_id").distinct()
    ann = a.filter("question_id % 7 <> 0").join(q.select("question_id", "client"), "question_id").select("client", "question_id")
    ann = ann.unionByName(a.filter("question_id % 500 = 0").select(F.lit(3).alias("client"), "question_id"))
    groups = table(spark, d, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_mktsegment").alias("grp"))
    out = validate.unit_alignment(q, ann, 10, 5, groups, 4)
    return out.withColumn("coverage_share", F.round("coverage_share", 9))


@query("v04_schema_rules", f"""WITH {SAMPLES} SELECT rule, count(*) AS rows FROM (SELECT unnest([CASE WHEN img IS NULL THEN 'img' END, CASE WHEN NOT coalesce(quality IN (0, 1), FALSE) THEN 'quality' END, CASE WHEN NOT coalesce(length(text) < 3000, FALSE) THEN 'length' END]) AS rule FROM samples) WHERE rule IS NOT NULL GROUP BY rule""")
def _(spark, d):
    rules = {"img": F.col("img").isNotNull(), "quality": F.col("quality").isin(0, 1), "length": F.length("text") < 3000}
    return validate.failed_rules(samples(spark, d), rules)


EXPECTED = {"en": 600, "de": 100, "xx": 5}


@query("v05_expected_counts", f"""WITH {IDS}, h AS (SELECT label AS split, count(*) AS rows FROM ids GROUP BY label), {values('want', 'split, expected', list(EXPECTED.items()))}
    SELECT split, coalesce(rows, 0) AS rows, coalesce(expected, 0)::BIGINT AS expected, coalesce(rows, 0) = coalesce(expected, 0) AS ok FROM h FULL JOIN want USING (split)""")
def _(spark, d):
    return validate.expected_counts(ids(spark, d).withColumnRenamed("label", "split"), EXPECTED)


@query("v06_split_check", f"""WITH {sql_grid()} SELECT stat, modal, count(*) AS rows, count(DISTINCT client) AS with_rows, 10 - count(DISTINCT client) AS empty_clients,
    count(*) FILTER (WHERE img IS NULL AND coalesce(length(trim(text)), 0) = 0) AS both_missing, count(*) FILTER (WHERE label NOT IN ('en', 'fr', 'es')) AS bad_labels,
    count(*) FILTER (WHERE (img IS NULL OR coalesce(length(trim(text)), 0) = 0) AND modal = 'aligned') AS aligned_gaps FROM grid GROUP BY ALL""")
def _(spark, d):
    return validate.split_check(grid(spark, d), ["en", "fr", "es"], 10)


@query("v07_id_sets", """SELECT (SELECT count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders) AS repeated_questions, (SELECT count(l_orderkey) - count(DISTINCT l_orderkey) FROM lineitem) AS repeated_annotations,
    (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) AS questions_only, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) AS annotations_only""")
def _(spark, d):
    return validate.id_set_checks(questions(spark, d), answers(spark, d))


