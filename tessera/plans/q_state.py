"""Queries of the model-state operators and of parameter selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import state as A
from .views import PARAMS, params, query, values

CELL = ["key", "pos"]
R = 8  # digits that sums are compared with


def rounded(df, *names):
    return df.select(*[F.round(c, R).alias(c) if c in names else F.col(c) for c in df.columns])


MEAN = f"{PARAMS}, mean AS (SELECT round, key, pos, sum(value * sample_num) / sum(sample_num) AS value FROM params GROUP BY ALL)"


@query("a01_weighted_average", f"WITH {MEAN} SELECT round, key, pos, round(value, {R}) AS value FROM mean")
def _(spark, d):
    return rounded(A.weighted_average(params(spark, d), ["round", *CELL]), "value")


@query("a02_cross_domain_average", f"WITH {PARAMS}, p AS (SELECT *, client % 2 AS domain FROM params) SELECT key, pos, round(sum(value * sample_num * (1 + domain)) / sum(sample_num * (1 + domain)), {R}) AS value FROM p GROUP BY ALL")
def _(spark, d):
    own = params(spark, d).withColumn("weight", F.col("sample_num") * (1 + F.col("client") % 2))
    return rounded(A.weighted_average(own, CELL, weight="weight"), "value")


@query("a03_uplink_cost", f"""WITH {PARAMS}, n AS (SELECT count(DISTINCT client) AS c, count(DISTINCT (key, pos)) AS k FROM params)
    SELECT 'average' AS rule, 4 * c * k AS bytes FROM n UNION ALL SELECT 'critical', 4 * c * k + c * k FROM n UNION ALL SELECT 'control', 4 * 20 * 2 * k FROM n""")
def _(spark, d):
    p = params(spark, d)
    parts = [A.uplink_cost(p, rule, 20).withColumn("rule", F.lit(rule)) for rule in ("average", "critical", "control")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("rule", "bytes")


@query("a04_traffic", f"""WITH {PARAMS}, r AS (SELECT round, count(DISTINCT client) AS clients, count(DISTINCT (key, pos)) AS params FROM params GROUP BY round),
    t AS (SELECT *, 4 * clients * params AS bytes, (sum(4 * clients * params) OVER (ORDER BY round))::BIGINT AS total FROM r)
    SELECT round, bytes, total, CASE WHEN total >= 1073741824 THEN printf('%.2f GB', total / 1073741824) WHEN total >= 1048576 THEN printf('%.2f MB', total / 1048576) ELSE printf('%.2f KB', total / 1024) END AS text FROM t""")
def _(spark, d):
    rounds = params(spark, d).groupBy("round").agg(F.countDistinct("client").alias("clients"), F.countDistinct("key", "pos").alias("params"))
    return A.traffic(rounds).select("round", "bytes", "total", "text")


def fold(rule: str, mean: str = "mean") -> str:
    """The recurrence in SQL, one recursive step a round."""
    m = "CASE WHEN s.n = 0 THEN c.d ELSE 0.9 * s.m + 0.1 * c.d END"
    v = {"momentum": "s.v", "adagrad": "s.v + c.d * c.d", "yogi": f"s.v - 0.01 * ({m}) * ({m}) * sign(s.v - ({m}) * ({m}))", "adam": f"0.99 * s.v + 0.01 * ({m}) * ({m})"}[rule]
    move = {"momentum": m, "adagrad": f"0.1 * c.d / (sqrt({v}) + 0.001)"}.get(rule, f"0.1 * ({m}) / (sqrt({v}) + 0.001)")
    source = MEAN if mean == "mean" else f"{PARAMS}, mean AS (SELECT round, key, pos, avg(value) AS value FROM params GROUP BY ALL)"
    return f"""WITH RECURSIVE {source}, c AS (SELECT *, value - coalesce(lag(value) OVER w, 0) AS d, row_number() OVER w AS n FROM mean WINDOW w AS (PARTITION BY key, pos ORDER BY round)),
        s AS (SELECT key, pos, 0::BIGINT AS n, 0::DOUBLE AS w, 0::DOUBLE AS m, 1e-6::DOUBLE AS v FROM (SELECT DISTINCT key, pos FROM mean)
              UNION ALL SELECT s.key, s.pos, c.n, s.w + {move}, {m}, {v} FROM s JOIN c ON c.key = s.key AND c.pos = s.pos AND c.n = s.n + 1)
        SELECT key, pos, round(arg_max(w, n), 6) AS w FROM s GROUP BY key, pos"""


def register_rules() -> None:
    for name, rule, weighted in (("a05_momentum", "momentum", True), ("a06_adagrad", "adagrad", False), ("a07_yogi", "yogi", True), ("a08_adam", "adam", True)):

        @query(name, fold(rule, "mean" if weighted else "plain"))
        def _(spark, d, rule=rule, weighted=weighted):
            return A.server_rule(A.deltas(params(spark, d), weighted), rule).select("key", "pos", F.round("w", 6).alias("w"))


register_rules()

#: Clients with their step counts; some are null, or 0 and so at the floor.
STEPS = [(c, float(100 + 13 * c), None if c == 3 else float(c % 4)) for c in range(10)]
BEFORE = "before_ AS (SELECT key, pos, avg(value) AS w FROM params WHERE round = 0 GROUP BY key, pos)"


def before(spark, d):
    return params(spark, d).filter("round = 0").groupBy(*CELL).agg(F.avg("value").alias("w"))


@query("a09_normalised_average", f"""WITH {PARAMS}, {BEFORE}, {values('steps', 'client, n, tau', STEPS)}, p AS (SELECT client, n / sum(n) OVER () AS p, greatest(coalesce(tau, 1), 0.25) AS t FROM steps),
    e AS (SELECT sum(p * t) AS e FROM p) SELECT key, pos, round(max(w) + 0.5 * max(e) * sum(p * (value - w) / t), 4) AS w FROM params JOIN p USING (client) JOIN before_ USING (key, pos) CROSS JOIN e WHERE round = 1 GROUP BY key, pos""")
def _(spark, d):
    clients = A.local_steps(spark.createDataFrame(STEPS, "client int, sample_num double, tau double"), eps=0.25)
    own = params(spark, d).filter("round = 1").drop("sample_num")
    return A.normalised_average(own, before(spark, d), clients, 0.5).select("key", "pos", F.round("w", 4).alias("w"))


CHANGES = f"{PARAMS}, {BEFORE}, ch AS (SELECT client, sample_num, p.key, p.pos, value - w AS dy, (value - w) / 2 AS dc FROM params p JOIN before_ b ON b.key = p.key AND b.pos = p.pos WHERE round = 1)"


def changes(spark, d):
    own = params(spark, d).filter("round = 1").join(before(spark, d), CELL)
    return own.select("client", "sample_num", *CELL, (F.col("value") - F.col("w")).alias("dy"), ((F.col("value") - F.col("w")) / 2).alias("dc"))


def control(weighted: bool):
    def run(spark, d):
        start = before(spark, d).withColumn("c", F.lit(0.25))
        return rounded(A.control_server(changes(spark, d), start, 20, 0.5, weighted), "w", "c")

    return run


for _name, _weighted, _dy in (("a10_control_weighted", True, "sum(sample_num * dy) / sum(sample_num)"), ("a11_control_mean", False, "avg(dy)")):
    query(_name, f"""WITH {CHANGES}, s AS (SELECT key, pos, {_dy} AS dy, sum(dc) AS dc FROM ch GROUP BY key, pos)
        SELECT b.key, b.pos, round(w + 0.5 * coalesce(dy, 0), {R}) AS w, round(0.25 + coalesce(dc, 0) / 20, {R}) AS c FROM before_ b LEFT JOIN s ON s.key = b.key AND s.pos = b.pos""")(control(_weighted))


@query("a12_client_control", f"""WITH {PARAMS}, b AS (SELECT * FROM params WHERE round = 0), a AS (SELECT * FROM params WHERE round = 1),
    j AS (SELECT b.client, b.key, b.pos, 0.1 AS ci, 0.05 AS c, b.value AS wb, a.value AS wa FROM b LEFT JOIN a ON a.client = b.client AND a.key = b.key AND a.pos = b.pos)
    SELECT client, key, pos, round(CASE WHEN wb IS NOT NULL AND wa IS NOT NULL THEN ci - c + (wb - wa) / (5 * 0.01) ELSE ci END, 6) AS c_new FROM j""")
def _(spark, d):
    p = params(spark, d)
    after = p.filter("round = 1").select("client", *CELL, F.col("value").alias("w_after"))
    rows = p.filter("round = 0").select("client", *CELL, F.lit(0.1).alias("ci"), F.lit(0.05).alias("c"), F.col("value").alias("w_before")).join(after, ["client", *CELL], "left")
    return A.client_control(rows, 5, 0.01).select("client", *CELL, F.round("c_new", 6).alias("c_new"))


MASKS = f"""{PARAMS}, own AS (SELECT client, key, pos, avg(value) AS w FROM params GROUP BY ALL), sc AS (SELECT *, abs((w * 0.5) * w) AS score FROM own),
    rk AS (SELECT *, row_number() OVER (PARTITION BY client, key ORDER BY score DESC, pos) - 1 AS r, count(*) OVER (PARTITION BY client, key) AS n FROM sc),
    th AS (SELECT client, key, max(CASE WHEN r = greatest(floor(n * 0.3), 1) - 1 THEN score END) AS kth, min(CASE WHEN score > 1e-20 THEN score END) AS least FROM rk GROUP BY client, key),
    masks AS (SELECT rk.client, rk.key, rk.pos, rk.w, score >= CASE WHEN kth <= 1e-10 THEN coalesce(least, 'inf'::DOUBLE) ELSE kth END AS mask FROM rk JOIN th USING (client, key))"""


def cells(spark, d):
    return params(spark, d).groupBy("client", *CELL).agg(F.avg("value").alias("w")).withColumn("d", F.col("w") * 0.5)


def masks(spark, d):
    return A.critical_mask(cells(spark, d), 0.3)


@query("a13_critical_mask", f"WITH {MASKS} SELECT client, key, pos, mask FROM masks")
def _(spark, d):
    return masks(spark, d).select("client", "key", "pos", "mask")


OVERLAP = f"""{MASKS}, overlap AS (SELECT a.client AS i, b.client AS j, 1 - sum(abs(a.mask::INT - b.mask::INT)) / (2 * sum(a.mask::INT)) AS overlap FROM masks a JOIN masks b ON a.key = b.key AND a.pos = b.pos AND a.client <> b.client GROUP BY ALL),
    pairs AS (SELECT i, j FROM overlap, (SELECT avg(overlap) AS m, max(overlap) AS t FROM overlap) WHERE overlap >= m + 2 / 10 * (t - m) - 1e-12)"""


@query("a14_mask_overlap", f"WITH {OVERLAP} SELECT o.i, o.j, round(overlap, {R}) AS overlap, p.i IS NOT NULL AS chosen FROM overlap o LEFT JOIN pairs p ON p.i = o.i AND p.j = o.j")
def _(spark, d):
    over = A.mask_overlap(masks(spark, d))
    chosen = A.collaborators(over, 1, 10).withColumn("chosen", F.lit(True))
    return over.join(chosen, ["i", "j"], "left").select("i", "j", F.round("overlap", R).alias("overlap"), F.coalesce("chosen", F.lit(False)).alias("chosen"))


CUSTOM = f"""{OVERLAP}, all_ AS (SELECT i, j FROM pairs UNION ALL SELECT DISTINCT client, client FROM masks), custom AS (SELECT a.i AS client, key, pos, avg(w) AS custom FROM all_ a JOIN masks m ON m.client = a.j GROUP BY ALL)"""


def custom(spark, d):
    m = masks(spark, d)
    pairs = A.collaborators(A.mask_overlap(m), 1, 10)
    return m, A.customised(m.select("client", *CELL, F.col("w").alias("value")), pairs)


@query("a15_customised_average", f"WITH {CUSTOM} SELECT client, key, pos, round(custom, {R}) AS custom FROM custom")
def _(spark, d):
    return rounded(custom(spark, d)[1], "custom")


@query("a16_masked_merge", f"""WITH {CUSTOM}, g AS (SELECT key, pos, avg(w) AS g FROM masks GROUP BY ALL)
    SELECT m.client, m.key, m.pos, round(CASE WHEN mask THEN custom ELSE g END, {R}) AS value FROM masks m JOIN custom c USING (client, key, pos) JOIN g ON g.key = m.key AND g.pos = m.pos""")
def _(spark, d):
    m, own = custom(spark, d)
    shared = m.groupBy(*CELL).agg(F.avg("w").alias("value"))
    return rounded(A.masked_merge(m, own, shared), "value")


@query("a17_state_summary", f"WITH {PARAMS} SELECT client, count(DISTINCT key) AS tensors, count(*) AS params, round(sqrt(sum(value * value)), {R}) AS l2 FROM params GROUP BY client")
def _(spark, d):
    return rounded(A.summary(params(spark, d), "client"), "l2")


TWO = f"{MEAN}, a AS (SELECT * FROM mean WHERE round = 0), b AS (SELECT * FROM mean WHERE round = 1), j AS (SELECT a.key, a.pos, a.value AS x, b.value AS y FROM a JOIN b ON a.key = b.key AND a.pos = b.pos)"


def two(spark, d):
    mean = A.weighted_average(params(spark, d), ["round", *CELL])
    return mean.filter("round = 0"), mean.filter("round = 1")


@query("a18_state_difference", f"WITH {TWO}, k AS (SELECT key, sum((x - y) * (x - y)) AS s2, power(sum(power(abs(x - y), 3)), 1 / 3.0) AS n FROM j GROUP BY key) SELECT round(sqrt(sum(s2)), 7) AS l2, round(sum(n), 7) AS norms FROM k")
def _(spark, d):
    return A.difference(*two(spark, d), p=3.0).select(F.round("l2", 7).alias("l2"), F.round("norms", 7).alias("norms"))


@query("a19_state_arithmetic", f"WITH {TWO} SELECT key, pos, round(x + y, {R}) AS added, round(x - y, {R}) AS taken, round(x * 0.5, {R}) AS scaled FROM j")
def _(spark, d):
    return rounded(A.arithmetic(*two(spark, d), 0.5), "added", "taken", "scaled")


WORDS = ["layer", ".1", ".2", "w", "adapter"]


@query("a20_prefix_audit", f"""WITH {PARAMS}, {values('words', 'keyword', [(w,) for w in WORDS])} SELECT array_to_string(list_slice(string_split(key, '.'), 1, 2), '.') AS name, count(*) AS params FROM params GROUP BY 1
    UNION ALL SELECT 'has ' || keyword, count(p.key) FROM words LEFT JOIN params p ON contains(p.key, keyword) GROUP BY keyword""")
def _(spark, d):
    p = params(spark, d)
    words = A.keyword_audit(p, WORDS).select(F.concat(F.lit("has "), "keyword").alias("name"), "params")
    return A.prefix_audit(p, 2).select(F.col("prefix").alias("name"), "params").unionByName(words)


@query("a21_watched_key", f"WITH {PARAMS} SELECT round, round(avg(value), {R}) AS mean, round(coalesce(stddev_samp(value), 0), {R}) AS sd FROM params WHERE key = 'layer.1.w' GROUP BY round")
def _(spark, d):
    return rounded(A.watched(params(spark, d), "layer.1.w", "round"), "mean", "sd")


@query("a22_vector_distances", """WITH v AS (SELECT vec_id AS id, embedding AS x FROM embeddings), l AS (SELECT id, unnest(range(1, len(x) + 1)) AS pos, x FROM v),
    p AS (SELECT l.id, l.x[l.pos]::DOUBLE AS x, w.x[l.pos]::DOUBLE AS y FROM l JOIN v w ON w.id = l.id + 1)
    SELECT id, round(sum((x - y) * (x - y)), 7) AS l2sq, round(1 - sum(x * y) / sqrt(sum(x * x) * sum(y * y)), 7) AS cosine_distance, round(CASE WHEN sum((x - y) * (x - y)) > 0 THEN -10 * log10(sum((x - y) * (x - y)) / count(*)) END, 6) AS psnr FROM p GROUP BY id""")
def _(spark, d):
    from .views import table

    long = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("pos", "v")).select("id", "pos", F.col("v").cast("double").alias("x"))
    after = long.select((F.col("id") - 1).alias("id"), "pos", F.col("x").alias("y"))
    out = A.vector_distances(long.join(after, ["id", "pos"]))
    return out.select("id", F.round("l2sq", 7).alias("l2sq"), F.round("cosine_distance", 7).alias("cosine_distance"), F.round("psnr", 6).alias("psnr"))


@query("a23_resume_merge", f"WITH {TWO} SELECT a.key, a.pos, round(coalesce(b.value, a.value), {R}) AS value FROM a LEFT JOIN b ON b.key = a.key AND b.pos = a.pos AND b.pos % 3 = 0")
def _(spark, d):
    a, b = two(spark, d)
    return rounded(A.resumed(a, b.filter("pos % 3 = 0")), "value")


@query("f03_parameter_selection", f"WITH {PARAMS} SELECT 'contain' AS how, key, count(*) AS n FROM params WHERE contains(key, '.1') OR contains(key, '.7') GROUP BY key UNION ALL SELECT 'except', key, count(*) FROM params WHERE NOT (contains(key, '.1') OR contains(key, '.7')) GROUP BY key")
def _(spark, d):
    p = params(spark, d)
    parts = [A.select_parameters(p, how, [".1", ".7"]).groupBy("key").agg(F.count(F.lit(1)).alias("n")).select(F.lit(how).alias("how"), "key", "n") for how in ("contain", "except")]
    return parts[0].unionByName(parts[1])


SETS = [[".1", ".2"], [".3"], [".4", "5"]]


@query("f04_rotating_selection", f"""WITH {PARAMS}, {values('sets', 'idx, word', [(i, w) for i, s in enumerate(SETS) for w in s])}
    SELECT round, key, count(*) AS n FROM params p WHERE EXISTS (SELECT 1 FROM sets WHERE idx = (round // 2) % 3 AND contains(p.key, word)) GROUP BY ALL""")
def _(spark, d):
    return A.rotating_selection(params(spark, d), SETS).groupBy("round", "key").agg(F.count(F.lit(1)).alias("n"))


@query("j09_pairwise_clients", f"WITH {PARAMS}, m AS (SELECT client, key, pos, avg(value) > 0 AS m FROM params GROUP BY ALL) SELECT a.client AS i, b.client AS j, count(*) AS cells, count(*) FILTER (WHERE a.m = b.m) AS same FROM m a JOIN m b ON a.key = b.key AND a.pos = b.pos AND a.client <> b.client GROUP BY ALL")
def _(spark, d):
    m = params(spark, d).groupBy("client", *CELL).agg((F.avg("value") > 0).alias("mask"))
    return A.client_pairs(m).select("i", "j", "cells", (F.col("known") - F.col("differ")).alias("same"))
