"""Queries of the evaluation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluate as E
from ..operators import state as A
from ..operators.joins import score_drop
from .views import PREDS, SEED, TRACE, preds, query, sql_u, table, trace

OPTIONS = {"A": "A", "N": "N", "R": "R"}
NAMES = ["A", "N", "R"]
LETTER = "CASE WHEN trim(raw) = '' THEN 'UNK' WHEN raw LIKE 'The answer is %' THEN right(raw, 1) WHEN raw LIKE '(%' THEN raw[2] WHEN raw IN ('A', 'N', 'R') THEN raw ELSE 'UNK' END"
SCORED = f"{PREDS}, scored AS (SELECT *, {LETTER} AS pred FROM preds), typed AS (SELECT *, CASE WHEN trim(raw) = '' THEN 'empty_output' WHEN pred = 'UNK' THEN 'parse_error' WHEN pred = gt THEN 'correct' ELSE 'wrong_prediction' END AS error_type FROM scored)"
CONF = f"{SCORED}, conf AS (SELECT gt, pred, count(*) AS n FROM scored GROUP BY ALL)"


def scored(spark, d):
    return preds(spark, d).withColumn("pred", F.coalesce(E.answer_letter(F.col("raw"), {"A": "zzz", "N": "yyy", "R": "xxx"}), F.lit(E.UNKNOWN)))


def typed(spark, d):
    return scored(spark, d).withColumn("error_type", E.error_type(F.col("gt"), F.col("raw"), F.col("pred")))


@query("e01_strict_label", f"WITH {PREDS} SELECT id, CASE WHEN raw LIKE '(A)%' THEN 'accept' WHEN raw LIKE '(R)%' THEN 'return' WHEN raw = 'A' THEN 'accept' WHEN raw = 'N' THEN 'none' WHEN raw = 'R' THEN 'return' END AS label FROM preds")
def _(spark, d):
    return preds(spark, d).select("id", E.strict_label(F.col("raw"), {"A": "accept", "N": "none", "R": "return"}).alias("label"))


@query("e02_answer_letter", f"WITH {SCORED} SELECT id, pred FROM scored")
def _(spark, d):
    return scored(spark, d).select("id", "pred")


@query("e03_canonical_label", f"WITH {SCORED} SELECT id, CASE pred WHEN 'A' THEN 'answered' WHEN 'N' THEN 'never' WHEN 'R' THEN 'flag' ELSE 'UNK' END AS label FROM scored")
def _(spark, d):
    return preds(spark, d).select("id", E.canonical_label(F.col("raw"), {"A": "answered", "N": "never", "R": "flag"}).alias("label"))


@query("e04_error_taxonomy", f"WITH {SCORED}, k AS (SELECT unnest(['correct', 'empty_output', 'parse_error', 'wrong_prediction']) AS error_type) SELECT k.error_type, count(t.id) AS n, round(count(t.id) / (SELECT count(*) FROM typed), 9) AS ratio FROM k LEFT JOIN typed t USING (error_type) GROUP BY k.error_type")
def _(spark, d):
    return E.error_counts(typed(spark, d)).select("error_type", "n", F.round("ratio", 9).alias("ratio"))


F1 = """cls AS (SELECT coalesce(t.label, g.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, coalesce(guessed, 0) AS guessed
    FROM (SELECT gt AS label, sum(n) AS support, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM conf GROUP BY gt) t FULL JOIN (SELECT pred AS label, sum(n) AS guessed FROM conf GROUP BY pred) g ON t.label = g.label),
    f AS (SELECT *, CASE WHEN guessed > 0 THEN tp / guessed ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN guessed + support > 0 THEN 2 * tp / (guessed + support) ELSE 0 END AS f1 FROM cls)"""


@query("e05_accuracy_f1", f"WITH {CONF}, {F1} SELECT round(sum(tp) / sum(support), 4) AS accuracy, round(avg(f1), 4) AS f1_macro, round(sum(f1 * support) / sum(support), 4) AS f1_weighted, sum(support)::BIGINT AS n FROM f")
def _(spark, d):
    return E.accuracy_f1(E.confusion(scored(spark, d)))


@query("e06_class_report", f"WITH {CONF}, {F1} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM f WHERE label IN ('A', 'N', 'R')")
def _(spark, d):
    s = E.class_scores(E.confusion(scored(spark, d))).filter(F.col("label").isin(NAMES))
    return s.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("e07_confusion_matrix", f"WITH {CONF}, l AS (SELECT unnest(['A', 'N', 'R']) AS x) SELECT a.x AS gt, b.x AS pred, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN conf ON conf.gt = a.x AND conf.pred = b.x")
def _(spark, d):
    return E.dense_confusion(E.confusion(scored(spark, d)), NAMES)


AUC = f"""{PREDS}, ok AS (SELECT *, [greatest(x, 0) for x in score_vector] AS c FROM preds), v AS (SELECT gt, [x / list_sum(c) for x in c] AS s FROM ok WHERE list_sum(c) > 0),
    long AS (SELECT gt, unnest(['A', 'N', 'R']) AS label, unnest(s) AS s FROM v), cell AS (SELECT label, s, count(*) AS n, count(*) FILTER (WHERE gt = label) AS pos FROM long GROUP BY ALL),
    rk AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY label ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM cell),
    auc AS (SELECT label, (sum(pos * r) - sum(pos) * (sum(pos) + 1) / 2) / (sum(pos) * (sum(n) - sum(pos))) AS auc, sum(pos)::BIGINT AS support FROM rk GROUP BY label)"""


@query("e08_auc", f"WITH {AUC} SELECT label, round(auc, 6) AS auc, support FROM auc UNION ALL SELECT 'macro', round(avg(auc), 6), sum(support)::BIGINT FROM auc UNION ALL SELECT 'weighted', round(sum(auc * support) / sum(support), 6), sum(support)::BIGINT FROM auc")
def _(spark, d):
    # The clipped sum is the same fold in both engines: left to right.
    a = E.class_auc(E.valid_scores(preds(spark, d), NAMES), NAMES)
    macro = a.agg(F.lit("macro").alias("label"), F.avg("auc").alias("auc"), F.sum("support").alias("support"))
    weighted = a.agg(F.lit("weighted").alias("label"), (F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc"), F.sum("support").alias("support"))
    return a.unionByName(macro).unionByName(weighted).select("label", F.round("auc", 6).alias("auc"), "support")


@query("e09_softmax", f"WITH {PREDS}, e AS (SELECT id, [exp(x - list_max(score_vector)) for x in score_vector] AS e FROM preds) SELECT id, [round(x / list_sum(e), 9) for x in e] || [0.0::DOUBLE] AS p FROM e")
def _(spark, d):
    p = E.softmax(F.col("score_vector"), 4)
    return preds(spark, d).select("id", F.transform(p, lambda x: F.round(x, 9)).alias("p"))


@query("e10_top_labels", f"WITH {PREDS} SELECT id, [['A', 'N', 'R'][x[2]] for x in list_slice(list_sort([[-score_vector[i], i] for i in range(1, 4)]), 1, 2)] AS top FROM preds".replace("['A', 'N', 'R'][x[2]]", "['A', 'N', 'R'][x[2]::INT]"))
def _(spark, d):
    return preds(spark, d).select("id", E.top_labels(F.col("score_vector"), NAMES, 2).alias("top"))


@query("e11_prediction_diagnostics", f"WITH {SCORED}, g AS (SELECT gt AS label, count(*) AS n_true FROM scored GROUP BY gt), p AS (SELECT pred AS label, count(*) AS n_pred FROM scored GROUP BY pred) SELECT label, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(n_pred, 0) = 0 AS never_predicted, label NOT IN ('A', 'N', 'R') AS out_of_set FROM g FULL JOIN p USING (label)")
def _(spark, d):
    s = scored(spark, d)
    g = s.groupBy(F.col("gt").alias("label")).agg(F.count(F.lit(1)).alias("n_true"))
    p = s.groupBy(F.col("pred").alias("label")).agg(F.count(F.lit(1)).alias("n_pred"))
    both = g.join(p, "label", "full").na.fill(0)
    return both.withColumn("never_predicted", F.col("n_pred") == 0).withColumn("out_of_set", ~F.col("label").isin(NAMES))


QA_ROWS = """qa AS (SELECT o_orderkey AS id, o_orderstatus AS pred, o_orderpriority AS kind, list(l_linestatus ORDER BY l_linenumber) AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
    s AS (SELECT *, list_contains(refs, pred) AS hit, least(1.0, len([x for x in refs if x = pred]) / 3.0) AS soft FROM qa)"""


def qa(spark, d):
    refs = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linestatus").alias("refs"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("pred"), F.col("o_orderpriority").alias("kind")).join(refs, "id")
    exact, soft = E.qa_scores(F.col("pred"), F.col("refs"))
    return own.withColumn("exact", exact).withColumn("soft", soft)


@query("e11b_abnormal_outputs", f"""WITH {SCORED}, w AS (SELECT *, trim(regexp_replace(regexp_replace(lower(raw), '[^a-z0-9_ ]', '', 'g'), ' +', ' ', 'g')) AS words, pred IN ('A', 'N', 'R', 'Z') AS inside FROM scored)
    SELECT count(*) AS n, count(*) FILTER (WHERE trim(raw) = '') AS raw_empty, round(count(*) FILTER (WHERE trim(raw) = '') / count(*), 9) AS raw_empty_share,
        count(*) FILTER (WHERE NOT inside) AS out_of_set, round(count(*) FILTER (WHERE NOT inside) / count(*), 9) AS out_of_set_share,
        count(*) FILTER (WHERE inside AND words NOT IN ('a', 'n', 'r', 'z')) AS fallback, round(count(*) FILTER (WHERE inside AND words NOT IN ('a', 'n', 'r', 'z')) / count(*), 9) AS fallback_share,
        count(*) FILTER (WHERE pred = 'UNK') AS unknown, round(count(*) FILTER (WHERE pred = 'UNK') / count(*), 9) AS unknown_share,
        list_sort(list_filter(['A', 'N', 'R', 'Z'], lambda x: NOT list_contains(list(DISTINCT gt), x))) AS missing_labels FROM w""")
def _(spark, d):
    out = E.abnormal_outputs(scored(spark, d), [*NAMES, "Z"])
    return out.select("n", *[F.round(c, 9).alias(c) if c.endswith("_share") else F.col(c) for c in out.columns if c not in ("n", "missing_labels")], "missing_labels")


@query("e12_qa_scores", f"WITH {QA_ROWS} SELECT id, CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS exact, round(soft::DOUBLE, 9) AS soft FROM s")
def _(spark, d):
    return qa(spark, d).select("id", "exact", F.round("soft", 9).alias("soft"))


@query("e13_qa_metrics", f"WITH {QA_ROWS} SELECT kind, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS exact, round(avg(soft::DOUBLE), 4) AS soft, count(*) AS n, round(avg(len(refs)), 4) AS mean_refs FROM s GROUP BY ROLLUP (kind)")
def _(spark, d):
    return qa(spark, d).rollup("kind").agg(F.round(F.avg("exact"), 4).alias("exact"), F.round(F.avg("soft"), 4).alias("soft"), F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size("refs")), 4).alias("mean_refs"))


@query("e14_references", "SELECT o_orderkey AS id, CASE WHEN count(l_linenumber) > 0 THEN list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_returnflag <> 'N') ELSE NULL END AS refs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1".replace("list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_returnflag <> 'N')", "coalesce(list(l_returnflag ORDER BY l_linenumber, l_returnflag) FILTER (WHERE l_returnflag <> 'N'), [])").replace("ELSE NULL", "ELSE [o_orderpriority]").replace("GROUP BY 1", "GROUP BY o_orderkey, o_orderpriority"))
def _(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("  ").alias("a")))), lambda x: x["a"]).alias("given"))
    own = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority").join(li, "id", "left")
    kept = F.filter(F.transform("given", lambda x: F.trim(x)), lambda x: x != "")
    return own.select("id", F.coalesce(kept, F.array(F.trim("o_orderpriority"))).alias("refs"))


# ROUGE of neighbouring benchmark items (whole texts).
TOK = "string_split_regex(lower({c}), '[^a-z0-9]+')"
BENCH = f"""b AS (SELECT item_id AS id, [x for x in {TOK.format(c='text')} if x <> ''] AS t FROM benchmark), pr AS (SELECT x.id, x.t AS a, y.t AS b FROM b x JOIN b y ON y.id = x.id + 1)"""


def bench(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("a"))
    return b.join(b.select((F.col("id") - 1).alias("id"), F.col("a").alias("b")), "id")


def sql_rouge(n: int) -> str:
    gram = lambda c: f"[array_to_string(list_slice({c}, i, i + {n - 1}), ' ') for i in range(1, len({c}) - {n - 2})]"
    return f"""WITH {BENCH}, g AS (SELECT id, unnest({gram('a')}) AS g, 1 AS x, 0 AS y FROM pr UNION ALL SELECT id, unnest({gram('b')}), 0, 1 FROM pr),
        c AS (SELECT id, g, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL), o AS (SELECT id, sum(least(x, y)) AS o, sum(x) AS na, sum(y) AS nb FROM c GROUP BY id)
        SELECT pr.id, round(coalesce(CASE WHEN o > 0 THEN 2 * o / (na + nb) END, 0), 9) AS f FROM pr LEFT JOIN o USING (id)"""


for _n in (1, 2):

    @query(f"e15_rouge_{_n}", sql_rouge(_n))
    def _(spark, d, n=_n):
        return E.rouge_n(bench(spark, d), n).select("id", F.round("f", 9).alias("f"))


@query("e16_rouge_l")
def _(spark, d):
    return E.rouge_l(bench(spark, d)).select("id", F.round("f", 9).alias("f"))


#: Items with their references, the three that follow, by the F of ROUGE-1 and ROUGE-2.
MULTI = f"""b AS (SELECT item_id AS id, text, [x for x in {TOK.format(c='text')} if x <> ''] AS t FROM benchmark), b2 AS (SELECT 'rouge1' AS metric, id, t FROM b UNION ALL SELECT 'rouge2', id, [array_to_string(list_slice(t, i, i + 1), ' ') for i in range(1, len(t))] FROM b),
    pr AS (SELECT x.metric, x.id, y.id AS ref, x.t AS a, y.t AS b FROM b2 x JOIN b2 y ON x.metric = y.metric AND y.id IN (x.id + 1, x.id + 2, x.id + 3)),
    g AS (SELECT metric, id, ref, unnest(a) AS g, 1 AS x, 0 AS y FROM pr UNION ALL SELECT metric, id, ref, unnest(b), 0, 1 FROM pr), c AS (SELECT metric, id, ref, g, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL),
    o AS (SELECT metric, id, ref, sum(least(x, y)) AS o, sum(x) AS na, sum(y) AS nb FROM c GROUP BY ALL), s AS (SELECT pr.metric, pr.id, pr.ref, round(coalesce(CASE WHEN o > 0 THEN 2 * o / (na + nb) END, 0), 9) AS f FROM pr LEFT JOIN o USING (metric, id, ref))"""


def references(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("a"))
    asked = b.select("id", "a", F.explode(F.array(*[F.col("id") + k for k in (1, 2, 3)])).alias("ref"))
    return asked.join(b.select(F.col("id").alias("ref"), F.col("a").alias("b")), "ref").select(F.struct("id", "ref").alias("pair"), "a", "b")


def multi(spark, d, metrics=("rouge1", "rouge2")):
    """``metric, id, ref, f`` of items with their references."""
    pairs, found = references(spark, d), {}
    for m in metrics:
        found[m] = E.rouge_l(pairs, "pair") if m == "rougeL" else E.rouge_n(pairs, int(m[-1]), "pair")
    parts = [df.select(F.lit(m).alias("metric"), "pair.id", "pair.ref", F.round("f", 9).alias("f")) for m, df in found.items()]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def best_of(rows):
    return rows.groupBy("metric", "id").agg(F.max_by("ref", F.struct(F.col("f"), -F.col("ref"))).alias("ref"), F.max("f").alias("f"))


@query("e17_best_reference", f"WITH {MULTI} SELECT metric, id, arg_max(ref, (f, -ref)) AS ref, max(f) AS f FROM s GROUP BY metric, id")
def _(spark, d):
    return best_of(multi(spark, d))


@query("e17b_best_reference_l")
def _(spark, d):
    return best_of(multi(spark, d, ("rougeL",)))


def summary(rows):
    return rows.groupBy("metric").agg(F.round(F.avg("f"), 8).alias("mean"), F.max("f").alias("most"), F.round(F.stddev_pop("f"), 8).alias("sd"))


@query("e18_score_summary", f"WITH {MULTI} SELECT metric, round(avg(f), 8) AS mean, max(f) AS most, round(stddev_pop(f), 8) AS sd FROM s GROUP BY metric")
def _(spark, d):
    return summary(multi(spark, d))


@query("e18b_score_summary_l")
def _(spark, d):
    return summary(multi(spark, d, ("rougeL",)))


def sql_poisson(x: str, top: int = 8) -> str:
    cdf, p, parts = 0.0, 0.36787944117144233, []
    for k in range(top):
        cdf += p
        parts.append(f"({x} >= {cdf!r})::INT")
        p /= k + 1
    return " + ".join(parts)


@query("e19_bootstrap_mean", f"""WITH {MULTI}, one AS (SELECT id, max(f) AS f FROM s WHERE metric = 'rouge1' GROUP BY id), r AS (SELECT id, f, unnest(range(30))::INT AS b FROM one), un AS (SELECT *, {sql_u(SEED, 'poisson', 'b', 'id')} AS u FROM r),
    m AS (SELECT b, sum(({sql_poisson('u')}) * f) / sum({sql_poisson('u')}) AS m FROM un GROUP BY b) SELECT round(quantile_cont(m, 0.5), 8) AS mid FROM m""")
def _(spark, d):
    one = multi(spark, d, ("rouge1",)).groupBy("id").agg(F.max("f").alias("f"))
    return A.bootstrap_mean(one, "f", 30, "id", SEED).select(F.round("mid", 8).alias("mid"))


def sql_similar(n: int) -> str:
    gram = "t" if n == 1 else "[array_to_string(list_slice(t, i, i + 1), ' ') for i in range(1, len(t))]"
    return f"""WITH b0 AS (SELECT item_id AS id, [x for x in {TOK.format(c='text')} if x <> ''] AS t FROM benchmark), b AS (SELECT id, {gram} AS t FROM b0), w AS (SELECT id, g, count(*) AS n FROM (SELECT id, unnest(t) AS g FROM b) GROUP BY ALL),
    o AS (SELECT x.id, y.id AS ref, sum(least(x.n, y.n)) AS o FROM w x JOIN w y ON x.g = y.g AND x.id <> y.id WHERE x.id % 100 = 0 GROUP BY ALL), s AS (SELECT o.id, ref, round(2 * o / (len(p.t) + len(q.t)), 12) AS f FROM o JOIN b p ON p.id = o.id JOIN b q ON q.id = ref)
    SELECT id, arg_max(ref, (f, -ref)) AS ref, round(max(f), 9) AS f FROM s GROUP BY id"""


def similar(spark, d, metric):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text"))
    return E.most_similar(b.filter("id % 100 = 0"), b, metric).select("id", "ref", F.round("f", 9).alias("f"))


@query("e20_most_similar", sql_similar(1))
def _(spark, d):
    return similar(spark, d, "rouge1")


@query("e20b_most_similar_2", sql_similar(2))
def _(spark, d):
    return similar(spark, d, "rouge2")


@query("e20c_most_similar_l")
def _(spark, d):
    return similar(spark, d, "rougeL")


SHOWN = "SELECT '{side}' AS side, metric, s.id, ref, x.text AS input, y.text AS target, f FROM s JOIN b x ON x.id = s.id JOIN b y ON y.id = s.ref QUALIFY row_number() OVER (PARTITION BY metric ORDER BY f {way}, s.id, ref) <= 10"


@query("e21_best_and_worst", f"WITH {MULTI} {SHOWN.format(side='best', way='DESC')} UNION ALL {SHOWN.format(side='worst', way='ASC')}")
def _(spark, d):
    s, parts = multi(spark, d), []
    for m in ("rouge1", "rouge2"):  # ten rows a side, taken without a sort of all
        own = s.filter(F.col("metric") == m)
        parts += [own.orderBy(order, "id", "ref").limit(10).withColumn("side", F.lit(side)) for side, order in (("best", F.desc("f")), ("worst", F.asc("f")))]
    found = F.broadcast(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]))
    texts = references(spark, d).select("pair.id", "pair.ref", F.col("a").alias("input"), F.col("b").alias("target"))
    return texts.join(found, ["id", "ref"]).select("side", "metric", "id", "ref", "input", "target", "f")


LOSS = f"""{PREDS}, l AS (SELECT *, CASE gt WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS k, score_vector AS s FROM preds), prior AS (SELECT k, ln(count(*) / (SELECT count(*) FROM l)) AS lp FROM l GROUP BY k), pl AS (SELECT list(lp ORDER BY k) AS lp FROM prior),
    b AS (SELECT l.*, [s[i] + lp[i] for i in [1, 2, 3]] AS sb FROM l CROSS JOIN pl)"""


@query("e22_loss_metrics", f"""WITH {LOSS} SELECT round(avg(ln(list_sum([exp(x) for x in s])) - s[k]), 6) AS cross_entropy, round(avg((list_position(s, list_max(s)) = k)::INT), 6) AS accuracy, round(avg(ln(list_sum([exp(x) for x in sb])) - sb[k]), 6) AS balanced FROM b""")
def _(spark, d):
    own = preds(spark, d).withColumn("k", F.when(F.col("gt") == "A", 1).when(F.col("gt") == "N", 2).otherwise(3)).withColumnRenamed("score_vector", "s")
    total = own.agg(F.count(F.lit(1)).alias("t"))
    prior = own.groupBy("k").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.log(F.col("n") / F.col("t")).alias("lp")))), lambda x: x["lp"]).alias("lp"))
    both = own.join(F.broadcast(prior)).withColumn("sb", F.zip_with("s", "lp", lambda a, b: a + b))
    lse = lambda c: F.log(F.aggregate(F.transform(c, F.exp), F.lit(0.0), lambda a, b: a + b))
    hit = (F.array_position("s", F.array_max("s")) == F.col("k")).cast("int")
    return both.agg(F.round(F.avg(lse("s") - F.element_at("s", F.col("k"))), 6).alias("cross_entropy"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(lse("sb") - F.element_at("sb", F.col("k"))), 6).alias("balanced"))


@query("e22b_batch_metrics", f"""WITH {LOSS}, r AS (SELECT id // 640 AS batch, ln(list_sum([exp(x) for x in s])) - s[k] AS cross_entropy, (list_position(s, list_max(s)) = k)::INT AS accuracy FROM b),
    m AS (SELECT batch, avg(cross_entropy) AS cross_entropy, avg(accuracy) AS accuracy, count(*) AS n FROM r GROUP BY batch) SELECT round(sum(cross_entropy * n) / sum(n), 6) AS cross_entropy, round(sum(accuracy * n) / sum(n), 6) AS accuracy, count(*) AS batches FROM m""")
def _(spark, d):
    k = F.when(F.col("gt") == "A", 1).when(F.col("gt") == "N", 2).otherwise(3)
    s = F.col("score_vector")
    lse = F.log(F.aggregate(F.transform(s, F.exp), F.lit(0.0), lambda a, b: a + b))
    rows = preds(spark, d).select(F.expr("id div 640").alias("batch"), (lse - F.element_at(s, k)).alias("cross_entropy"), (F.array_position(s, F.array_max(s)) == k).cast("int").alias("accuracy"))
    return E.batch_weighted(rows, ["batch"], ["cross_entropy", "accuracy"]).select(F.round("cross_entropy", 6).alias("cross_entropy"), F.round("accuracy", 6).alias("accuracy"), "batches")


@query("e23_weighted_mean", "SELECT l_returnflag AS metric, round(sum(l_quantity * l_discount) / sum(l_quantity), 9) AS mean FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("metric")).agg(F.round(F.sum(F.col("l_quantity") * F.col("l_discount")) / F.sum("l_quantity"), 9).alias("mean"))


PER_CLIENT = f"""{SCORED}, pc AS (SELECT client, round(avg((pred = gt)::INT), 9) AS accuracy, round(avg(d0), 9) AS loss, CASE WHEN client <> 4 THEN round(avg((pred = 'UNK')::INT), 9) END AS unknown, NULL::DOUBLE AS none FROM scored GROUP BY client)"""
METRICS = ["accuracy", "loss", "unknown", "none"]


def per_client(spark, d):
    avg = lambda c: F.round(F.avg(c), 9)
    own = scored(spark, d).groupBy("client").agg(avg((F.col("pred") == F.col("gt")).cast("int")).alias("accuracy"), avg("d0").alias("loss"), avg((F.col("pred") == E.UNKNOWN).cast("int")).alias("unknown"))
    return own.withColumn("unknown", F.when(F.col("client") != 4, F.col("unknown"))).withColumn("none", F.lit(None).cast("double"))


@query("e24_metric_spread", "WITH " + PER_CLIENT + ", long AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, client, {m} AS x FROM pc" for m in METRICS) + """)
    SELECT metric, count(x) AS valid, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS sd, max(x) AS best, coalesce(arg_max(client, (x, -client)) FILTER (WHERE x IS NOT NULL), -1) AS best_client, min(x) AS worst, coalesce(arg_min(client, (x, client)) FILTER (WHERE x IS NOT NULL), -1) AS worst_client FROM long GROUP BY metric""")
def _(spark, d):
    out = E.metric_spread(per_client(spark, d), METRICS)
    return out.select("metric", "valid", F.round("mean", 8).alias("mean"), F.round("sd", 8).alias("sd"), "best", F.coalesce("best_client", F.lit(-1)).alias("best_client"), "worst", F.coalesce("worst_client", F.lit(-1)).alias("worst_client"))


@query("e25_finetune_curve", f"WITH {SCORED}, c AS (SELECT client, round, avg((pred = gt)::INT) AS x FROM scored GROUP BY ALL) SELECT 'accuracy' AS metric, round AS epoch, round(avg(x), 8) AS mean FROM c GROUP BY round")
def _(spark, d):
    c = scored(spark, d).groupBy("client", F.col("round").alias("epoch")).agg(F.avg((F.col("pred") == F.col("gt")).cast("int")).alias("x"))
    return c.groupBy("epoch").agg(F.round(F.avg("x"), 8).alias("mean")).select(F.lit("accuracy").alias("metric"), "epoch", "mean")


@query("e26_binary_report", f"""WITH {SCORED}, b AS (SELECT (gt = 'N')::INT AS y, (pred = 'N')::INT AS p FROM scored), c AS (SELECT sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, sum((1 - y) * (1 - p)) AS tn, count(*) AS n FROM b)
    SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round((tp + tn) / n, 9) AS accuracy, round((2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)) / 2, 9) AS f1_macro FROM c""")
def _(spark, d):
    y, p = F.col("gt") == "N", F.col("pred") == "N"
    c = scored(spark, d).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    f = lambda a: 2 * F.col(a) / (2 * F.col(a) + F.col("fp") + F.col("fn"))
    return c.select("*", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 9).alias("accuracy"), F.round((f("tp") + f("tn")) / 2, 9).alias("f1_macro"))


ROUNDS = f"""{SCORED}, conf AS (SELECT round, scope, gt, pred, count(*) AS n FROM scored GROUP BY ALL),
    rounds AS (SELECT round, scope, round(sum(CASE WHEN gt = pred THEN n ELSE 0 END) / sum(n), 4) AS accuracy FROM conf GROUP BY ALL)"""


def rounds(spark, d):
    return E.accuracy_f1(E.confusion(scored(spark, d), "round", "scope"), "round", "scope")


@query("e27_benchmark_table", f"WITH {ROUNDS} SELECT CASE round % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS method, printf('%.4f', max(accuracy)) AS best, arg_max(round, (accuracy, -round)) AS best_round, printf('%.4f', arg_max(accuracy, round)) AS last, 'N/A' AS auc FROM rounds GROUP BY 1")
def _(spark, d):
    r = rounds(spark, d).withColumn("method", F.when(F.col("round") % 2 == 0, "even").otherwise("odd")).withColumn("auc", F.lit(None).cast("double"))
    show = lambda c: F.coalesce(F.format_string("%.4f", c), F.lit("N/A"))
    out = r.groupBy("method").agg(F.max("accuracy").alias("b"), F.max_by("round", F.struct(F.col("accuracy"), -F.col("round"))).alias("best_round"), F.max_by("accuracy", "round").alias("l"), F.max("auc").alias("a"))
    return out.select("method", show(F.col("b")).alias("best"), "best_round", show(F.col("l")).alias("last"), F.when(F.col("a").isNull(), "N/A").otherwise(show(F.col("a"))).alias("auc"))


@query("e28_best_round", f"WITH {ROUNDS} SELECT accuracy AS value, round, scope FROM rounds ORDER BY accuracy DESC, round LIMIT 1")
def _(spark, d):
    return E.best_round(rounds(spark, d), "accuracy")


@query("e29_round_wall_time", f"""WITH {TRACE}, p AS (SELECT round, min(epoch_us(ts)) FILTER (WHERE event = 'signup') AS a, max(epoch_us(ts)) FILTER (WHERE event = 'purchase') AS b, avg(loss) AS loss FROM trace GROUP BY round),
    t AS (SELECT round, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(b - a, 0) / 1e6 END AS seconds, loss FROM p) SELECT round, round(seconds, 3) AS seconds, round((SELECT avg(seconds) FROM t), 3) AS mean_seconds, round(loss, 6) AS loss FROM t""")
def _(spark, d):
    t = trace(spark, d)
    loss = t.groupBy("round").agg(F.round(F.avg("loss"), 6).alias("loss"))
    return E.round_times(t, "signup", "purchase").join(loss, "round").select("round", F.round("seconds", 3).alias("seconds"), F.round("mean_seconds", 3).alias("mean_seconds"), "loss")


@query("j10_setting_comparison", f"""WITH {SCORED}, s AS (SELECT scope || (client % 2) AS dataset, CASE WHEN round <= 3 THEN 'early' ELSE 'late' END AS setting, 100 * avg((pred = gt)::INT) AS score FROM scored GROUP BY ALL)
    SELECT s.dataset, s.setting, round(b.score - s.score, 1) AS drop FROM s JOIN s b ON b.dataset = s.dataset AND b.setting = 'early'""")
def _(spark, d):
    s = scored(spark, d).groupBy(F.concat("scope", (F.col("client") % 2).cast("string")).alias("dataset"), F.when(F.col("round") <= 3, "early").otherwise("late").alias("setting")).agg((100 * F.avg((F.col("pred") == F.col("gt")).cast("int"))).alias("score"))
    return score_drop(s, "early")


