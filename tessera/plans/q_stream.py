"""Queries of the streaming operators and registries.

Each stream runs over all there is and must give what the batch twin gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..registry import SERVERS, TASKS
from ..operators import state as A
from ..sources.scratch import folder
from ..streaming import streams as R
from .q_evaluate import CONF, F1, SCORED, scored
from .views import TRACE, params, query, table, trace


def logged(spark, d) -> str:
    """The event table as a folder of JSON lines, as a running job writes it."""
    path = folder(spark, "trace")
    t = trace(spark, d)
    t.select("event", F.struct("round", "client", "loss", "ts").alias("context")).write.json(path)
    return path


def stored(spark, d) -> str:
    path = folder(spark, "preds")
    scored(spark, d).select("id", "round", "scope", "gt", "pred", "raw").write.parquet(path)
    return path


def streamed(spark, events, keys, sums, by_window=False):
    """The sums of a stream over all there is."""
    out = folder(spark, "totals")
    R.running_totals(events, keys, sums, out, folder(spark, "ck")).awaitTermination()
    return R.read_totals(spark, out, keys, list(sums), by_window)


def events(spark, d):
    return R.trace(spark, logged(spark, d)).select("event", "context.*")


@query("r01_trace_stream", f"WITH {TRACE} SELECT event, count(*) AS n FROM trace GROUP BY event")
def _(spark, d):
    return streamed(spark, events(spark, d), ["event"], {"n": R.LOSSES["n"]})


@query("r02_round_losses", f"WITH {TRACE} SELECT round, client, count(*) AS n, round(sum(loss), 4) AS loss FROM trace GROUP BY round, client")
def _(spark, d):
    return streamed(spark, events(spark, d), ["round", "client"], R.LOSSES).withColumn("loss", F.round("loss", 4))


@query("r02b_windowed_losses", f"WITH {TRACE} SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, event, count(*) AS n, round(sum(loss), 4) AS loss FROM trace GROUP BY 1, 2")
def _(spark, d):
    return streamed(spark, events(spark, d), ["event"], R.LOSSES, by_window=True).withColumn("loss", F.round("loss", 4))


@query("r03_running_scores", f"""WITH {SCORED}, c AS (SELECT round, scope, gt, pred, count(*) AS n FROM scored GROUP BY ALL),
    t AS (SELECT round, scope, gt AS label, sum(n) AS support, sum(CASE WHEN gt = pred THEN n ELSE 0 END) AS tp FROM c GROUP BY ALL), g AS (SELECT round, scope, pred AS label, sum(n) AS guessed FROM c GROUP BY ALL),
    f AS (SELECT round, scope, label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, CASE WHEN coalesce(guessed, 0) + coalesce(support, 0) > 0 THEN 2 * coalesce(tp, 0) / (coalesce(guessed, 0) + coalesce(support, 0)) ELSE 0 END AS f1 FROM t FULL JOIN g USING (round, scope, label))
    SELECT round, scope, round(sum(tp) / sum(support), 4) AS accuracy, round(avg(f1), 4) AS f1_macro, round(sum(f1 * support) / sum(support), 4) AS f1_weighted, sum(support)::BIGINT AS n FROM f GROUP BY round, scope""")
def _(spark, d):
    src, out = stored(spark, d), folder(spark, "scores")
    stream = spark.readStream.schema("id long, round int, scope string, gt string, pred string, raw string").parquet(src)
    R.running_scores(stream, out, folder(spark, "ck")).awaitTermination()
    return spark.read.parquet(out)


@query("r04_evaluation_cadence", f"WITH {TRACE} SELECT round, count(*) AS n FROM trace WHERE (round + 1) % 5 = 0 GROUP BY round")
def _(spark, d):
    return streamed(spark, R.due(events(spark, d), 5), ["round"], {"n": R.LOSSES["n"]})


@query("r05_quarantine_stream", f"WITH {SCORED} SELECT CASE WHEN trim(raw) = '' THEN 'raw' ELSE 'pred' END AS error, count(*) AS n FROM scored WHERE trim(raw) = '' OR pred = 'UNK' GROUP BY 1")
def _(spark, d):
    src, base = stored(spark, d), folder(spark, "quarantine")
    stream = spark.readStream.schema("id long, round int, scope string, gt string, pred string, raw string").parquet(src)
    checks = {"raw": F.trim("raw") != "", "pred": F.col("pred") != "UNK"}
    R.quarantined(stream, checks, f"{base}/good", f"{base}/bad", folder(spark, "ck")).awaitTermination()
    return spark.read.schema("id long, error string").json(f"{base}/bad").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@TASKS.register("classification")
def _classification(spark, d):
    return E.accuracy_f1(E.confusion(scored(spark, d))).select("accuracy", "n")


@TASKS.register("vqa")
def _vqa(spark, d):
    return scored(spark, d).agg(F.round(F.avg((F.col("raw") == F.col("gt")).cast("int")), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))


@query("g01_task_registry", f"WITH {CONF}, {F1} SELECT round(sum(tp) / sum(support), 4) AS accuracy, sum(support)::BIGINT AS n FROM f")
def _(spark, d):
    return TASKS.get("Classification")(spark, d)


SERVERS.register("average")(lambda p: A.weighted_average(p, ["round"]))
SERVERS.register("summary")(lambda p: A.summary(p, "round"))


@query("g02_object_registry", "SELECT ((vec_id // 10) % 5)::INT AS round, count(DISTINCT 'layer.' || label || '.w') AS tensors FROM embeddings GROUP BY 1")
def _(spark, d):
    return SERVERS.get("SUMMARY")(params(spark, d)).select("round", "tensors")


@query("g03_hooks", "SELECT event_type AS event, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    found = []
    hooks = R.Hooks().on("table", lambda _, c: found.append(c["df"].groupBy(F.col("event_type").alias("event")).agg(F.count(F.lit(1)).alias("n"))))
    hooks.emit("table", df=table(spark, d, "events"))
    return found[0]
