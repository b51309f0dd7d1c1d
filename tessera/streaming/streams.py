"""Run logs as streams; the same functions serve batch tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..sources.sinks import split_valid

TRACE = "event string, context struct<round:int,client:int,loss:double,ts:timestamp>"


def trace(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """Append-only JSON lines of ``event, context`` as a stream."""
    return spark.readStream.schema(schema).json(path)


#: What is summed of a run's events, as SQL.
LOSSES = {"n": "1L", "loss": "loss"}


def totals(events: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """``keys`` with the sum of each of ``sums``, of a batch table."""
    return events.groupBy(*keys).agg(*[F.sum(F.expr(e)).alias(name) for name, e in sums.items()])


def round_losses(events: DataFrame, *by: str) -> DataFrame:
    """``round, client, n, loss`` of a batch table."""
    return totals(events, ["round", "client", *by], LOSSES)


def windowed(events: DataFrame, keys: list[str], sums: dict[str, str], width: str) -> DataFrame:
    """Sums by window of ``ts`` and ``keys``: ``start``, ``keys``, ``sums``."""
    own = events.groupBy(F.window("ts", width).alias("w"), *keys).agg(*[F.sum(F.expr(e)).alias(name) for name, e in sums.items()])
    return own.select(F.col("w.start").alias("start"), *keys, *sums)


def running_totals(events: DataFrame, keys: list[str], sums: dict[str, str], out: str, checkpoint: str, late: str = "1 hour", width: str = "6 hours", files: int | None = None):
    """Streams ``windowed`` sums in update mode to the table at ``out`` (see ``read_totals``).

    State holds only windows that the watermark has not passed; rows later than that are
    dropped.  Each batch writes the sums that it changed to a folder of its own number, so a
    batch that runs again after a failure overwrites what it wrote and changes nothing.
    """
    spark = events.sparkSession
    own = windowed(events.withWatermark("ts", late), keys, sums, width)
    # Without any batch there is a table, too.
    spark.createDataFrame([], own.schema).write.mode("overwrite").parquet(f"{out}/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return own.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def read_totals(spark: SparkSession, out: str, keys: list[str], names: list[str], by_window: bool = False) -> DataFrame:
    """What ``running_totals`` has summed so far, by ``keys`` (and ``start``): of each window the
    sums of the last batch that changed it."""
    rows = spark.read.option("basePath", out).parquet(out)
    last = rows.groupBy("start", *keys).agg(F.max_by(F.struct(*names), "batch").alias("v")).select("start", *keys, "v.*")
    return last if by_window else last.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in names])


def due(rows: DataFrame, every: int, round_col: str = "round") -> DataFrame:
    """Rows of the rounds in which an evaluation is due."""
    return rows.filter((F.col(round_col) + 1) % every == 0)


def round_scores(predictions: DataFrame) -> DataFrame:
    """Accuracy and F1 by (round, scope) from confusion counts."""
    return evaluate.accuracy_f1(evaluate.confusion(predictions, "round", "scope"), "round", "scope")


def running_scores(stream: DataFrame, out: str, checkpoint: str):
    """Streams confusion counts; each batch rewrites the scores so far at ``out``."""
    counts = evaluate.confusion(stream, "round", "scope")

    def store(batch: DataFrame, _: int) -> None:
        evaluate.accuracy_f1(batch, "round", "scope").write.mode("overwrite").parquet(out)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


def quarantined(stream: DataFrame, checks: dict[str, Column], good: str, bad: str, checkpoint: str):
    """Two sinks from one stream: valid rows and, with their error, the others."""

    def store(batch: DataFrame, batch_id: int) -> None:
        ok, failed = split_valid(batch, checks)
        ok.write.mode("overwrite").parquet(f"{good}/batch={batch_id}")
        failed.write.mode("overwrite").json(f"{bad}/batch={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()


class Hooks:
    """Named events with handlers; a handler gets the event and its context."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[str, dict], None]]] = {}

    def on(self, event: str, handler: Callable[[str, dict], None]) -> Hooks:
        self.handlers.setdefault(event, []).append(handler)
        return self

    def emit(self, event: str, **context: object) -> None:
        for handler in [*self.handlers.get(event, []), *self.handlers.get("*", [])]:
            handler(event, context)
