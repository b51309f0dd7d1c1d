"""Writers: client shards, manifests, reports, quarantine of bad records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rng import u


def client_shards(df: DataFrame, path: str, seed: int = 0, overwrite: bool = False, id_col: str = "id", client: str = "client_id", rows_per_file: int = 1_000_000) -> None:
    """JSON lines by client, shuffled within a client.  Refuses a folder that
    has data unless ``overwrite``; then stale clients go, too.

    Rows are dealt by ranges of (client, shuffled place), about ``rows_per_file`` a task, so a
    very large client is cut over many tasks, and no file has more rows than that.  A client's
    files, in the order of their names, hold its rows in their shuffled order."""
    parts = max(1, -(-df.count() // rows_per_file))
    dealt = df.withColumn("_u", u(seed, "order", id_col)).repartitionByRange(parts, client, "_u").sortWithinPartitions(client, "_u").drop("_u")
    mode = "overwrite" if overwrite else "errorifexists"
    dealt.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(client).json(path)


def setting_shards(df: DataFrame, path: str, seed: int = 0, id_col: str = "id", rows_per_file: int = 1_000_000) -> None:
    """JSON lines by ``stat, modal, client``, shuffled within each, in files of bounded size."""
    keys = ["stat", "modal", "client"]
    parts = max(1, -(-df.count() // rows_per_file))
    dealt = df.withColumn("_u", u(seed, "order", id_col)).repartitionByRange(parts, *keys, "_u").sortWithinPartitions(*keys, "_u").drop("_u")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*keys).json(path)


def manifest(spark, path: str, kind: str, parameters: dict[str, str], history: list[dict[str, str]] | None = None) -> DataFrame:
    """One-row manifest with its transform history; written and returned."""
    rows = [(kind, {k: str(v) for k, v in parameters.items()}, [{k: str(v) for k, v in h.items()} for h in history or []])]
    out = spark.createDataFrame(rows, "dataset_type string, parameters map<string,string>, transform_history array<map<string,string>>")
    out.coalesce(1).write.mode("overwrite").json(path)
    return out


def with_step(manifest_rows: DataFrame, name: str, **parameters: object) -> DataFrame:
    """A manifest with one more step in its history."""
    step = F.create_map(*[F.lit(str(x)) for kv in {"step": name, **parameters}.items() for x in kv])
    return manifest_rows.withColumn("transform_history", F.concat("transform_history", F.array(step)))


def report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def split_valid(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with an ``error`` that names
    the first check they fail."""
    error = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = df.withColumn("error", error)
    return marked.filter("error is null").drop("error"), marked.filter("error is not null")


def quarantine(df: DataFrame, path: str, checks: dict[str, Column]) -> DataFrame:
    """Writes failing rows as JSON with their error; returns the others."""
    good, bad = split_valid(df, checks)
    bad.write.mode("append").json(path)
    return good
