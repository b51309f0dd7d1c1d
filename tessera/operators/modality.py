"""Removing modalities: per row, per client, exactly or by chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.rng import exact_rank, u


def pattern(img: Column, text: Column) -> Column:
    has_text = text.isNotNull() & (F.length(F.trim(text)) > 0)
    return F.when(img.isNotNull() & has_text, "image_text").when(img.isNotNull(), "image_only").when(has_text, "text_only").otherwise("none")


def mask(df: DataFrame, drop_img: Column, drop_text: Column) -> DataFrame:
    kept = df.withColumn("_di", drop_img).withColumn("_dt", drop_text)
    kept = kept.withColumn("img", F.when(~F.col("_di"), F.col("img"))).withColumn("text", F.when(~F.col("_dt"), F.col("text")))
    return kept.drop("_di", "_dt")


def bernoulli(df: DataFrame, rate: float, seed: int = 0, salt: str = "missing", id_col: str = "id") -> DataFrame:
    """Each modality is dropped with ``rate``; where both are, a coin restores one."""
    di, dt = u(seed, salt + "-img", id_col) < rate, u(seed, salt + "-text", id_col) < rate
    coin = u(seed, salt + "-coin", id_col) < 0.5
    return mask(df, di & ~(dt & coin), dt & ~(di & ~coin))


def hybrid(df: DataFrame, keep: float, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Each modality is kept with probability ``keep``, with the same repair."""
    ki, kt = u(seed, "hybrid-img", id_col) < keep, u(seed, "hybrid-text", id_col) < keep
    coin = u(seed, "hybrid-coin", id_col) < 0.5
    return mask(df, ~ki & ~(~kt & coin), ~kt & ~(~ki & ~coin))


def client_ranks(spark, clients: int, seed: int, salt: str) -> DataFrame:
    """``client, r``: a shuffled rank of the clients, from 1."""
    base = spark.range(clients).select(F.col("id").cast("int").alias("client"))
    return base.withColumn("r", F.row_number().over(W.orderBy(u(seed, salt, "client"), "client")))


def cross(df: DataFrame, image_only: int, text_only: int, clients: int, seed: int = 0) -> DataFrame:
    """``image_only`` random clients lose their text, the others their image."""
    if image_only + text_only != clients:
        raise ValueError("the two parts must add up to the number of clients")
    plan = F.broadcast(client_ranks(df.sparkSession, clients, seed, "cross").select("client", (F.col("r") <= image_only).alias("_img")))
    own = df.join(plan, "client")
    return mask(own, ~F.col("_img"), F.col("_img")).drop("_img")


def exact_missing(df: DataFrame, rate: float, kind: str = "random", seed: int = 0, id_col: str = "id") -> DataFrame:
    """In each client exactly ``round_half_even(rate * eligible)`` rows lose their
    image, their text, or (``random``) one of the two; then only rows with both
    are eligible.  Adds a note to ``transformations`` where that column exists."""
    has_img, has_text = F.col("img").isNotNull(), F.coalesce(F.length(F.trim("text")) > 0, F.lit(False))
    eligible = {"image": has_img, "text": has_text, "random": has_img & has_text}[kind]
    own = df.withColumn("_e", eligible)
    ranked = exact_rank(own.withColumn("_u", u(seed, "exact", id_col)), ["client", "_e"], "_u", [id_col], "_r").drop("_u")
    sizes = F.broadcast(own.filter("_e").groupBy("client").agg(F.bround(F.count(F.lit(1)) * F.lit(rate)).alias("_k")))
    hit = ranked.join(sizes, "client", "left").withColumn("_hit", F.col("_e") & (F.col("_r") < F.coalesce("_k", F.lit(0))))
    lose_img = {"image": F.lit(True), "text": F.lit(False), "random": u(seed, "which", id_col) < 0.5}[kind]
    out = hit.withColumn("_di", F.col("_hit") & lose_img).withColumn("_dt", F.col("_hit") & ~lose_img)
    if "transformations" in df.columns:
        note = F.when(F.col("_di"), f"missing_image_{rate}").when(F.col("_dt"), f"missing_text_{rate}")
        out = out.withColumn("transformations", F.when(note.isNotNull(), F.concat("transformations", F.array(note))).otherwise(F.col("transformations")))
    return mask(out, F.col("_di"), F.col("_dt")).drop("_e", "_r", "_k", "_hit")


def client_patterns(spark, clients: int, rate: float, seed: int = 0) -> DataFrame:
    """``client, pattern``: ``round(clients * rate)`` clients have one modality,
    the larger half of them the image."""
    k = round(clients * rate)
    ranked = client_ranks(spark, clients, seed, "pattern")
    return ranked.select("client", F.when(F.col("r") <= (k + 1) // 2, "image_only").when(F.col("r") <= k, "text_only").otherwise("image_text").alias("pattern"))


def apply_patterns(df: DataFrame, patterns: DataFrame, rate: float = 1.0, seed: int = 0, id_col: str = "id") -> DataFrame:
    """Drops the modality that a client's pattern lacks, with probability ``rate``."""
    own = df.join(F.broadcast(patterns), "client")
    hit = u(seed, "apply", id_col) < rate
    return mask(own, hit & (F.col("pattern") == "text_only"), hit & (F.col("pattern") == "image_only"))


def noted(df: DataFrame, note: str) -> DataFrame:
    """Appends a note to the ``transformations`` of every row."""
    return df.withColumn("transformations", F.concat(F.coalesce("transformations", F.array().cast("array<string>")), F.array(F.lit(note))))


# Grids: every statistical setting with every modal one, from one scan.


def modal_settings(missing: list[float], cross: list[tuple[int, int]], keep: list[float]) -> list[tuple[str, str, float, int]]:
    """``modal, kind, rate, image_only`` of aligned, missing, cross and hybrid settings."""
    rows = [("aligned", "aligned", 0.0, 0)]
    rows += [(f"missing_{r:g}", "missing", float(r), 0) for r in missing]
    rows += [(f"cross_{a}_{b}", "cross", 0.0, a) for a, b in cross]
    return rows + [(f"hybrid_{r:g}", "hybrid", float(r), 0) for r in keep]


def settings_table(spark, stats: list[str], modals: list[tuple[str, str, float, int]], clients: int, seed: int = 0) -> DataFrame:
    """``stat, modal, client, kind, rate, image_client``: a row for each setting and client; in
    cross settings ``image_only`` random clients keep the image."""
    names = F.explode(F.array(*[F.lit(s) for s in stats])).alias("stat")
    rows = spark.createDataFrame(modals, "modal string, kind string, rate double, image_only int").select("*", names)
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(clients - 1))).alias("client"))
    order = W.partitionBy("stat", "modal").orderBy(u(seed, "grid-cross", "stat", "modal", "client"), "client")
    return each.select("stat", "modal", "client", "kind", "rate", (F.row_number().over(order) <= F.col("image_only")).alias("image_client"))


def setting_grid(df: DataFrame, placed: Column, settings: DataFrame, seed: int = 0, id_col: str = "id") -> DataFrame:
    """``df`` once for each setting, with ``stat, modal, client`` and what the setting leaves of
    ``img`` and ``text``; ``placed`` is an array of ``stat, client`` of a row.

    The table is read once; settings x clients rows are broadcast, and their columns are part
    of the masks.  Draws differ between settings."""
    own = df.withColumn("_placed", F.explode(placed)).select(*df.columns, F.col("_placed.stat").alias("stat"), F.col("_placed.client").alias("client"))
    each = own.join(F.broadcast(settings), ["stat", "client"])
    ui, ut, uc = (u(seed, f"grid-{x}", "stat", "modal", id_col) for x in ("img", "text", "coin"))
    hit = lambda x: F.when(F.col("kind") == "missing", x < F.col("rate")).when(F.col("kind") == "hybrid", x >= F.col("rate")).otherwise(F.lit(False))
    marked = each.withColumn("_hi", hit(ui)).withColumn("_ht", hit(ut)).withColumn("_coin", uc < 0.5)
    cross = F.col("kind") == "cross"
    drop_img = F.when(cross, ~F.col("image_client")).otherwise(F.col("_hi") & ~(F.col("_ht") & F.col("_coin")))
    drop_text = F.when(cross, F.col("image_client")).otherwise(F.col("_ht") & ~(F.col("_hi") & ~F.col("_coin")))
    return mask(marked, drop_img, drop_text).drop("_hi", "_ht", "_coin", "kind", "rate", "image_client")
