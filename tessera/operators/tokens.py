"""Vocabulary tables, token ids, padding and supervision masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.order import rank
from ..functions.text import basic_tokens

IGNORED = -100


def vocabulary(docs: DataFrame, least: int = 5, text: str = "text") -> DataFrame:
    """``token, n, token_id``: tokens seen ``least`` times, by falling count, then
    name; ids 0 and 1 are the unknown token and the padding."""
    counts = docs.select(F.explode(basic_tokens(text)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # Ranked within (count, first letters); running counts of those cells give the
    # offsets, so one task sees the distinct counts but never the tokens.
    own = counts.withColumn("_head", F.substring("token", 1, 3))
    cells = own.groupBy("n", "_head").agg(F.count(F.lit(1)).alias("_m"))
    levels = cells.groupBy("n").agg(F.sum("_m").alias("_m"))
    before = lambda w: F.coalesce(F.sum("_m").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    higher = levels.select("n", before(W.partitionBy(F.lit(0)).orderBy(F.desc("n"))).alias("_higher"))
    offsets = cells.select("n", "_head", before(W.partitionBy("n").orderBy("_head")).alias("_first")).join(higher, "n")
    nth = F.row_number().over(W.partitionBy("n", "_head").orderBy("token"))
    ranked = own.withColumn("_nth", nth).join(offsets, ["n", "_head"])
    return ranked.select("token", "n", (F.col("_higher") + F.col("_first") + F.col("_nth") + 1).cast("int").alias("token_id"))


def encoded(docs: DataFrame, vocab: DataFrame, most: int | None = None, id_col: str = "id", text: str = "text") -> DataFrame:
    """``id, input_ids``: all tokens, or the first ``most``, by the vocabulary, unknown 0."""
    tokens = basic_tokens(text) if most is None else F.slice(basic_tokens(text), 1, most)
    long = docs.select(id_col, F.posexplode(tokens).alias("pos", "token"))
    ids = long.join(vocab.select("token", "token_id"), "token", "left").select(id_col, "pos", F.coalesce("token_id", F.lit(0)).alias("t"))
    packed = ids.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("input_ids"))
    return docs.select(id_col).join(packed, id_col, "left").select(id_col, F.coalesce("input_ids", F.array().cast("array<int>")).alias("input_ids"))


def padded(ids: Column, length: Column | int, value: int, left: bool = False) -> Column:
    """Cut to ``length`` and filled with ``value``."""
    n = F.lit(length) if isinstance(length, int) else length
    cut = F.slice(ids, F.lit(1), n)
    fill = F.array_repeat(F.lit(value), F.greatest(n - F.size(cut), F.lit(0)).cast("int"))
    return F.concat(fill, cut) if left else F.concat(cut, fill)


def supervised(prompt: Column, answer: Column, eos: int, most: int, language_model: bool = False) -> tuple[Column, Column]:
    """``input_ids`` and ``labels`` of prompt, answer and end token, cut to ``most``;
    the prompt's labels are ignored unless the whole text is modelled."""
    ids = F.concat(prompt, answer, F.array(F.lit(eos)))
    labels = ids if language_model else F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer, F.array(F.lit(eos)))
    return F.slice(ids, 1, most), F.slice(labels, 1, most)


def multi_turn(turns: Column, end: int) -> tuple[Column, Column]:
    """``input_ids, labels`` of an array of ``role, ids``: every turn ends with
    ``end``; assistant tokens and their end are supervised; if nothing is, the
    last token is."""
    ids = F.flatten(F.transform(turns, lambda t: F.concat(t["ids"], F.array(F.lit(end)))))
    own = F.flatten(F.transform(turns, lambda t: F.when(F.lower(t["role"]) == "assistant", F.concat(t["ids"], F.array(F.lit(end)))).otherwise(F.array_repeat(F.lit(IGNORED), F.size(t["ids"]) + 1))))
    none = F.forall(own, lambda x: x == IGNORED)
    last = F.concat(F.array_repeat(F.lit(IGNORED), F.size(ids) - 1), F.array(F.element_at(ids, -1)))
    return ids, F.when(none & (F.size(ids) > 0), last).otherwise(own)


def batches(rows: DataFrame, size: int, most: int, id_col: str = "id", pad: int = 0, by_length: bool = False, left: bool = False) -> DataFrame:
    """``id, batch, input_ids, mask``: batches of ``size`` rows in the order of ids, or of falling
    length (``by_length``), so that little is filled up; each is padded to its longest row, at
    most ``most``, on the right or on the ``left``."""
    own = rows.select(id_col, "input_ids", F.size("input_ids").alias("_n"))
    ranked = rank(own, [], [F.desc("_n"), F.col(id_col)] if by_length else [F.col(id_col)]).withColumn("batch", F.expr(f"rank div {size}"))
    longest = ranked.groupBy("batch").agg(F.least(F.max("_n"), F.lit(most)).alias("len"))
    both = ranked.join(longest, "batch")
    ones, none = F.array_repeat(F.lit(1), F.least("_n", "len")), F.array_repeat(F.lit(0), F.greatest(F.col("len") - F.col("_n"), F.lit(0)))
    mask = F.concat(none, ones) if left else F.concat(ones, none)
    return both.select(id_col, "batch", padded(F.col("input_ids"), F.col("len"), pad, left).alias("input_ids"), mask.alias("mask"))


def prompt_batches(rows: DataFrame, size: int, id_col: str = "id", pad: int = 0) -> DataFrame:
    """``id, batch, place, prompt, answer``: batches of ``size`` rows in the order of ids; in a
    batch the longest prompt comes first, and all are padded on the left to its length."""
    ranked = rank(rows.select(id_col, "prompt", "answer"), [], [F.col(id_col)]).withColumn("batch", F.expr(f"rank div {size}"))
    own = W.partitionBy("batch")
    placed = ranked.withColumn("place", F.row_number().over(own.orderBy(F.desc(F.size("prompt")), id_col)) - 1).withColumn("_width", F.max(F.size("prompt")).over(own))
    return placed.select(id_col, "batch", "place", padded(F.col("prompt"), F.col("_width"), pad, left=True).alias("prompt"), "answer")


def prefix_cut(ids: Column, share: float = 0.8) -> tuple[Column, Column]:
    """The first ``int(n * share)`` ids, and the others."""
    n = F.floor(F.size(ids) * F.lit(share)).cast("int")
    return F.slice(ids, F.lit(1), n), F.slice(ids, n + 1, F.size(ids))


def hashed_bag(docs: DataFrame, buckets: int, id_col: str = "id", text: str = "text") -> DataFrame:
    """``id, bucket, weight``: counts of hashed words over their total (md5 buckets)."""
    words = docs.select(id_col, F.explode(F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0b]+"), lambda w: w != "")).alias("w"))
    bucket = F.pmod(F.conv(F.substring(F.md5("w"), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    counts = words.groupBy(id_col, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.col("n") / F.sum("n").over(W.partitionBy(id_col))).drop("n")


def channel_statistics(rows: DataFrame, values: str) -> DataFrame:
    """One row: means over rows of the row's mean and of its sample deviation."""
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (n - 1)
    return rows.filter(F.size(values) > 1).withColumn("m", mean).withColumn("s", F.sqrt(var)).agg(F.avg("m").alias("mean"), F.avg("s").alias("sd"))
