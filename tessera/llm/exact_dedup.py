"""Exact dedup by two-pass Bloom filtering, with DataFrame functions only.

Pass one hashes each text and sets ``HASHES`` slots of a counting Bloom filter
of ``bits`` slots; the slots that two or more rows hit are packed into bitmaps.
Pass two tests every row against those bitmaps: a row whose slots are not all
hit twice cannot have a copy and passes straight through.  Only the others
shuffle, and as (digest, id) pairs, never as texts.

The bitmaps are broadcast and never exceed 32 MiB (``common.MAX_BITS``); with more
rows than it serves well, more rows go the exact way, and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import bitmaps, filter_bits, free_name, join_unique, tested, text_or_empty, written

HASHES = 2


def _slots(digest: Column, bits: int) -> list[Column]:
    words = [F.conv(F.substring(F.hex(digest), 1 + 13 * i, 13), 16, 10).cast("long") for i in range(HASHES)]
    return [F.pmod(w, F.lit(bits)) for w in words]


def repeated_slots(digests: DataFrame, bits: int) -> DataFrame:
    """``(bucket, bitmap)``: the slots that at least two rows of ``digest`` hit."""
    slot = digests.select(F.explode(F.array_distinct(F.array(*_slots(F.col("digest"), bits)))).alias("slot"))
    twice = slot.groupBy("slot").agg(F.count(F.lit(1)).alias("hits")).filter("hits > 1")
    return bitmaps(twice, bits)


def _maybe_repeated(rows: DataFrame, repeated: DataFrame, bits: int) -> DataFrame:
    """Adds ``maybe``: whether all slots of ``digest`` were hit twice."""
    return tested(rows, repeated, _slots(F.col("digest"), bits))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their UTF-8 bytes are; a null text counts as empty.
    Of equal texts the largest id stays.  Rows that repeat both id and text
    count in ``group_size`` and one of them is ``kept``; a null id sorts below
    all others and is itself kept only if its whole group has null ids.
    """
    hashed = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text_or_empty(text_col), 256)).alias("digest"))
    return _decide(written(hashed, "digests"), bits)


def _decide(hashed: DataFrame, bits: int | None) -> DataFrame:
    rows = hashed.count()
    bits = bits or filter_bits(rows)
    twice = written(repeated_slots(hashed, bits), "repeated")
    known = _maybe_repeated(hashed, twice, bits)
    lone = known.filter("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    maybe = written(known.filter("maybe").select("doc_id", "digest"), "maybe")
    return lone.unionByName(_groups(maybe)).withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def _groups(maybe: DataFrame) -> DataFrame:
    sizes = written(maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id")), "groups")
    # Repeats of one (digest, id) are rare; they are numbered only where they exist.
    twins = maybe.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("n_same"))
    joined = join_unique(twins, sizes, "digest", maybe.count())
    first = joined.filter("n_same = 1").select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.expr("doc_id <=> keep_id").alias("kept"), "digest")
    again = joined.filter("n_same > 1").select("*", F.explode(F.sequence(F.lit(1), F.col("n_same").cast("int"))).alias("k"))
    return first.unionByName(again.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.expr("doc_id <=> keep_id and k = 1").alias("kept"), "digest"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """``docs`` without all but one row of each group of equal texts.

    Rows that cannot have a copy are passed on by a map over the input; only
    possibly repeated rows shuffle.  All columns of ``docs`` are returned.
    """
    digest = F.unhex(F.sha2(text_or_empty(text_col), 256))
    hashed = written(docs.select(F.col(id_col).alias("doc_id"), digest.alias("digest")), "digests")
    bits = bits or filter_bits(hashed.count())
    twice = written(repeated_slots(hashed, bits), "repeated")
    row, names = free_name(docs.columns, "_row"), docs.columns
    known = _maybe_repeated(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias(row), F.col(id_col).alias("doc_id"), digest.alias("digest")), twice, bits)
    lone = known.filter("not maybe").select(f"{row}.*")
    maybe = known.filter("maybe").select(row, "doc_id", "digest")
    groups = written(maybe.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id")), "groups")
    # A row can stay only if its id is its group's largest: at most the rows of
    # one id remain for the window below, however large the group is.
    best = join_unique(maybe, groups, "digest", max(1, int(groups.agg(F.sum("n_rows")).first()[0] or 0))).filter("doc_id <=> keep_id")
    one = best.withColumn("_k", F.row_number().over(W.partitionBy("digest").orderBy(F.lit(1)))).filter("_k = 1")
    return lone.unionByName(one.select(f"{row}.*"))
