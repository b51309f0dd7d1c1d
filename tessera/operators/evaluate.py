"""Scores of predictions: label matching, confusion counts, F1, AUC, QA, ROUGE."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import text as T
from ..functions.order import running
from ..sources.scratch import folder

UNKNOWN = "UNK"


def strict_label(answer: Column, options: dict[str, str]) -> Column:
    """``(X) tail`` with a known tail gives it, else the letter's label; a bare
    letter its label; a bare label itself; anything else null."""
    clean = F.trim(answer)
    letters = F.create_map(*[F.lit(x) for kv in options.items() for x in kv])
    known = F.array(*[F.lit(v) for v in options.values()])
    valid = "".join(options)
    letter = F.upper(F.regexp_extract(clean, rf"(?i)\(\s*([{valid}])\s*\)\s*.+", 1))
    tail = T.label_strict(F.regexp_extract(clean, rf"(?i)\(\s*[{valid}]\s*\)\s*(.+)", 1))
    bare = F.upper(F.regexp_extract(clean, rf"(?i)^\(?\s*([{valid}])\s*\)?$", 1))
    whole = T.label_strict(clean)
    return F.coalesce(
        F.when((letter != "") & F.array_contains(known, tail), tail), F.when(letter != "", F.try_element_at(letters, letter)), F.when(bare != "", F.try_element_at(letters, bare)),
        F.when(F.array_contains(known, whole), whole),
    )


def answer_letter(answer: Column, options: dict[str, str]) -> Column:
    """The option letter of a free answer: after an answer cue, a leading letter,
    the first stand-alone valid letter, else an option's text within it."""
    return F.coalesce(_stated_letter(answer, options), T.once(T.label_words(answer), lambda text: _letter_by_text(text, options)))


def _stated_letter(answer: Column, options: dict[str, str]) -> Column:
    valid = "".join(options)

    def pick(pattern: str) -> Column:
        found = F.upper(F.regexp_extract(answer, pattern, 1))
        return F.when(found.isin(list(options)), found)

    alone = F.nullif(F.regexp_extract(F.upper(answer), rf"\b([{valid}])\b", 1), F.lit(""))
    return F.coalesce(pick(r"(?i)(?:the answer is|answer)\s*[:：]?\s*\(?\s*([A-Z])\s*\)?"), pick(r"(?i)^\s*\(?\s*([A-Z])\s*\)?(?:[.):-]|$|\s)"), alone)


def _letter_by_text(text: Column, options: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(text.contains(T.plain_words(v)), F.lit(k)) for k, v in options.items() if T.plain_words(v)], F.lit(None).cast("string"))


def canonical_label(answer: Column, options: dict[str, str]) -> Column:
    """The exact label, the label of the answer's letter, a label within the
    answer (2 letters at least), a label that holds the answer (3 at least),
    else UNK; labels in their given order."""
    names = {v: T.plain_words(v) for v in options.values()}
    labels = F.create_map(*[F.lit(x) for kv in options.items() for x in kv])

    def label(text: Column) -> Column:
        exact = [F.when(text == n, F.lit(v)) for v, n in names.items()]
        letter = F.try_element_at(labels, F.coalesce(_stated_letter(answer, options), _letter_by_text(text, options)))
        inside = [F.when(text.contains(n), F.lit(v)) for v, n in names.items() if len(n) >= 2]
        around = [F.when((F.length(text) >= 3) & F.lit(n).contains(text), F.lit(v)) for v, n in names.items()]
        return F.when(text != "", F.coalesce(*exact, letter, *inside, *around, F.lit(UNKNOWN))).otherwise(UNKNOWN)

    return T.once(T.label_words(answer), label)


def error_type(gt: Column, raw: Column, pred: Column) -> Column:
    return F.when(F.length(F.trim(F.coalesce(raw, F.lit("")))) == 0, "empty_output").when(pred == UNKNOWN, "parse_error").when(pred == gt, "correct").otherwise("wrong_prediction")


def error_counts(rows: DataFrame, kinds: tuple[str, ...] = ("correct", "empty_output", "parse_error", "wrong_prediction")) -> DataFrame:
    """``error_type, n, ratio`` with zero-filled kinds."""
    base = rows.sparkSession.createDataFrame([(k,) for k in kinds], "error_type string")
    n = rows.groupBy("error_type").agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("t"))
    return base.join(F.broadcast(n), "error_type", "left").join(F.broadcast(total)).select("error_type", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("t")).alias("ratio"))


#: Parsed answers that stand for not knowing.
UNKNOWN_ALIASES = ("unk", "unknown", "none", "n a", "not sure")


def abnormal_outputs(rows: DataFrame, labels: list[str], aliases: tuple[str, ...] = UNKNOWN_ALIASES) -> DataFrame:
    """One row of counts over ``gt, raw, pred`` and their shares of all rows: ``raw_empty`` (blank
    answers), ``out_of_set`` (parsed to no label of the set), ``fallback`` (parsed to a label that
    the answer itself is not), ``unknown`` (parsed to an alias of not knowing), and
    ``missing_labels``, those of the set that no row truly has."""
    raw, pred = T.label_words(F.coalesce("raw", F.lit(""))), F.coalesce("pred", F.lit(""))
    known, plain = F.array(*[F.lit(x) for x in labels]), F.array(*[F.lit(T.plain_words(x)) for x in labels])
    inside = F.array_contains(known, pred)
    kinds = {
        "raw_empty": F.length(F.trim(F.coalesce("raw", F.lit("")))) == 0, "out_of_set": ~inside,
        "fallback": inside & ~((raw != "") & F.array_contains(plain, raw)), "unknown": T.label_words(pred).isin(*aliases),
    }
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    counts = [c for name, hit in kinds.items() for c in (F.count_if(hit).alias(name), (F.count_if(hit) / n).alias(f"{name}_share"))]
    return rows.agg(F.count(F.lit(1)).alias("n"), *counts, F.array_sort(F.array_except(known, F.collect_set("gt"))).alias("missing_labels"))


def batch_weighted(rows: DataFrame, batch: list[str], metrics: list[str]) -> DataFrame:
    """One row: the means over batches of each metric's mean in a batch, weighted by the batch's
    size, and ``batches``; rows without a value count in no mean of that metric."""
    own = rows.groupBy(*batch).agg(*[x for m in metrics for x in (F.avg(m).alias(m), F.count(m).alias(f"_n_{m}"))])
    return own.agg(*[(F.sum(F.col(m) * F.col(f"_n_{m}")) / F.sum(f"_n_{m}")).alias(m) for m in metrics], F.count(F.lit(1)).alias("batches"))


def round_times(events: DataFrame, start: str, end: str) -> DataFrame:
    """``round, seconds, mean_seconds``: from a round's first ``start`` event to its last ``end``
    event, at least 0, and the mean over the rounds that have both; other rounds have nulls."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    per = events.groupBy("round").agg(F.min(F.when(F.col("event") == start, micros)).alias("a"), F.max(F.when(F.col("event") == end, micros)).alias("b"))
    timed = per.select("round", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.greatest(F.col("b") - F.col("a"), F.lit(0)) / 1e6).alias("seconds"))
    return timed.join(F.broadcast(timed.agg(F.avg("seconds").alias("mean_seconds"))))


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, "gt", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame, *by: str) -> DataFrame:
    """``label, precision, recall, f1, support`` over the union of true and
    predicted labels of ``gt, pred, n``; a zero division gives 0."""
    truth = counts.groupBy(*by, F.col("gt").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    guess = counts.groupBy(*by, F.col("pred").alias("label")).agg(F.sum("n").alias("guessed"))
    both = truth.join(guess, [*by, "label"], "full").select(*by, "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "tp", "guessed")])
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return both.select(*by, "label", over(F.col("tp"), F.col("guessed")).alias("precision"), over(F.col("tp"), F.col("support")).alias("recall"), over(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"), "support", "tp")


def accuracy_f1(counts: DataFrame, *by: str) -> DataFrame:
    """Accuracy, macro and weighted F1, rounded to 4 digits."""
    s = class_scores(counts, *by)
    n = F.sum("support")
    return s.groupBy(*by).agg(F.round(F.sum("tp") / n, 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("f1_macro"), F.round(F.sum(F.col("f1") * F.col("support")) / n, 4).alias("f1_weighted"), n.alias("n"))


def dense_confusion(counts: DataFrame, labels: list[str]) -> DataFrame:
    """``gt, pred, n`` of the given labels, zero-filled; other labels are dropped."""
    names = F.array(*[F.lit(x) for x in labels])
    grid = counts.sparkSession.range(1).select(F.explode(names).alias("gt")).select("gt", F.explode(names).alias("pred"))
    return grid.join(F.broadcast(counts), ["gt", "pred"], "left").select("gt", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def valid_scores(rows: DataFrame, labels: list[str]) -> DataFrame:
    """``gt, scores``: clipped at 0 and normalised; rows with an unknown label, a
    vector of the wrong length or no positive score are left out."""
    clipped = F.transform("score_vector", lambda x: F.greatest(x, F.lit(0.0)))
    total = F.aggregate("clipped", F.lit(0.0), lambda a, b: a + b)
    own = rows.filter(F.col("gt").isin(labels) & (F.size("score_vector") == len(labels))).withColumn("clipped", clipped).withColumn("total", total)
    return own.filter("total > 0").withColumn("scores", F.transform("clipped", lambda x: x / F.col("total")))


def mid_rank(cells: DataFrame, keys: tuple[str, ...] = ("label",), value: str = "s", n: str = "n") -> DataFrame:
    """Distinct values with their counts, and ``rank``: the mean place of a value's rows."""
    return running(cells, list(keys), [value], n, "_before").withColumn("rank", F.col("_before") + (F.col(n) + 1) / 2).drop("_before")


def class_auc(valid: DataFrame, labels: list[str]) -> DataFrame:
    """``label, auc, support`` one against the rest (Mann-Whitney with mid-ranks),
    from counts per (class, score) and a running sum of those in ranges of the scores,
    so a class may hold nearly all rows; classes that are absent, or alone, have none."""
    names = F.array(*[F.lit(x) for x in labels])
    long = valid.select("gt", F.posexplode("scores").alias("k", "s")).withColumn("label", F.element_at(names, F.col("k") + 1))
    cells = long.groupBy("label", "s").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gt") == F.col("label")).alias("pos"))
    ranks = mid_rank(cells)
    sums = ranks.groupBy("label").agg(F.sum(F.col("pos") * F.col("rank")).alias("r"), F.sum("pos").alias("np"), (F.sum("n") - F.sum("pos")).alias("nn"))
    return sums.filter("np > 0 and nn > 0").select("label", ((F.col("r") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"), F.col("np").alias("support"))


def softmax(scores: Column, labels: int) -> Column:
    """Shifted exponentials over ``labels`` slots, missing ones as -1e9."""
    full = F.transform(F.sequence(F.lit(0), F.lit(labels - 1)), lambda i: F.coalesce(F.get(scores, i), F.lit(-1e9)))
    top = F.array_max(full)
    e = F.transform(full, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return F.transform(e, lambda x: x / total)


def top_labels(scores: Column, labels: list[str], k: int) -> Column:
    """The ``k`` labels with the highest scores; ties in label order."""
    names = F.array(*[F.lit(x) for x in labels])
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.element_at(names, p["i"] + 1))


def qa_scores(pred: Column, references: Column) -> tuple[Column, Column]:
    """Normalised exact match and the soft score min(1, matches / 3); an empty
    prediction scores 0."""
    own = T.vqa_answer(pred)
    same = F.size(F.filter(F.transform(references, T.vqa_answer), lambda r: r == own))
    some = own != ""
    return F.when(some & (same > 0), 1.0).otherwise(0.0), F.when(some, F.least(F.lit(1.0), same / 3.0)).otherwise(0.0)


def rouge_n(pairs: DataFrame, n: int, id_col: str = "id") -> DataFrame:
    """``id, f``: F of the n-gram multiset overlap of ``a`` and ``b``."""
    toks = pairs.select(id_col, T.rouge_tokens("a").alias("a"), T.rouge_tokens("b").alias("b"))

    def grams(c: str) -> Column:
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - n + 1), lambda i: F.array_join(F.slice(c, i, n), " "))).otherwise(F.array().cast("array<string>"))

    g = toks.select(id_col, grams("a").alias("ga"), grams("b").alias("gb"))
    long = g.select(id_col, F.explode("ga").alias("g"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(g.select(id_col, F.explode("gb").alias("g"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    over = long.groupBy(id_col, "g").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).groupBy(id_col).agg(F.sum(F.least("x", "y")).alias("o"), F.sum("x").alias("na"), F.sum("y").alias("nb"))
    return pairs.select(id_col).join(over, id_col, "left").select(id_col, F.coalesce(F.when(F.col("o") > 0, 2.0 * F.col("o") / (F.col("na") + F.col("nb"))), F.lit(0.0)).alias("f"))


#: Rarest words of a query that find its first candidates, and rows of a word in one task.
FIRST_WORDS, POSTINGS = 6, 4096


def _grams(df: DataFrame, name: str, n: int, id_col: str, text_col: str) -> DataFrame:
    """``name, n_name, w, k_name``: n-grams of words with their counts and their number in all."""
    toks = df.select(F.col(id_col).alias(name), T.rouge_tokens(text_col).alias("t"))
    grams = F.col("t") if n == 1 else F.when(F.size("t") >= n, F.transform(F.sequence(F.lit(1), F.size("t") - (n - 1)), lambda i: F.array_join(F.slice("t", i, n), " "))).otherwise(F.array().cast("array<string>"))
    g = toks.select(name, grams.alias("g"))
    return g.select(name, F.size("g").alias(f"n_{name}"), F.explode("g").alias("w")).groupBy(name, f"n_{name}", "w").agg(F.count(F.lit(1)).alias(f"k_{name}"))


def most_similar(asked: DataFrame, items: DataFrame, metric: str = "rouge1", id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``id, ref, f``: for each row of ``asked`` the other item with the largest F of ROUGE-1, -2
    or -L (``rouge1``, ``rouge2``, ``rougeL``), the smallest id of equal ones; rows that share
    nothing with any item are left out, as are null texts.

    An exact similarity join.  The rarest words of a query find first candidates, whose best F is
    a bound from below.  With it only items of fitting length that share one of the query's rarer
    words can be better: the other words, the frequent ones, are too few to reach the bound alone.
    What has been met so far and what may still come bound each pair from above; only pairs that
    may reach the bound are compared in full.  Words that are met in very many items are dealt
    over tasks.  The longest common subsequence is no longer than the overlap of words, so ROUGE-L
    has the same candidates, with the bound of its own.
    """
    if metric not in ("rouge1", "rouge2", "rougeL"):
        raise ValueError(f"unknown metric {metric!r}; known: rouge1, rouge2, rougeL")
    spark, n = asked.sparkSession, 2 if metric == "rouge2" else 1

    def kept(df: DataFrame) -> DataFrame:
        path = folder(spark, "similar")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    held = kept(_grams(items, "ref", n, id_col, text_col))
    often = held.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    queries = _grams(asked, "id", n, id_col, text_col).join(often, "w", "left").na.fill(0, ["often"])
    rarer = W.partitionBy("id").orderBy("often", "w")
    before = F.coalesce(F.sum("k_id").over(rarer.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = kept(queries.withColumn("before", before).withColumn("place", F.count_if(F.col("often") > 1).over(rarer)))

    def met(words: DataFrame) -> DataFrame:
        """Words of queries with the items that have them."""
        chunks = F.ceil(F.col("often") / POSTINGS).cast("int")
        hot = often.filter(F.col("often") > POSTINGS).select("w", chunks.alias("chunks"))
        salted = held.join(hot, "w", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("ref"), "chunks"), F.lit(0)).cast("int")).drop("chunks")
        asked_ = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(chunks, F.lit(1)) - 1))).drop("often")
        return asked_.join(salted, ["w", "salt"]).filter("id <> ref")

    def f(o: Column) -> Column:
        return F.round(2.0 * o / (F.col("n_id") + F.col("n_ref")), 12)

    def in_full(pairs: DataFrame, words: DataFrame) -> DataFrame:
        """``id, ref, n_id, n_ref, f`` of ``pairs`` with the overlap ``o`` so far, and ``words`` still to come."""
        more = pairs.join(words.select("id", "w", "k_id"), "id").join(held.select("ref", "w", "k_ref"), ["ref", "w"])
        rest = more.groupBy("id", "ref").agg(F.sum(F.least("k_id", "k_ref")).alias("more"))
        both = pairs.join(rest, ["id", "ref"], "left").withColumn("f", f(F.col("o") + F.coalesce("more", F.lit(0))))
        return both.select("id", "ref", "n_id", "n_ref", "f")

    def best(scored: DataFrame) -> DataFrame:
        return scored.groupBy("id").agg(F.max_by("ref", F.struct(F.col("f"), -F.col("ref"))).alias("ref"), F.max("f").alias("f"))

    def subsequences(pairs: DataFrame) -> DataFrame:
        """Pairs with the F of their longest common subsequence."""
        a = asked.select(F.col(id_col).alias("id"), F.col(text_col).alias("a"))
        b = items.select(F.col(id_col).alias("ref"), F.col(text_col).alias("b"))
        texts = pairs.select("id", "ref").join(a, "id").join(b, "ref").withColumn("pair", F.struct("id", "ref"))
        return rouge_l(texts.select("pair", "a", "b"), "pair").select("pair.id", "pair.ref", F.round("f", 12).alias("f"))

    first = met(own.filter((F.col("place") <= FIRST_WORDS) & (F.col("often") > 1)))
    few = first.groupBy("id", "ref", "n_id", "n_ref").agg(F.sum(F.least("k_id", "k_ref")).alias("o"))
    top = few.groupBy("id").agg(F.max_by(F.struct("ref", "n_id", "n_ref"), F.struct(f(F.col("o")), -F.col("ref"))).alias("t")).select("id", "t.*")
    start = in_full(top.withColumn("o", F.lit(0)), own)
    start = kept((subsequences(start) if metric == "rougeL" else start).select("id", F.col("f").alias("least")))
    bounded = own.join(start, "id", "left").na.fill(0.0, ["least"])
    # Fewest shared words of an item that reaches the bound.
    needed = F.ceil(F.col("least") * F.col("n_id") / (2 - F.col("least")) - 1e-9)
    marked = kept(bounded.withColumn("early", F.col("before") <= F.col("n_id") - F.greatest(needed, F.lit(1))))
    late = marked.groupBy("id").agg(F.sum(F.when(F.col("early"), 0).otherwise(F.col("k_id"))).alias("late"))
    fits = (2.0 * F.least("n_id", "n_ref") >= (F.col("least") - 1e-9) * (F.col("n_id") + F.col("n_ref")))
    shared = met(marked.filter("early")).filter(fits)
    pairs = shared.groupBy("id", "ref", "n_id", "n_ref", "least").agg(F.sum(F.least("k_id", "k_ref")).alias("o")).join(late, "id")
    most = F.col("o") + F.least(F.col("late"), F.col("n_ref") - F.col("o"))
    left = kept(pairs.filter(f(most) >= F.col("least") - 1e-9).drop("late"))
    full = in_full(left, marked.filter("not early"))
    if metric != "rougeL":
        return best(full)
    return best(subsequences(full.join(start, "id", "left").filter(F.col("f") >= F.coalesce("least", F.lit(0.0)) - 1e-9)).filter("f > 0"))


def lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence of two token arrays, row by row in the JVM."""
    zero = F.transform(b, lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("left"), F.lit(0).alias("diag"))

        def cell(s: Column, yi: Column) -> Column:
            up = F.element_at(prev, yi["i"] + 1)
            best = F.when(yi["y"] == x, s["diag"] + 1).otherwise(F.greatest(up, s["left"]))
            return F.struct(F.concat(s["row"], F.array(best)).alias("row"), best.alias("left"), up.alias("diag"))

        indexed = F.transform(b, lambda y, i: F.struct(y.alias("y"), i.alias("i")))
        return F.aggregate(indexed, start, cell, lambda s: s["row"])

    return F.coalesce(F.array_max(F.aggregate(a, zero, row)), F.lit(0))


def lcs(a: list, b: list) -> int:
    """Longest common subsequence, a row of the textbook programme at a time as the
    bits of one number; memory is linear in the tokens."""
    places: dict[object, list[int]] = defaultdict(list)
    for i, y in enumerate(b):
        places[y].append(i)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        if x in places:
            mask = bytearray(len(b) // 8 + 1)
            for i in places[x]:
                mask[i >> 3] |= 1 << (i & 7)
            met = row & int.from_bytes(mask, "little")
            row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


def rouge_l(pairs: DataFrame, id_col: str = "id") -> DataFrame:
    """``id, f`` of the whole texts ``a`` and ``b``; a null text has no tokens."""
    toks = pairs.select(id_col, T.rouge_tokens("a").alias("a"), T.rouge_tokens("b").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = []
            # One number for each distinct word of the batch, so words are compared as numbers.
            sides = [batch.column(i).fill_null([]) for i in (1, 2)]
            coded = pa.concat_arrays([x.flatten() for x in sides]).dictionary_encode().indices.to_pylist()
            sizes = [pc.list_value_length(x).to_pylist() for x in sides]
            at, other = 0, sum(sizes[0])
            for k, m in zip(*sizes):
                a, b = coded[at : at + k], coded[other : other + m]
                at, other = at + k, other + m
                n = lcs(a, b)
                f.append(2.0 * n / (len(a) + len(b)) if n else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.float64())], [id_col, "f"])

    return toks.mapInArrow(run, StructType([toks.schema[0], StructField("f", DoubleType())]))


def metric_spread(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """``metric, valid, mean, sd, best, best_client, worst, worst_client`` over clients;
    the first client wins ties."""
    long = rows.unpivot("client", metrics, "metric", "x")
    best = F.max_by(F.struct("x", "client"), F.struct(F.col("x"), -F.col("client")))
    worst = F.min_by(F.struct("x", "client"), F.struct(F.col("x"), F.col("client")))
    ok = long.filter("x is not null").groupBy("metric").agg(F.count(F.lit(1)).alias("valid"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"), best.alias("b"), worst.alias("w"))
    names = rows.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    return names.join(F.broadcast(ok), "metric", "left").select("metric", F.coalesce("valid", F.lit(0)).alias("valid"), "mean", "sd", F.col("b.x").alias("best"), F.col("b.client").alias("best_client"), F.col("w.x").alias("worst"), F.col("w.client").alias("worst_client"))


def best_round(rows: DataFrame, metric: str) -> DataFrame:
    """One row: the best value of a metric with its round and scope, the first on ties."""
    top = F.max_by(F.struct(F.col(metric).alias("value"), "round", "scope"), F.struct(F.col(metric), -F.col("round"), F.col("scope")))
    return rows.filter(F.col(metric).isNotNull()).agg(top.alias("b")).select("b.*")
