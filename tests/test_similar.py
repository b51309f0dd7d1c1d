"""Most similar references against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import evaluate as E

COMMON = "the of and to in a is that it for".split()


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def score(metric, a, b):
    if metric == "rougeL":
        o = longest(a, b)
    else:
        if metric == "rouge2":
            a, b = ([" ".join(x[i : i + 2]) for i in range(len(x) - 1)] for x in (a, b))
        o = sum(min(a.count(w), b.count(w)) for w in set(a))
    return round(2 * o / (len(a) + len(b)), 12) if o else 0.0


def texts():
    rng = random.Random(6)
    rows = []
    for i in range(90):
        words = [rng.choice(COMMON) if rng.random() < 0.6 else f"w{rng.randrange(200)}" for _ in range(rng.randrange(3, 40))]
        if i % 4 == 3:  # a changed copy of an earlier one
            words = [w for w in rows[rng.randrange(i)][1].split() if rng.random() < 0.8] + words[:5]
        rows.append((i, " ".join(words)))
    return rows + [(90, ""), (91, None), (92, "nothing shared here"), (93, rows[5][1]), (94, "the the the the"), (95, "the")]


@pytest.mark.parametrize("metric", ["rouge1", "rouge2", "rougeL"])
@pytest.mark.parametrize("postings", [4096, 7])
def test_best_reference_is_that_of_all_pairs(spark, monkeypatch, metric, postings):
    monkeypatch.setattr(E, "POSTINGS", postings)
    rows = texts()
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["f"], r["ref"]) for r in E.most_similar(df.filter("id % 2 = 0 or id > 88"), df, metric).collect()}
    split = {i: (t or "").split() for i, t in rows}
    for i, t in split.items():
        if i % 2 and i <= 88:
            continue
        f, ref = max((score(metric, t, x), -j) for j, x in split.items() if j != i)
        assert got.get(i) == ((f, -ref) if f > 0 else None), i


def test_a_word_of_all_items_is_dealt_over_tasks(spark, monkeypatch):
    """Its rows meet in keys (word, chunk) of bounded size."""
    monkeypatch.setattr(E, "POSTINGS", 64)
    df = spark.range(2000).select("id", F.concat(F.lit("the "), (F.col("id") % 500).cast("string")).alias("text"))
    got = {r["id"]: r["ref"] for r in E.most_similar(df.filter("id < 5"), df).collect()}
    assert got == {i: i + 500 for i in range(5)}


def test_unknown_metrics_and_empty_tables(spark):
    df = spark.createDataFrame(texts(), "id long, text string")
    with pytest.raises(ValueError, match="rouge9"):
        E.most_similar(df, df, "rouge9")
    assert E.most_similar(df.limit(0), df).count() == 0 and E.most_similar(df, df.limit(0)).count() == 0
