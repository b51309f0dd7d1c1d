"""The classifier, the packer and the whole pipeline against plain versions."""

import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import SMALL
from pyspark.sql import functions as F
from test_dedup import brute_groups
from test_scans import brute_spans
from texts import prose
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import packing, quality, secrets

BPE = public_tokenizers.path("byte_bpe_50k.json")


def plain_scores(texts, labels, shrink=0.05, ridge=0.02):
    """Quadratic discriminant straight from its formula: covariances of all rows of a class,
    shrunk to the pooled one, with explicit inverses and determinants."""
    x = {i: np.array(quality.statistics((t or "").encode())) for i, t in texts.items()}
    known = [(i, y) for i, y in labels if i in x and y in (0, 1) and zlib.crc32(str(i).encode()) % 3 != 1]
    rows = {c: np.array([x[i] for i, y in known if y == c]) for c in (0, 1)}
    n = {c: len(r) for c, r in rows.items()}
    own = {c: np.cov(r.T, bias=True) for c, r in rows.items()}
    pooled = (n[0] * own[0] + n[1] * own[1]) / (n[0] + n[1])
    density = {}
    for c in (0, 1):
        cov = (1 - shrink) * own[c] + shrink * pooled + ridge * np.diag(np.diag(pooled) + 1e-3)
        inverse, (_, log_det), mean = np.linalg.inv(cov), np.linalg.slogdet(cov), rows[c].mean(0)
        density[c] = {i: -0.5 * ((v - mean) @ inverse @ (v - mean) + log_det) for i, v in x.items()}
    margin = {i: np.clip(density[1][i] - density[0][i] + np.log(n[1] / n[0]), -700, 700) for i in x}
    return {i: 1 / (1 + np.exp(-m)) for i, m in margin.items()}


def tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    return docs, {r["doc_id"]: r["text"] for r in docs.collect()}, labels


def test_scores_are_those_of_the_formula(spark):
    docs, texts, labels = tables(spark)
    want = plain_scores(texts, labels)
    got = {r["doc_id"]: r for r in quality.quality(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert set(got) == set(want)
    for i, r in got.items():
        assert r["score"] == pytest.approx(want[i], abs=1e-6) and r["predicted"] == int(r["score"] >= 0.5)
    seen = [(got[i]["predicted"], y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(p == y for p, y in seen) >= 0.9 * len(seen)


def test_quality_of_repeated_long_and_clashing_rows(spark):
    rows = [(k, prose(k, 50) if k % 2 else "$$$ " * 60) for k in range(40)] + [(50, " ".join(prose(k) for k in range(800))), (1, prose(1, 50)), (51, "x" * 100_000), (52, ""), (None, prose(3))]
    docs = spark.createDataFrame([(i, t, "x", 7, 0.5) for i, t in rows], "doc_id long, text string, label string, x int, score double")
    known = spark.createDataFrame([(k, k % 2, 9) for k in range(40)] + [(3, 1, 9), (None, 1, 9), (4, 7, 9)], "doc_id long, quality int, label int")
    got = quality.quality(docs, known).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    kept = quality.keep_good(docs, known)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {k for k in range(1, 40, 2)}


def plain_packing(lengths, capacity):
    """Best-two-fit on the pieces themselves, one at a time."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], capacity
        while fits := [n for n in left if n <= gap]:
            n = max(fits)
            left.remove(n)
            bin_.append(n)
            gap -= n
        if gap and len(bin_) > 1:
            room, best = gap + bin_[-1], (bin_[-1], None)
            for a, b in itertools.combinations(left, 2):
                if best[0] < a + b <= room:
                    best = (a + b, (a, b))
            if best[1]:
                left.append(bin_.pop())
                left.sort()
                for n in best[1]:
                    left.remove(n)
                    bin_.append(n)
        bins.append(sorted(bin_))
    return bins


def test_packer_fills_like_the_plain_one():
    """As many bins, and each as full, as packing pieces one by one gives."""
    rng = random.Random(8)
    for trial in range(60):
        capacity = rng.choice([20, 50, 101])
        lengths = [rng.randrange(1, capacity + 1) if rng.random() < 0.5 else rng.randrange(1, max(2, capacity // 4)) for _ in range(rng.randrange(0, 40))]
        counts = np.bincount(lengths, minlength=capacity + 1) if lengths else np.zeros(capacity + 1, np.int64)
        plan = packing.best_two_fit(counts)
        got = sorted(sum(b) for b, times in plan for _ in range(times))
        want = plain_packing(lengths, capacity)
        assert sorted(n for b, times in plan for _ in range(times) for n in b) == sorted(lengths)
        assert abs(len(got) - len(want)) <= 1, (trial, lengths)


def redacted(text):
    spans = [(a, b) for _, a, b in brute_spans(text)]
    spans += [m.span() for rule in secrets.ADDED for m in re.finditer(rule.pattern, text)]
    return secrets.masked(text, spans, "[SECRET]")


def test_pipeline_keeps_and_packs_what_plain_stages_do(spark):
    _, texts, labels = tables(spark)
    scores = plain_scores(texts, labels)
    kept = {i: t for i, t in texts.items() if scores[i] >= 0.5}
    largest = {}
    for i, t in kept.items():
        largest[t or ""] = max(i, largest.get(t or "", i))
    kept = {i: kept[i] for i in largest.values()}
    groups = brute_groups([(i, t or "") for i, t in kept.items()])
    kept = {i: redacted(t or "") for i, t in kept.items() if groups[i] == i}
    whole, want = Tokenizer.from_file(BPE), []
    for i, t in kept.items():
        ids = [*whole.encode(t, add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and "sequence_id" in out.columns


def test_stages_of_odd_rows(spark, odd_docs):
    """Nulls, repeats, long texts and clashing names pass each stage, with their columns."""
    docs = odd_docs.withColumn("score", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("_u", F.lit(2.0)).withColumn("lang", F.lit("en"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").count() >= docs.count()
