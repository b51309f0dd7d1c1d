"""Exact and near dedup against brute force."""

import hashlib
import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, simhash
from tessera.llm.components import components
from texts import prose


def brute_exact(rows):
    out = []
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [None, 32768])
def test_exact_dedup_is_grouping(spark, odd_docs, bits):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = exact_dedup.exact_dedup(odd_docs, bits=bits).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute_exact(rows)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert len(kept) == len(set(kept)) == len({t or "" for _, t in rows})


def test_keep_one_keeps_all_columns_and_one_row_a_text(odd_docs):
    out = exact_dedup.keep_one(odd_docs)
    assert out.columns == odd_docs.columns
    texts = [r["text"] or "" for r in out.collect()]
    assert sorted(texts) == sorted({r["text"] or "" for r in odd_docs.collect()})


def test_a_crowded_filter_changes_nothing(spark):
    rows = spark.range(40000).select(F.col("id").alias("doc_id"), (F.col("id") % 30000).cast("string").alias("text"))
    got = exact_dedup.exact_dedup(rows, bits=32768).agg(F.count(F.lit(1)), F.count_if("kept"), F.sum("group_size")).first()
    assert tuple(got) == (40000, 30000, 10000 * 2 * 2 + 20000)


def test_empty_tables(no_docs):
    assert exact_dedup.exact_dedup(no_docs).count() == 0
    assert exact_dedup.keep_one(no_docs).count() == 0
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def brute_fingerprint(text, width=4):
    words = (text or "").encode().translate(simhash.LOWER).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = simhash.near_duplicates(odd_docs).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, set()).add(f"{brute_fingerprint(t):016x}")
    for r in got:
        assert r["fingerprint"] in want[r["doc_id"]]
    comp = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert comp[2] == 1 and comp[5] == comp[6] == comp[4] == 4


def test_segments_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SEGMENT", 101)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text.decode())


@pytest.mark.parametrize("blocks", [6, 7])
def test_blocks_meet_every_close_pair(spark, blocks):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(6)})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, node long")
    got = {(r["a"], r["b"]) for r in simhash.close_pairs(df, 4, blocks).collect()}
    want = {(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(fps), 2) if (a ^ b).bit_count() <= 4}
    assert got == want and len(want) > 100


@pytest.mark.parametrize("block", [4096, 32])
def test_near_copies_of_one_text_give_a_forest_and_not_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    near = [0x123456789ABCDEF ^ (1 << i) ^ (1 << j) for i, j in itertools.combinations(range(62), 2)][:400]
    far = [int(x) for x in np.random.default_rng(4).integers(0, 2**63, 200)]
    fps = list(enumerate([*near, *far]))
    edges = simhash.close_forest(spark.createDataFrame([(f, i) for i, f in fps], "fp long, node long"))
    got = {(r["a"], r["b"]) for r in edges.collect()}
    close = {(i, j) for (i, a), (j, b) in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4}
    assert {tuple(sorted(e)) for e in got} <= close and len(close) > 70_000
    low = {r["node"]: r["component"] for r in components(edges).collect()}
    assert low == dict.fromkeys(range(400), 0)
    if block == 4096:
        assert edges.count() < 15 * len(fps)


def test_similar_texts_share_a_group(spark):
    rows = []
    for k in range(60):
        words = prose(k + 100, 200).split()
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join([*words[:100], "changed", *words[101:]])))  # similarity about 0.95
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    assert got == {i: i - i % 10 for i, _ in rows}
    assert simhash.keep_one(docs).count() == 60


def brute_groups(rows, width=5, similarity=0.8):
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}

    sets, low = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for i, j in itertools.combinations(sorted(sets), 2):
        if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) and low[i] != low[j]:
            a, b = sorted((low[i], low[j]))
            low = {k: a if v == b else v for k, v in low.items()}
    return low


def test_groups_are_those_of_exact_jaccard(spark):
    """Pairs at 0.6 to 0.78 and different texts around one repeated line stay; a copy
    with a line repeated goes."""
    line = prose(1, 12)
    rows = [(1, prose(2) + f"\n{line}" * 30), (2, prose(3) + f"\n{line}" * 30), (3, prose(4, 400)), (4, prose(4, 400) + f"\n{line}" * 30)]
    for k in range(10, 60):
        words, keep = prose(k, 200).split(), 160 + k % 30  # the first words stay: similarity about 0.66 to 0.9
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[:keep] + prose(1000 + k, 200 - keep).split()))]
    rows += [(1000 + k, prose(7, 200) + " " + prose(2000 + k, 30 if k else 1)) for k in range(40)]  # a star: only its centre is near all
    want = brute_groups(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert want[2] == 2 and want[4] == 3 and 0 < sum(want[10 * k] == want[10 * k + 1] for k in range(10, 60)) < 50
    assert {want[1000 + k] for k in range(40)} == {1000}


def test_large_blocks_and_components_are_dealt_as_pairs_of_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    rows = [(k, " ".join(prose(5, 200).split()[: 150 + 5 * (k * 7 % 11)] + prose(3000 + k // 2, 20).split())) for k in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(900, i) for i in range(200, 260)] + [(7, 8), (8, 9), (9, 7), (7, 7), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 181)} | {i: 200 for i in range(200, 260)} | {900: 200} | {7: 7, 8: 7, 9: 7}
    assert got == want
