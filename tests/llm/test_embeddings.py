"""Links of embeddings against all pairs."""

import numpy as np
import pytest

from tessera.llm import embedding_dedup as E


def brute(vectors, threshold):
    ok = [v is not None and len(v) > 0 and None not in v and bool(np.isfinite(v).all()) and any(v) for v in vectors]
    n = len(vectors)
    links, root = np.zeros(n, int), list(range(n))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                x, y = np.array(vectors[i], float), np.array(vectors[j], float)
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    return links.tolist(), [find(k) for k in range(n)]


@pytest.mark.parametrize("block", [512, 8])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(12):
        base = rng.standard_normal(32)
        vectors += [(base + s * rng.standard_normal(32)).astype(np.float32).tolist() for s in (0, 0.05, 0.1, 0.15, 0.2, 0.4)]
    vectors += [vectors[0], vectors[0], [0.0] * 32, None, [], [float("nan")] * 32, [1.0] * 31 + [None], [1.0, 2.0], [2.0, 4.0]]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in E.near_duplicates(df).collect()}
    links, comp = brute(vectors, 0.95)
    found = sum(got[i]["n_links"] for i in range(len(vectors)))
    assert found >= 0.97 * sum(links) and all(got[i]["n_links"] <= links[i] for i in range(len(vectors)))
    if found == sum(links):
        assert [got[i]["component_id"] for i in range(len(vectors))] == comp
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in range(len(vectors)))


def test_estimates_are_unbiased_and_within_their_bounds():
    plan = E.Plan.of(1000, 64, 0.95)
    matrix, bits = plan.matrix(), plan.rotations * plan.dims
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((400, 64))
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * noise
    turned = x @ matrix
    factor = np.abs(turned).sum(1) / np.sqrt(bits)
    estimate = ((np.sign(turned) / np.sqrt(bits)) * (y @ matrix)).sum(1) / factor
    assert abs((estimate - 0.95).mean()) < 0.004
    assert (estimate + plan.bound(factor) >= 0.95).mean() > 0.995


def test_tables_without_usable_vectors(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    """Ids name rows, not vectors: different vectors of one id are compared apart, and rows
    without an id link; columns of the operator's own names are not read."""
    rows = [(1, [1.0, 0.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0, 0.0]), (None, [0.0, 0.0, 1.0, 0.0]), (5, [0.0, 0.0, 1.0, 0.01]), (None, [0.0, 0.0, 0.0, 1.0]), (None, [0.0, 0.0, 0.0, 1.0]), (None, None)]
    df = spark.createDataFrame([(i, v, "x", 7, b"y", 1.0) for i, v in rows], "vec_id long, embedding array<double>, digest string, node int, vec binary, n_rows double")
    got = sorted(map(tuple, E.near_duplicates(df).collect()), key=str)
    want = [(1, 1, 1, True), (1, 0, 1, True), (2, 1, 1, False), (None, 1, 5, False), (5, 1, 5, True), (None, 1, None, True), (None, 1, None, True), (None, 0, None, True)]
    assert got == sorted(want, key=str)
