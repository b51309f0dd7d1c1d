"""Personal data, periodic runs and whitening against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from compare import SMALL
from pyspark.sql import functions as F
from texts import prose

from tessera.llm import pii, periods, queries, whitening

EMPTY = hashlib.sha256(b"").hexdigest()


def luhn(digits):
    d = [int(c) for c in digits][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text):
    """The contract's rules, word for word."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), i, m.end(), kind) for i, (kind, rule, good) in enumerate(rules) for m in re.finditer(rule, text) if good(m.group())]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def spans_of(df):
    return [(r.doc_id, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in df.collect()]


PERSONAL = [
    "a.b@c.d_e@f.g mail x@y x@y.z. é+1 (788) 555-0037, +33 1 23 45 67 89 ++49 +1",
    "4111 1111 1111 1111 then 4111111111111112; 1.2.3.4.5.6.7.8 and 256.1.1.1 or 000255.0.0.09 1..2.3.4.5",
    "\U0001f600 tel +1-202-555-0123 \U0001f600 10.0.0.1\U0001f600 a@b.c " + "9" * 40,
    "a@a@a@a.b.c.d@e.f" * 3,
    "+1 (((( 2 3 4) 5.6.7-8 9 0+1 222 333 444",
]


def test_pii_base_spans(spark, odd_docs):
    rng = random.Random(3)
    noisy = ["".join(rng.choice("09+.-() a@é\n5") for _ in range(300)) for _ in range(150)]
    many = " ".join(f"u{i}@h{i}.com {i}.1.2.3 +1 555 000 {i:04d}" for i in range(2000))
    docs = [(i, t) for i, t in enumerate([*PERSONAL, *noisy, many, "x" * 3000 + "@y", "7" * 3000])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = dict(spans_of(pii.find(df)))
    for i, text in docs:
        assert [s[:3] for s in got[i] if s[3]] == base_spans(text), text[:200]
    odd = spans_of(pii.find(odd_docs))
    assert sorted(str(i) for i, _ in odd) == sorted(str(r.doc_id) for r in odd_docs.collect())
    assert not any(s for _, s in odd)
    assert pii.find(odd_docs.limit(0)).count() == 0


def test_pii_adds_what_labelers_agree_on(spark):
    rows = [(i, f"{prose(i, 20)} mail u{i}@mail{i}.com, phone +1 202 555 {i:04d}, card 4111111111111111, {prose(i + 500, 20)} order 1234567{i % 10}, build 20{i:06d}1 {prose(i, 9)}") for i in range(300)]
    rows += [(1000, "account DE89 3704 0044 0532 0130 00 of Maria Schmidt"), (1001, "total 4111111111111112 items, version 123456789"), (1002, "social security ssn: 123-45-6789 here"), (1003, prose(7))]
    got = dict(spans_of(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))))
    added = {i: [s[:3] for s in v if not s[3]] for i, v in got.items()}
    assert ("account", 8, 35) in added[1000]
    assert added[1001] == [] and added[1003] == []
    assert added[1002] == [("number", 21, 32)]
    assert not any(added[i] for i in range(300))


def test_pii_estimates_match_plain_em(spark):
    """The same steps on lists give the same probabilities."""
    rng = random.Random(5)
    rows = [([1, 0, 0, 0, 0, *[rng.choice([-1, 0, 0, 1]) for _ in range(6)]], k % 4 == 0, rng.randrange(1, 50)) for k in range(40)]
    got = {(tuple(r.x), r.base, r.n): r.p for r in pii.estimated(spark.createDataFrame(rows, "x array<int>, base boolean, n long"), rounds=12).collect()}
    prior = {1: {1: 0.5, 0: 0.4, -1: 0.1}, 0: {1: 0.1, 0: 0.4, -1: 0.5}}
    rate, share = {y: [dict(prior[y]) for _ in range(6)] for y in (0, 1)}, 0.3

    def likely(x, base):
        odds = share / (1 - share)
        for j in range(6):
            odds *= rate[1][j][x[5 + j]] / rate[0][j][x[5 + j]]
        return 1.0 if base else odds / (1 + odds)

    for _ in range(12):
        p = [likely(x, b) for x, b, _ in rows]
        s, a = sum(n * q for (_, _, n), q in zip(rows, p)), sum(n for _, _, n in rows)
        share = (sum(n * q for (_, b, n), q in zip(rows, p) if not b) + 1.2) / (sum(n for _, b, n in rows if not b) + 4)
        for j in range(6):
            for v in (-1, 0, 1):
                yes, both = (sum(n * k for (x, _, n), k in zip(rows, w) if x[5 + j] == v) for w in (p, [1] * len(p)))
                rate[1][j][v] = (yes + 4 * prior[1][v]) / (s + 4)
                rate[0][j][v] = (both - yes + 4 * prior[0][v]) / (a - s + 4)
    for x, b, n in rows:
        assert got[tuple(x), b, n] == pytest.approx(likely(x, b), abs=1e-4)


def test_op11(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = queries.op11_pii(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in base) for x in ("email", "ip", "card", "phone")]
        joined = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(r.spans.split(",")) | {""}


# Periodic runs.


def brute_runs(words, least=6, power=4):
    found = {}
    for q in range(1, len(words) // power + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in dropped)


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.randrange(1, 5)):
            size = rng.choice([1, 2, 3, 5])
            part = [rng.randrange(size) for _ in range(rng.randrange(1, 9))]
            docs.append([rng.randrange(size) for _ in range(rng.randrange(40))] + part * rng.randrange(8) + part[: rng.randrange(len(part) + 1)] + [rng.randrange(size) for _ in range(rng.randrange(10))])
        for least, power in ((6, 4), (5, 3), (9, 4), (12, 5)):
            got = periods.runs_of(np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]), least, power)
            want, at = [], 0
            for d in docs:
                want += [[s + at, n, q] for s, n, q in brute_runs(d, least, power)]
                at += len(d)
            assert got.tolist() == want, docs


def test_runs_of_odd_texts(spark, odd_docs):
    """Nulls, blanks, repeated rows, very long texts and clashing names."""
    again = [(20, "a " * 20_000), (21, "x\x0by\tx y " * 9 + "x z"), (22, "ü " * 5), (23, "ü " * 9)]
    given = odd_docs.withColumn("runs", F.lit(1)).unionByName(spark.createDataFrame([(i, t, "x", 0, 1, "y", True, 1, 2) for i, t in again], "doc_id long, text string, digest string, keep_id int, _row int, fp string, maybe boolean, n_chars long, runs int"))
    rows = periods.periodic_runs(given).collect()
    assert len(rows) == given.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [tuple(x) for x in by[20].runs] == [(0, 20_000, 1)] and by[20].collapsed == "a"
    assert [tuple(x) for x in by[21].runs] == [(0, 37, 2)] and by[21].collapsed == "x y z"
    assert by[22].runs == [] and by[22].collapsed == "ü ü ü ü ü" and by[23].runs == [] and by[5].collapsed == "" and by[6].runs == []
    assert periods.periodic_runs(odd_docs.limit(0)).count() == 0


def test_op12(spark):
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    some = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        h, n = zlib.crc32(str(d.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs, r = brute_runs(words), rows[d.doc_id]
        some += bool(runs)
        assert r.n_runs == len(runs)
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n_},{q}\n" for s, n_, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 3


# Whitening.


@pytest.mark.parametrize("d", [1, 2, 5, 31, 64, 90])
def test_contours_find_all_eigenvalues(d):
    rng = np.random.default_rng(d)
    for v in (np.cov((rng.standard_normal((300, d)) * np.geomspace(1, 300, d)).T).reshape(d, d), np.eye(d), np.zeros((d, d)), np.diag(np.arange(d) // 2 * 1.0)):
        parts = whitening.slices_of(*whitening.tridiagonal(v), 32)
        values = np.concatenate([whitening.contour(v, p)[0] for p in parts] or [np.zeros(0)])
        want = np.linalg.eigvalsh(v)[::-1]
        want = want[want > 1e-9 * max(1e-300, want[0])]
        assert len(values) >= min(32, len(want))
        np.testing.assert_allclose(values, want[: len(values)], rtol=1e-9)


def test_whitening_matches_numpy(spark):
    rows = queries.op13_whitening(spark, SMALL).collect()
    given = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ids = sorted(given)
    x = np.floor(64 * np.array([given[i] for i in ids], float)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(0)
    centred = np.array([[float(Fraction(int(n * a - s), n)) for a, s in zip(row, total)] for row in x])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    want = centred @ u / np.sqrt(e)
    got = np.zeros((n, 32))
    place = {i: k for k, i in enumerate(ids)}
    for r in rows:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[place[r.vec_id]] - total) ** 2).sum())
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(v), rel=1e-9) and r.identity_error < 1e-9
    assert len(rows) == 32 * n
    sign = np.sign((got * want).sum(0))
    np.testing.assert_allclose(got, want * sign, atol=1e-6)


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(0)
    good = [(k % 50, [float(c) for c in rng.standard_normal(5)]) for k in range(100)] + [(None, [0.1, 0.2, 0.3, 0.4, 0.5])]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [nan, 0.0, 0.0, 0.0, 0.0]), (903, [inf, 0.0, 0.0, 0.0, 0.0]), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in good + bad], "vec_id long, embedding array<double>, n int, x double")
    rows = whitening.whitened(df).collect()
    assert len(rows) == 5 * 101 and all(r.vec_id is None or r.vec_id < 900 for r in rows) and rows[0].n == 101
    assert max(r.identity_error for r in rows) < 1e-9
    equal = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "vec_id long, embedding array<double>")
    assert whitening.whitened(equal).count() == 0 and whitening.whitened(equal.limit(0)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whitening.whitened(flat).collect()} == {1}
    large = spark.createDataFrame([(i, [1e9 * i, -7.0 * i * i]) for i in range(9)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="larger than a long"):
        whitening.whitened(large.unionByName(large)).collect()


@pytest.mark.parametrize("tight", [1e-2, 1e-3, 1e-4])
@pytest.mark.parametrize("far", [[], [150.0], [150.0, 149.0, 90.0]])
def test_contours_tell_far_eigenvalues_from_a_dense_part(far, tight):
    rng = np.random.default_rng(len(far))
    want = np.sort(np.concatenate([far, 64 * (1 + tight * rng.random(64 - len(far)))]))[::-1]
    turn, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    v = turn * want @ turn.T
    parts = whitening.slices_of(*whitening.tridiagonal((v + v.T) / 2), 32)
    found = [whitening.contour((v + v.T) / 2, p) for p in parts]
    values = np.concatenate([f[0] for f in found])
    np.testing.assert_allclose(values, want[: len(values)], rtol=1e-12)
    vectors = np.concatenate([f[1] for f in found], axis=1)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-11 and max(p.width for p in parts) < 32


def test_contours_leave_out_values_that_are_mixtures():
    # With a wide basis, what lies above and below a slice mixes to values inside.
    v = np.diag(np.concatenate([64 + np.arange(20.0), 100 + np.arange(5.0), 120 + np.arange(20.0)])[::-1])
    for width in range(6, 46):
        values, vectors = whitening.contour(v, whitening.Slice(99.5, 104.5, 20, 5, width))
        np.testing.assert_allclose(values, [104, 103, 102, 101, 100], rtol=1e-12)
        assert np.abs(vectors[:20]).max() < 1e-9 and np.abs(vectors[25:]).max() < 1e-9


def test_whitening_of_large_tables_spectrum(spark):
    # Two far eigenvalues over 62 within half a percent, as of many random vectors with groups of copies.
    sides = np.array([2000.0, 1900.0] + [1000 + k / 32 for k in range(62)])
    rows = [(2 * k + s, [float(c * (1 - 2 * s)) if j == k else 0.0 for j in range(64)]) for k, c in enumerate(sides) for s in (0, 1)]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    share = np.sort(sides**2)[::-1] / (sides**2).sum()
    assert len(got) == 128 * 32 and max(r.identity_error for r in got) < 1e-9
    for r in got:
        assert r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        assert r.deviation == (128 * int(64 * sides[r.vec_id // 2])) ** 2
