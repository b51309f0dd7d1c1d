"""Secrets, URLs and licenses against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import automaton, licenses, secrets, url_filter

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(text):
    hits = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    hits += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hits += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], a, b) for a, k, b in sorted(hits)]


def random_texts(n):
    rng = random.Random(5)
    parts = ["token", "PassWD", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0123", "é", "ſecret", "\n", "x", "secret"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_scan_finds_what_the_expressions_find(spark):
    texts = [*random_texts(400), None, "", "a" * 3000 + "b" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert {i: [s for s in spans if s[0] in ("assign", "access", "hex")] for i, spans in got.items()} == {i: brute_spans(t or "") for i, t in enumerate(texts)}


def test_spans_do_not_depend_on_segments_or_neighbours(monkeypatch):
    texts = [t for t in random_texts(3000)] + ["token=" + "x" * 5000 + "é secret:abcdef", "deadbeef" * 900]
    find = secrets._finder(secrets.RULES, secrets.combined(secrets.RULES))
    scan = automaton.Automaton.scan
    monkeypatch.setattr(automaton.Automaton, "scan", lambda self, text: scan(self, text, lanes=7, segment=1000))
    got = [[s for s in spans if s[0] in ("assign", "access", "hex")] for spans in find([t.encode() for t in texts])]
    assert got == [brute_spans(t) for t in texts]


def test_scan_of_repeated_rows_and_clashing_names(spark):
    rows = [(1, "token=abcdef", "x", 5), (1, "token=abcdef", "y", 6), (None, "secret: 'éa", "z", 7)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int"))
    assert got.columns == ["doc_id", "spans"]
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in got.collect()) == [(0, 0), (1, 1), (1, 1)]


def test_longest_match_of_an_anchored_automaton():
    machine = automaton.compile_rules([("a(b|bc)*d?", False)], anchored=True)
    assert [machine.longest(b"xabcbdd", i) for i in (0, 1, 2)] == [-1, 6, -1]


def test_added_rules(spark):
    text = "k eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NSJ9.abcDEF123_-x and -----BEGIN RSA PRIVATE KEY-----"
    kinds = [s["kind"] for s in secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]]
    assert kinds == ["jwt", "pem"]


@pytest.mark.parametrize("lanes", [1, 3, 50, 4096])
def test_automaton_is_one_pass_whatever_the_lanes(lanes):
    machine = automaton.compile_rules([("ab+c", False), ("[0-9]{3}", False), ("(?:x|yz)q?", True)])
    rng = random.Random(lanes)
    for _ in range(40):
        text = "".join(rng.choice("abcxyzqXYZ0123\n ") for _ in range(rng.randint(0, 400)))
        ends, bits = machine.scan(text.encode(), lanes)
        got = {(int(e), k) for e, b in zip(ends, bits) for k in range(3) if b >> k & 1}
        want = set()
        for k, rx in enumerate((re.compile("ab+c"), re.compile("[0-9]{3}"), re.compile("(?:x|yz)q?", re.I))):
            want |= {(j - 1, k) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 400) + 1) if rx.fullmatch(text, i, j)} if len(text) < 120 else {g for g in got if g[1] == k}
        assert got == want


def test_redaction_keeps_rows_and_columns(odd_docs, no_docs):
    out = secrets.redact(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    row = out.filter("doc_id = 9").first()
    assert row["text"].endswith("[SECRET]") and row["n_chars"] == len(row["text"])
    assert out.filter("doc_id = 5").first()["text"] is None
    assert secrets.redact(no_docs).count() == 0 and secrets.scan(no_docs).count() == 0
    assert secrets.masked("abcdef", [(1, 3), (2, 4)], "#") == "a#ef"


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("a.org", "", "allow")]
URLS = [
    "http://example.com/en/7198#top", "https://x.example.com/en/6?q=/en/7", "HTTP://NET/de/1", "ftp://b.a.org", "no scheme", None, "", "http://notcom/en/", "http://a.com:80/en/", "s://example.net/de/8/", "http://u.net/de/8",
    "http://org/es/x://y.com/en/", "://com/en/", "http://x.com/EN/", "http://a.org/es/1",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_by_trie_and_by_join(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    want = {i: brute_rule(u) for i, u in enumerate(URLS)}
    by_trie = {r["page_id"]: tuple(r)[1:] for r in url_filter.match(pages, RULES).collect()}
    by_join = {r["page_id"]: tuple(r)[1:] for r in url_filter.match_by_join(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()}
    assert by_trie == want and by_join == want
    assert url_filter.match(pages.limit(0), RULES).count() == 0


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    with pytest.raises(ValueError, match="match_by_join"):
        url_filter.match(spark.createDataFrame([(1, "x")], "page_id long, url string"), RULES)


def test_license_inheritance(spark):
    apache, gpl = licenses.NOTICES["Apache-2.0"][0], licenses.NOTICES["GPL-3.0"][0]
    rows = [
        (1, "a/LICENSE", apache), (2, "a/b/code", "just some words here"), (3, "a/b/c/LICENSE", gpl), (4, "a/b/c/d/code", "other words\nfollow"),
        (5, "z/code", "nothing"), (6, "a/own", "first line of prose\n" + gpl + "\n" + "many words of the file " * 20), (7, None, None), (8, "a/b/x", ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.licenses(docs, F.col("p")).collect()}
    assert got == {
        1: ("Apache-2.0", "Apache-2.0", None), 2: (None, "Apache-2.0", "a"), 3: ("GPL-3.0", "GPL-3.0", None), 4: (None, "GPL-3.0", "a/b/c"), 5: (None, None, None),
        6: ("GPL-3.0", "GPL-3.0", None), 7: (None, None, None), 8: (None, "Apache-2.0", "a"),
    }
    assert licenses.licenses(docs.limit(0), F.col("p")).count() == 0


def test_cosine_against_dense_vectors():
    import numpy as np

    idf = {"a": 2.0, "b": 1.0, "c": 3.0}
    got = licenses.cosine({"a": 2, "b": 1}, 1, {"a": 1, "c": 1}, idf)
    x, y = np.array([2 * 2, 1 * 1, 0, 3.0]), np.array([2, 0, 3, 0.0])
    assert got == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y))


def wrapped(text, width=70):
    import textwrap

    return "\n".join(textwrap.wrap(text, width))


PROSE = "the terms of the road and the use of this map are free to any person who will not change it under the rain "
NOTICED = {
    "inline": (PROSE + "Licensed under CC BY-NC 4.0. " + PROSE, "CC-BY-NC-4.0"),
    "comment": ("# SPDX-License-Identifier: BSD-2-Clause\nimport os\n" + PROSE, "BSD-2-Clause"),
    "header": ("/* " + wrapped(licenses.NOTICES["GPL-2.0"][1]).replace("\n", "\n * ") + " */\nint main() {}\n" + PROSE * 3, "GPL-2.0"),
    "lesser": (PROSE + "under the GNU Lesser General Public License, version 3. " + PROSE, "LGPL-3.0"),
    "rights": (PROSE + "(c) Some Firm. All rights reserved.", "proprietary"),
    "prose": (PROSE * 4, None),
    "tag of another": ("SPDX-License-Identifier: Sleepycat\n" + PROSE, None),
}


def test_notices_inside_lines_and_texts(spark):
    docs = spark.createDataFrame([(i, k, t) for i, (k, (t, _)) in enumerate(NOTICED.items())], "doc_id long, p string, text string")
    got = {r["path"]: r["own_license"] for r in licenses.licenses(docs, F.col("p")).collect()}
    assert got == {k: want for k, (_, want) in NOTICED.items()}


def test_real_licence_files_pass_their_license_on(spark):
    rows = []
    for i, (name, text) in enumerate(licenses.FILES.items()):
        body = f"{name} License\n\nCopyright (c) 2020 Some One, of a town\n\n" + wrapped(text)
        rows += [(2 * i, f"{name}/LICENSE", body + ("\n\nfurther paragraphs follow here " * 200 if "GNU" in text else "")), (2 * i + 1, f"{name}/src/code", PROSE)]
    got = licenses.licenses(spark.createDataFrame(rows, "doc_id long, p string, text string"), F.col("p")).collect()
    assert {r["path"]: (r["own_license"], r["license"]) for r in got} == {p: (None if "src" in p else p.split("/")[0], p.split("/")[0]) for _, p, _ in rows}


def brute_licenses(rows, templates):
    import numpy as np

    vocabulary = sorted({w for t in templates for w in licenses.words(t.text)})
    texts = [licenses.words(t or "") for _, _, t in rows]
    idf = np.array([np.log((1 + len(rows)) / (1 + sum(w in t for t in texts))) + 1 for w in vocabulary])
    vector = lambda ws: np.array([ws.count(w) for w in vocabulary]) * idf
    own, files = {}, {}
    for (i, path, _), text in zip(rows, texts):
        scored = []
        for j, t in enumerate(templates):
            ws = licenses.words(t.text)
            n = len(ws) if t.whole else min(3, len(ws))
            grams = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
            runs = []
            for k in [k for k in range(len(text) - n + 1) if tuple(text[k : k + n]) in grams]:
                if runs and k - runs[-1][1] <= licenses.GAP:
                    runs[-1][1] = k
                else:
                    runs.append([k, k])
            for a, b in runs:
                part = text[a : b + n]
                x, y, other = vector(part), vector(ws), sum(w not in vocabulary for w in part) * idf.max() ** 2
                scored.append((round(float(x @ y / np.sqrt((x @ x + other) * (y @ y))), 9), len(part), -j))
        best, size, j = max(scored, default=(0.0, 0, 0))
        own[i] = templates[-j].license if best >= licenses.NEAR else None
        if own[i] and (size >= 0.5 * len(text) or any(s >= 0.8 and templates[-k].file and templates[-k].license == own[i] for s, _, k in scored)):
            files.setdefault(path.rpartition("/")[0], []).append((best, -i, own[i]))
    out = {}
    for i, path, _ in rows:
        at = path
        while own[i] is None and at:
            at = at.rpartition("/")[0]
            if at in files:
                break
        out[i] = (own[i], own[i] or (max(files[at])[2] if at in files else None), at if own[i] is None and at in files else None)
    return out


def test_licenses_against_brute_force(spark):
    rng = random.Random(8)
    bits = [t.text for t in licenses.TEMPLATES] + [" ".join(t.text.split()[:6]) for t in licenses.TEMPLATES] + [PROSE, "one two three four", "version 3", "of the License"]
    rows = []
    for i in range(300):
        path = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) + f"/f{i}"
        rows.append((i, path.lstrip("/"), " ".join(rng.choice(bits) for _ in range(rng.randint(0, 3))) if rng.random() < 0.5 else PROSE))
    rows += [(300, "a/b/same", rows[0][2]), (301, "a/none", None), (302, "f", "")]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("terms", F.lit(1)).withColumn("own_license", F.lit("x"))
    got = {r["doc_id"]: (r["own_license"], r["license"], r["inherited_from"]) for r in licenses.licenses(docs, F.col("path")).collect()}
    assert got == brute_licenses(rows, licenses.TEMPLATES)


def test_passages_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    bits = [*(t.text for t in licenses.TEMPLATES), PROSE, "x " * 20]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    find = licenses.Finder(licenses.TEMPLATES)
    key = lambda x: (sorted(x[0]), sorted((j, n, sorted(c.items())) for j, n, c in x[1]), x[2])
    whole = [key(find(t)) for t in texts]
    for size in (1, 17, 150, 700):
        monkeypatch.setattr(licenses, "PIECE", size)
        assert [key(find(t)) for t in texts] == whole


def test_long_hexadecimal_texts_need_little_memory():
    """Nearly every byte starts a match: what is held are stretches, not places."""
    import tracemalloc

    from tessera.llm import secrets as S

    find = S._finder(S.RULES, S.combined(S.RULES))
    text = b"ab12" * (1 << 20) + b"\xc3\xa9 token=" + b"0f" * (1 << 20) + b" x"
    tracemalloc.start()
    spans = find([b"nothing", text, b"AKIA" + b"Z" * 30])
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    n = 4 << 20
    assert spans[1] == [("hex", 0, n), ("assign", n + 2, n + 8 + (2 << 20)), ("hex", n + 8, n + 8 + (2 << 20))] and spans[0] == [] and len(spans[2]) == 1
    assert most < 40 * len(text)
