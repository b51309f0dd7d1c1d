"""Repeats, packing, SentencePiece and quality against brute force."""

import hashlib
import itertools
import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, quality, repeats, sentencepiece_nbest
from texts import prose

BPE = public_tokenizers.path("byte_bpe_50k.json")
SPM = public_tokenizers.path("piece_bpe_32k.model")


def brute_repeats(texts, length, passage=51):
    data = [(t or "").encode() for t in texts]
    seen, holders = {}, {}
    for n, b in enumerate(data):
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = seen.get(b[i : i + length], 0) + 1
        words = b.split()
        for i in range(len(words) - passage + 1):
            holders.setdefault(tuple(words[i : i + passage]), set()).add(n)
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        words = b.split()
        shared = any(len(holders[tuple(words[i : i + passage])]) > 1 for i in range(len(words) - passage + 1))
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), shared))
    return out


def repeat_texts(length):
    shared = prose(900, 120)
    texts = [prose(1, 300), prose(2, 50) + shared + prose(3, 40), shared + prose(4, 90), prose(1, 300), None, "", "ab" * 700, "z" * 900, prose(5, 100) + "é" * 500, "é" * 450, prose(6, 60) + prose(6, 60), shared[: length + 1], "x" + shared[3 : length + 3]]
    words = prose(7, 250).split()
    for k in range(8):  # near copies that differ in one word
        texts.append(" ".join([*words[: 20 + 25 * k], "changed", *words[21 + 25 * k :]]))
    texts += ["a b " * 30, "a b " * 30 + "c", "a " * 60, prose(8, 51) + "\n" + prose(9, 10), prose(10, 10) + " \t" + prose(8, 51), prose(11, 50), prose(11, 50) + " x", " ".join(f"é{k}" for k in range(51)) * 2]
    return texts


@pytest.mark.parametrize(("length", "segment"), [(60, 1 << 20), (400, 700)])
def test_repeats_are_exact(spark, monkeypatch, length, segment):
    monkeypatch.setattr(repeats, "SEGMENT", segment)
    monkeypatch.setattr(repeats, "ARRAY", 50)
    texts = repeat_texts(length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.repeat_report(docs, length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_rows_that_share_an_id_or_have_none(spark):
    texts = repeat_texts(100)
    rows = [(None if k % 3 == 0 else k % 4, t, "x", 1) for k, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, uid string, digest int")
    want = sorted(((i, *b) for (i, *_), b in zip(rows, brute_repeats([r[1] for r in rows], 100))), key=str)
    assert sorted(map(tuple, repeats.repeat_report(docs, 100).collect()), key=str) == want


def test_repeats_of_odd_tables(spark, odd_docs, no_docs):
    assert repeats.repeat_report(no_docs).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = sorted(((i, *b) for (i, _), b in zip(rows, brute_repeats([t for _, t in rows], 400))), key=str)
    assert sorted(map(tuple, repeats.repeat_report(odd_docs).collect()), key=str) == want
    texts = {r["doc_id"]: r["text"] for r in repeats.without_repeats(odd_docs).collect() if r["doc_id"] is not None}
    assert texts[1] == texts[2] == "" and texts[7] == "one"


def test_every_window_is_in_one_cell_with_its_anchor():
    parser, rng = repeats.Parser(40, 9), np.random.default_rng(3)
    sizes = np.array([500, 39, 40, 200, 0, 90])
    values = parser.value[rng.integers(0, 3, sizes.sum())]
    piece, first, last, _, _ = parser.cells(0, values, sizes)
    got = sorted((p, s) for p, a, b in zip(piece, first, last) for s in range(a, b + 1))
    assert got == [(p, s) for p, n in enumerate(sizes) for s in range(n - 39)]


def test_hashes_tell_apart_what_powers_of_two_do_not():
    word = b"a"
    for _ in range(12):  # two strings that polynomials modulo 2**64 confuse
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    parser = repeats.Parser(len(word), 9)
    values = parser.value[np.frombuffer(word + other, np.uint8)]
    context = repeats.levels(len(word))
    assert context[-1] == len(word)
    _, _, _, k, h = parser.cells(2, values, np.array([len(word), len(word)]))
    assert k[0] == k[1] and h[0] != h[1]


def test_pieces_are_those_of_the_tokenizer(spark):
    texts = ["Hello  world, it's", " lead", "tail ", "a\n\n b\n c", "x\u00a0 y", "don't <|endoftext|> stop", "日本 語", None, "", "é" * 50, "a\x1c b \x85 c", prose(1, 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.best_fit_packing(docs, BPE).collect()
    whole = Tokenizer.from_file(BPE)
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want = [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows if r["doc_id"] == i) == want
    for _, own in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def test_plan_uses_every_piece_once_and_packs_tightly():
    rng = np.random.default_rng(1)
    lengths = np.concatenate([rng.integers(1, 1025, 5000), rng.integers(1, 200, 5000), np.full(300, 1024)])
    counts = np.bincount(lengths, minlength=1025)
    plan = packing.best_two_fit(counts)
    used = np.zeros(1025, np.int64)
    for bin_, times in plan:
        assert sum(bin_) <= 1024 and times > 0
        np.add.at(used, bin_, times)
    assert (used == counts).all()
    assert sum(t for _, t in plan) <= 1.01 * lengths.sum() / 1024 + 1
    assert packing.best_two_fit(np.zeros(1025, np.int64)) == []


def test_the_smallest_is_replaced_by_two_that_fit_better():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 25, 15]] = 1
    assert packing.best_two_fit(counts)[0][0] == [60, 25, 15]


def test_packing_odd_tables(odd_docs, no_docs):
    assert packing.best_fit_packing(no_docs, BPE).count() == 0
    rows = packing.best_fit_packing(odd_docs, BPE).collect()
    assert sum(r["piece"] == 0 for r in rows) == odd_docs.count()


def all_segmentations(model, text):
    """Scores and pieces of every segmentation, straight from the vocabulary."""
    if not text:
        return [(0.0, [])]
    out = []
    for end in range(1, len(text) + 1):
        if text[:end] in model.ids:
            edge = float(model.model.get_score(model.ids[text[:end]]))
        elif end == 1:
            edge = model.unknown
        else:
            continue
        out += [(edge + s, [text[:end], *rest]) for s, rest in all_segmentations(model, text[end:])]
    return out


def ids_of(model, pieces):
    return [i for p in pieces for i in ([model.ids[p]] if p in model.ids else [model.bytes[b] for b in p.encode()])]


@pytest.mark.parametrize("text", ["hello", "worlds", "straße", "日本", "  a", "\x01x", "ab cd", "it is", "to\nbe", "", "x  y", "aaaaaa", "is is", "a日b"])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_nbest_is_that_of_all_segmentations(text, n):
    model = sentencepiece_nbest.Pieces(SPM)
    plain = model.model.Normalize(text)
    every = sorted(all_segmentations(model, plain), key=lambda x: -x[0])
    got = model.encode(text, n)
    assert [s for s, _ in got] == [s for s, _ in every[: len(got)]] and len(got) == min(n, len(every))
    known = {(s, tuple(ids_of(model, p))) for s, p in every}
    found = [(s, tuple(np.frombuffer(p, "<i4").tolist())) for s, p in got]
    assert set(found) <= known and len(set(found)) == len(found)
    assert all(model.decode(np.array(p, int)) == plain for _, p in found)


def test_segments_and_forgetting_change_nothing(monkeypatch):
    texts = [prose(k, 40 + k) for k in range(12)] + ["", "ab" * 300, "日本 語!", "x" * 90]
    plain = [sentencepiece_nbest.Pieces(SPM).model.Normalize(t) for t in texts]
    want = list(sentencepiece_nbest.Pieces(SPM).encoded(plain, 4))
    monkeypatch.setattr(sentencepiece_nbest, "SEGMENT", 64)
    monkeypatch.setattr(sentencepiece_nbest, "CACHED", 10)
    assert list(sentencepiece_nbest.Pieces(SPM).encoded(plain, 4)) == want
    assert all(back for _, back in want)


def test_one_word_of_200_000_letters_in_1_gb():
    code = f"""
import resource, sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.dirname(__file__)))!r})
from tessera.llm import sentencepiece_nbest
model = sentencepiece_nbest.Pieces({SPM!r})
for word in ("a" * 200_000, "lorem" * 40_000):
    (found, back), = model.encoded([model.model.Normalize(word)], 4)
    assert back and len(found) == 4
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout) < 1 << 20


def test_texts_nbest_and_round_trip(spark, odd_docs):
    model = sentencepiece_nbest.Pieces(SPM)
    docs = spark.createDataFrame([(1, "hello wörld\n\tx 日本\u200b"), (2, None), (3, ""), (3, "aaaa"), (3, "aaaa"), (None, "b")], "doc_id long, text string")
    assert all(r["round_trip"] for r in sentencepiece_nbest.summary(docs, SPM).collect())
    best = sentencepiece_nbest.encode(docs, SPM).selectExpr("doc_id", "nbest[0].ids as ids")
    back = sorted(((r["doc_id"], r["text"]) for r in sentencepiece_nbest.decode(best, SPM).collect()), key=str)
    assert back == sorted([(1, model.model.Normalize("hello wörld\n\tx 日本\u200b")), (2, ""), (3, ""), (3, "▁aaaa"), (3, "▁aaaa"), (None, "▁b")], key=str)
    assert sentencepiece_nbest.summary(docs.limit(0), SPM).count() == 0 and sentencepiece_nbest.decode(best.limit(0), SPM).count() == 0
    clashing = odd_docs.withColumn("ids", F.lit(1)).withColumn("score", F.lit("x")).withColumn("nbest", F.lit(0))
    rows = sentencepiece_nbest.summary(clashing, SPM).collect()
    assert len(rows) == odd_docs.count() and all(r["round_trip"] for r in rows)
    twins = [tuple(r) for r in rows if r["doc_id"] == 3]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_quality_learns_and_never_reads_held_out_labels(spark):
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        rows.append((k, prose(k, 60) if good else "BUY!!! " * 40 + "### " * (k % 30)))
        labels.append((k, int(good) if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - int(good)))  # wrong where held out
    docs = spark.createDataFrame([*rows, (1000, None), (1001, "")], "doc_id long, text string")
    known = spark.createDataFrame([*labels, (5, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality.quality(docs, known).collect()}
    assert all(got[k]["predicted"] == int(k % 3 > 0) for k in range(300))
    assert got[1000]["score"] == got[1001]["score"] and 0 <= got[1000]["score"] <= 1
    assert [got[k]["held_out"] for k in range(300)] == [zlib.crc32(str(k).encode()) % 3 == 1 for k in range(300)]
    kept = {r["doc_id"] for r in quality.keep_good(docs, known).select("doc_id").collect()}
    assert kept == {k for k, r in got.items() if r["predicted"]}


def test_quality_of_one_class_and_of_empty_tables(spark, odd_docs, no_docs):
    one = spark.createDataFrame([(k, 1) for k in range(1, 9)], "doc_id long, quality int")
    assert {r["score"] for r in quality.quality(odd_docs, one).collect()} == {1.0}
    assert {r["score"] for r in quality.quality(odd_docs, one.limit(0)).collect()} == {0.5}
    assert quality.quality(no_docs, one).count() == 0 and quality.keep_good(no_docs, one).count() == 0
