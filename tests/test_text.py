"""Text functions and formats on hand-made rows."""

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import evaluate as E
from tessera.operators import formats as O
from tessera.operators import tokens as K


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_tweet_cleaning(spark):
    raw = "RT @a: RT @b: itâ€™s &amp; #fun\u0007 see https://x.y/z?q=1 nowÂ ok"
    assert one(spark, raw, T.clean_tweet) == "it's & fun see now ok"
    assert one(spark, "", T.clean_tweet) == ""


def test_labels(spark):
    assert one(spark, " Not-Humanitarian! 2 ", T.label_strict) == "not_humanitarian"
    assert one(spark, " A-b c ", T.label_light) == "a_b_c"
    assert one(spark, "Don't  stop_it!", T.label_words) == "dont stop_it"
    assert one(spark, "Don't stop", T.label_spaced) == "don t stop"


def test_vqa_answers(spark):
    for raw, want in (("The 1,000 Apples.", "1000 apple"), ("two women", "2 woman"), ("an dishes?", "dish"), ("3.5", "3 5"), ("Is it a bus", "is it bus")):
        assert one(spark, raw, T.vqa_answer) == want


def test_answers(spark):
    options = {"A": "no damage", "B": "severe damage"}
    names = {k: v.replace(" ", "_") for k, v in options.items()}
    for raw, want in (("(B) severe damage", "severe_damage"), ("b", "severe_damage"), ("(A) odd", "no_damage"), ("No damage", "no_damage"), ("nothing", None)):
        assert one(spark, raw, lambda c: E.strict_label(c, names)) == want
    for raw, want in (("The answer is B", "B"), ("A) yes", "A"), ("maybe option (b)", "B"), ("it is severe damage", "B"), ("none", None)):
        assert one(spark, raw, lambda c: E.answer_letter(c, options)) == want
    for raw, want in (("No damage.", "no damage"), ("I see severe damage here", "severe damage"), ("severe", "severe damage"), ("?", E.UNKNOWN)):
        assert one(spark, raw, lambda c: E.canonical_label(c, options)) == want


def test_letters_and_labels_are_inverse(spark):
    options = ["yes", "no", "not sure"]
    rows = spark.createDataFrame([(o,) for o in options], "x string")
    letters = rows.select("x", O.labels_to_letters(F.col("x"), options).alias("l"))
    assert [r["l"] for r in letters.collect()] == ["A", "B", "C"]
    back = letters.select("x", O.letters_to_labels(F.col("l"), options).alias("b")).collect()
    assert all(r["b"].endswith(r["x"]) for r in back)


def test_longest_common_subsequence(spark):
    def brute(a, b):
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        return rows[-1][-1]

    cases = [("the cat sat on the mat", "the mat sat on a cat"), ("a b c", ""), ("x y z x y", "y x y z"), ("same words", "same words")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], "id int, a string, b string")
    got = rows.select("id", E.lcs_length(T.rouge_tokens("a"), T.rouge_tokens("b")).alias("n")).orderBy("id").collect()
    assert [r["n"] for r in got] == [brute(a.split(), b.split()) for a, b in cases]


def test_rouge_l_reads_whole_texts(spark):
    import random

    def brute(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            diag = 0
            for j, y in enumerate(b):
                diag, row[j + 1] = row[j + 1], diag + 1 if x == y else max(row[j + 1], row[j])
        return 2 * row[-1] / (len(a) + len(b)) if row[-1] else 0.0

    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(k)) for _ in range(n)) for k, n in ((1, 65), (1, 300), (3, 500), (9, 129), (2, 3))]
    head = " ".join(f"x{i}" for i in range(64))
    cases = [(a, b) for a in texts for b in texts] + [(head + " one", head + " two"), ("p " * 64 + "same end", "q " * 64 + "same end"), ("", "a")]
    rows = [(f"k{i}", a, b) for i, (a, b) in enumerate(cases)] + [("null", None, "a b")]
    got = {r["id"]: r["f"] for r in E.rouge_l(spark.createDataFrame(rows, "id string, a string, b string")).collect()}
    assert got == {i: brute((a or "").split(), b.split()) for i, a, b in rows}


def test_vocabulary_is_ranked_in_parts(spark):
    import re

    words = [f"{h}{i}" for i in range(40) for h in ("a", "ab", "abc", "abcd", "zz")]
    rows = spark.createDataFrame([(" ".join([w] * (5 + i % 4)),) for i, w in enumerate(words)] + [("rare",)], "text string")
    got = K.vocabulary(rows)
    want = sorted(((w, 5 + i % 4) for i, w in enumerate(words)), key=lambda x: (-x[1], x[0]))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == [(w, n, k + 2) for k, (w, n) in enumerate(want)]
    specs = re.findall(r"windowspecdefinition\(([^)]*)", got._jdf.queryExecution().toString())
    assert specs and all("_head#" in x for x in specs if "token#" in x)


def test_multi_turn_without_answer_supervises_the_last_token(spark):
    rows = spark.createDataFrame([([("user", [5, 6])],), ([("user", [5]), ("assistant", [7, 8])],)], "turns array<struct<role:string,ids:array<int>>>")
    ids, labels = K.multi_turn(F.col("turns"), 9)
    got = rows.select(ids.alias("i"), labels.alias("l")).collect()
    assert (got[0]["i"], got[0]["l"]) == ([5, 6, 9], [-100, -100, 9])
    assert (got[1]["i"], got[1]["l"]) == ([5, 9, 7, 8, 9], [-100, -100, 7, 8, 9])


def test_question_is_put_on_one_line(spark):
    got = one(spark, " who\r\n is it ", lambda c: O.first_user(O.qa_conversation(c, F.lit("me"))))
    assert got.split("\n")[2] == "Question: who is it"


def test_segments_are_cleaned_or_skipped(spark):
    rows = ["<image>\nPick.\nRT @a: see #x http://a.b\n\nWhich one?\n(A) y", "<image>\nPick.\nWhich one?\nz", "<image>\nPick.\ntext\nmore", "Pick.\n#a\n#b\nWhich one?", None, "<image>\r\nPick.\r\n#a\r\n#b\r\nWhich one?"]
    df = spark.createDataFrame(list(enumerate(rows)), "id int, p string")
    clean, skipped = T.clean_segment("p", "^Which")
    got = {r["id"]: (r["c"], r["s"]) for r in df.select("id", clean.alias("c"), skipped.alias("s")).collect()}
    assert got == {0: ("<image>\nPick.\nsee x\nWhich one?\n(A) y", 0), 1: (rows[1], 1), 2: (rows[2], 1), 3: (rows[3], 1), 4: ("", 1), 5: ("<image>\nPick.\na b\nWhich one?", 0)}


def test_normal_form_of_an_answer_is_computed_once(spark):
    options = {"A": "answered", "N": "never", "R": "flag"}
    df = spark.createDataFrame([(None,), ("",), ("no idea",), ("(A) flag",), ("it is Never!",), ("ans",), ("fla",), ("zz",)], "raw string")
    for label, want in ((E.canonical_label, ["UNK", "UNK", "UNK", "answered", "never", "answered", "flag", "UNK"]), (E.answer_letter, [None, None, None, "A", "N", None, None, None])):
        out = df.select(label(F.col("raw"), options).alias("x"))
        assert [r["x"] for r in out.collect()] == want
        assert out._jdf.queryExecution().optimizedPlan().toString().count(r"(?U)[^\w\s]") == 1


def test_texts_are_counted_before_a_rollup_expands_them(spark):
    from compare import SMALL

    from tessera.plans import catalog

    plan = catalog.queries()["p07_clean_counts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan.split("Expand", 1)[1]


def test_counts_of_what_cleaning_removes(spark):
    rows = [(0, None), (1, ""), (2, "ÂÂ â€™â€™ ## www.x HTTPS://y"), (3, "â€ ‚Ä Ã &amp"), (4, "RT @u: a‚Ä¶b#Âc â€\u009d"), (5, "&amp;lt; a  b")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", *[c.alias(k) for k, c in T.clean_counts("text").items()], T.clean_tweet("text").alias("clean")).collect()}
    assert got[0][0] is None and got[0][1] is None and got[0][3:] == (None, None, None)
    assert got[1] == (0, 0, 0, 0, 0, "") and got[2] == (1, 2, 0, 2, 4, "''") and got[3] == (0, 0, 0, 0, 0, "â€ ‚Ä Ã &amp")
    assert got[4] == (1, 0, 1, 1, 3, 'a...bc "') and got[5] == (1, 0, 0, 0, 0, "&lt; a b")
    assert {n[: len(s)] for n, _ in T.MOJIBAKE for s in T.MOJIBAKE_STARTS if n.startswith(s)} == set(T.MOJIBAKE_STARTS) and all(n.startswith(T.MOJIBAKE_STARTS) for n, _ in T.MOJIBAKE)
