"""Text scalar functions as Column expressions; none runs Python per row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use(c)`` with ``c`` computed once a row, however often ``use`` names it."""
    return F.transform(F.array(c), use)[0]


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def label_strict(c: Column | str) -> Column:
    """Trim, lower, ``-`` and blank to ``_``, only ``a-z_``, runs of ``_`` squeezed and stripped."""
    x = F.translate(F.lower(F.trim(_col(c))), "- ", "__")
    x = F.regexp_replace(F.regexp_replace(x, r"[^a-z_]", ""), r"_+", "_")
    return F.regexp_replace(x, r"^_+|_+$", "")


def label_light(c: Column | str) -> Column:
    return F.translate(F.lower(F.trim(_col(c))), "- ", "__")


def label_words(c: Column | str) -> Column:
    """Lower, no punctuation (``_`` stays), blanks squeezed."""
    return squeeze(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\s]", ""))


def plain_words(text: str) -> str:
    """``label_words`` of a constant."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", text.lower())).strip()


def label_spaced(c: Column | str) -> Column:
    """As ``label_words``, but punctuation becomes a blank."""
    return squeeze(F.regexp_replace(F.lower(_col(c)), r"(?U)[^\w\s]", " "))


#: Entities that are unescaped, in this order.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
#: Wrongly decoded sequences and what they stand for, in this order.
MOJIBAKE = (
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€“", "-"),
    ("â€”", "-"),
    ("â€¦", "..."),
    ("‚Ä¶", "..."),
    ("‚Äù", '"'),
    ("‚Äú", '"'),
    ("‚Äô", "'"),
    ("Â", ""),
)
#: How they begin, and by which most texts are seen to hold none.
MOJIBAKE_STARTS = ("â€", "‚Ä", "Â")
URL = r"(?i)(?:https?://|www\.)\S+"
RETWEET = r"(?i)^\s*(?:RT\s+@[A-Za-z0-9_]{1,20}:?\s*)+"


def _any(c: Column, parts: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | c.contains(part)
    return hit


def unescaped(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def repaired(c: Column) -> Column:
    for a, b in MOJIBAKE:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def occurrences(c: Column, text: str) -> Column:
    """How often a constant that cannot overlap itself occurs, by the bytes that go without it."""
    return ((F.octet_length(c) - F.octet_length(F.replace(c, F.lit(text), F.lit("")))) / len(text.encode())).cast("int")


def clean_tweet(c: Column | str) -> Column:
    """Entities, mojibake, extended Greek, control characters, URLs, repeated
    retweet prefixes and ``#`` in this order; blanks squeezed."""
    x = once(_col(c), lambda x: F.when(x.contains("&"), unescaped(x)).otherwise(x))
    x = once(x, lambda x: F.when(_any(x, MOJIBAKE_STARTS), repaired(x)).otherwise(x))
    x = F.regexp_replace(x, r"[\x{1F00}-\x{1FFF}]", "")
    x = F.regexp_replace(x, r"[\x00-\x08\x0b-\x1f\x7f-\x9f]+", " ")
    x = F.regexp_replace(x, URL, "")
    x = F.regexp_replace(x, RETWEET, "")
    return squeeze(F.replace(x, F.lit("#"), F.lit("")))


def clean_counts(c: Column | str) -> dict[str, Column]:
    """What cleaning would remove, as integer columns."""
    x = _col(c)
    fixes = F.when(~_any(x, MOJIBAKE_STARTS), 0).otherwise(sum((occurrences(x, a) for a, _ in MOJIBAKE), F.lit(0)))
    return {
        "changed": (clean_tweet(x) != x).cast("int"), "urls": F.regexp_count(x, F.lit(URL)), "retweets": F.when(x.rlike(RETWEET), 1).otherwise(0),
        "hashes": occurrences(x, "#"), "mojibake": fixes,
    }


def clean_segment(prompt: Column | str, question: str) -> tuple[Column, Column]:
    """``(prompt, skipped)``: a prompt whose first line is ``<image>`` with the text
    between its second line and the question cleaned as a tweet.  ``question`` is the
    pattern of the question's line; a prompt without it, without text before it or of
    another form stays as it is and is marked as skipped."""
    x = F.coalesce(_col(prompt), F.lit(""))
    lines = F.split(x, r"\r\n|\r|\n")
    at = F.array_position(F.transform(F.slice(lines, 3, F.size(lines)), lambda line: F.trim(line).rlike(question)), True).cast("int")
    fits = (F.size(lines) >= 4) & (F.trim(lines[0]) == "<image>") & (at > 1)
    segment = clean_tweet(F.array_join(F.slice(lines, 3, F.greatest(at - 1, F.lit(0))), "\n"))
    whole = F.array_join(F.concat(F.slice(lines, 1, 2), F.array(segment), F.slice(lines, at + 2, F.size(lines))), "\n")
    return F.when(fits, whole).otherwise(x), (~fits).cast("int")


def prompt_text(prompt: Column | str, instruction: str, question: str) -> Column:
    """The lines between the instruction and the question of a prompt."""
    lines = F.filter(F.transform(F.split(_col(prompt), "\n"), lambda x: F.trim(x)), lambda x: x != "<image>")
    start, end = F.array_position(lines, F.lit(instruction)), F.array_position(lines, F.lit(question))
    inner = F.when((end > start), F.slice(lines, (start + 1).cast("int"), (end - start - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.filter(inner, lambda x: x != ""), "\n")


def strip_placeholders(c: Column | str) -> Column:
    """Without ``<image>`` and ``<image_N>``; three or more line ends become two."""
    x = F.regexp_replace(_col(c), r"(?i)<image(?:_\d+)?>", "")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def option_table(c: Column | str) -> Column:
    """Map letter -> name of the lines ``(X) name``."""
    lines = F.filter(F.split(_col(c), "\n"), lambda x: x.rlike(r"^\s*\([A-Z]\)\s*\S"))
    entry = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"\(([A-Z])\)", 1).alias("key"), F.trim(F.regexp_extract(x, r"\([A-Z]\)\s*(.*)$", 1)).alias("value")))
    return F.map_from_entries(entry)


#: Instructions on the form of an answer that are taken out.
ANSWER_FORMS = (
    r"(?i)Answer with the option's letter from the given choices directly and only give the best option\.?",
    r"(?i)Respond with ONLY one uppercase option letter from\s*\{?[A-Z,\s]+\}?\.",
    r"用单个字母回答这句话[。.!！?？]?",
    r"请只用单个字母回答[。.!！?？]?",
)
#: Fixed value: the cue that an answer follows.
ANSWER_CUE = r"(?i)\n?(?:the best answer is:|the answer is:|answer:)\s*$"


def without_answer_forms(c: Column | str) -> Column:
    x = _col(c)
    for form in ANSWER_FORMS:
        x = F.regexp_replace(x, form, "")
    return F.trim(F.regexp_replace(x, r"\n{2,}", "\n"))


def letter_constraint(prompt: Column | str, letters: Column) -> Column:
    """Without a trailing answer cue, and with the letters it may use."""
    x = F.regexp_replace(F.regexp_replace(_col(prompt), ANSWER_CUE, ""), r"\s+$", "")
    tail = "}.\nDo not output the option text, explanation, or punctuation.\nAnswer:"
    return F.concat(x, F.lit("\n\nRespond with ONLY one uppercase option letter from {"), F.array_join(F.array_sort(letters), ", "), F.lit(tail))


def joined_path(*parts: Column) -> Column:
    """Parts with ``/`` between, backslashes turned, doubled slashes squeezed."""
    return F.regexp_replace(F.translate(F.concat_ws("/", *parts), "\\", "/"), "/{2,}", "/")


def rerooted(path: Column | str, marker: str, root: str) -> Column:
    """What follows ``marker/`` in a path, under ``root``; other paths stay."""
    x = F.translate(_col(path), "\\", "/")
    return F.when(x.contains(marker + "/"), F.concat(F.lit(root.rstrip("/") + "/"), F.substring_index(x, marker + "/", -1))).otherwise(x)


def numbered_image(subtype: Column | str, image_id: Column | str) -> Column:
    return F.concat(F.lit("COCO_"), _col(subtype), F.lit("_"), F.lpad(_col(image_id).cast("string"), 12, "0"), F.lit(".jpg"))


#: Contractions written without their apostrophe.
CONTRACTIONS = (
    ("aint", "ain't"),
    ("arent", "aren't"),
    ("cant", "can't"),
    ("couldve", "could've"),
    ("couldnt", "couldn't"),
    ("didnt", "didn't"),
    ("doesnt", "doesn't"),
    ("dont", "don't"),
    ("hadnt", "hadn't"),
    ("hasnt", "hasn't"),
    ("havent", "haven't"),
    ("hes", "he's"),
    ("im", "i'm"),
    ("isnt", "isn't"),
    ("itll", "it'll"),
    ("its", "it's"),
    ("ive", "i've"),
    ("lets", "let's"),
    ("mightnt", "mightn't"),
    ("mustnt", "mustn't"),
    ("shes", "she's"),
    ("shouldnt", "shouldn't"),
    ("thats", "that's"),
    ("theres", "there's"),
    ("theyre", "they're"),
    ("wasnt", "wasn't"),
    ("werent", "weren't"),
    ("whats", "what's"),
    ("wheres", "where's"),
    ("whos", "who's"),
    ("wont", "won't"),
    ("wouldnt", "wouldn't"),
    ("youre", "you're"),
)
#: Number words.
NUMBERS = (("none", "0"), ("zero", "0"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"), ("ten", "10"))
#: Plurals without a rule.
IRREGULAR = (("men", "man"), ("women", "woman"), ("children", "child"), ("people", "person"), ("mice", "mouse"), ("geese", "goose"), ("teeth", "tooth"), ("feet", "foot"))


def _mapped(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def singular(w: Column) -> Column:
    """One word: irregular plurals, then -ies, -ses, -(x|z|ch|sh)es, -s; words of
    up to three letters and numbers stay."""
    rule = (
        F.when(w.rlike("^[0-9]+$") | (F.length(w) <= 3), w)
        .when((F.length(w) > 4) & w.endswith("ies"), F.regexp_replace(w, "ies$", "y"))
        .when((F.length(w) > 4) & w.endswith("ses") | w.rlike("(x|z|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
        .when(w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )
    return F.coalesce(F.try_element_at(_mapped(IRREGULAR), w), rule)


def vqa_answer(c: Column | str) -> Column:
    """Normal form of a short answer: marks become blanks, then each word goes
    through contractions, number words, articles and plurals."""
    x = F.translate(F.lower(F.trim(_col(c))), "’`", "''")
    x = F.regexp_replace(x, r"(?<=\d),(?=\d)", "")
    x = F.regexp_replace(x, r"(?U)[^\w\s']", " ")
    words = F.filter(F.split(squeeze(x), " "), lambda w: w != "")
    fixed = F.transform(words, lambda w: F.coalesce(F.try_element_at(_mapped(CONTRACTIONS), w), F.try_element_at(_mapped(NUMBERS), w), w))
    kept = F.filter(fixed, lambda w: ~w.isin("a", "an", "the"))
    return F.array_join(F.transform(kept, singular), " ")


def basic_tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and apostrophes, and single marks."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"(?U)([\w']+|[.,!?;:()])"), 1)


def rouge_tokens(c: Column | str) -> Column:
    return F.filter(F.split(F.lower(_col(c)), "[^a-z0-9]+"), lambda x: x != "")
