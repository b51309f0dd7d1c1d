r"""Personal data by weak supervision, with DataFrame and SQL functions only.

Fixed rules find the base spans.  Everything else that might be personal (numbers
that fail a base rule, account numbers, given names before a capitalised word,
addresses written with [at]) is a candidate.  Labelers vote on each span: regular
expressions and check sums, gazetteers, and the words around it.  Votes are counted
by pattern; expectation-maximisation on the counts estimates how reliable each
labeler is and how likely each pattern is personal; and a logistic regression on
votes and shapes is trained on these probabilities.  Candidates that it scores at
one half or more become spans; base spans stay in any case.

A text is read where it lies and never shuffled.  Places of matches come from the
lengths of what stands between them: ``\G(.*?)(?:pattern)`` cuts a text into gaps
and matches in one linear pass.  Patterns are possessive or looked behind, so that
long runs of one kind of character are read once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: Kinds by rank: base ones first, as the contract lists them.
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "account", "name", "handle")
KINDS = BASE + ADDED
CONTEXT = 40  # code points that are looked at before and behind a span

# Gazetteers of the labelers.
GIVEN = (
    "Alice Andrea Anna Anne Antonio Barbara Carlos Carmen Charles Christine Claire Daniel David Elena Elizabeth Emma "
    "François Frank Hans Isabel James Javier Jean Jennifer Jessica John José Juan Julia Karl Klaus Laura Linda Lisa Lucas "
    "Luis Manuel Maria Marie Martin Mary Michael Miguel Monika Nathalie Nicolas Olivia Patricia Paul Pedro Peter Pierre "
    "Richard Robert Sabine Sarah Sofia Stefan Susan Thomas Ursula William"
).split()
FAMILY = (
    "Bernard Brown Davis Dubois Durand Fernández Fischer Garcia García González Hernández Hoffmann Johnson Jones Lefebvre "
    "Leroy López Martin Martínez Meyer Miller Moreau Müller Pérez Petit Rodríguez Sánchez Schmidt Schneider Schulz Smith "
    "Taylor Thomas Wagner Weber Williams Wilson"
).split()
DOMAINS = "com org net edu gov io info biz de fr es it uk us ch at nl be eu ca au br mx jp".split()
SUFFIXES = "png jpg jpeg gif svg js css py txt html pdf zip".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 63 64 65 66 81 82 84 86 90 91".split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB IE IT LU NL NO PL PT SE".split()
PRIVATE_WORDS = (
    "phone tel telefon téléphone teléfono mobile cell call fax contact whatsapp card visa mastercard amex credit ssn social security "
    "iban account konto compte cuenta passport reisepass pasaporte born name nombre nom mr mrs ms dr herr frau monsieur madame señor "
    "email mail correo address"
).split()
OTHER_WORDS = "order invoice isbn issn version page figure fig table chapter id build serial doi line total sum ticket item ref year rows port".split()
UNITS = "% km kg mm cm ms px kb mb gb eur usd years people times".split()

# Java patterns; each finds what the contract's pattern finds, in linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-](?:[\x20().-]*+[0-9])++"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$"
HANDLE = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}){1,8}"
NAMED = (
    r"(?=[A-Z])(?<![\p{L}\p{N}])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
    rf"|(?:{'|'.join(GIVEN)})(?:\x20[A-Z]\.)?\x20\p{{Lu}}\p{{Ll}}{{1,30}}+)(?![\p{{L}}\p{{N}}])"
)


def _quoted(pattern: str) -> str:
    """A SQL literal of a pattern."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words: list[str]) -> str:
    return _quoted(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(words)})(?![\p{{L}}\p{{N}}])")


def _let(name: str, value: str, body: str) -> str:
    """SQL ``body`` with ``name`` for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(lengths: str) -> str:
    """Running sums of an array of ints with one entry at least, in blocks, so that the
    cost stays near its size."""
    part = f"transform(sequence(0, (size({lengths}) - 1) div 256), b -> slice({lengths}, b * 256 + 1, 256))"
    before = "aggregate(blocks, array(0), (acc, y) -> concat(acc, array(element_at(acc, -1) + aggregate(y, 0, (p, q) -> p + q))))"
    inner = "flatten(transform(blocks, (y, b) -> transform(y, (z, i) -> firsts[b] + aggregate(slice(y, 1, i + 1), 0, (p, q) -> p + q))))"
    return _let("blocks", part, _let("firsts", before, inner))


def _matches(pattern: str, guard: str = "true") -> str:
    """SQL of all leftmost, non-overlapping matches of ``pattern`` in ``text``, an array of
    ``start, end, text, before, after`` (code points)."""
    gaps = f"regexp_extract_all(s.text, {_quoted(rf'\G((?s:.)*?)(?:{pattern})')}, 1)"
    lengths = "zip_with(t.gaps, t.found, (a, b) -> length(a) + length(b))"
    # Contexts reach over two neighbours.
    before = f"concat_ws('', {', '.join(f'right(get(v.gaps, i - {k}), {CONTEXT}), get(v.found, i - {k})' for k in (2, 1))}, right(v.gaps[i], {CONTEXT}))"
    after = f"concat_ws('', {', '.join(f'left(get(v.gaps, i + {k}), {CONTEXT}), get(v.found, i + {k})' for k in (1, 2))}, if(i + 2 < size(v.gaps), '', substring(v.text, v.ends[size(v.ends) - 1] + 1, {CONTEXT})))"
    span = f"named_struct('start', v.ends[i] - length(x), 'end', v.ends[i], 'text', x, 'before', right({before}, {CONTEXT}), 'after', left({after}, {CONTEXT}))"
    spans = _let("v", f"named_struct('text', t.text, 'found', t.found, 'gaps', t.gaps, 'ends', {_let('lengths', lengths, _running('lengths'))})", f"transform(v.found, (x, i) -> {span})")
    none = "cast(array() as array<struct<start:int,end:int,text:string,before:string,after:string>>)"
    some = _let("t", f"named_struct('text', s.text, 'found', s.found, 'gaps', {gaps})", spans)
    found = f"if({guard}, regexp_extract_all(text, {_quoted(pattern)}, 0), cast(array() as array<string>))"
    return _let("s", f"named_struct('text', text, 'found', {found})", f"if(size(s.found) = 0, {none}, {some})")


def _digits(text: str) -> str:
    return f"regexp_replace({text}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Whether a string of 12 to 19 digits passes Luhn's check."""
    one = "cast(substring(d, length(d) - i + 1, 1) as int)"
    total = f"aggregate(sequence(1, length(d)), 0, (a, i) -> a + {one} * (2 - i % 2) - if(i % 2 = 0 and {one} > 4, 9, 0))"
    return _let("d", digits, f"length(d) between 12 and 19 and {total} % 10 = 0")


def _mod97(account: str) -> str:
    """Whether the check digits of an account number are right."""
    turned = f"concat(substring(replace({account}, ' ', ''), 5), left({account}, 4))"
    c = "substring(d, i, 1)"
    rest = f"aggregate(sequence(1, length(d)), 0, (a, i) -> if({c} >= 'A', (a * 100 + ascii({c}) - 55) % 97, (a * 10 + ascii({c}) - 48) % 97))"
    return _let("d", turned, f"{rest} = 1")


def _vote(yes: str, no: str = "false") -> str:
    return f"case when {yes} then 1 when {no} then -1 else 0 end"


def _labelers() -> list[str]:
    """SQL of the votes (1 personal, -1 not, 0 none) on a span ``c``."""
    n = f"length({_digits('c.text')})"
    shape = _quoted(r"^(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}[\x20-][0-9]{3}[\x20-][0-9]{4}|[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}|\+[0-9].*)$")
    date = _quoted(r"^(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}.*|[0-9]{1,2}-[0-9]{1,2}-(?:19|20)[0-9]{2}|[0-9]{1,3}(?:\x20[0-9]{3})+)$")
    number = "c.kind in ('number', 'card', 'phone')"
    suffix = r"regexp_extract(c.text, '([A-Za-z0-9]+)$', 1)"
    known = lambda words: f"array({', '.join(_quoted(w) for w in words)})"
    calling = _quoted(rf"^\+(?:{'|'.join(CALLING)})")
    dull = _quoted(r"^(?:([0-9])\1*|0?123456789?0?[0-9]*)$")
    return [
        _vote(f"c.kind in ('email', 'handle', 'ip') or {number} and c.text rlike {shape} or c.kind = 'account'", f"{number} and c.text rlike {date}"),
        _vote(f"c.kind <> 'phone' and {number} and {_luhn(_digits('c.text'))} or c.kind = 'account' and {_mod97('c.text')}", f"{number} and c.kind <> 'phone' and {n} between 12 and 19 or c.kind = 'account'"),
        _vote(
            f"c.kind in ('email', 'handle') and array_contains({known(DOMAINS)}, lower({suffix})) or c.text rlike {calling} or c.kind = 'account' and array_contains({known(COUNTRIES)}, left(c.text, 2))"
            f" or c.kind = 'name' and array_contains({known(FAMILY)}, substring_index(c.text, ' ', -1)) or c.before rlike {_words(GIVEN)}",
            f"c.kind in ('email', 'handle') and array_contains({known(SUFFIXES)}, lower({suffix})) or c.kind = 'account'",
        ),
        _vote(f"c.before rlike {_words(PRIVATE_WORDS)}", f"c.before rlike {_words(OTHER_WORDS)}"),
        _vote(rf"c.before rlike {_quoted(r'(?U)\w{2,}\x20?[:=]\s*$')} or c.after rlike {_quoted(r'^.{0,20}@[A-Za-z0-9]')}", rf"c.after rlike {_quoted(rf'(?iu)^\x20?(?:{"|".join(UNITS)})(?![\p{{L}}])')} or c.before rlike {_quoted(r'[#$€£§]\s*$')}"),
        _vote("false", f"{number} and {_digits('c.text')} rlike {dull}"),
    ]


N_VOTES = 6


def _features() -> str:
    """SQL of the classifier's whole numbers: 1, family of kinds, votes, shape of the span."""
    family = [f"cast(c.kind in ({kinds}) as int)" for kinds in ("'email', 'handle'", "'ip'", "'account'", "'name'")]
    n = f"length({_digits('c.text')})"
    shape = [f"cast({x} as int)" for x in (f"{n} between 1 and 8", f"{n} between 9 and 11", f"{n} > 16", r"c.text rlike '[\\x20.-]'", "length(c.text) > 20", r"c.before rlike '[\\(\\[<]$'")]
    return f"array({', '.join(['1', *family, *_labelers(), *shape])})"


#: Index of the first vote among the features.
FIRST_VOTE = 5


_NAMED = "if(c.text rlike '^[A-Z]{2}[0-9]{2}', 'account', 'name')"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: base spans and candidates of every row, an array of ``start, rank,
    end, kind, base, x`` by start, then kind; ``x`` are the classifier's features."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    digits = "text rlike '[0-9]'"
    rows = given.select(
        "doc_id",
        F.expr(_matches(EMAIL, "contains(text, '@')")).alias("email"),
        F.expr(_matches(IP, digits)).alias("ip"),
        F.expr(_matches(CARD, digits)).alias("card"),
        F.expr(_matches(PHONE, "contains(text, '+')")).alias("phone"),
        F.expr(_matches(NAMED)).alias("named"),
        F.expr(_matches(HANDLE, "text rlike '[\\\\[(]at[\\\\])]'")).alias("handle"),
    )
    holds = {"email": "true", "ip": f"c.text rlike {_quoted(OCTETS)}", "card": _luhn(_digits("c.text")), "phone": f"length({_digits('c.text')}) between 9 and 15"}
    # A number that fails is a candidate where it stands alone and is no part of an address or a phone number.
    alone = rf"not c.before rlike {_quoted(r'[A-Za-z0-9._%+@/-]$|\+(?:[0-9][\x20().0-9-]*)?$')} and not c.after rlike {_quoted(r'^(?:[A-Za-z0-9@_/]|[.:-][0-9])')}"
    failed = f"c.kind in ('card', 'phone') and length({_digits('c.text')}) between 7 and 19 and {alone}"

    def told(kind: str, base: str) -> str:
        return f"named_struct('start', c.start, 'end', c.end, 'text', c.text, 'before', c.before, 'after', c.after, 'kind', {kind}, 'base', {base})"

    parts = [f"transform({k}, c -> {told(repr(k), f'coalesce({holds[k]}, false)')})" for k in BASE]
    parts += [f"transform(named, c -> {told(_NAMED, 'false')})", f"transform(handle, c -> {told(repr('handle'), 'false')})"]
    every = rows.select("doc_id", F.expr(f"concat({', '.join(parts)})").alias("spans"))
    usable = f"filter(spans, c -> c.base or c.kind in ('account', 'name', 'handle') or {failed})"
    kind = "if(c.base or c.kind in ('account', 'name', 'handle'), c.kind, 'number')"
    own = every.select("doc_id", F.expr(f"transform({usable}, c -> {told(kind, 'c.base')})").alias("spans"))
    rank = f"array_position(array({', '.join(map(repr, KINDS))}), c.kind)"
    return own.select("doc_id", F.expr(f"array_sort(transform(spans, c -> named_struct('start', c.start, 'rank', cast({rank} as int), 'end', c.end, 'kind', c.kind, 'base', c.base, 'x', {_features()})))").alias("spans"))


def estimated(patterns: DataFrame, rounds: int = 25, strength: float = 4.0) -> DataFrame:
    """``patterns`` (features ``x``, ``base``, count ``n``) with ``p``, how likely they are personal,
    by expectation-maximisation.  Base spans are held at 1, and priors say that labelers are
    rather right than wrong, so the classes cannot change places.  The share of the classes
    is that of the candidates."""
    votes = [(j, v) for j in range(N_VOTES) for v in (-1, 0, 1)]
    prior = {1: {1: 0.5, 0: 0.4, -1: 0.1}, 0: {1: 0.1, 0: 0.4, -1: 0.5}}
    rate = {y: {(j, v): prior[y][v] for j, v in votes} for y in (0, 1)}
    share = 0.3

    def posterior():
        odds = F.lit(float(np.log(share / (1 - share))))
        for j in range(N_VOTES):
            seen = F.col("x")[FIRST_VOTE + j]
            gain = {v: float(np.log(rate[1][j, v] / rate[0][j, v])) for v in (-1, 0, 1)}
            odds = odds + F.when(seen == 1, gain[1]).when(seen == -1, gain[-1]).otherwise(gain[0])
        return F.when(F.col("base"), 1.0).otherwise(1 / (1 + F.exp(-odds)))

    for _ in range(rounds):
        held = patterns.select("x", "base", "n", posterior().alias("p"))
        sums = [F.sum(F.when(F.col("x")[FIRST_VOTE + j] == v, F.col("n") * F.col("p"))).alias(f"s{i}") for i, (j, v) in enumerate(votes)]
        alls = [F.sum(F.when(F.col("x")[FIRST_VOTE + j] == v, F.col("n"))).alias(f"a{i}") for i, (j, v) in enumerate(votes)]
        open_ = F.when(~F.col("base"), F.col("n"))
        r = held.agg(F.sum(F.col("n") * F.col("p")).alias("s"), F.sum("n").alias("a"), F.sum(open_ * F.col("p")).alias("os"), F.sum(open_).alias("oa"), *sums, *alls).first()
        s, a = float(r.s or 0), float(r.a or 0)
        last, share = share, (float(r.os or 0) + 0.3 * strength) / (float(r.oa or 0) + strength)
        for i, (j, v) in enumerate(votes):
            yes, both = float(r[f"s{i}"] or 0), float(r[f"a{i}"] or 0)
            rate[1][j, v] = (yes + strength * prior[1][v]) / (s + strength)
            rate[0][j, v] = (both - yes + strength * prior[0][v]) / (a - s + strength)
        if abs(share - last) < 1e-6:
            break
    return patterns.select("x", "base", "n", posterior().alias("p"))


def trained(rows: DataFrame, size: int, rounds: int = 8, ridge: float = 1.0) -> list[float]:
    """Weights of a logistic regression on ``x, n, p`` rows by Newton steps; Spark adds up
    the gradient and the curvature by cell."""
    weights = np.zeros(size)
    for _ in range(rounds):
        w = F.array(*[F.lit(float(v)) for v in weights])
        z = F.expr("aggregate(zip_with(x, w, (a, b) -> a * b), 0D, (a, b) -> a + b)")
        now = rows.withColumn("w", w).withColumn("q", 1 / (1 + F.exp(-z)))
        slope, bend = "transform(x, a -> a * n * (p - q))", "flatten(transform(x, a -> transform(x, b -> a * b * n * q * (1 - q))))"
        cells = now.select(F.posexplode(F.expr(f"concat({slope}, {bend})")).alias("cell", "value"))
        sums = np.zeros(size + size * size)
        for r in cells.groupBy("cell").agg(F.sum("value").alias("value")).collect():
            sums[r.cell] = r.value
        curve = sums[size:].reshape(size, size)
        step = np.linalg.solve(curve + ridge * np.eye(size), sums[:size] - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    return [float(w) for w in weights]


def find(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``: spans are an array of ``kind, start, end``
    (code points, end exclusive), ``base`` and ``score``, by start, then kind.

    Base spans of a kind do not overlap; an added span may overlap one of another kind.
    Null and empty texts have no spans; repeated rows, repeated and null ids give a row
    each; whole texts of any length are read; other columns, whatever their names, are not.
    Without any candidate nothing is trained; an empty table gives an empty one.  What the
    driver sees is sums over votes and features; patterns of votes are counted before they
    are shuffled, and there are at most some thousand.
    """
    spans = written(candidates(docs, id_col, text_col), "spans")
    patterns = written(spans.select(F.explode("spans").alias("c")).groupBy(F.col("c.x").alias("x"), F.col("c.base").alias("base")).agg(F.count(F.lit(1)).alias("n")), "patterns")
    first = patterns.select(F.size("x").alias("k")).first()
    weights = trained(written(estimated(patterns), "estimated"), first.k) if first else []
    z = f"aggregate(zip_with(c.x, array({', '.join(repr(w) + 'D' for w in weights)}), (a, b) -> a * b), 0D, (a, b) -> a + b)" if weights else "0D"
    scored = f"transform(spans, c -> named_struct('kind', c.kind, 'start', c.start, 'end', c.end, 'base', c.base, 'score', 1 / (1 + exp(-({z})))))"
    return spans.select("doc_id", F.expr(f"filter({scored}, c -> c.base or c.score >= {least!r})").alias("spans"))
