"""License scan: TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory.

Every word of a whole text is read.  Where runs of a template's words (three in
a row) follow each other closely, inside a line or over many lines, the passage
from the first to the last is a candidate; its sparse vector over the templates'
words, weighted by inverse document frequency over all documents, is compared
with the template's.  A document takes the best candidate's license.  A
directory takes that of its best licence file (a document with a file template,
or one that is mostly notice), and a document without a license of its own
inherits from its nearest ancestor directory that has one; directories and
their ancestors meet in equi-joins.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, join_unique, text_or_empty, written

#: Notices and headers by SPDX identifier.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-2.1": ["This library is free software under the GNU Lesser General Public License, version 2.1."],
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted.", "Licensed under the BSD 3-Clause License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal Public Domain Dedication."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "Confidential and proprietary."],
}
_PERMISSIVE = "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: Licence files, whole where they are short, else how they begin.
FILES = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause": f"{_BSD} {_AS_IS} {_PERMISSIVE}",
    "BSD-3-Clause": f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_AS_IS} {_PERMISSIVE}",
    "Apache-2.0": 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.',
    "GPL-3.0": f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}",
    "GPL-2.0": f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}",
    "LGPL-3.0": f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}",
    "LGPL-2.1": f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}",
    "AGPL-3.0": f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}",
    "MPL-2.0": 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.',
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
BREAK = re.compile(r"[^A-Za-z0-9.]")
NEAR = 0.6  # least cosine of a match
FILE = 0.8  # least cosine to a file template that makes a licence file
COVER = 0.5  # share of a text's words in its license passage that makes one
GRAM = 3  # words in a row that a passage and its template share
GAP = 12  # most words between two such runs of one passage
PIECE = 1 << 20  # characters of a text that are split into words at a time


class Template(NamedTuple):
    """``whole``: its words count only all in a row, as in a tag."""

    license: str
    text: str
    file: bool = False
    whole: bool = False


TEMPLATES = [
    *(Template(k, t) for k, ts in NOTICES.items() for t in ts),
    *(Template(k, t, file=True) for k, t in FILES.items()),
    *(Template(k, f"SPDX-License-Identifier: {k}", whole=True) for k in {**NOTICES, **FILES} if k != "proprietary"),
]


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _pieces(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE)
        end = cut.end() if cut else len(text)
        yield words(text[at:end])
        at = end


class Finder:
    """Candidate passages of texts, by template."""

    def __init__(self, templates: list[Template]):
        self.known = {w for t in templates for w in words(t.text)}
        self.by_first: dict[str, dict[tuple, list[int]]] = {}
        for j, template in enumerate(templates):
            own = words(template.text)
            n = len(own) if template.whole else min(GRAM, len(own))
            for gram in {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} - {()}:
                self.by_first.setdefault(gram[0], {}).setdefault(gram, []).append(j)
        self.sizes = {w: sorted({len(g) for g in grams}) for w, grams in self.by_first.items()}
        self.keep = GAP + max((n for sizes in self.sizes.values() for n in sizes), default=GRAM)

    def __call__(self, text: str) -> tuple[set[str], list[tuple[int, int, Counter]], int]:
        """Template words of a text, its passages ``(template, size, counts)`` and
        its number of words.  Words of a piece's end are read again with the next."""
        seen: set[str] = set()
        done: list[tuple[int, int, Counter]] = []
        open_: dict[int, list] = {}  # template: last run's place, end, size, counts
        total, carried, base = 0, [], 0
        for own in _pieces(text):
            total += len(own)
            seen |= self.known.intersection(own)
            own = carried + own
            for i, w in enumerate(own):
                for n in self.sizes.get(w, ()):
                    for j in self.by_first[w].get(tuple(own[i : i + n]), ()):
                        at, end = base + i, base + i + n
                        now = open_.get(j)
                        if now and now[0] >= at:
                            continue  # read with the piece before
                        if now and at - now[0] <= GAP:
                            new = own[max(now[1] - base, 0) : i + n]
                        else:
                            if now:
                                done.append((j, now[2], now[3]))
                            now = open_[j] = [at, at, 0, Counter()]
                            new = own[i : i + n]
                        now[0], now[1] = at, max(now[1], end)
                        now[2] += len(new)
                        now[3].update(new)
            base += max(len(own) - self.keep, 0)
            carried = own[-self.keep :]
        return seen, done + [(j, now[2], now[3]) for j, now in open_.items()], total


def passages(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, path, n_words, passages, terms, n_docs`` of every row: the word counts
    of each candidate (``other``: words beyond the templates).  ``terms`` and ``n_docs``
    count texts by template word; they stand on one row of a slice of rows."""

    def make():
        find = Finder(templates)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            total, found, df = [], [], Counter()
            for text in batch.column("text").to_pylist():
                seen, got, n = find(text)
                df.update(seen)
                total.append(n)
                found.append([{"template": j, "size": size, "other": sum(k for w, k in c.items() if w not in find.known), "terms": sorted(w for w in c if w in find.known), "counts": [c[w] for w in sorted(c) if w in find.known]} for j, size, c in got])
            rest = [[]] * (len(total) - 1)
            yield {"doc_id": batch.column("doc_id"), "path": batch.column("path"), "n_words": total, "passages": found, "terms": [list(df), *rest], "n_docs": [list(df.values()), *rest]}

        return work

    kind = "array<struct<template:int,size:int,other:int,terms:array<string>,counts:array<int>>>"
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("path"), text_or_empty(text_col).alias("text"))
    return arrow_map(given, make, f"doc_id long, path string, n_words long, passages {kind}, terms array<string>, n_docs array<int>")


def cosine(counts: dict[str, int], other: int, template: dict[str, int], idf: dict[str, float]) -> float:
    """Of a passage and a template; words beyond the templates weigh as the rarest."""
    top = max(idf.values(), default=1.0)
    dot = sum(k * template[w] * idf[w] ** 2 for w, k in counts.items() if w in template)
    norm = sum((k * idf[w]) ** 2 for w, k in counts.items()) + other * top**2
    own = sum((k * idf[w]) ** 2 for w, k in template.items())
    return float(dot / np.sqrt(norm * own)) if dot else 0.0


def best_matches(found: DataFrame, templates: list[Template], near: float = NEAR) -> DataFrame:
    """``doc_id, path, own_license, own_score, licence_file`` of ``passages`` rows.

    Ties of the cosine (to nine digits) go to the longer passage, then to the
    template that comes first.  Document frequencies are over all rows; the
    driver sees one count per template word.
    """
    counted = [Counter(words(t.text)) for t in templates]
    n = found.count()
    pairs = found.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("x"))
    df = {r["w"]: r["n"] for r in pairs.groupBy(F.col("x.terms").alias("w")).agg(F.sum("x.n_docs").alias("n")).collect()}
    idf = {w: float(np.log((1 + n) / (1 + df.get(w, 0))) + 1) for c in counted for w in c}

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            out: dict[str, list] = {c: [] for c in ("own_license", "own_score", "licence_file")}
            for total, candidates in zip(batch.column("n_words").to_pylist(), batch.column("passages").to_pylist()):
                scored = []
                for x in candidates:
                    j = x["template"]
                    score = round(cosine(dict(zip(x["terms"], x["counts"])), x["other"], counted[j], idf), 9)
                    scored.append((score, x["size"], -j))
                best, size, j = max(scored, default=(0.0, 0, 0))
                name = templates[-j].license if best >= near else None
                as_file = any(s >= FILE and templates[-i].file and templates[-i].license == name for s, _, i in scored)
                for c, v in zip(out, (name, best, name is not None and (as_file or size >= COVER * total))):
                    out[c].append(v)
            yield {"doc_id": batch.column("doc_id"), "path": batch.column("path")} | out

        return work

    return arrow_map(found, make, "doc_id long, path string, own_license string, own_score double, licence_file boolean")


def ancestors(path: Column) -> Column:
    """Directories above a file path, the nearest first; the root is ``''``."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def licenses(docs: DataFrame, path: Column, templates: list[Template] | None = None, near: float = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, path, own_license, own_score, license, inherited_from`` of every row.

    ``inherited_from`` is the directory a license comes from; null for a text's
    own license or none.  Of a directory's licence files the highest score
    wins, then the smallest id.  A null path is a file in the root.  Null and
    empty texts have no license of their own and may inherit one; repeated rows
    each give a row; very long texts are split into words piece by piece; other
    columns, whatever their names, are not read.  An empty table gives an empty one.
    """
    templates = TEMPLATES if templates is None else templates
    given = docs.select(F.col(id_col), F.col(text_col), F.coalesce(path, F.lit("")).alias("path"))
    rows = written(best_matches(written(passages(given, templates, id_col, text_col), "passages"), templates, near), "matches")
    rows = rows.withColumn("dir", F.element_at(ancestors(F.col("path")), 1))
    rank = F.struct(F.col("own_score"), -F.col("doc_id"))
    held = rows.filter("licence_file").groupBy("dir").agg(F.max_by("own_license", rank).alias("dir_license"))
    dirs = written(rows.groupBy("dir").agg(F.count(F.lit(1)).alias("n_rows")), "dirs")
    above = dirs.select("dir", F.posexplode(F.array_union(F.array("dir"), ancestors(F.col("dir")))).alias("up", "ancestor"))
    met = above.join(held.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.min_by(F.struct("dir_license", "ancestor"), "up").alias("got"))
    named = written(dirs.join(met, "dir", "left").select("dir", "n_rows", "got"), "inherited")
    out = join_unique(rows, named, "dir", rows.count())
    own = F.col("own_license").isNotNull()
    return out.select("doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "got.dir_license").alias("license"), F.when(~own, F.col("got.ancestor")).alias("inherited_from"))
