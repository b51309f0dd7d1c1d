"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a vector of transformed document statistics (logs and
logits of counts and shares).  Class means and covariances are sums over all
labelled rows, added up by Spark; the driver only sees sums of fixed size.
Covariances are shrunk towards the pooled one and its diagonal, and the score
of a row is the logistic of the difference of the two classes' Mahalanobis
log densities, from Cholesky factors that are computed once.
"""

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KeySet, arrow_map, small_batches, text_or_empty, written

#: Byte classes that are counted; a byte above 127 is a letter of its own class.
UPPER, LOWER, DIGIT, SPACE, MARK, SYMBOL, WIDE = range(7)
CLASS_OF = np.full(256, SYMBOL, np.uint8)
for _k, _bytes in ((UPPER, range(65, 91)), (LOWER, range(97, 123)), (DIGIT, range(48, 58)), (SPACE, (9, 10, 11, 12, 13, 32)), (MARK, b".,;:'\"?()-"), (WIDE, range(128, 256))):
    CLASS_OF[list(_bytes)] = _k
FEATURES = (
    "log_bytes", "upper", "digit", "space", "mark", "symbol", "wide", "log_words", "mean_word", "distinct_words",
    "top_word", "same_next", "log_lines", "distinct_lines", "line_bytes", "top_symbol", "loud_words", "symbol_words",
)
SEGMENT = 1 << 20


def _logit(part: float, whole: float) -> float:
    return float(np.log((part + 0.5) / (max(0.0, whole - part) + 0.5)))


def statistics(text: bytes) -> list[float]:
    """FEATURES of one whole text; an empty text has finite values, too.

    Words are counted a segment at a time, so a very long text needs memory
    for its distinct words and lines only.
    """
    by_byte = np.zeros(256, np.int64)
    words: Counter = Counter()
    lines: Counter = Counter()
    last, same, at = None, 0, 0
    while at < len(text):
        end = at + SEGMENT
        while end < len(text) and text[end] != 10 and end < at + 2 * SEGMENT:
            end += 1
        part = text[at:end]
        at = end
        by_byte += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        split = part.split()
        words.update(split)
        if split:
            same += (last == split[0]) + sum(map(bytes.__eq__, split, split[1:]))
            last = split[-1]
        lines.update(map(hash, part.split(b"\n")))
    n = len(text)
    kinds = np.bincount(CLASS_OF, weights=by_byte, minlength=7)
    n_words, n_lines = sum(words.values()), sum(lines.values())
    letters = kinds[UPPER] + kinds[LOWER]
    loud = sum(k for w, k in words.items() if len(w) > 3 and w.isupper())
    marked = sum(k for w, k in words.items() if CLASS_OF[w[-1]] == SYMBOL)
    symbols = np.where(CLASS_OF == SYMBOL, by_byte, 0)
    return [
        float(np.log1p(n)), _logit(kinds[UPPER], letters), _logit(kinds[DIGIT], n), _logit(kinds[SPACE], n), _logit(kinds[MARK], n),
        _logit(kinds[SYMBOL], n), _logit(kinds[WIDE], n), float(np.log1p(n_words)), float(np.log1p((n - kinds[SPACE]) / max(1, n_words))),
        _logit(len(words), n_words), _logit(max(words.values(), default=0), n_words), _logit(same, n_words), float(np.log1p(n_lines)),
        _logit(len(lines), n_lines), float(np.log1p(n / max(1, n_lines))), _logit(float(symbols.max()), n), _logit(loud, n_words), _logit(marked, n_words),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, x`` for every row, ``x`` an array of doubles; null texts are empty."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield {"doc_id": batch.column("doc_id"), "x": [statistics(t or b"") for t in texts]}

        return work

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, x array<double>")


@dataclass
class Model:
    """``means`` and inverse Cholesky factors by class; ``prior`` is the log odds."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    log_dets: list[float]
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        density = [-0.5 * (np.square((x - m) @ f.T).sum(1) + d) for m, f, d in zip(self.means, self.factors, self.log_dets)]
        margin = density[1] - density[0] + self.prior
        return 1 / (1 + np.exp(-np.clip(margin, -700, 700)))


def fit(labelled: DataFrame, shrink: float = 0.05, ridge: float = 0.02) -> Model:
    """Model of ``(x, label)`` rows; all rows count, label 1 is the good class.

    Each task adds up its own count, sum and outer products, Spark adds those
    by cell, and the driver gets 2 * (1 + d + d*d) numbers.  Where a class has
    no rows the score is the constant 1 or 0; without labels it is 0.5.
    """
    d = len(FEATURES)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            x = np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, d)
            y = np.array(batch.column("label").to_pylist(), np.int64)
            for label in (0, 1):
                own = x[y == label]
                values = np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
                yield {"label": np.full(len(values), label), "cell": np.arange(len(values)), "value": values}

        return work

    cells = arrow_map(labelled.select("x", "label"), make, "label int, cell int, value double")
    sums = np.zeros((2, 1 + d + d * d))
    for r in cells.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        sums[r.label, r.cell] = r.value
    counts = sums[:, 0]
    if not counts.all():
        return Model([], [], [], 0.0 if not counts.any() else (700.0 if counts[1] else -700.0))
    means = [s[1 : 1 + d] / s[0] for s in sums]
    scatter = [s[1 + d :].reshape(d, d) - s[0] * np.outer(m, m) for s, m in zip(sums, means)]
    pooled = sum(scatter) / counts.sum()
    factors, log_dets = [], []
    for n, s in zip(counts, scatter):
        cov = (1 - shrink) * s / n + shrink * pooled
        cov += ridge * np.diag(np.diag(pooled) + 1e-3)
        lower = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(lower))
        log_dets.append(float(2 * np.log(np.diag(lower)).sum()))
    return Model(means, factors, log_dets, float(np.log(counts[1] / counts[0])))


def score(vectors: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` to ``(doc_id, x)`` rows and drops ``x``."""
    d = len(FEATURES)

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            yield {"doc_id": batch.column("doc_id"), "score": model.score(np.array(batch.column("x").to_pylist(), np.float64).reshape(-1, d))}

        return work

    return arrow_map(vectors, make, "doc_id long, score double")


def held_out(id_col: str = "doc_id"):
    return F.expr(f"pmod(crc32(cast({id_col} as string)), 3) = 1")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Labels come only from rows whose ``crc32(id) mod 3`` is not 1; null ids and
    labels other than 0 and 1 are left out of the fit.  A document with several
    labels counts once for each.
    """
    vectors = written(features(docs, id_col, text_col), "features")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out("doc_id"))
    model = fit(vectors.join(known, "doc_id"))
    out = score(vectors, model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", least: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that the classifier does not reject, with all their columns.

    Texts are never shuffled: a Bloom filter finds the rows that may have labels,
    their features meet the labels, and each row is scored where it is read.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out("doc_id"))
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    wanted = KeySet(known.select("doc_id").distinct(), "doc_id", "labelled").maybe(given)
    model = fit(written(features(wanted), "features").join(known, "doc_id"))

    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics((t or "").encode()) for t in texts], np.float64).reshape(-1, len(FEATURES))))

    return docs.filter(scored(F.col(text_col)) >= least)
