"""Whitening of embeddings by principal components from contour integrals.

Spark sums counts, sums and products over all vectors; entries are whole numbers
first, so the covariance is exact before it is rounded to doubles once.  Its
leading eigenvalues are cut into slices at gaps, and for each slice a contour
integral around it is taken by quadrature: a sum of solves with the covariance
shifted by complex numbers projects random vectors onto the slice's eigenspace,
and a Rayleigh-Ritz step extracts the components.  Slices are tasks of their own.
Inertia counts (the signs in a factorisation of the shifted covariance) say how
many eigenvalues a slice holds, so none can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, written

#: Entries are SCALE * c, rounded down, plus OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Most dimensions: the covariance of so many is 32 MB, and what the driver and a task hold.
MAX_DIMS = 2048


# Eigenvalues of a symmetric matrix, on d x d numbers.


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a tridiagonal matrix similar to ``v`` (Householder)."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not x[1:].any():
            continue
        x[0] += np.copysign(size, x[0])
        x /= np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        w = rest @ x
        w -= (x @ w) * x
        rest -= 2 * (np.outer(w, x) + np.outer(x, w))
        a[k + 1, k] = -np.copysign(size, a[k + 1, k])
    return np.diag(a).copy(), np.array([a[k + 1, k] for k in range(d - 1)])


def above(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Inertia counts: how many eigenvalues are larger than each shift, from the signs
    of the pivots of the shifted matrix."""
    tiny = np.finfo(float).tiny * 1e20 + np.finfo(float).eps ** 2 * max(1.0, float(np.abs(diagonal).max(initial=0)))
    pivot = diagonal[0] - shifts
    count = (pivot > 0).astype(int)
    for k in range(1, len(diagonal)):
        pivot = np.where(np.abs(pivot) < tiny, -tiny, pivot)
        pivot = diagonal[k] - shifts - off[k - 1] ** 2 / pivot
        count += pivot > 0
    return count


@dataclass(frozen=True)
class Slice:
    """Eigenvalues between ``low`` and ``high``: those numbered ``first`` to
    ``first + count - 1``, from 0, largest first; ``width`` dimensions (0: a few more
    than ``count``) are enough for its contour."""

    low: float
    high: float
    first: int
    count: int
    width: int = 0


def quadrature(part: Slice, nodes: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Points and factors of a contour integral: Gauss-Legendre nodes on the upper half of
    a circle around the slice; the lower half is its mirror image, so real parts are enough."""
    centre, radius = (part.low + part.high) / 2, (part.high - part.low) / 2
    nodes_at, weights = np.polynomial.legendre.leggauss(nodes)
    turn = np.exp(1j * np.pi / 2 * (nodes_at + 1))
    return centre + radius * turn, weights / 2 * radius * turn


def spare(count: int) -> int:
    """Dimensions that a contour has beside those of ``count`` eigenvalues."""
    return max(6, count // 2)


def width_of(part: Slice, value: np.ndarray, fall: float = 0.1) -> int:
    """Dimensions with which a round at a slice leaves at most ``fall`` of any error, given
    all eigenvalues: what the quadrature passes nearly as well as the slice has to fit in."""
    points, factors = quadrature(part)
    passed = np.abs((factors / (points - value[:, None])).real.sum(axis=1))
    inside = passed[part.first : part.first + part.count]
    outside = np.delete(passed, np.s_[part.first : part.first + part.count])
    return part.count + max(spare(part.count), int((outside > fall * inside.min()).sum()))


def slices_of(diagonal: np.ndarray, off: np.ndarray, most: int, each: int = 8, steps: int = 80) -> list[Slice]:
    """Slices that hold the ``most`` largest eigenvalues, those at zero left out.

    Eigenvalues are bracketed by bisection on inertia counts.  A slice ends at the
    widest gap after ``each / 2`` to 2 * ``each`` of them, earlier where they fall to
    a quarter (a contour tells apart what differs against its radius) or where a contour
    reaching on into a dense part would pass much of what lies beyond; a cluster without
    a gap stays whole, however large.
    """
    d = len(diagonal)
    reach = np.abs(diagonal) + np.concatenate([[0], np.abs(off)]) + np.concatenate([np.abs(off), [0]])
    top = float(reach.max(initial=0)) * (1 + 1e-12)
    zero = top * d * np.finfo(float).eps * 8
    found = int(above(diagonal, off, np.array([zero]))[0]) if top > 0 else 0
    low, high = np.full(found, zero), np.full(found, top)
    for _ in range(steps):
        middle = np.sqrt(low * high)
        more = above(diagonal, off, middle) > np.arange(found)
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    value = np.append(np.sqrt(low * high), zero)
    every = np.concatenate([value[:-1], np.zeros(d - found)])
    gap = 1 - value[1:] / value[:-1] if found else value
    wide = np.flatnonzero(gap > 1e-7) + 1  # where a slice may end

    def between(first: int, end: int) -> Slice:
        # To the middle of the gaps around, but on neither side far beyond the other or the slice.
        spread = value[first] - value[end - 1]
        over = min(0.25, (value[first - 1] / value[first] - 1) / 2 if first else 0.25) * value[first]
        under = min(0.2, gap[end - 1] / 2) * value[end - 1]
        upper = value[first] + min(over, max(spread, under))
        lower = value[end - 1] - min(under, max(spread, over))
        part = Slice(float(lower), float(upper), first, end - first)
        return replace(part, width=width_of(part, every))

    out, first = [], 0
    while first < min(most, found):
        ends = wide[(wide > first) & (wide <= first + 2 * each)]
        near = ends[value[ends - 1] * 4 >= value[first]]
        near = near if len(near) else ends[:1] if len(ends) else wide[wide > first][:1]
        parts = {int(end): between(first, int(end)) for end in near}
        more = {end: p.width - p.count - spare(p.count) for end, p in parts.items()}
        near = np.array([end for end in parts if more[end] == min(more.values())])
        late = near[near >= min(first + each // 2, found)]
        near = late if len(late) else near[-1:]
        part = parts[int(near[np.argmax(gap[near - 1])])]
        end = first + part.count
        over, under = above(diagonal, off, np.array([part.high, part.low]))
        if (over, under) != (first, end):
            raise ArithmeticError(f"inertia counts {over} and {under} do not bound the slice {first} to {end}")
        out.append(part)
        first = end
    return out


def contour(v: np.ndarray, part: Slice, nodes: int = 8, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of ``v`` in a slice.

    Mixtures of what lies above and below the slice can have values inside; of more values
    than the slice has, those that fit worst are no eigenvalues.
    """
    d = len(v)
    points, factors = quadrature(part, nodes)
    width = min(d, part.width or part.count + spare(part.count))
    basis = np.random.default_rng(part.first).standard_normal((d, width))
    size = np.abs(v).sum(axis=1).max()
    worst = np.inf
    for _ in range(rounds):
        summed = np.zeros_like(basis)
        for z, factor in zip(points, factors):
            summed += (factor * np.linalg.solve(z * np.eye(d) - v, basis.astype(complex))).real
        basis, _ = np.linalg.qr(summed)
        value, inner = np.linalg.eigh(basis.T @ v @ basis)
        basis = basis @ inner
        inside = np.flatnonzero((value > part.low) & (value < part.high))[::-1]
        misfit = np.abs(v @ basis[:, inside] - basis[:, inside] * value[inside]).max(axis=0, initial=0)
        best = np.sort(np.argsort(misfit, kind="stable")[: part.count])
        last, worst = worst, np.inf
        if len(best) == part.count:
            worst = misfit[best].max(initial=0)
            if worst <= 4 * np.finfo(float).eps * size or worst >= last / 2 and worst <= 1e-12 * size:
                return value[inside[best]], basis[:, inside[best]]
    raise ArithmeticError(f"the slice {part} has {part.count} eigenvalues by inertia, of which {len(inside)} were found, to {worst:.1e} of {size:.1e}")


# Sums over all vectors.


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, x``: entries as long ``floor(64 c) + 1000000`` of every usable row."""
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_v"))
    return given.filter("_v is not null").filter(finite).select("vec_id", F.transform("_v", lambda c: F.floor(c * SCALE).cast("long") + OFFSET).alias("x"))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _exact_sums(rows: DataFrame, of, bound) -> dict[int, int]:
    """Sums by cell, as whole numbers of any size, of ``of(matrix)`` over all batches; of
    a matrix of longs where ``bound(largest entry, rows)`` fits one, else of Python's."""

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            value = of(x if bound(int(np.abs(x).max(initial=1)), len(x)) < 1 << 62 else x.astype(object)).tolist()
            yield {"cell": np.arange(len(value)), "value": [str(v) for v in value]}

        return work

    cells = arrow_map(rows.select("x"), make, "cell int, value string")
    total = cells.groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    return {r.cell: int(r.value) for r in total.collect()}


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor n) of ``x``: entries less their rounded means are multiplied
    and added up as whole numbers, and the rest of the mean is taken off exactly."""
    d = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)
    total = _exact_sums(rows, lambda x: ((x - centre).T @ (x - centre))[upper], lambda x, k: (2 * x) ** 2 * k)
    out = np.zeros((d, d))
    rest = [s - n * int(c) for s, c in zip(sums, centre)]
    for cell, value in total.items():
        i, j = int(upper[0][cell]), int(upper[1][cell])
        out[i, j] = out[j, i] = float(Fraction(n * value - rest[i] * rest[j], n * n))
    return out


@dataclass
class Whitener:
    """``mean`` as exact fractions of ``sums / n``; columns of ``components`` are unit
    vectors, ``values`` their variances and ``trace`` the variance of all dimensions."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole = np.array([s // self.n for s in self.sums], np.int64)
        part = np.array([s % self.n / self.n for s in self.sums])
        return (x - whole) - part

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))


def leading(spark, v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above zero with their vectors, a task a slice."""
    parts = slices_of(*tridiagonal(v), most)
    if not parts:
        return np.zeros(0), np.zeros((len(v), 0))

    def make():
        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            for r in batch.to_pylist():
                value, vectors = contour(v, Slice(**r))
                yield {"number": np.arange(r["first"], r["first"] + r["count"]), "value": value, "vector": list(vectors.T)}

        return work

    given = spark.createDataFrame([astuple(p) for p in parts], "low double, high double, first int, count int, width int")
    rows = arrow_map(given.repartition(len(parts)), make, "number int, value double, vector array<double>").collect()
    rows.sort(key=lambda r: r.number)
    if [r.number for r in rows] != list(range(sum(p.count for p in parts))):
        raise ArithmeticError("slices do not add up to the inertia count")
    # Slices were solved apart: one more Rayleigh-Ritz step over all of them.
    basis, _ = np.linalg.qr(np.array([r.vector for r in rows]).T)
    value, inner = np.linalg.eigh(basis.T @ v @ basis)
    return value[::-1][:most], (basis @ inner)[:, ::-1][:, :most]


def fit(rows: DataFrame, most: int = 32) -> Whitener:
    """Whitener of all rows ``x`` (equally long arrays of long), of up to ``most``
    components; the driver holds d x d numbers only."""
    size = rows.select(F.size("x").alias("d")).agg(F.max("d").alias("d")).first().d or 0
    if size > MAX_DIMS:
        raise ValueError(f"at most {MAX_DIMS} dimensions, not {size}")
    n = rows.count()
    if not n or not size:
        return Whitener(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    by_cell = _exact_sums(rows, lambda x: x.sum(axis=0), lambda x, k: x * k)
    sums = [by_cell[k] for k in range(size)]
    v = covariance(rows, n, sums)
    values, components = leading(rows.sparkSession, v, most)
    return Whitener(n, sums, values, components, float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitener) -> float:
    """Largest entry of the whitened vectors' covariance less the identity, measured
    over all rows in a pass of its own."""
    k, d = len(model.values), len(model.sums)

    def cells(make_value) -> np.ndarray:
        def make():
            def work(batch: pa.RecordBatch) -> Iterator[dict]:
                value = make_value(model.whiten(_matrix(batch, d)))
                yield {"cell": np.arange(len(value)), "value": value}

            return work

        out = arrow_map(rows.select("x"), make, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        return np.array([r.value for r in sorted(out, key=lambda r: r.cell)]) / model.n

    if not k:
        return 0.0
    mean = cells(lambda z: z.sum(axis=0))
    products = cells(lambda z: ((z - mean).T @ (z - mean)).ravel())
    return float(np.abs(products.reshape(k, k) - np.eye(k)).max())


def whitened(vectors: DataFrame, most: int = 32, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """A row for each usable vector and component, numbered from 1 by falling variance:
    ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped, and
    so are vectors of another length than most have (ties: the longest).  Repeated rows and
    ids count and come out each; a null id stays null; other columns are not read.
    Components without variance (equal vectors, fewer vectors than dimensions) are left out,
    so a table of equal vectors, like an empty one, gives no rows.  Equal variances may come
    in any order, the same for all rows.  Entries have to be below 2**46 in magnitude, and
    a deviation that no long can hold is an error.
    """
    rows = written(whole_numbers(vectors, id_col, vec_col).filter(F.size("x") > 0), "whole")
    usual = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    d = usual[0].d if usual else 0
    rows = rows.filter(F.size("x") == d)
    model = fit(rows, most)
    error = identity_error(rows, model)
    k, n = len(model.values), model.n
    explained = model.values / model.trace if k else model.values

    def make():
        total = np.array(model.sums, np.int64)

        def deviations(x: np.ndarray) -> np.ndarray:
            y = x - total // max(1, n)  # n x - S = n (x - S div n) - S mod n
            bound = n * (int(np.abs(y).max(initial=0)) + 1)
            if bound * bound * d < 1 << 63:
                return ((n * y - total % n) ** 2).sum(axis=1)
            exact = ((n * y.astype(object) - (total % n).astype(object)) ** 2).sum(axis=1)
            if max(exact) >= 1 << 63:
                raise OverflowError("a deviation is larger than a long")
            return exact.astype(np.int64)

        def work(batch: pa.RecordBatch) -> Iterator[dict]:
            if not k:
                return
            x = _matrix(batch, d)
            ids, m = batch.column("vec_id"), len(x)
            yield {
                "vec_id": ids.take(pa.array(np.repeat(np.arange(m), k))),
                "component": np.tile(np.arange(1, k + 1), m),
                "deviation": np.repeat(deviations(x), k),
                "whitened": model.whiten(x).ravel(),
                "explained": np.tile(explained, m),
            }

        return work

    out = arrow_map(rows, make, "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
