"""Kernels without a known feature map whose rows span few dimensions of their space.

A partial Cholesky with pivots: rows y are taken as pivots P until every row of the table
has k(y, y) - |phi(y)|^2 is within the last of ``TOLERANCES``, phi(y) = L^-1 k(P, y) with k(P, P) = L L'. Then
phi is a feature map of the kernel on these rows up to that tolerance, and what a kernel
with features does with feature-sized moments holds for this one: a row costs r^2 for r
pivots, however many landmarks there are.

Each task finds the pivots its rows lack, a few tasks cut those down, then the driver; the
table is scanned again until no row lacks any. More than ``MAX_SPAN`` pivots, or a function
that is no positive kernel, and there is no span: such kernels are left to the tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernspan.functions.kernels import Kernel
from kernspan.operators.score import Space, rows_of
from kernspan.session import written

#: pivots of a span, at most
MAX_SPAN = 2_048
#: part of k(y, y) that a row may have outside the span; from coarse to fine, so that rows far
#: from the others are taken first and the factor stays well conditioned
TOLERANCES = (1e-2, 1e-4, 1e-6, 1e-8, 1e-10, 1e-11)
#: a row is looked into when it has this many tolerances outside, below that it may be rounding
SLACK = 4.0
#: a block is not looked into closer when no row has more than this many tolerances outside
CLEAR = SLACK / 2
#: part of k(y, y) that rounding may take from a row
NOISE = 1e-8
#: rows a task compares with its pivots at once
SPAN_ROWS = 1_024
#: parts of the copy per core
SPREAD = 4
#: rows that the first pivots are taken from
SEED_ROWS = 2_000
#: scans for one tolerance after which the search is given up
MAX_SCANS = 4


@dataclass(frozen=True)
class SpannedKernel(Kernel):
    """``base`` with the feature map L^-1 k(pivots, y)."""

    base: Kernel
    pivots: np.ndarray
    lower: np.ndarray
    inverse: np.ndarray

    explicit = True

    def block(self, left, right):
        return self.base.block(left, right)

    def diagonal(self, rows):
        return self.base.diagonal(rows)

    def features(self, rows):
        return _solved(self.base.block(rows, self.pivots), self.lower, self.inverse)

    def scoring(self, factor: np.ndarray) -> tuple[Space, Kernel]:
        """A space and a kernel with the leverages |factor phi(y)|^2, as one product with k(P, y)."""
        return Space(0, np.linalg.solve(self.lower.T, factor.T).T, self.pivots, True), self.base

    def column(self, a: Column, b: Column) -> Column:
        return self.base.column(a, b)

    def norm_column(self, x: Column) -> Column:
        return self.base.norm_column(x)


def _solved(
    values: np.ndarray, lower: np.ndarray, inverse: np.ndarray, first: np.ndarray | None = None
) -> np.ndarray:
    """L^-1 of each row; the inverse of an ill-conditioned L needs a second step."""
    first = values @ inverse.T if first is None else first
    return first + (values - first @ lower.T) @ inverse.T


class _Pivots:
    """Pivots that grow, with ``lower``, the Cholesky factor of k(P, P)."""

    def __init__(self, kernel: Kernel, pivots: np.ndarray, lower: np.ndarray, scale: float):
        self.kernel, self.pivots, self.lower, self.scale = kernel, pivots, lower, scale
        self.inverse = np.linalg.inv(lower)

    def take(self, rows: np.ndarray, tolerance: float) -> bool:
        """Add the pivots that ``rows`` lack; whether that could be done."""
        norms = self.kernel.diagonal(rows)
        usable = np.isfinite(norms)
        rows, norms = rows[usable], norms[usable]
        bound = tolerance * np.maximum(norms, self.scale)
        features = np.empty((len(rows), 0))
        if len(self.pivots):
            values = self.kernel.block(rows, self.pivots)
            # the first step is off where it matters least: its squared length tells what is clear
            features = values @ self.inverse.T
            rest = norms - np.einsum("ij,ij->i", features, features)
            if (np.abs(rest) <= CLEAR * bound).all():
                return True
            features = _solved(values, self.lower, self.inverse, features)
        rest = norms - np.einsum("ij,ij->i", features, features)
        # far below rounding a negative rest is no kernel's
        if (rest < -NOISE * np.maximum(norms, self.scale)).any():
            return False
        if not (rest > SLACK * bound).any():
            return True
        room = MAX_SPAN - len(self.pivots)
        features = np.hstack([features, np.zeros((len(rows), min(room, len(rows))))])
        known, taken = len(self.pivots), []
        while (rest > bound).any():
            n = known + len(taken)
            if n == MAX_SPAN:
                return False
            at = int(np.argmax(rest))
            values = self.kernel.block(rows, rows[at : at + 1])[:, 0]
            features[:, n] = (values - features[:, :n] @ features[at, :n]) / math.sqrt(rest[at])
            rest = rest - features[:, n] ** 2
            rest[at] = -np.inf
            taken.append(at)
        n = known + len(taken)
        lower = np.zeros((n, n))
        lower[:known, :known], lower[known:] = self.lower, np.tril(features[taken, :n], known)
        self.pivots, self.lower = np.vstack([self.pivots, rows[taken]]), lower
        self.inverse = np.linalg.inv(lower)
        return True


def _lacking(df: DataFrame, start: _Pivots, tolerance: float, marked: bool = False) -> DataFrame:
    """The pivots that the rows of a partition lack; a row without a vector if too many,
    which is what such a row of ``df`` tells if ``marked``."""
    shared = (start.kernel, start.pivots, start.lower, start.scale)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Pivots(*shared)
        fits = True
        for batch in batches:
            rows, _ = rows_of(batch["x"].drop_null())
            fits = fits and not (marked and batch["x"].null_count)
            for first in range(0, len(rows), SPAN_ROWS):
                fits = fits and held.take(rows[first : first + SPAN_ROWS], tolerance)
        found = held.pivots[len(shared[1]) :].tolist()
        if not fits:
            found = [None]
        if found:
            yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.list_(pa.float64()))})

    return df.select("x").mapInArrow(scan, "x array<double>")


def spanned(df: DataFrame, landmarks: DataFrame, kernel: Kernel, known: SpannedKernel | None = None) -> SpannedKernel | None:
    """The kernel with a feature map that holds on the rows of ``df`` and ``landmarks``
    (each with a column ``x``), from the pivots of ``known`` on; None if there is none."""
    vectors = [t.select(F.col("x").cast("array<double>").alias("x")) for t in (df, landmarks)]
    if known is None:
        seeds = [r["x"] for r in vectors[1].limit(SEED_ROWS).collect()]
        if not seeds or any(s is None or None in s or len(s) != len(seeds[0]) for s in seeds):
            return None
        rows = np.array(seeds, dtype=float)
        norms = kernel.diagonal(rows)
        if not np.isfinite(norms).all():
            return None
        pivots = _Pivots(kernel, rows[:0], np.empty((0, 0)), float(norms.max()))
        if not pivots.take(rows, TOLERANCES[0]):
            return None
    else:
        pivots = _Pivots(kernel, known.pivots, known.lower, float(kernel.diagonal(known.pivots).max()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    whole = written(vectors[0].unionByName(vectors[1]).repartition(SPREAD * cores), "span")
    for tolerance in TOLERANCES if known is None else TOLERANCES[-1:]:
        if not _reached(whole, pivots, tolerance):
            return None
    if known is not None and len(pivots.pivots) == len(known.pivots):
        return known
    return SpannedKernel(kernel, pivots.pivots, pivots.lower, pivots.inverse)


def _reached(whole: DataFrame, pivots: _Pivots, tolerance: float) -> bool:
    """Whether pivots could be added until no row lacks any."""
    few = max(1, math.isqrt(whole.sparkSession.sparkContext.defaultParallelism))
    for _ in range(MAX_SCANS):
        found = _lacking(whole, pivots, tolerance).repartition(few)
        more = [r["x"] for r in _lacking(found, pivots, tolerance, marked=True).collect()]
        if not more:
            return True
        if None in more or not pivots.take(np.array(more, dtype=float), tolerance):
            return False
        if tolerance > TOLERANCES[-1]:
            # what is still missing is found by the finer scans
            return True
    return False
