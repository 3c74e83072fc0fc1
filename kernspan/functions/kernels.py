"""Kernels, each in a Column form and in a block (matrix) form.

A kernel with a finite feature map phi, k(x, y) = phi(x).phi(y), also provides
``features``. Operators then work with feature-sized matrices instead of
landmark-sized ones, which is far cheaper when landmarks outnumber features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from kernspan.functions import vectors as V


#: doubles of a block that are worked on at once
CACHED_DOUBLES = 16_384


class Kernel:
    """Interface shared by all kernels. Blocks hold one row per vector."""

    #: True when ``features`` is available
    explicit = False

    def block(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def diagonal(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def features(self, rows: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def column(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def norm_column(self, x: Column) -> Column:
        return self.column(x, x)


def _squared_lengths(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


@dataclass(frozen=True)
class LinearKernel(Kernel):
    explicit = True

    def block(self, left, right):
        return left @ right.T

    def diagonal(self, rows):
        return _squared_lengths(rows)

    def features(self, rows):
        return rows

    def column(self, a, b):
        return V.dot(a, b)

    def norm_column(self, x):
        return V.norm_sqr(x)


@dataclass(frozen=True)
class CosineKernel(Kernel):
    """The linear kernel of vectors scaled to length one (zero stays zero)."""

    explicit = True

    def features(self, rows):
        lengths = np.sqrt(_squared_lengths(rows))
        return rows / np.where(lengths > 0, lengths, 1.0)[:, None]

    def block(self, left, right):
        return self.features(left) @ self.features(right).T

    def diagonal(self, rows):
        return (_squared_lengths(rows) > 0).astype(float)

    def column(self, a, b):
        lengths = V.norm(a) * V.norm(b)
        return V.let(lengths, lambda n: F.when(n > 0, V.dot(a, b) / n).otherwise(F.lit(0.0)))

    def norm_column(self, x):
        return F.when(V.norm_sqr(x) > 0, F.lit(1.0)).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class RbfKernel(Kernel):
    gamma: float

    def block(self, left, right):
        out = left @ right.T
        ours, theirs = _squared_lengths(left)[:, None], _squared_lengths(right)[None, :]
        # some rows at a time, so that the steps after the product find them in the cache
        step = max(1, CACHED_DOUBLES // max(1, len(right)))
        for start in range(0, len(left), step):
            part = out[start : start + step]
            part *= 2.0
            distances = ours[start : start + step] + theirs
            distances -= part
            np.maximum(distances, 0.0, out=distances)
            distances *= -self.gamma
            np.exp(distances, out=part)
        return out

    def diagonal(self, rows):
        return np.ones(len(rows))

    def column(self, a, b):
        gap = F.zip_with(a, b, lambda u, v: u - v)
        return F.exp(F.lit(-self.gamma) * V.norm_sqr(gap))

    def norm_column(self, x):
        return F.lit(1.0)


@dataclass(frozen=True)
class PolyKernel(Kernel):
    degree: int
    offset: float

    def block(self, left, right):
        return (left @ right.T + self.offset) ** self.degree

    def diagonal(self, rows):
        return (_squared_lengths(rows) + self.offset) ** self.degree

    def column(self, a, b):
        return F.pow(V.dot(a, b) + F.lit(self.offset), F.lit(float(self.degree)))


@dataclass(frozen=True)
class CustomKernel(Kernel):
    """A user function of two blocks ``(m, d), (n, d) -> (m, n)``."""

    function: Callable[[np.ndarray, np.ndarray], np.ndarray]

    def block(self, left, right):
        return np.asarray(self.function(left, right), dtype=float)

    def diagonal(self, rows):
        out = np.empty(len(rows))
        for start in range(0, len(rows), 64):
            part = rows[start : start + 64]
            out[start : start + len(part)] = np.diagonal(self.block(part, part))
        return out

    def column(self, a, b):
        raise TypeError("a custom kernel has no Column form; use the block operators")


def linear() -> Kernel:
    return LinearKernel()


def cosine() -> Kernel:
    return CosineKernel()


def rbf(gamma: float) -> Kernel:
    return RbfKernel(float(gamma))


def poly(degree: int, offset: float = 1.0) -> Kernel:
    return PolyKernel(int(degree), float(offset))


def custom(function: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Kernel:
    return CustomKernel(function)
