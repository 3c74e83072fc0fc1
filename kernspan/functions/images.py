"""Pooling of square images stored as flat ``array<double>`` columns.

Both functions stay within the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kernspan.functions.vectors import _col, normalize


def _tiles(image: Column, side: int, count: int, step: int, width: int) -> Column:
    """The ``count x count`` square windows of an image, each as a flat array."""

    def window(position: Column) -> Column:
        top = F.floor(position / F.lit(count)).cast("int") * step
        left = F.pmod(position, F.lit(count)).cast("int") * step
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.lit(width - 1)),
                lambda r: F.slice(image, (top + r) * side + left + 1, F.lit(width)),
            )
        )

    return F.transform(F.sequence(F.lit(0), F.lit(count * count - 1)), window)


def max_pool(
    image: Column | str, side: int, window: int = 7, stride: int = 3, full: bool = False
) -> Column:
    """Largest value of each window.

    The pooled side is ``(side - window) // stride``; ``full`` adds the last
    window that still fits.
    """
    pooled = (side - window) // stride + (1 if full else 0)
    if pooled < 1:
        raise ValueError(f"no {window}-wide window with stride {stride} in side {side}")
    tiles = _tiles(_col(image), side, pooled, stride, window)
    return F.transform(tiles, F.array_max)


def avg_pool_normalize(image: Column | str, side: int, tile: int) -> Column:
    """Mean of each tile, then scaled to length one (null for a blank image)."""
    if side % tile:
        raise ValueError(f"tile {tile} does not divide side {side}")
    tiles = _tiles(_col(image), side, side // tile, tile, tile)

    def mean(values: Column) -> Column:
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return total / F.lit(float(tile * tile))

    return normalize(F.transform(tiles, mean))
