"""Element-wise functions on ``array<double>`` columns.

Everything here is a built-in Spark expression, evaluated in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Column | str
Constant = Column | Sequence[float]


def _col(x: Vector) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _constant(c: Constant) -> Column:
    return c if isinstance(c, Column) else F.array(*[F.lit(float(v)) for v in c])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``.

    An expression named inside a lambda is otherwise evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Vector, b: Vector) -> Column:
    products = F.zip_with(_col(a), _col(b), lambda u, v: u * v)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm_sqr(x: Vector) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda acc, v: acc + v * v)


def norm(x: Vector) -> Column:
    return F.sqrt(norm_sqr(x))


def normalize(x: Vector) -> Column:
    """x / |x|; null for the zero vector."""
    return let(
        norm(x),
        lambda n: F.when(n > 0, F.transform(_col(x), lambda v: v / n)),
    )


def add_vec(x: Vector, c: Constant) -> Column:
    return F.zip_with(_col(x), _constant(c), lambda v, w: v + w)


def mul_vec(x: Vector, c: Constant) -> Column:
    return F.zip_with(_col(x), _constant(c), lambda v, w: v * w)


def div_vec(x: Vector, c: Constant) -> Column:
    """Element-wise x / c; null where c is zero."""
    return F.zip_with(_col(x), _constant(c), lambda v, w: F.try_divide(v, w))


def add_scalar(x: Vector, c: float) -> Column:
    return F.transform(_col(x), lambda v: v + F.lit(float(c)))


def mul_scalar(x: Vector, c: float) -> Column:
    return F.transform(_col(x), lambda v: v * F.lit(float(c)))


def div_scalar(x: Vector, c: float) -> Column:
    return F.transform(_col(x), lambda v: F.try_divide(v, F.lit(float(c))))


def square(x: Vector) -> Column:
    return F.transform(_col(x), lambda v: v * v)


def reciprocal(x: Vector) -> Column:
    """Element-wise 1 / x; null where x is zero."""
    return F.transform(_col(x), lambda v: F.try_divide(F.lit(1.0), v))


def split_array(flat: Vector, cols: Vector) -> Column:
    """Cut a flat array into ``cols`` consecutive slices of equal length.

    Elements are fetched by place: ``slice`` would walk the whole array for every
    vector, and a derived ``flat`` would be derived for every vector too.
    """
    flat, cols = _col(flat), _col(cols).cast("int")

    def cut(whole: Column, width: Column) -> Column:
        def vector(i: Column) -> Column:
            places = F.sequence(i * width, (i + 1) * width - 1)
            # a sequence of no places would count down
            return F.when(width > 0, F.transform(places, lambda j: F.get(whole, j))).otherwise(
                F.slice(whole, 1, width)
            )

        return F.transform(F.sequence(F.lit(0), cols - 1), vector)

    return let(flat, lambda whole: let((F.size(whole) / cols).cast("int"), lambda width: cut(whole, width)))


def on_pack(flat: Vector, cols: Vector, fn: Callable[[Column], Column]) -> Column:
    """Apply a vector function to every vector of a packed block."""
    return F.flatten(F.transform(split_array(flat, cols), fn))


def cap_to_one(score: Vector) -> Column:
    return F.least(_col(score), F.lit(1.0))
