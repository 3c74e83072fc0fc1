"""Element-wise statistics of vector tables, standardising, score summaries.

Vectors are exploded to (position, value) and aggregated per position: Spark
combines on the map side, so a shuffle carries one row per position and task
whatever the table size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: dimension up to which moments become literals of the expression
FOLDED_DIM = 64


def vector_dim(df: DataFrame, x: str = "x") -> DataFrame:
    """Smallest and largest vector length of the whole table."""
    size = F.size(x)
    return df.agg(F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))


def _elements(df: DataFrame, x: str, cols: str | None) -> DataFrame:
    """(pos, value) of every element; packed blocks wrap at the vector length."""
    if cols is None:
        return df.select(F.size(x).alias("width"), F.posexplode(x).alias("pos", "value"))
    width = (F.size(x) / F.col(cols)).cast("int")
    exploded = df.select(width.alias("width"), F.posexplode(x).alias("at", "value"))
    return exploded.select("width", F.pmod("at", "width").alias("pos"), "value")


def _per_position(df: DataFrame, x: str, cols: str | None, **aggregates: Column) -> DataFrame:
    """One row holding an array per aggregate, in position order."""
    named = [agg.alias(name) for name, agg in aggregates.items()]
    widths = [F.min("width").alias("least_width"), F.max("width").alias("most_width")]
    rows = _elements(df, x, cols).groupBy("pos").agg(*named, *widths)
    ordered = F.array_sort(F.collect_list(F.struct("pos", *aggregates)))
    least, most = F.min("least_width"), F.max("most_width")
    checked = F.when(least == most, ordered).otherwise(
        F.raise_error(F.concat(F.lit("vectors of unequal length: "), least, F.lit(" and "), most))
    )
    # a table without vectors has no moments
    whole = F.when(F.count(F.lit(1)) == 0, ordered).otherwise(checked)
    return rows.agg(whole.alias("rows")).select(
        *[F.col(f"rows.{name}").alias(name) for name in aggregates]
    )


def vec_sum(df: DataFrame, x: str = "x", cols: str | None = None) -> DataFrame:
    """Element-wise sum, one row; ``cols`` names the vector count of a pack."""
    return _per_position(df, x, cols, sum=F.sum("value"))


def vec_mean(df: DataFrame, x: str = "x", cols: str | None = None) -> DataFrame:
    return _per_position(df, x, cols, mean=F.avg("value"))


def vec_var(df: DataFrame, x: str = "x", cols: str | None = None) -> DataFrame:
    """Element-wise population variance, one row."""
    return _per_position(df, x, cols, var=F.var_pop("value"))


def vector_stats(df: DataFrame, x: str = "x", cols: str | None = None) -> DataFrame:
    """Mean and population variance in one pass over the table."""
    return _per_position(df, x, cols, mean=F.avg("value"), var=F.var_pop("value"))


def standardize(
    df: DataFrame,
    x: str = "x",
    by: str = "variance",
    stats: DataFrame | None = None,
    out: str | None = None,
) -> DataFrame:
    """(x - mean) / variance per dimension, or / std with ``by='std'``.

    A constant dimension becomes 0; a vector of another length than the moments is an
    error that names its id. Without given ``stats`` they are computed
    here, once, so that later passes over the result do not repeat that job.
    """
    if by not in ("variance", "std"):
        raise ValueError(f"by must be 'variance' or 'std', not {by!r}")
    who = F.concat(F.lit(" (id "), F.col("id").cast("string"), F.lit(")")) if "id" in df.columns else F.lit("")

    def checked(scaled: Column, size: Column) -> Column:
        message = F.concat(F.lit("vectors of unequal length: "), size, F.lit(" and "), F.size(x), who)
        even = F.col(x).isNull() | (F.size(x) == size)
        return F.when(even, scaled).otherwise(F.raise_error(message))

    if stats is None:
        row = vector_stats(df, x).first()
        mean, var = list(row["mean"] or []), list(row["var"] or [])
        if len(mean) <= FOLDED_DIM:
            # two numbers a dimension, folded into an expression that Spark compiles
            return df.withColumn(out or x, checked(_folded(F.col(x), mean, var, by), F.lit(len(mean))))
        stats = df.sparkSession.createDataFrame([(mean, var)], "mean array<double>, var array<double>")
    scale = F.col("var") if by == "variance" else F.transform("var", F.sqrt)
    inverse = F.transform(
        scale, lambda v: F.when(v == 0, F.lit(0.0)).otherwise(F.try_divide(F.lit(1.0), v))
    )
    moments = stats.select(F.arrays_zip("mean", inverse.alias("inverse"))).scalar()
    scaled = F.zip_with(
        F.col(x), F.col("_moments"), lambda v, m: (v - m["mean"]) * m["inverse"]
    )
    whole = checked(scaled, F.size("_moments"))
    return df.withColumn("_moments", moments).withColumn(out or x, whole).drop("_moments")


def _folded(x: Column, mean: list, var: list, by: str) -> Column:
    def scaled(place: int) -> Column:
        center, spread = mean[place], var[place]
        if spread is not None and by == "std":
            spread = math.sqrt(spread)
        inverse = None if spread is None else 0.0 if spread == 0 else 1.0 / spread
        center, inverse = (F.lit(v).cast("double") for v in (center, inverse))
        return (F.get(x, F.lit(place)) - center) * inverse

    empty = F.array().cast("array<double>")
    return F.when(x.isNotNull(), F.array(*map(scaled, range(len(mean)))) if mean else empty)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def total_leverage(df: DataFrame, score: str = "leverage") -> DataFrame:
    return df.agg(F.sum(score).alias("total_leverage"))


def mean_leverage(df: DataFrame, score: str = "leverage") -> DataFrame:
    return df.agg(F.avg(score).alias("mean_leverage"))


def score_describe(df: DataFrame, score: str = "leverage") -> DataFrame:
    """count, mean, stddev, min and max of a score in one pass."""
    return df.agg(
        F.count(score).alias("n"),
        F.avg(score).alias("mean"),
        F.stddev_samp(score).alias("stddev"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
    )


#: the eleven deciles 0.0, 0.1, ..., 1.0
DECILES = tuple(i / 10 for i in range(11))


def score_quantiles(
    df: DataFrame,
    score: str = "leverage",
    probabilities: Sequence[float] = DECILES,
    relative_error: float = 0.01,
) -> DataFrame:
    """Approximate quantiles, one row per probability.

    The sketch is mergeable, so no task ever holds the whole column; the rank
    of each result is within ``relative_error * n`` of the asked one.
    """
    probs = [float(p) for p in probabilities]
    sketch = F.percentile_approx(score, probs, int(round(1.0 / relative_error)))
    zipped = df.agg(sketch.alias("value")).select(
        F.array(*[F.lit(p) for p in probs]).alias("probability"), "value"
    )
    return zipped.select(F.inline(F.arrays_zip("probability", "value")))


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))


def match_summary(
    df: DataFrame,
    label: str = "label",
    predicted: str = "pred_label",
    residual: str = "residual",
) -> DataFrame:
    """Rows and summed residual of right and of wrong predictions."""
    return df.groupBy((F.col(label) == F.col(predicted)).alias("is_match")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(residual).alias("residual_sum")
    )
