"""Row sampling by score, and the bounded top-k that ends each sampling round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernspan.functions.uniform import hash_uniform, nested_level
from kernspan.functions.vectors import cap_to_one

#: decimals of a score that decide its rank; ties then follow the tie columns
RANK_DIGITS = 9


def known(score: Column | str) -> Column:
    """Whether a score is a number: null and NaN are neither sampled nor ranked."""
    score = F.col(score) if isinstance(score, str) else score
    return score.isNotNull() & ~F.isnan(score)


def scale_scores(df: DataFrame, factor: float, score: str = "score") -> DataFrame:
    return df.withColumn(score, F.col(score) * F.lit(float(factor)))


def sample_fraction(
    df: DataFrame, fraction: float, seed: int | str, round_no: int = 0, row_id: str = "id"
) -> DataFrame:
    """Keep each row with the same probability, decided by its id alone."""
    return df.filter(hash_uniform(row_id, seed, round_no) < F.lit(float(fraction)))


def bernoulli_by_score(
    df: DataFrame,
    seed: int | str,
    round_no: int = 0,
    score: str = "score",
    row_id: str = "id",
) -> DataFrame:
    """Keep a row with probability min(score, 1); never one whose score is no number."""
    return df.filter(known(score) & (hash_uniform(row_id, seed, round_no) <= cap_to_one(score)))


def stage_seed(seed: int | str) -> str:
    """The seed of the pre-sampling stage, independent of the main one."""
    return f"{seed}/stage"


def bernoulli_two_stage(
    df: DataFrame,
    beta: float,
    seed: int | str,
    round_no: int = 0,
    score: str = "score",
    row_id: str = "id",
) -> DataFrame:
    """Sample a fraction ``beta``, then keep with probability score / beta.

    Overall a row stays with probability min(beta, score).
    """
    staged = sample_fraction(df, beta, stage_seed(seed), round_no, row_id)
    u = hash_uniform(row_id, seed, round_no)
    return staged.filter(known(score) & (u * F.lit(float(beta)) <= F.col(score)))


def bernoulli_by_scaled_score(
    df: DataFrame,
    seed: int | str,
    round_no: int = 0,
    delta: float | None = None,
    score: str = "score",
    row_id: str = "id",
    total: Column | None = None,
) -> DataFrame:
    """Keep when u < score * ln(total / delta); without delta, when u < score.

    ``total`` defaults to the sum of the score over ``df``.
    """
    u = hash_uniform(row_id, seed, round_no)
    df = df.filter(known(score))
    if delta is None:
        return df.filter(u < F.col(score))
    if total is None:
        total = df.agg(F.sum(score)).scalar()
    return df.filter(u < F.col(score) * F.log(total / F.lit(float(delta))))


def with_nested_level(
    df: DataFrame, n_levels: int, seed: int | str, row_id: str = "id", out: str = "level"
) -> DataFrame:
    return df.withColumn(out, nested_level(hash_uniform(row_id, seed), n_levels))


def level_filter(df: DataFrame, level: int, column: str = "level") -> DataFrame:
    """Rows that survive to the nested level with this index."""
    return df.filter(F.col(column) > level)


#: rows among which a plain sort finds the first ones, and bins of one histogram
SORTED_ROWS, BINS = 1_000_000, 1_024


def _first_rows(df: DataFrame, keys: list[Column], k: int) -> DataFrame:
    """Rows of ``df`` that can be among the first k in ascending order of numeric keys.

    A histogram of the first key finds the bin of the k-th row; rows of earlier bins are
    in, later ones are out, and the bin's rows are counted in finer bins, at last by the
    next key, until the rows in doubt are few or equal in all keys. Counts are added up by
    Spark and the driver sees one histogram at a time. Null and NaN come last.
    """
    if df.count() <= max(SORTED_ROWS, k):
        return df
    inside, doubt, open_rows = F.lit(False), F.lit(True), df
    for key in keys:
        number = F.when(~F.isnan(key), key)
        while True:
            n, bare, low, high = open_rows.agg(
                F.count(F.lit(1)), F.count_if(number.isNull()), F.min(number), F.max(number)
            ).first()
            if n <= max(SORTED_ROWS, k):
                return df.filter(inside | doubt)
            if 0 < bare < n:
                if k <= n - bare:
                    doubt = doubt & number.isNotNull()
                else:
                    inside, doubt, k = inside | (doubt & number.isNotNull()), doubt & number.isNull(), k - (n - bare)
                open_rows = df.filter(doubt)
                continue
            if bare or low == high:
                break
            # infinite values have bins of their own
            low, high = max(low, -1e300), min(high, 1e300)
            width = max(high / BINS - low / BINS, 5e-324)
            place = F.greatest(F.lit(0.0), F.least(F.floor((key - F.lit(low)) / F.lit(width)).cast("double"), F.lit(float(BINS))))
            place = F.when(key > F.lit(high), BINS + 1).when(key < F.lit(low), -1).otherwise(place.cast("int"))
            before = 0
            for bin_no, count in sorted(open_rows.groupBy(place.alias("bin")).count().collect()):
                if before + count >= k:
                    break
                before += count
            inside, doubt, k = inside | (doubt & (place < bin_no)), doubt & (place == bin_no), k - before
            if count == n:
                return df.filter(inside | doubt)
            open_rows = df.filter(doubt)
    return df.filter(inside | doubt)


def ranked_limit(df: DataFrame, order: list[Column], k: int, keys: list[Column] | None = None) -> DataFrame:
    """The first k rows in ``order``.

    ``keys`` are its leading terms as numbers in ascending order: with them a large table
    is cut to the rows that can be among the first, and only those are sorted. Without
    them ``df`` is taken to be pruned already.
    """
    return (df if keys is None else _first_rows(df, keys, k)).orderBy(*order).limit(k)


def topk_by_score(
    df: DataFrame, k: int, score: str = "score", ties: tuple[str, ...] = ("id",)
) -> DataFrame:
    """The k rows with the highest score; rows without a number come last."""
    return _extreme(df, k, score, ties, descending=True)


def bottomk_by_score(
    df: DataFrame, k: int, score: str = "score", ties: tuple[str, ...] = ("id",)
) -> DataFrame:
    """The k rows with the lowest score; rows without a number come last."""
    return _extreme(df, k, score, ties, descending=False)


def _extreme(df: DataFrame, k: int, score: str, ties: tuple[str, ...], descending: bool) -> DataFrame:
    df = df.withColumn(score, F.when(known(score), F.col(score)))
    rank = F.round(score, RANK_DIGITS)
    order = [rank.desc_nulls_last() if descending else rank.asc_nulls_last(), *[F.col(t) for t in ties]]
    keys = [-rank if descending else rank]
    for tie in ties:
        if not isinstance(df.schema[tie].dataType, T.NumericType):
            break
        keys.append(F.col(tie).cast("double"))
        if not isinstance(df.schema[tie].dataType, T.DoubleType):
            break  # large whole numbers may become equal: no key may follow
    return ranked_limit(df, order, k, keys)


def numbered(df: DataFrame, order: list[Column], out: str = "ord") -> DataFrame:
    """Number a bounded sample 0, 1, ... in ``order``."""
    everything = Window.partitionBy(F.lit(0)).orderBy(*order)
    return df.withColumn(out, F.row_number().over(everything) - 1)
