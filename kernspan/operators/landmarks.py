"""Landmark tables and the joins between them and the data.

A landmark table ``spaces`` has the columns ``space_id, ord, id, x, reg``:
landmark number ``ord`` of a subspace, its row id and vector, and its weight in
the regulariser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernspan.functions.uniform import any_uniform_below, hash_uniform
from kernspan.operators.sampling import numbered, ranked_limit
from kernspan.session import broadcast_if_small, materialize

SPACE_COLUMNS = ("space_id", "ord", "id", "x", "reg")


def uniform_spaces(df: DataFrame, n_spaces: int, m: int, seed: int | str) -> DataFrame:
    """Independent uniform samples of m rows ``(id, x)``, one per subspace.

    A sample is the m rows with the smallest hash uniforms. One scan keeps the
    rows below a share that holds more than m of each subspace; only those few
    are ranked. Should a subspace have fewer, the share grows until none has.
    """
    coins = [f"coin_{s}" for s in range(n_spaces)]
    rows = df.select(
        "id", "x", *[hash_uniform("id", seed, s // 4, s % 4).alias(c) for s, c in enumerate(coins)]
    )
    n_rows = df.count()
    share = 2.0 * (m + 50) / max(n_rows, 1)
    while share < 0.5:
        near = [
            any_uniform_below("id", seed, first // 4, min(4, n_spaces - first), share)
            for first in range(0, n_spaces, 4)
        ]
        few = materialize(rows.filter(reduce(Column.__or__, near)).repartition("id"))
        counts = few.agg(*[F.count_if(F.col(c) < share) for c in coins]).first()
        if min(counts) >= m:
            rows = few
            break
        share *= 2

    def one(space_id: int) -> DataFrame:
        order = [F.col(coins[space_id]), F.col("id")]
        drawn = ranked_limit(rows.select("id", "x", coins[space_id]), order, m)
        return numbered(drawn, order).select(
            F.lit(space_id).alias("space_id"), "ord", "id", "x", F.lit(1.0).alias("reg")
        )

    return materialize(reduce(DataFrame.unionByName, map(one, range(n_spaces))))


def chosen_ids_union(spaces: DataFrame) -> DataFrame:
    """The distinct row ids of all subspaces."""
    return spaces.select("id").distinct()


def filter_by_ids(df: DataFrame, spaces: DataFrame) -> DataFrame:
    """Rows that are a landmark of some subspace."""
    return df.join(broadcast_if_small(spaces.select("id")), "id", "left_semi")


def landmark_semi_join(df: DataFrame, spaces: DataFrame) -> DataFrame:
    """One row per (subspace, landmark), with the columns of its data row."""
    keys = spaces.select("space_id", "ord", "id")
    return df.join(broadcast_if_small(keys), "id")


def align_labels_to_landmarks(
    df: DataFrame, spaces: DataFrame, label: str = "label"
) -> DataFrame:
    """The labels of each subspace's landmarks, as an array in landmark order."""
    joined = landmark_semi_join(df.select("id", label), spaces)
    ordered = F.array_sort(F.collect_list(F.struct("ord", label)))
    return joined.groupBy("space_id").agg(ordered.alias("pairs")).select(
        "space_id", F.col(f"pairs.{label}").alias("labels")
    )


def landmark_union(first: DataFrame, second: DataFrame, distinct_ids: bool = False) -> DataFrame:
    """Append landmarks to a set; repeated rows stay unless asked otherwise."""
    both = first.unionByName(second)
    return both.dropDuplicates(["id"]) if distinct_ids else both


def space_sizes(spaces: DataFrame) -> DataFrame:
    return spaces.groupBy("space_id").agg(F.count(F.lit(1)).alias("n_landmarks"))
