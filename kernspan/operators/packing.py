"""Blocks of vectors in one row, and partition sizing.

Scoring does not need packs (Arrow batches already are blocks); they are kept
for tables that are stored that way.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernspan.functions.uniform import hash_uniform
from kernspan.functions.vectors import split_array
from kernspan.session import broadcast_if_small


def repartition_by_size(df: DataFrame, rows_per_partition: int = 200_000) -> DataFrame:
    """One partition per ``rows_per_partition`` rows, filled evenly."""
    return df.repartition(df.count() // rows_per_partition + 1)


def pack_count(n_rows: int, pack_size: int) -> int:
    return max(1, math.ceil(n_rows / pack_size))


def _pack_id(row_id: Column | str, n_packs: int) -> Column:
    return F.floor(hash_uniform(row_id, "pack") * n_packs).cast("long")


def pack_vectors(
    df: DataFrame, pack_size: int = 5000, n_packs: int | None = None
) -> DataFrame:
    """Group about ``pack_size`` rows ``(id, x)`` into one block row.

    Rows are spread by a hash of their id, so blocks stay even whatever the id
    pattern is, and the result does not depend on the partitioning.
    """
    if n_packs is None:
        n_packs = pack_count(df.count(), pack_size)
    members = F.array_sort(F.collect_list(F.struct("id", "x")))
    blocks = (
        df.select("id", "x", _pack_id("id", n_packs).alias("pack_id"))
        .groupBy("pack_id")
        .agg(members.alias("members"))
    )
    return blocks.select(
        "pack_id",
        F.size("members").cast("long").alias("cols"),
        F.flatten("members.x").alias("x_pack"),
        F.col("members.id").alias("ids"),
    )


def unpack_vectors(packs: DataFrame, *scores: str) -> DataFrame:
    """Back to one row per vector, with per-vector arrays of scores zipped in."""
    keep = [F.col(s) for s in scores]
    parts = packs.select(
        F.col("ids").alias("id"), split_array("x_pack", "cols").alias("x"), *keep
    )
    return parts.select(F.inline(F.arrays_zip("id", "x", *scores)))


def explode_scores(packs: DataFrame, scores: str, out: str = "score") -> DataFrame:
    """One row per entry of the score array of each pack.

    Of a bare column Spark would first ask whether it has entries, and so derive it again.
    """
    return packs.select(F.inline(F.arrays_zip(scores))).toDF(out)


def collect_by_label(
    df: DataFrame, pack_size: int = 5000, label: str = "label"
) -> DataFrame:
    """The vectors of each label in blocks, with the label's row count.

    A label may hold most of the table, so its rows are gathered in as many
    blocks as its count asks for, never in one group.
    """
    counts = df.groupBy(F.col(label).alias("_label")).agg(
        F.count(F.lit(1)).alias("label_rows")
    )
    blocks_of = F.ceil(F.col("label_rows") / F.lit(pack_size))
    # null-safe: rows without a label are a group like any other
    same = F.col(label).eqNullSafe(F.col("_label"))
    tagged = df.join(broadcast_if_small(counts, 100_000), same).select(
        label,
        "id",
        "x",
        "label_rows",
        F.floor(hash_uniform("id", "pack") * blocks_of).cast("long").alias("block"),
    )
    members = F.array_sort(F.collect_list(F.struct("id", "x")))
    return (
        tagged.groupBy(label, "block", "label_rows")
        .agg(members.alias("members"))
        .select(
            label,
            "block",
            "label_rows",
            F.col("members.id").alias("ids"),
            F.col("members.x").alias("xs"),
        )
    )
