"""Labelled vector tables: ``id``, ``label long``, ``x array<double>``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def drop_header_rows(lines: DataFrame, markers: Sequence[str], column: str = "value") -> DataFrame:
    """Drop text lines that contain one of the header markers."""
    return reduce(lambda df, m: df.filter(~F.col(column).contains(m)), markers, lines)


def scan_labeled_csv(
    spark: SparkSession, path: str, header_markers: Sequence[str] = ()
) -> DataFrame:
    """Read CSV lines ``label,feature,feature,...`` (plain or compressed).

    The label is written as a double and becomes a long. A compressed file is
    one partition, so large ones want ``repartition_by_size`` afterwards.
    """
    lines = drop_header_rows(spark.read.text(path), header_markers)
    fields = lines.select(F.split("value", ",").alias("fields"))
    return fields.select(
        F.element_at("fields", 1).cast("double").cast("long").alias("label"),
        F.slice("fields", 2, F.size("fields")).cast("array<double>").alias("x"),
    )


def scan_parquet_vectors(
    spark: SparkSession,
    path: str,
    features: str = "features",
    label: str = "label",
    row_id: str | None = None,
) -> DataFrame:
    """Read parquet vectors of any numeric element type.

    Only the named columns reach the scan. Without a natural key in ``row_id``
    the rows are numbered by ``assign_row_id``.
    """
    table = spark.read.parquet(path)
    columns = [
        F.col(label).cast("long").alias("label"),
        F.col(features).cast("array<double>").alias("x"),
    ]
    if row_id is None:
        return assign_row_id(table.select(*columns))
    return table.select(F.col(row_id).alias("id"), *columns)


def assign_row_id(df: DataFrame, name: str = "id") -> DataFrame:
    """Add a unique long id. It depends on the partitioning, so write the table
    before relying on it across jobs, and prefer a natural key."""
    return df.withColumn(name, F.monotonically_increasing_id())


def sink_parquet_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path, compression="snappy")


def combine_splits(splits: Mapping[str, DataFrame], name: str = "split") -> DataFrame:
    """Stack tables (train, test, ...) with their name in a column."""
    tagged = [df.withColumn(name, F.lit(split)) for split, df in splits.items()]
    return reduce(DataFrame.unionByName, tagged)
