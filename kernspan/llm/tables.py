"""Written intermediate tables, let-bindings for columns, and bounded sampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernspan.session import scratch_path

#: what separates words: the ASCII white space characters
SPACE = r"[\x20\x09-\x0D]+"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back.

    Later plans start from the files: a lost executor costs a few tasks, not
    the lineage, and a table that is used twice is computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row.

    A column that a lambda refers to may be inlined into it by the optimizer and
    then be computed for every element; a lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def words(text: Column | str) -> Column:
    """The words of a text as an array; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def named_apart(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
