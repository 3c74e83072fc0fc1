"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

Usage: ``python -m verification.check [sf_dir] [query ...]``
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
import pandas as pd

from kernspan import configured_builder, ship_package
from verification.oracle import SQL
from verification.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duckdb_views(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return connection


def _sorted(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty when both hold the same rows exactly, types included."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    got, want = _sorted(got), _sorted(want)
    odd = [c for c in got.columns if got[c].dtype != want[c].dtype]
    if odd:
        return "types " + ", ".join(f"{c} {got[c].dtype} != {want[c].dtype}" for c in odd)
    for column in got.columns:
        a, b = got[column], want[column]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            first = int((~same).to_numpy().argmax())
            return f"{column}: {int((~same).sum())} differ, first {a[first]!r} != {b[first]!r}"
    return ""


def main(sf: str, names: list[str]) -> int:
    spark = (
        configured_builder("check")
        .master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    connection = duckdb_views(sf)
    failed = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            spark_time, start = time.time() - start, time.time()
            if name not in SQL:
                print(f"rows   {name:34s} {len(got):8d} {spark_time:6.2f}s", flush=True)
                continue
            problem = difference(got, connection.sql(SQL[name]).df())
        except Exception as error:  # noqa: BLE001 - report and go on
            problem, spark_time = f"{type(error).__name__}: {str(error)[:600]}", 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        failed += bool(problem)
        verdict = "FAILED" if problem else "ok"
        print(
            f"{verdict:6s} {name:34s} {spark_time:6.2f}s {time.time() - start:6.2f}s {problem}",
            flush=True,
        )
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:]
    folder = arguments[0] if arguments else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, arguments[1:]) else 0)
