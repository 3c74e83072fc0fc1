"""Readers and writers of labelled vector tables."""

from kernspan.sources.vectors import (
    assign_row_id,
    combine_splits,
    drop_header_rows,
    scan_labeled_csv,
    scan_parquet_vectors,
    sink_parquet_vectors,
)

__all__ = [
    "assign_row_id",
    "combine_splits",
    "drop_header_rows",
    "scan_labeled_csv",
    "scan_parquet_vectors",
    "sink_parquet_vectors",
]
