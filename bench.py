"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores.
Each query runs on whole tables; its result is consumed by a ``noop`` write.
"""

from __future__ import annotations

import json
import os
import time

from kernspan import configured_builder, ship_package
from verification.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = [
    "scan_labeled_csv",
    "standardize",
    "vec_mean",
    "vec_var",
    "max_pool",
    "pack_vectors",
    "collect_by_label",
    "sample_fraction",
    "level_filter",
    "kernel_crosses",
    "kernel_proj_spaces",
    "leverage",
    "leverage_min",
    "leverage_min_lineitem",
    "leverage_min_packed",
    "leverage_rbf",
    "total_leverage_lineitem",
    "score_quantiles",
    "topk_by_score",
    "spaces_append",
    "nystrom_spaces",
    "nystrom_bless",
    "nystrom_halving",
    "nystrom_refine",
    "classify_max_projection_events",
    "ridge_predict_multi",
    "ridge_classify_vote",
]


def main() -> None:
    spark = (
        configured_builder("bench")
        .master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    # starts the Python workers and warms up the code generator
    QUERIES["leverage"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
