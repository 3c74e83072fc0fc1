"""Histogram selection against brute force over whole numbers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from kernspan.llm import histogramtopk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def whole(x):
    """floor(256 x) of a vector, or None where it takes no part."""
    if x is None or any(v is None or not math.isfinite(v) for v in x):
        return None
    return [math.floor(256 * v) if abs(v) < 2.0**1000 else int(v) * 256 for v in x]


def brute(rows, k, every=50):
    usable = [(i, r[0], whole(r[1])) for i, r in enumerate(rows) if whole(r[1]) is not None]
    limit, out = histogramtopk.MOST_SCORE, []
    for i, query_id, q in usable:
        if query_id is None or query_id % every:
            continue
        scored = []
        for j, vec_id, v in usable:
            if j != i:
                score = sum(a * b for a, b in zip(q, v))
                scored.append((-max(-limit, min(limit, score)), vec_id is None, vec_id or 0))
        for rank, (score, lost, vec_id) in enumerate(sorted(scored)[:k], 1):
            out.append((query_id, rank, None if lost else vec_id, -score))
    return sorted(out, key=str)


def found(df, k=5, **options):
    done = histogramtopk.top_k(df, F.col("vec_id") % 50 == 0, k, **options)
    assert done.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in done.collect()), key=str)


def random_rows(n, dims, seed=5):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(dims)], 0) for i in range(n)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = random_rows(260, 6)
    rows[100] = rows[50][:1] + rows[51][1:]  # an id that comes back, with another vector
    rows += [rows[3], rows[3], rows[0]]  # repeated rows, a query among them
    rows += [(400 + i, list(rows[7][1]), 0) for i in range(30)]  # ties
    rows += [(500, None, 0), (550, [1.0, None], 0), (600, [math.nan] * 6, 0), (650, [math.inf], 0)]
    rows += [(700, [], 0), (750, [2.0, 1.0], 0), (751, [5.0] * 9, 0), (None, list(rows[7][1]), 0)]
    df = vectors(spark, rows)
    for name in ("block", "c", "r", "low", "n", "ids", "wanted"):
        df = df.withColumn(name, F.lit("taken"))
    assert found(df) == brute(rows, 5)
    assert found(df.repartition(7)) == brute(rows, 5)


def test_scores_are_exact_where_doubles_are_not(spark):
    rows = [(i, [2.0**40 + i, 3.0 * i, -1.0], 0) for i in range(0, 120, 5)]
    assert found(vectors(spark, rows)) == brute(rows, 5)
    middle = [(i, [2.0**19 + i / 256, 2.0**18 * i, -7.0], 0) for i in range(0, 120, 5)]
    assert found(vectors(spark, middle)) == brute(middle, 5)
    huge = [(0, [1.7e308, -1.0], 0), (1, [1.7e308, 1.0], 0), (2, [-1.0, 2.0], 0)]
    assert found(vectors(spark, huge)) == brute(huge, 5)


@pytest.mark.parametrize("k", [1, 40])
def test_fewer_candidates_than_k_and_equal_scores(spark, k):
    rows = [(i, [1.0, 1.0], 0) for i in range(30)]
    assert found(vectors(spark, rows), k) == brute(rows, k)


def test_many_groups_and_blocks(spark, monkeypatch):
    rows = random_rows(300, 5, seed=8)
    want = brute(rows, 5, every=50)
    for name, value in (("LEAST_ROWS", 40), ("QUERY_ROWS", 2)):
        monkeypatch.setattr(histogramtopk, name, value)
    assert found(vectors(spark, rows).repartition(5)) == want


def test_empty_tables(spark):
    assert found(vectors(spark, [])) == []
    assert found(vectors(spark, [(0, [1.0], 0)])) == []
    assert found(vectors(spark, [(50, None, 0), (1, [1.0], 0)])) == []
