"""Conjugate gradients against direct solves."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan.functions import kernels
from kernspan.operators import conjugate, ridge
from tests import brute


def system(spark, n=90, outputs=2, seed=4):
    rng = np.random.default_rng(seed)
    x, f, reg = rng.normal(size=(n, 3)), rng.normal(size=(n, outputs)), rng.uniform(0.3, 1.0, n)
    space = np.where(np.arange(n) % 4 == 0, 1, 0)
    rows = [
        (int(space[i]), i, 500 + i, [float(v) for v in x[i]], float(reg[i]), [float(v) for v in f[i]]) for i in range(n)
    ]
    schema = "space_id int, ord int, id long, x array<double>, reg double, targets array<double>"
    return spark.createDataFrame(rows, schema), x, f, reg, space


@pytest.mark.parametrize("sample", [6, 200])
def test_coefficients_equal_a_direct_solve(spark, sample):
    df, x, f, reg, space = system(spark)
    solved = conjugate.solve(df, 2.0, kernels.rbf(0.2), tile=25, sample=sample).orderBy("ord").collect()
    assert [r["id"] for r in solved] == [500 + i for i in range(90)]
    assert np.allclose([r["x"] for r in solved], x)
    got = np.array([r["alpha"] for r in solved])
    for s in (0, 1):
        own = space == s
        want = np.linalg.solve(brute.gram(x[own], reg[own], 2.0, brute.rbf(0.2)), f[own])
        assert np.abs(got[own] - want).max() < 1e-8 * np.abs(want).max()


def test_ridge_takes_it_where_a_subspace_is_large(spark):
    df, x, f, reg, space = system(spark, n=40, outputs=1, seed=5)
    rows = df.select("id", "x", F.col("targets")[0].alias("f"))
    spaces = df.drop("targets")
    direct = ridge.ridge_fit(spaces, rows, "f", 0.4, kernels.linear(), solver="direct")
    large = ridge.ridge_fit(spaces, rows, "f", 0.4, kernels.linear(), max_landmarks=20)
    want = {r["ord"]: r["alpha"][0] for r in direct.collect()}
    got = {r["ord"]: r["alpha"][0] for r in large.collect()}
    assert want.keys() == got.keys() and all(np.isclose(got[o], want[o], rtol=1e-8) for o in want)
    with pytest.raises(ValueError, match="more than 20"):
        ridge.ridge_fit(spaces, rows, "f", 0.4, max_landmarks=20, solver="direct")
    with pytest.raises(ValueError, match="solver must be"):
        ridge.ridge_fit(spaces, rows, "f", 0.4, solver="other")


def test_targets_of_zero_and_empty_tables(spark):
    df, *_ = system(spark, n=12)
    zero = df.withColumn("targets", F.array(F.lit(0.0), F.col("targets")[0]))
    got = conjugate.solve(zero, 0.5, kernels.linear(), tile=5).collect()
    assert all(r["alpha"][0] == 0.0 for r in got) and any(r["alpha"][1] != 0.0 for r in got)
    with pytest.raises(ValueError, match="no landmarks"):
        conjugate.solve(df.limit(0), 0.5, kernels.linear())
    with pytest.raises(ValueError, match="lambda > 0"):
        conjugate.solve(df, 0.0, kernels.linear())
