"""Nearest landmarks and the eigen form against NumPy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from kernspan.functions import kernels
from kernspan.operators import fit as fitting
from kernspan.operators import score as S
from kernspan.operators import spaces as collections
from kernspan.operators import tiles
from tests import brute
from tests.test_tiles import landmarks, table


def test_nearest_landmarks_with_ties_and_null_vectors(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(40, 2)), 1)
    x[10:20] = x[0:10]  # equal values under every row
    space = np.array([0] * 12 + [1] * 28)
    y = [None if i % 9 == 0 else rng.normal(size=2) for i in range(50)]
    sp = landmarks(spark, x, space=space)
    for k, tile in ((3, 7), (100, 16)):
        got = {}
        for r in tiles.kernel_top(table(spark, y), sp, kernels.rbf(0.4), k, tile).orderBy("id", "rank").collect():
            got.setdefault(r["id"], []).append((r["space_id"], r["ord"], r["landmark_id"], r["k"]))
            assert r["rank"] == len(got[r["id"]])
        assert sorted(got) == [i for i in range(50) if i % 9]
        for i, found in got.items():
            values = brute.rbf(0.4)(x, y[i][None])[:, 0]
            order = sorted(range(40), key=lambda j: (-round(values[j], 9), space[j], j))[:k]
            assert [f[:3] for f in found] == [(space[j], j, 1000 + j) for j in order]
            assert np.allclose([f[3] for f in found], values[order])
    assert tiles.kernel_top(table(spark, y).limit(0), sp).collect() == []


def test_a_row_meets_small_landmark_blocks_in_one_cell(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(40, 2)), rng.normal(size=(30, 2))
    space = np.array([0] * 12 + [1] * 28)
    calls = tmp_path / "calls"

    def counted(a, b):
        with open(calls, "a") as file:
            file.write(f"{len(a)}\n")
        return a @ b.T

    def found(most):
        monkeypatch.setattr(tiles, "TILE", most)
        calls.write_text("")
        top = tiles.kernel_top(table(spark, y), landmarks(spark, x, space=space), kernels.custom(counted), 6, 5)
        rows = sorted((r["id"], r["rank"], r["space_id"], r["ord"], r["landmark_id"], round(r["k"], 12)) for r in top.collect())
        return rows, sum(map(int, calls.read_text().split()))

    # nine blocks of landmarks: in one cell, in cells of two blocks, in one cell each
    whole, by_two, by_one = found(1024), found(10), found(5)
    assert whole[0] == by_two[0] == by_one[0] and len(whole[0]) == 30 * 6
    assert (whole[1], by_two[1], by_one[1]) == (30, 30 * 5, 30 * 9)


def test_one_factorisation_serves_every_lambda(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x, y, reg = rng.normal(size=(30, 3)), rng.normal(size=(40, 3)), rng.uniform(0.1, 1, 30)
    sp, df = landmarks(spark, x, reg), table(spark, y)
    for kernel, k in ((kernels.rbf(0.3), brute.rbf(0.3)), (kernels.linear(), brute.linear)):
        built = collections.SubspaceCollection.create(sp.drop("space_id"), 0.5, kernel, 2, form="eigen")
        with monkeypatch.context() as patch:
            patch.setattr(collections, "fit", None)  # no refit
            for lam in (0.5, 0.01, 3.0):
                moved = built.update_lambda(lam)
                got = [r["leverage"] for r in moved.leverage_min(df).orderBy("id").collect()]
                assert np.allclose(got, brute.leverages(x, reg, lam, y, k))
        entries = fitting.gram_inverse(moved.models).orderBy("i", "j").collect()
        assert np.allclose([r["g_inv"] for r in entries], np.linalg.inv(brute.gram(x, reg, 3.0, k)).ravel())
        images = np.array([r["proj"] for r in S.kernel_proj(df, moved.models, kernel).orderBy("id").collect()])
        energy = (y**2).sum(1) if k is brute.linear else np.ones(40)
        assert np.allclose(energy - (images**2).sum(1), got)


def test_singular_eigen_form(spark):
    x = np.array([[1.0, 0.0], [2.0, 0.0], [1.0, 0.0]])
    models = fitting.fit(landmarks(spark, x), 0.0, kernels.linear(), form="eigen")
    got = S.leverage(table(spark, [[3.0, 4.0]]), models).first()["leverage"]
    assert np.isclose(got, 16.0)
    assert models.select(F.size("e_flat")).first()[0] == 3
