"""Tiled models against dense NumPy solves; tiles are small so that there are many."""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from kernspan.functions import kernels
from kernspan.operators import classify, fit, spans, tiles
from kernspan.operators import score as S
from kernspan.plans import selection
from kernspan.session import GROUP_BYTES, written
from tests import brute
from tests.test_selection import halving_brute

LANDMARKS = "space_id int, ord int, id long, x array<double>, reg double"


def landmarks(spark, x, reg=None, space=None, first=0):
    n = len(x)
    rows = [
        (0 if space is None else int(space[i]), first + i, 1000 + first + i, [float(v) for v in x[i]], 1.0 if reg is None else float(reg[i]))
        for i in range(n)
    ]
    return spark.createDataFrame(rows, LANDMARKS)


def table(spark, y, **columns):
    rows = [(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "id long, x array<double>")
    for name, value in columns.items():
        df = df.withColumn(name, value)
    return df


def scores(df, model):
    return np.array([r["leverage"] for r in tiles.tiled_leverage_min(df, model).orderBy("id").collect()])


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    return rng.normal(size=(130, 3)), rng.uniform(0.2, 1.0, 130), rng.normal(size=(90, 3))


@pytest.mark.parametrize("tile", [25, 1000])
def test_leverages_of_any_tiling(spark, data, tile):
    x, reg, y = data
    model = tiles.fit_tiled(landmarks(spark, x, reg), 0.1, kernels.rbf(0.3), tile=tile)
    assert model.n_blocks >= 130 / tile and model.n_landmarks == 130
    want = brute.leverages(x, reg, 0.1, y, brute.rbf(0.3))
    assert np.allclose(scores(table(spark, y), model), want, atol=1e-10)


def test_subspaces_of_unequal_size(spark, data):
    x, reg, y = data
    space = np.array([0] * 90 + [1] * 25 + [2] * 15)
    model = tiles.fit_tiled(landmarks(spark, x, reg, space), 0.2, kernels.poly(2, 1.0), tile=30)
    k = lambda a, b: (a @ b.T + 1.0) ** 2
    each = np.array([brute.leverages(x[space == s], reg[space == s], 0.2, y, k) for s in range(3)])
    got = tiles.tiled_leverage_min(table(spark, y), model).orderBy("id").collect()
    assert np.allclose([r["leverage"] for r in got], each.min(0), atol=1e-8)
    sure = np.sort(each, axis=0)[1] - each.min(0) > 1e-6
    assert (np.array([r["best"] for r in got])[sure] == each.argmin(0)[sure]).all()


def test_appended_landmarks_equal_a_fit_of_all(spark, data):
    x, reg, y = data
    model = tiles.fit_tiled(landmarks(spark, x[:60], reg[:60]), 0.1, kernels.rbf(0.3), tile=30)
    for a, b in ((60, 61), (61, 130)):
        model = tiles.append_landmarks(model, landmarks(spark, x[a:b], reg[a:b], first=a), tile=30)
    want = brute.leverages(x, reg, 0.1, y, brute.rbf(0.3))
    assert np.allclose(scores(table(spark, y), model), want, atol=1e-10)
    entries = tiles.tiled_inverse_entries(model).orderBy("i", "j").collect()
    inverse = np.linalg.inv(brute.gram(x, reg, 0.1, brute.rbf(0.3)))
    assert np.allclose([r["g_inv"] for r in entries], inverse.ravel(), atol=1e-8)
    nothing = landmarks(spark, x[:1]).limit(0)
    assert tiles.append_landmarks(model, nothing).n_landmarks == 130


def test_gram_entries_by_order(spark, data):
    x, _, _ = data
    got = tiles.kernel_gram(landmarks(spark, x[:40], first=5), kernels.rbf(0.3), tile=9).collect()
    want = brute.rbf(0.3)(x[:40], x[:40])
    assert len(got) == 1600
    assert all(np.isclose(r["k"], want[r["i"] - 5, r["j"] - 5]) for r in got)


def test_singular_matrices_have_a_generalised_inverse(spark, data):
    x, _, y = data
    twice = np.concatenate([x[:2], x[:2], x[:1] + x[1:2], x[:2]])
    model = tiles.fit_tiled(landmarks(spark, twice), 0.0, kernels.linear(), method="pinv", tile=2)
    basis = np.linalg.qr(x[:2].T)[0]
    want = (y**2).sum(1) - ((y @ basis) ** 2).sum(1)
    assert np.allclose(scores(table(spark, y), model), want, atol=1e-9)


def test_rows_keep_their_columns_and_null_vectors_have_no_score(spark, data):
    x, reg, y = data
    model = tiles.fit_tiled(landmarks(spark, x[:20], reg[:20]), 0.1, kernels.rbf(0.3), tile=8)
    rows = [v if i % 7 else None for i, v in enumerate(y)]
    df = table(spark, rows, block=F.lit("mine"), label=F.col("id") * 2, least=F.lit(None).cast("double"))
    got = tiles.tiled_leverage_min(df, model, "score").orderBy("id").collect()
    want = brute.leverages(x[:20], reg[:20], 0.1, y, brute.rbf(0.3))
    assert [r["label"] for r in got] == [2 * i for i in range(90)] and got[0]["block"] == "mine"
    for i, r in enumerate(got):
        assert (r["score"] is None and r["best"] is None) if i % 7 == 0 else np.isclose(r["score"], want[i])
    assert tiles.tiled_leverage_min(df.limit(0), model).collect() == []


def test_bad_landmarks_are_errors(spark, data):
    ragged = landmarks(spark, [[1.0, 2.0], [1.0]])
    with pytest.raises(Exception, match="unequal length"):
        tiles.fit_tiled(ragged, 0.1)
    with pytest.raises(ValueError, match="no landmarks"):
        tiles.fit_tiled(ragged.limit(0), 0.1)


def test_a_hot_label_is_many_blocks(spark, data, monkeypatch):
    x, _, y = data
    labels = np.array([5] * 110 + [9] * 12 + [2] * 8)
    rows = [(i, int(labels[i]), [float(v) for v in x[i]]) for i in range(130)]
    chosen = spark.createDataFrame(rows, "id long, label long, x array<double>")
    fit = classify.fit_tiled
    monkeypatch.setattr(classify, "fit_tiled", lambda *a, **o: fit(*a, **o, tile=40))
    model = classify.fit_class_subspaces(chosen, 400, kernels.rbf(0.3), form="tiled")
    assert model.n_blocks >= 3 and model.n_spaces == 3
    each = np.array(
        [brute.leverages(x[labels == c], np.ones((labels == c).sum()), 1 / 20, y, brute.rbf(0.3)) for c in (2, 5, 9)]
    )
    df = table(spark, y, label=F.lit(5))
    got = classify.classify_max_projection(df, model).orderBy("id").collect()
    assert got[0].asDict().keys() == {"id", "x", "label", "pred_label", "residual"}
    assert np.allclose([r["residual"] for r in got], each.min(0))
    assert [r["pred_label"] for r in got] == [(2, 5, 9)[i] for i in each.argmin(0)]


@pytest.mark.parametrize("kernel", [kernels.linear(), kernels.cosine()])
def test_rows_of_few_features_are_scored_in_one_scan(spark, data, monkeypatch, kernel):
    """Neither the rows nor the tiles are copied for each other: a table of any size is one scan."""
    def copied(*a, **o):
        raise AssertionError("rows are copied")

    for name in ("row_blocks", "block_leverages", "_plates"):
        monkeypatch.setattr(tiles, name, copied)
    x, reg, y = data
    space = np.array([4] * 90 + [1] * 25 + [7] * 15)
    model = tiles.fit_tiled(landmarks(spark, x, reg, space), 0.2, kernel, tile=20)
    assert model.n_blocks == 5
    each = np.array([brute.leverages(x[space == s], reg[space == s], 0.2, y, kernel.block) for s in (1, 4, 7)])
    rows = [v if i % 7 else None for i, v in enumerate(y)]
    df = table(spark, rows, block=F.lit("mine"), label=F.col("id") * 2).select("block", "x", "label", "id")
    scored = tiles.tiled_leverage_min(df, model, "score")
    assert scored.columns == ["id", "x", "block", "label", "best", "score"]
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    for i, r in enumerate(scored.orderBy("id").collect()):
        assert r["label"] == 2 * i and r["block"] == "mine"
        if i % 7 == 0:
            assert r["score"] is None and r["best"] is None
        else:
            assert np.isclose(r["score"], each[:, i].min(), atol=1e-12) and r["best"] == each[:, i].argmin()
    assert tiles.tiled_leverage_min(df.limit(0), model).collect() == []
    wide = spark.createDataFrame([(5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0])], "id long, x array<double>").coalesce(1)
    with pytest.raises(Exception, match="unequal length.*id 6"):
        tiles.tiled_leverage_min(wide, model).collect()


def test_tables_of_large_cells_have_small_row_groups(spark):
    """A reader takes the cells of a row group together, and a writer holds all of it."""
    cell = F.repeat(F.lit("0123456789abcdef"), 65_536)
    cells = spark.range(0, 60, 1, 1).select("id", F.concat(cell, F.col("id").cast("string")).cast("binary").alias("cell"))
    table = written(cells, "cells")
    assert table.select("id", F.crc32("cell")).collect() == cells.select("id", F.crc32("cell")).collect()
    groups = []
    for path in table.inputFiles():
        file = pq.ParquetFile(urlparse(path).path).metadata
        groups += [file.row_group(k) for k in range(file.num_row_groups)]
    assert sum(group.num_rows for group in groups) == 60
    assert max(group.total_byte_size for group in groups) < 1.5 * GROUP_BYTES


def test_few_features_of_a_singular_and_of_an_extended_model(spark, data):
    x, reg, y = data
    twice = np.concatenate([x[:2], x[:2], x[:1] + x[1:2], x[:2]])
    model = tiles.fit_tiled(landmarks(spark, twice), 0.0, kernels.linear(), method="pinv", tile=2)
    basis = np.linalg.qr(x[:2].T)[0]
    (_, residual), = tiles.feature_residuals(model)
    assert np.allclose(residual, np.eye(3) - basis @ basis.T, atol=1e-9)
    model = tiles.fit_tiled(landmarks(spark, x[:50], reg[:50]), 0.1, kernels.linear(), tile=30)
    model = tiles.append_landmarks(model, landmarks(spark, x[50:], reg[50:], first=50), tile=30)
    want = brute.leverages(x, reg, 0.1, y, kernels.linear().block)
    assert np.allclose(scores(table(spark, y), model), want, atol=1e-12)


def test_tiled_and_primal_classes_agree(spark, data):
    """The least leverage may be a small share of k(y, y): both forms keep its digits."""
    x, _, y = data
    rows = [(i, (5, 9, 2)[i % 3], [float(v) for v in x[i]]) for i in range(130)]
    chosen = spark.createDataFrame(rows, "id long, label long, x array<double>")
    df = table(spark, y, label=F.col("id") % 3)
    got, want = (
        classify.classify_max_projection(df, classify.fit_class_subspaces(chosen, 10**9, form=form)).orderBy("id").collect()
        for form in ("tiled", "primal")
    )
    assert [r["pred_label"] for r in got] == [r["pred_label"] for r in want]
    assert np.allclose([r["residual"] for r in got], [r["residual"] for r in want], rtol=1e-6, atol=0)


def test_halving_and_refinement_under_rbf_match_brute_force(spark, monkeypatch):
    _halving_and_refinement(spark, monkeypatch)


def test_halving_and_refinement_without_a_span(spark, monkeypatch):
    monkeypatch.setattr(selection, "spanned", lambda *a, **o: None)
    _halving_and_refinement(spark, monkeypatch)


def test_rows_of_few_dimensions_need_no_tiles(spark, monkeypatch):
    """Rounds cost the dimension of the span, not the landmarks: no tile is made for them."""
    def tiled(*a, **o):
        raise AssertionError("tiles of landmark size")

    for name in ("fit_tiled", "append_landmarks", "block_leverages"):
        monkeypatch.setattr(selection, name, tiled)
    x = np.random.default_rng(6).normal(size=(300, 3))
    x[7] *= 40
    x /= np.linalg.norm(x, axis=1)[:, None]
    first = selection.nystrom_halving(table(spark, x), kernels.poly(2, 1.0), seed=2)
    assert len(first.models.state.kernel.pivots) == 9
    refined = selection.nystrom_refine(
        table(spark, x), first.spaces, kernels.poly(2, 1.0), seed=2, rounds=1, model=first.models
    )
    assert refined.spaces.count() == first.spaces.count() + refined.history[0][2]


def test_span_is_a_feature_map(spark):
    x = np.random.default_rng(7).normal(size=(3000, 3))
    x[2500:2503] *= 8
    df, kernel = table(spark, [*x, None]), kernels.rbf(0.05)
    span = spans.spanned(df, df.limit(100).where("x is not null"), kernel)
    features = span.features(x)
    assert np.abs(features @ features.T - kernel.block(x, x)).max() < 1e-9
    assert spans.spanned(df, df.limit(100).where("x is not null"), kernel, span) is span


def _halving_and_refinement(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(160, 2))
    for name in ("fit_tiled", "append_landmarks"):
        plain = getattr(selection, name)
        monkeypatch.setattr(selection, name, lambda *a, plain=plain, **o: plain(*a, **o, tile=60))
    got = selection.nystrom_halving(table(spark, rows), kernels.rbf(0.3), seed=2, lam=0.5)
    want = halving_brute(rows, 2, 0.5, 0.1, brute.rbf(0.3))
    assert [r["id"] for r in got.spaces.orderBy("ord", "id").collect()] == want
    assert got.models.n_landmarks == len(want)
    refined = selection.nystrom_refine(
        table(spark, rows), got.spaces, kernels.rbf(0.3), seed=2, lam=0.5, rounds=2, model=got.models
    )
    for i in (1000, 1001):
        score = 3.0 * brute.leverages(rows[want], np.ones(len(want)), 0.5, rows, brute.rbf(0.3))
        want = want + [r for r in range(len(rows)) if brute.uniform(r, 2, i) < score[r]]
    assert [r["id"] for r in refined.spaces.orderBy("ord", "id").collect()] == want
    assert [h[2] for h in refined.history] == [sum(1 for r in refined.spaces.collect() if r["ord"] == i) for i in (1000, 1001)]


def test_rows_of_a_span_are_scored_by_one_product(monkeypatch):
    rows = np.random.default_rng(21).normal(size=(500, 3))
    kernel = kernels.rbf(0.02)
    held = spans._Pivots(kernel, rows[:0], np.empty((0, 0)), 1.0)
    assert all(held.take(rows, tolerance) for tolerance in spans.TOLERANCES)
    span = spans.SpannedKernel(kernel, held.pivots, held.lower, held.inverse)
    features = span.features(rows)
    factor = fit.primal_factor(features[:200].T @ features[:200], 0.01)
    expected = np.square(features @ factor.T).sum(axis=1)

    def no_features(*_):
        raise AssertionError("features of rows that need none")

    monkeypatch.setattr(spans, "_solved", no_features)
    assert held.take(rows, spans.TOLERANCES[-1]) and len(held.pivots) == len(span.pivots)
    space, base = span.scoring(factor)
    np.testing.assert_allclose(S.leverage_block(rows, [space], base)[:, 0], expected, rtol=1e-6)


def test_rbf_blocks_larger_than_the_cache():
    rng = np.random.default_rng(22)
    left, right = rng.normal(size=(300, 4)), rng.normal(size=(200, 4))
    gaps = np.square(left[:, None, :] - right[None, :, :]).sum(axis=2)
    np.testing.assert_allclose(kernels.rbf(0.3).block(left, right), np.exp(-0.3 * gaps), rtol=1e-12)
    assert kernels.rbf(0.3).block(left, right[:0]).shape == (300, 0)
