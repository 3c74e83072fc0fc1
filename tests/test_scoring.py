"""Scores against direct solves, invariants, and edge cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan.functions import kernels
from kernspan.operators import fit as fitting
from kernspan.operators import packing
from kernspan.operators import score as S
from tests import brute
from verification import relations as R

KERNELS = {
    "linear": (kernels.linear(), brute.linear),
    "cosine": (kernels.cosine(), brute.cosine),
    "rbf": (kernels.rbf(0.7), brute.rbf(0.7)),
    "poly": (kernels.poly(2, 1.0), lambda a, b: (a @ b.T + 1) ** 2),
    "custom": (kernels.custom(lambda a, b: np.tanh(0.1 * a @ b.T) + 0.1 * a @ b.T),
               lambda a, b: np.tanh(0.1 * a @ b.T) + 0.1 * a @ b.T),
}


def table(spark, rows, ids=None):
    ids = range(len(rows)) if ids is None else ids
    data = [(int(i), [float(v) for v in row]) for i, row in zip(ids, rows)]
    return spark.createDataFrame(data, "id long, x array<double>")


def space_table(spark, blocks, reg=1.0):
    data = [
        (s, o, 1000 * s + o, [float(v) for v in x], float(reg))
        for s, rows in enumerate(blocks)
        for o, x in enumerate(rows)
    ]
    return spark.createDataFrame(
        data, "space_id int, ord int, id long, x array<double>, reg double"
    )


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(3)
    return rng.normal(size=(60, 5)), [rng.normal(size=(m, 5)) for m in (3, 8, 12)]


def column(df, name):
    return np.array([row[name] for row in df.orderBy("id").select(name).collect()], dtype=float)


@pytest.mark.parametrize("name", KERNELS)
def test_leverages_match_a_direct_solve(spark, sample, name):
    kernel, k = KERNELS[name]
    y, blocks = sample
    models = fitting.fit(space_table(spark, blocks, 0.7), 0.2, kernel)
    df = table(spark, y)
    want = np.array([brute.leverages(x, np.full(len(x), 0.7), 0.2, y, k) for x in blocks]).T
    each = column(S.leverage_per_space(df, models, kernel), "leverages")
    assert np.allclose(each, want, atol=1e-9)
    assert np.allclose(column(S.leverage_min(df, models, kernel), "leverage"), want.min(1))
    norms = np.array([k(v[None], v[None])[0, 0] for v in y])
    pseudo = norms - (norms[:, None] - want).sum(1)
    assert np.allclose(column(S.leverage_pseudo(df, models, kernel), "leverage"), pseudo)


@pytest.mark.parametrize("name", KERNELS)
def test_projections_match_a_direct_solve(spark, sample, name):
    kernel, k = KERNELS[name]
    y, blocks = sample
    models = fitting.fit(space_table(spark, blocks), 0.3, kernel)
    got = column(S.kernel_proj(table(spark, y), models, kernel), "proj")
    want = np.hstack([brute.projections(x, np.ones(len(x)), 0.3, y, k) for x in blocks])
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("name", ["linear", "cosine"])
def test_primal_form_equals_dual_form(spark, sample, name):
    kernel, _ = KERNELS[name]
    y, blocks = sample
    sp = space_table(spark, blocks, 0.4)
    df = table(spark, y)
    dual = S.leverage_per_space(df, fitting.fit(sp, 0.1, kernel), kernel)
    primal = S.leverage_per_space(
        df, fitting.fit(sp.repartition(5), 0.1, kernel, form="primal"), kernel
    )
    assert np.allclose(column(dual, "leverages"), column(primal, "leverages"), atol=1e-10)


@pytest.mark.parametrize("name", ["linear", "rbf"])
def test_models_beyond_the_broadcast_bound_are_scored_in_passes(spark, sample, name):
    kernel, _ = KERNELS[name]
    y, blocks = sample
    df = table(spark, y)
    models = fitting.fit(space_table(spark, blocks), 0.1, kernel)
    small = {"max_model_bytes": 12 * 12 * 8 + 12 * 5 * 8}
    for fn, out in (
        (S.leverage_min, "leverage"),
        (S.leverage_pseudo, "leverage"),
        (S.leverage_per_space, "leverages"),
        (S.kernel_proj, "proj"),
    ):
        one = column(fn(df, models, kernel), out)
        many = column(fn(df, models, kernel, **small), out)
        assert np.allclose(one, many, atol=1e-10)
    with pytest.raises(ValueError, match="one subspace needs"):
        S.leverage_min(df, models, kernel, max_model_bytes=8)


def test_cross_values_in_passes(spark, sample):
    y, blocks = sample
    sp, df = space_table(spark, blocks), table(spark, y)
    want = brute.linear(y, np.vstack(blocks))
    assert np.allclose(column(S.kernel_cross(df, sp), "k_cross"), want)
    assert np.allclose(column(S.kernel_cross(df, sp, max_bytes=12 * 5 * 8), "k_cross"), want)


def test_invariants(spark, sample):
    y, blocks = sample
    df = table(spark, y)
    norms = (y**2).sum(1)
    small = column(S.leverage_per_space(df, fitting.fit(space_table(spark, blocks), 0.1)), "leverages")
    large = column(S.leverage_per_space(df, fitting.fit(space_table(spark, blocks), 0.5)), "leverages")
    assert (small >= -1e-12).all() and (small <= norms[:, None] + 1e-12).all()
    assert (large >= small - 1e-12).all()
    grown = [np.vstack([b, y[:1]]) for b in blocks]
    more = column(S.leverage_per_space(df, fitting.fit(space_table(spark, grown), 0.1)), "leverages")
    assert (more <= small + 1e-12).all()
    models = fitting.fit(space_table(spark, blocks), 0.1)
    pseudo = column(S.leverage_pseudo(df, models), "leverage")
    assert (pseudo <= small.min(1) + 1e-12).all()


def test_landmarks_have_small_leverage(spark, sample):
    _, blocks = sample
    sp = space_table(spark, blocks[1:2], 0.5)
    models = fitting.fit(sp, 0.2)
    own = column(S.leverage(sp.select("id", "x"), models), "leverage")
    assert (own <= 0.2 * 0.5 + 1e-12).all()


def test_one_landmark_closed_form(spark):
    x, y, lam, reg = np.array([1.0, 2.0]), np.array([[3.0, -1.0], [0.5, 0.5]]), 0.3, 0.8
    models = fitting.fit(space_table(spark, [[x]], reg), lam)
    want = (y**2).sum(1) - (y @ x) ** 2 / (x @ x + lam * reg)
    assert np.allclose(column(S.leverage(table(spark, y), models), "leverage"), want)


def test_zero_vector_and_null_vector(spark, sample):
    _, blocks = sample
    for kernel in (kernels.linear(), kernels.cosine()):
        models = fitting.fit(space_table(spark, blocks), 0.1, kernel)
        df = spark.createDataFrame(
            [(0, [0.0] * 5), (1, None), (2, [1.0] * 5)], "id long, x array<double>"
        )
        rows = S.leverage_min(df, models, kernel).orderBy("id").collect()
        assert rows[0]["leverage"] == 0.0
        assert rows[1]["leverage"] is None
        assert rows[2]["leverage"] > 0
        projected = S.kernel_proj(df, models, kernel).orderBy("id").collect()
        assert projected[1]["proj"] is None and len(projected[2]["proj"]) == 23


def test_duplicated_landmarks_and_zero_weights(spark):
    x = np.array([[1.0, 0.0], [1.0, 0.0], [0.0, 2.0]])
    df = table(spark, np.array([[1.0, 1.0], [2.0, -1.0]]))
    for reg in (1.0, 0.0):
        for method in ("chol", "pinv"):
            models = fitting.fit(space_table(spark, [x], reg), 0.1, method=method)
            got = column(S.leverage(df, models), "leverage")
            assert np.isfinite(got).all() and (got >= -1e-6).all()


def test_unequal_lengths_name_the_row(spark, sample):
    _, blocks = sample
    models = fitting.fit(space_table(spark, blocks), 0.1)
    df = spark.createDataFrame([(7, [1.0] * 5), (8, [1.0] * 4)], "id long, x array<double>")
    with pytest.raises(Exception, match="unequal length.*8"):
        S.leverage_min(df.coalesce(1), models).collect()


def test_result_does_not_depend_on_partitions(spark, sample):
    y, blocks = sample
    models = fitting.fit(space_table(spark, blocks), 0.1)
    one = column(S.leverage_min(table(spark, y).coalesce(1), models), "leverage")
    many = column(S.leverage_min(table(spark, y).repartition(13), models), "leverage")
    assert np.allclose(one, many, atol=1e-13)


def test_packed_equals_unpacked(spark, sf):
    df = R.events(spark, sf)
    models = fitting.fit(R.spaces(df), 0.1)
    packs = S.leverage_min_packed(packing.pack_vectors(df, pack_size=64), models)
    rows = packing.unpack_vectors(packs, "leverages")
    assert rows.count() == df.count()
    direct = S.leverage_min(df, models).withColumnRenamed("x", "y")
    gap = rows.join(direct, "id").agg(
        F.count("*"), F.max(F.abs(F.col("leverages") - F.col("leverage"))), F.sum((F.col("x") != F.col("y")).cast("int"))
    ).first()
    assert gap[0] == df.count() and gap[1] < 1e-12 and gap[2] == 0


def test_a_score_keeps_filters_and_pruning_around_it(spark, sf):
    df = R.lineitem(spark, sf)
    models = fitting.fit(R.spaces(df), 0.1, form="primal")
    scored = S.leverage_min(df, models).filter("label = 1").select("leverage")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "Exchange" not in plan
    # the text key is not read for a score that does not return it
    assert "l_orderkey" not in plan
    # the label filter runs below the Python evaluation, on the scan
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_the_same_scorer_runs_on_a_stream(spark, sf, tmp_path):
    source = str(tmp_path / "rows")
    R.events_raw(spark, sf).write.parquet(source)
    batch = spark.read.parquet(source)
    models = fitting.fit(R.spaces(batch), 0.1)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    writer = S.leverage_min(stream, models).select("id", "leverage").writeStream
    run = writer.format("memory").queryName("scored_stream").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("scored_stream").agg(F.count("*"), F.sum("leverage")).first()
    want = S.leverage_min(batch, models).agg(F.count("*"), F.sum("leverage")).first()
    assert got[0] == want[0] and abs(got[1] - want[1]) < 1e-6 * abs(want[1])
