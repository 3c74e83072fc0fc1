"""Vectors and scores that are no numbers, models in chunks, and sizes of schedules."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan.functions.kernels import linear, rbf
from kernspan.operators import classify, fit, ridge, sampling, stats
from kernspan.operators import score as S
from kernspan.plans import schedules, selection


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, x array<double>")


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.normal(size=3) + i % 3).tolist()) for i in range(120)]
    return vectors(spark, rows).persist()


def test_ragged_vectors_are_errors(spark):
    ragged = vectors(spark, [(1, 0, [1.0, 2.0]), (2, 0, [3.0, 1.0]), (77, 0, [1.0])])
    for make in (stats.vec_sum, stats.vec_mean, stats.vec_var):
        with pytest.raises(Exception, match="unequal length"):
            make(ragged).collect()
    moments = stats.vector_stats(ragged.where("id < 3"))
    with pytest.raises(Exception, match="unequal length.*77"):
        stats.standardize(ragged, stats=moments).collect()
    assert stats.vec_mean(ragged.where("id < 3")).first()["mean"] == [2.0, 1.5]
    assert stats.standardize(ragged.where("id < 0")).count() == 0


def test_null_elements_are_errors(spark, table):
    landmarks = table.limit(5).select(
        F.lit(0).alias("space_id"), F.col("id").cast("int").alias("ord"), "id", "x", F.lit(1.0).alias("reg")
    )
    models = fit.fit(landmarks, 0.1)
    with pytest.raises(Exception, match="null element.*5"):
        S.leverage_min(vectors(spark, [(5, 0, [1.0, None, 2.0])]), models).collect()


def test_scores_that_are_no_numbers_are_not_drawn(spark):
    rows = [(1, 2.0), (2, float("nan")), (3, None), (4, 0.9), (5, float("inf"))]
    df = spark.createDataFrame(rows, "id long, score double")
    ids = lambda d: {r["id"] for r in d.collect()}
    for seed in range(5):
        assert not ids(sampling.bernoulli_by_score(df, seed)) & {2, 3}
        assert not ids(sampling.bernoulli_two_stage(df, 0.9, seed)) & {2, 3}
        assert not ids(sampling.bernoulli_by_scaled_score(df, seed)) & {2, 3}
        assert not ids(sampling.bernoulli_by_scaled_score(df.where("id != 5"), seed, delta=0.1)) & {2, 3}
    assert [r["id"] for r in sampling.topk_by_score(df, 3).collect()] == [5, 1, 4]
    assert [r["id"] for r in sampling.bottomk_by_score(df, 3).collect()] == [4, 1, 5]


def test_a_row_without_numbers_does_not_steer_the_selection(spark, table):
    """One NaN feature: both ways through a round leave that row out."""
    odd = table.unionByName(vectors(spark, [(999, 0, [float("nan"), 0.0, 0.0])]))
    for small in (None, 60):
        bound = {} if small is None else {"max_bytes": small}
        original = selection.load_models
        selection.load_models = lambda m, k, p=False, b=bound: original(m, k, p, **b)  # noqa: B023
        try:
            chosen = selection.nystrom_spaces(odd, max_rows=20, max_spaces=2, max_non_improv=2)
        except ValueError as error:  # a model over the bound is refused, not mis-scored
            assert small and "one subspace" in str(error)
            continue
        finally:
            selection.load_models = original
        assert 999 not in {r["id"] for r in chosen.spaces.collect()}
        assert all(math.isfinite(row[4]) for row in chosen.history)


def test_classes_in_chunks_and_on_a_stream(spark, table, tmp_path):
    models = classify.fit_class_subspaces(table.where("id < 45"), 120, rbf(0.3))
    one = classify.classify_max_projection(table, models, rbf(0.3)).orderBy("id").collect()
    bound = 15 * 15 * 8 + 15 * 3 * 8
    chunked = classify.classify_max_projection(table, models, rbf(0.3), max_model_bytes=bound)
    assert len(list(S.model_chunks(models, rbf(0.3), max_bytes=bound))) == 3
    many = chunked.orderBy("id").collect()
    assert [(r["id"], r["pred_label"]) for r in one] == [(r["id"], r["pred_label"]) for r in many]
    assert np.allclose([r["residual"] for r in one], [r["residual"] for r in many])
    plan = chunked._jdf.queryExecution().toString()
    assert "Checkpoint" not in plan and "checkpoint" not in plan

    source = str(tmp_path / "rows")
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    for name, scored in (
        ("classes", classify.classify_max_projection(stream, models, rbf(0.3), max_model_bytes=bound)),
        ("least", S.leverage_min(stream, models, rbf(0.3), max_model_bytes=bound)),
    ):
        run = scored.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert sorted((r["id"], r["pred_label"]) for r in spark.table("classes").collect()) == sorted(
        (r["id"], r["pred_label"]) for r in one
    )
    want = S.leverage_min(table, models, rbf(0.3)).agg(F.sum("leverage")).first()[0]
    assert abs(spark.table("least").agg(F.sum("leverage")).first()[0] - want) < 1e-9


def test_moments_of_many_tasks_meet_in_two_steps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(640, 48))
    rows = spark.createDataFrame([(0, i, i, v.tolist(), 1.0) for i, v in enumerate(x)], "space_id int, ord int, id long, x array<double>, reg double")
    model = fit.fit(rows.repartition(64), 0.1, linear(), form="primal").first()
    assert model["m"] == 640
    assert np.allclose(np.array(model["s_flat"]).reshape(48, 48), x.T @ x)


def test_labels_without_value_are_no_class(spark):
    df = vectors(spark, [(1, None, [1.0]), (2, 3, [1.0]), (3, 1, [1.0]), (4, 3, [1.0])])
    assert ridge.class_list(df) == [1, 3]


def test_schedules_of_small_tables():
    for n in (1, 2, 3, 10):
        level, budget = schedules.halving_levels(n, 0.1)
        assert level == 1 and budget == 0.1
        assert schedules.SingleSpaceSchedule(n).rounds >= 1
        assert schedules.MultiSpaceSchedule(n).rounds >= 1
    for make in (
        lambda: schedules.halving_levels(0, 0.1),
        lambda: schedules.SingleSpaceSchedule(0).rounds,
        lambda: schedules.MultiSpaceSchedule(0).rounds,
    ):
        with pytest.raises(ValueError, match="empty"):
            make()
    level, budget = schedules.halving_levels(1_000_000, 0.1)
    assert budget == pytest.approx(0.1 / 3 ** (level - 1))
    bound = lambda k: schedules.level_size_bound(1_000_000, k)
    assert bound(level) <= -192 * math.log(budget) and bound(level - 1) > -192 * math.log(budget * 3)
