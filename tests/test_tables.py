"""Sources, statistics, packing, pooling, classifiers, session helpers."""

from __future__ import annotations

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernspan import session
from kernspan.functions import images
from kernspan.functions import vectors as V
from kernspan.functions.uniform import any_uniform_below, hash_uniform, uniform_below
from kernspan.operators import classify, packing, ridge, score, stats
from kernspan.operators import fit as fitting
from kernspan.sources import assign_row_id, scan_labeled_csv, scan_parquet_vectors
from tests import brute


def one(spark, *rows):
    return spark.createDataFrame([(list(map(float, r)),) for r in rows], "x array<double>")


def test_csv_with_headers_in_several_files(spark, tmp_path):
    for name, lines in (("a", "label,f1,f2\n1.0,2.5,3\n0.0,-1,1e2"), ("b", "label,f1,f2\n2.0,0,7")):
        (tmp_path / f"{name}.csv").write_text(lines + "\n")
    got = scan_labeled_csv(spark, str(tmp_path), ["f1"]).orderBy("label").collect()
    assert [(r["label"], r["x"]) for r in got] == [(0, [-1.0, 100.0]), (1, [2.5, 3.0]), (2, [0.0, 7.0])]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        scan_labeled_csv(spark, str(tmp_path)).collect()


def test_parquet_scan_reads_only_its_columns(spark, sf):
    df = scan_parquet_vectors(spark, f"{sf}/embeddings.parquet", features="embedding", row_id="vec_id")
    plan = df.select("id", "label")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan.split("ReadSchema")[1]
    numbered = scan_parquet_vectors(spark, f"{sf}/embeddings.parquet", features="embedding")
    assert numbered.select("id").distinct().count() == numbered.count()


def test_assigned_ids_are_unique_over_partitions(spark):
    df = assign_row_id(spark.range(1000).repartition(7).drop("id"))
    assert df.select("id").distinct().count() == 1000


def test_a_uniform_below_a_share(spark):
    df = spark.createDataFrame([(i,) for i in range(2000)] + [(None,)], "id long")
    us = [r["u"] for r in df.select(hash_uniform("id", "9/stage", 2).alias("u")).collect() if r["u"] is not None]
    for share in (0.0, 1e-3, 0.3, us[5], us[5] + 2**-33, 1 - 2**-32, 1 - 2**-34, 1.0, 2.0):
        both = df.select(
            (hash_uniform("id", "9/stage", 2) < F.lit(share)).alias("wanted"), uniform_below("id", "9/stage", 2, share).alias("found")
        ).collect()
        assert all(bool(r["wanted"]) == bool(r["found"]) for r in both)
        assert sum(bool(r["found"]) for r in both) == sum(u < share for u in us)


def test_uniforms(spark):
    df = spark.range(2000)
    rows = df.select("id", hash_uniform("id", 9, 2, 3).alias("u")).collect()
    assert all(r["u"] == brute.uniform(r["id"], 9, 2, 3) for r in rows)
    below = df.filter(any_uniform_below("id", 9, 2, 4, 0.01)).select("id").collect()
    want = [i for i in range(2000) if any(brute.uniform(i, 9, 2, p) < 0.01 for p in range(4))]
    assert sorted(r["id"] for r in below) == want


def test_zero_and_constant_cases(spark):
    assert one(spark, [0, 0]).select(V.normalize("x")).first()[0] is None
    assert one(spark, [0, 4]).select(V.reciprocal("x")).first()[0] == [None, 0.25]
    df = one(spark, [1, 5], [3, 5])
    for by, scaled in (("variance", 1.0), ("std", 1.0)):
        got = sorted(r["x"] for r in stats.standardize(df, by=by).collect())
        assert got == [[-scaled, 0.0], [scaled, 0.0]]


def test_packed_statistics_equal_row_statistics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 3))
    df = one(spark, *x).withColumn("id", F.monotonically_increasing_id())
    packs = packing.pack_vectors(df, n_packs=4)
    for fn, name, want in (
        (stats.vec_sum, "sum", x.sum(0)),
        (stats.vec_mean, "mean", x.mean(0)),
        (stats.vec_var, "var", x.var(0)),
    ):
        assert np.allclose(fn(df).first()[name], want)
        assert np.allclose(fn(packs, "x_pack", "cols").first()[name], want)
    centred = packs.select(V.on_pack("x_pack", "cols", lambda v: V.add_vec(v, [-1, 0, 1])).alias("p"), "x_pack")
    row = centred.first()
    shift = np.array(row["p"]).reshape(-1, 3) - np.array(row["x_pack"]).reshape(-1, 3)
    assert np.allclose(shift, [-1, 0, 1])


def test_a_hot_label_is_gathered_in_bounded_blocks(spark):
    df = spark.range(6000).select(
        "id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("label"),
        F.array(F.col("id").cast("double")).alias("x"),
    )
    blocks = packing.collect_by_label(df, pack_size=100)
    sizes = blocks.agg(F.max(F.size("ids")), F.sum(F.size("ids"))).first()
    assert sizes[0] < 180 and sizes[1] == 6000
    assert blocks.filter("label = 1").first()["label_rows"] == 4000
    unlabelled = packing.collect_by_label(df.withColumn("label", F.lit(None).cast("long")), 1000)
    assert unlabelled.agg(F.sum(F.size("ids"))).first()[0] == 6000


def test_pooling_sizes_and_values(spark):
    image = np.arange(28 * 28, dtype=float)
    rng = np.random.default_rng(4)
    rng.shuffle(image)
    square = image.reshape(28, 28)
    df = one(spark, image)
    got = df.select(images.max_pool("x", 28)).first()[0]
    want = [square[3 * i : 3 * i + 7, 3 * j : 3 * j + 7].max() for i in range(7) for j in range(7)]
    assert got == want
    assert len(df.select(images.max_pool("x", 28, full=True)).first()[0]) == 64
    means = square.reshape(7, 4, 7, 4).mean(axis=(1, 3)).ravel()
    got = df.select(images.avg_pool_normalize("x", 28, 4)).first()[0]
    assert np.allclose(got, means / np.linalg.norm(means))
    with pytest.raises(ValueError):
        images.max_pool("x", 5)


def labelled(spark, x, labels):
    rows = [(i, int(l), [float(v) for v in r]) for i, (r, l) in enumerate(zip(x, labels))]
    return spark.createDataFrame(rows, "id long, label long, x array<double>")


def test_equal_energies_go_to_the_smaller_label(spark):
    x = np.array([[1.0, 0.0], [0.0, 1.0], [2.0, 2.0], [3.0, 1.0]])
    df = labelled(spark, x, [7, 4, 0, 0])
    models = classify.fit_class_subspaces(df.filter("label > 0"), 4)
    rows = classify.classify_max_projection(df, models).orderBy("id").collect()
    assert [r["pred_label"] for r in rows] == [7, 4, 4, 7]
    energy = 9.0 / (1.0 + 1.0 / np.sqrt(4))
    assert np.isclose(rows[3]["residual"], 10.0 - energy)


def test_ridge_interpolates_as_lambda_vanishes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 8))
    labels = [3, 1, 2, 3, 1, 2]
    df = labelled(spark, x, labels)
    sp = df.select(F.lit(0).alias("space_id"), F.col("id").cast("int").alias("ord"), "id", "x", F.lit(1.0).alias("reg"))
    model = ridge.ridge_fit(sp, df, "label", 1e-10)
    got = [r["pred"] for r in ridge.ridge_predict(df, model).orderBy("id").collect()]
    assert np.allclose(got, labels, atol=1e-6)
    classes = ridge.class_list(df)
    assert classes == [1, 2, 3]
    many = ridge.ridge_fit_multi(sp, df, ridge.one_hot("label", classes), 1e-10)
    voted = ridge.ridge_classify_vote(df, many, classes).orderBy("id").collect()
    assert [r["pred_label"] for r in voted] == labels


@pytest.mark.parametrize("gamma", [None, 0.5])
def test_ridge_of_several_spaces_matches_numpy(spark, gamma):
    from kernspan.functions import kernels

    kernel, k = (kernels.linear(), brute.linear) if gamma is None else (kernels.rbf(gamma), brute.rbf(gamma))
    rng = np.random.default_rng(7)
    x, f = rng.normal(size=(20, 3)), rng.normal(size=20)
    rows = [(i, float(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, f))]
    df = spark.createDataFrame(rows, "id long, f double, x array<double>")
    picks = {0: [3, 9, 1], 1: [5, 2, 11, 7]}
    data = [(s, o, i, [float(v) for v in x[i]], 0.5) for s, ids in picks.items() for o, i in enumerate(ids)]
    sp = spark.createDataFrame(data, "space_id int, ord int, id long, x array<double>, reg double")
    model = ridge.ridge_fit(sp, df, "f", 0.3, kernel)
    got = ridge.ridge_predict_spaces(df, model, kernel).orderBy("id").collect()
    small = ridge.ridge_predict_spaces(df, model, kernel, max_model_bytes=4 * 5 * 8)
    passes = [r["predictions"] for r in small.orderBy("id").collect()]
    assert np.allclose(passes, [r["predictions"] for r in got])
    for s, ids in picks.items():
        alpha = np.linalg.solve(brute.gram(x[ids], np.full(len(ids), 0.5), 0.3, k), f[ids])
        assert np.allclose([r["predictions"][s][0] for r in got], alpha @ k(x[ids], x))


def test_class_models_match_numpy(spark):
    rng = np.random.default_rng(8)
    x, labels = rng.normal(size=(30, 4)), rng.integers(0, 3, 30)
    df = labelled(spark, x, labels)
    dual = classify.fit_class_subspaces(df, 30)
    primal = classify.fit_class_subspaces(df, 30, form="primal")
    want = np.array(
        [
            brute.leverages(x[labels == c], np.ones((labels == c).sum()), 30**-0.5, x, brute.linear)
            for c in range(3)
        ]
    )
    for models in (dual, primal):
        rows = classify.classify_max_projection(df, models).orderBy("id").collect()
        assert [r["pred_label"] for r in rows] == list(want.argmin(0))
        assert np.allclose([r["residual"] for r in rows], want.min(0))
    g = fitting.gram_inverse(dual).filter("space_id = 1").orderBy("i", "j").collect()
    inverse = np.linalg.inv(brute.gram(x[labels == 1], np.ones((labels == 1).sum()), 30**-0.5, brute.linear))
    assert np.allclose([r["g_inv"] for r in g], inverse.ravel())


def test_quantiles_are_within_their_rank_error(spark):
    df = spark.range(10_000).select((F.pmod(F.col("id") * 7919, F.lit(10_007))).cast("double").alias("leverage"))
    values = np.sort([r[0] for r in df.collect()])
    for row in stats.score_quantiles(df).collect():
        rank = np.searchsorted(values, row["value"], side="right")
        assert abs(rank - row["probability"] * 10_000) <= 101


def test_broadcast_only_below_its_bound(spark):
    df = spark.range(100)
    plan = lambda d: d._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(session.broadcast_if_small(df, 100)).lower()
    assert "broadcast" not in plan(session.broadcast_if_small(df, 99)).lower()
    wide = df.select(F.repeat(F.lit("x"), 1000).alias("text"), F.array("id", "id").alias("pair"))
    assert "broadcast" in plan(session.broadcast_if_small(wide, 100)).lower()
    assert "broadcast" not in plan(session.broadcast_if_small(wide, 100, 100_000)).lower()


def test_checkpoints_go_to_the_session_folder(spark):
    folder = session.checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir() == folder
    assert session.scratch_path(spark, "t").startswith(folder)
    df = session.materialize(spark.range(10))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def _packed_norms(spark, n):
    """One pack of n vectors of 4, derived as ``pack_vectors`` derives it."""
    x = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.col("id") + i).cast("double"))
    return score.kernel_norms_packed(packing.pack_vectors(spark.range(n).select("id", x.alias("x")), n))


def _expected_norms(n):
    return [float(sum((i + d) ** 2 for d in range(4))) for i in range(n)]


def test_large_pack_is_cut_in_linear_time(spark):
    n = 30_000
    start = time.perf_counter()
    rows = _packed_norms(spark, n).select(F.posexplode("k_norms").alias("pos", "value")).collect()
    assert time.perf_counter() - start < 20
    assert [tuple(r) for r in rows] == list(enumerate(_expected_norms(n)))


def test_scores_of_a_large_pack_explode_in_linear_time(spark):
    n = 30_000
    start = time.perf_counter()
    scores = packing.explode_scores(_packed_norms(spark, n), "k_norms").collect()
    assert time.perf_counter() - start < 20
    assert [r["score"] for r in scores] == _expected_norms(n)


def test_packs_of_empty_and_null_arrays(spark):
    packs = spark.createDataFrame([([], 2), (None, 2), ([1.0, None, 3.0, 4.0], 2)], "p array<double>, n int")
    cut = [r["c"] for r in packs.select(V.split_array("p", "n").alias("c")).collect()]
    assert cut[0] == [[], []] and cut[2] == [[1.0, None], [3.0, 4.0]]


def test_scores_are_derived_once_to_be_exploded(spark):
    plan = packing.explode_scores(_packed_norms(spark, 10), "k_norms")._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("aggregate(") == 1
    packs = spark.createDataFrame([([1.0, None],), ([],), (None,)], "s array<double>")
    assert [tuple(r) for r in packing.explode_scores(packs, "s", "out").collect()] == [(1.0,), (None,)]
