"""Selection loops and collections against brute force on a small table."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kernspan.functions import kernels
from kernspan.functions.uniform import hash_uniform
from kernspan.operators import fit as fitting
from kernspan.operators import landmarks, packing, sampling
from kernspan.operators.score import Space
from kernspan.operators.spaces import SubspaceCollection
from kernspan.plans import selection
from kernspan.plans.schedules import MultiSpaceSchedule, SingleSpaceSchedule, halving_levels
from tests import brute
from verification import relations as R


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(4, 6)) * 2
    rows = np.vstack([c + 0.6 * rng.normal(size=(40, 6)) for c in centres]) / 2
    data = [(int(i), [float(v) for v in row]) for i, row in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, x array<double>").persist()
    return df, rows


def kept_ids(spaces):
    rows = spaces.orderBy("space_id", "ord").select("space_id", "id").collect()
    out: dict = {}
    for row in rows:
        out.setdefault(row["space_id"], []).append(row["id"])
    return [out[s] for s in sorted(out)]


@pytest.mark.parametrize("kernel_name", ["linear", "rbf"])
def test_multi_space_loop_matches_brute_force(small, kernel_name):
    df, rows = small
    kernel, k = {
        "linear": (kernels.linear(), brute.linear),
        "rbf": (kernels.rbf(0.4), brute.rbf(0.4)),
    }[kernel_name]
    got = selection.nystrom_spaces(
        df, kernel, seed=5, max_rows=9, max_spaces=3, max_non_improv=2, max_rounds=7
    )
    want, totals = brute.multi_space(
        list(range(len(rows))), rows, k, 5, 9, 3, 2, max_rounds=7
    )
    assert kept_ids(got.spaces) == want
    assert np.allclose([h[4] for h in got.history], totals, rtol=1e-8)
    kept = [h for h in got.history if h[5]]
    assert all(a[4] > b[4] for a, b in zip(kept, kept[1:]))


def test_full_loop_on_given_vectors_matches_brute_force(spark, sf):
    df = R.vectors(spark, sf)
    table = sorted((r["id"], r["x"]) for r in df.select("id", "x").collect())
    ids, rows = [i for i, _ in table], np.array([x for _, x in table])
    got = selection.nystrom_spaces(df, seed=R.SEED, max_rows=100, max_non_improv=2)
    want, totals = brute.multi_space(ids, rows, brute.linear, R.SEED, 100, 5, 2)
    assert np.allclose([h[4] for h in got.history], totals, rtol=1e-7)
    assert kept_ids(got.spaces) == want


def test_packed_loop_selects_the_same(small):
    df, _ = small
    options = {"seed": 5, "max_rows": 9, "max_spaces": 3, "max_rounds": 4}
    plain = selection.nystrom_spaces(df, **options)
    packed = selection.nystrom_spaces_packed(packing.pack_vectors(df, 32), **options)
    assert kept_ids(plain.spaces) == kept_ids(packed.spaces)


def test_loop_does_not_depend_on_partitions(small):
    df, _ = small
    options = {"seed": 8, "max_rows": 7, "max_rounds": 3}
    one = selection.nystrom_spaces(df.coalesce(1), **options)
    many = selection.nystrom_spaces(df.repartition(17), **options)
    assert kept_ids(one.spaces) == kept_ids(many.spaces)


def test_inputs_too_large_for_memory_are_scanned_again(small, monkeypatch):
    df, _ = small
    options = {"seed": 8, "max_rows": 7, "max_rounds": 3}
    kept = selection.nystrom_spaces(df, **options)
    monkeypatch.setattr(selection, "SPREAD_ROWS", 0)
    scanned = selection.nystrom_spaces(df, **options)
    assert kept_ids(kept.spaces) == kept_ids(scanned.spaces)


def test_a_larger_input_is_derived_once_for_all_rounds(small, tmp_path, monkeypatch):
    df, rows = small
    monkeypatch.setattr(selection, "SPREAD_ROWS", 0)
    seen = tmp_path / "seen"

    def derive(batches):
        for batch in batches:
            with open(seen, "a") as file:
                file.write(f"{len(batch)}\n")
            yield batch

    derived = df.mapInArrow(derive, df.schema)
    plans = [
        lambda: selection.nystrom_bless(derived, max_rounds=4, n_rows=len(rows)),
        lambda: selection.nystrom_spaces(derived, max_rows=7, max_rounds=4, n_rows=len(rows)),
        lambda: selection.nystrom_refine(derived, start, rounds=4),
    ]
    start = selection.nystrom_spaces(df, max_rows=7, max_rounds=1).spaces
    # refinement counts its rows before
    for plan, passes in zip(plans, (1, 1, 2)):
        seen.write_text("")
        assert plan().spaces.count()
        assert sum(map(int, seen.read_text().split())) <= passes * len(rows)


def test_models_beyond_the_broadcast_bound_select_the_same(small, monkeypatch):
    df, _ = small
    options = {"seed": 8, "max_rows": 7, "max_rounds": 3}
    want = [
        selection.nystrom_spaces(df, **options),
        selection.nystrom_bless(df, **options),
    ]
    load = selection.load_models
    monkeypatch.setattr(
        selection, "load_models", lambda m, k: [[space] for space in load(m, k)[0]] + [[]]
    )
    got = [
        selection.nystrom_spaces(df, **options),
        selection.nystrom_bless(df, **options),
    ]
    for a, b in zip(want, got):
        assert kept_ids(a.spaces) == kept_ids(b.spaces)
        assert np.allclose([h[4] for h in a.history], [h[4] for h in b.history])


def test_an_empty_draw_keeps_the_slots_and_counts_a_miss(spark):
    # equal rows: many landmarks leave the others next to no leverage
    rows = np.tile([0.3, 0.0], (30, 1))
    options = (30, 2, 3)
    for seed in range(100):
        sizes: list[int] = []
        want, totals = brute.multi_space(
            list(range(30)), rows, brute.linear, seed, *options, sizes=sizes
        )
        if 0 in sizes:
            break
    df = spark.range(30).select("id", F.array(F.lit(0.3), F.lit(0.0)).alias("x"))
    got = selection.nystrom_spaces(
        df, seed=seed, max_rows=30, max_spaces=2, max_non_improv=3
    )
    assert [h[2] for h in got.history][1:] == sizes and 0 in sizes
    assert np.allclose([h[4] for h in got.history], totals)
    assert kept_ids(got.spaces) == want


def test_bless_matches_brute_force(small):
    df, rows = small
    n, ids = len(rows), list(range(len(rows)))
    got = selection.nystrom_bless(df, seed=3, max_rows=25, max_rounds=4)
    plan = SingleSpaceSchedule(n)
    factor = plan.score_factor
    scores = np.minimum((rows**2).sum(1) * factor, 1)
    for i in range(4):
        picked = brute.draw(ids, scores, 3, i, 25, plan.beta_at(i), ascending=i == 0)
        lam = plan.lambda_at(i) * n
        leverage = brute.leverages(rows[picked], scores[picked], lam, rows, brute.linear)
        assert math.isclose(got.history[i][4], leverage.sum(), rel_tol=1e-8)
        scores = np.minimum(leverage * factor, 1)
    assert kept_ids(got.spaces) == [picked]


def halving_brute(rows, seed, lam, delta, kernel=brute.cosine):
    ids = range(len(rows))
    levels, d = halving_levels(len(rows), delta)
    u = np.array([brute.uniform(i, seed) for i in ids])
    chosen = [i for i in ids if u[i] < 0.5**levels]
    for r in range(1, levels + 1):
        d *= 3
        subset = [i for i in ids if r == levels or u[i] < 0.5 ** (levels - r)]
        score = 1.5 / lam * brute.leverages(
            rows[chosen], np.ones(len(chosen)), lam, rows[subset], kernel
        )
        bound = math.log(score.sum() / d)
        chosen += [
            i for i, s in zip(subset, score) if brute.uniform(i, seed, r) < s * bound
        ]
    return chosen


def test_halving_and_refine_match_brute_force(small, monkeypatch):
    df, rows = small
    got = selection.nystrom_halving(df, seed=2, lam=0.5)
    want = halving_brute(rows, 2, 0.5, 0.1)
    ids = [r["id"] for r in got.spaces.orderBy("ord", "id").collect()]
    assert ids == want
    load = selection.load_models
    with monkeypatch.context() as patch:
        patch.setattr(selection, "load_models", lambda m, k: [*load(m, k), []])
        passes = selection.nystrom_halving(df, seed=2, lam=0.5)
    assert [r["id"] for r in passes.spaces.orderBy("ord", "id").collect()] == want
    assert np.allclose([h[4] for h in passes.history[1:]], [h[4] for h in got.history[1:]])
    refined = selection.nystrom_refine(df, got.spaces, seed=2, lam=0.5, rounds=2)
    for i in (1000, 1001):
        score = 3.0 * brute.leverages(rows[want], np.ones(len(want)), 0.5, rows, brute.cosine)
        want = want + [r for r in range(len(rows)) if brute.uniform(r, 2, i) < score[r]]
    ids = [r["id"] for r in refined.spaces.orderBy("ord", "id").collect()]
    assert ids == want


def test_schedules():
    plan = MultiSpaceSchedule(1000)
    assert plan.rounds == 9
    assert [plan.lambda_at(i) for i in (0, 1, 8, 50)] == [1.0, 0.5, 2**-8, 2**-8]
    assert math.isclose(plan.score_factor, math.log(12 * 9 * 1000 / 0.9))
    single = SingleSpaceSchedule(10_000)
    assert single.rounds == 14 and math.isclose(single.base_lambda, 1 / 0.3)
    assert math.isclose(
        single.score_factor, 54 * (2.09 / 0.09) * math.log(12 * 14 * 10_000 / 0.9)
    )
    assert 0 < single.beta_at(0) < single.beta_at(5) <= 1.0
    levels, delta = halving_levels(50_000, 0.1)
    assert levels == 6 and math.isclose(delta, 0.1 / 3**5)


def collection_of(spark, count, capacity):
    rng = np.random.default_rng(1)

    def sample(number):
        rows = [
            (o, 100 * number + o, [float(v) for v in rng.normal(size=3)], 1.0) for o in range(4)
        ]
        return spark.createDataFrame(rows, "ord int, id long, x array<double>, reg double")

    built = SubspaceCollection.create(sample(0), 0.1, capacity=capacity)
    for number in range(1, count):
        built = built.append(sample(number))
    return built, sample


def slots(built):
    rows = built.spaces.groupBy("space_id").agg(F.min("id").alias("first")).collect()
    assert sorted(r["space_id"] for r in built.models.collect()) == sorted(
        r["space_id"] for r in rows
    )
    return {r["space_id"]: r["first"] // 100 for r in rows}


def test_collection_slots(spark):
    built, sample = collection_of(spark, 3, 3)
    with pytest.raises(ValueError, match="slots are taken"):
        built.append(sample(3))
    wrapped = built.append_circular(sample(3))
    assert slots(wrapped) == {0: 3, 1: 1, 2: 2}
    again = wrapped.append_circular(sample(4))
    assert slots(again) == {0: 3, 1: 4, 2: 2}
    assert slots(built) == {0: 0, 1: 1, 2: 2}, "the earlier value must not change"
    removed = again.remove(0)
    assert slots(removed) == {0: 2, 1: 4}
    assert slots(removed.append(sample(5))) == {0: 2, 1: 4, 2: 5}
    with pytest.raises(IndexError):
        removed.remove(2)
    refit = built.update_lambda(0.9)
    assert {r["lambda"] for r in refit.models.collect()} == {0.9}
    assert {r["lambda"] for r in built.models.collect()} == {0.1}


@pytest.mark.parametrize("k", [1, 37, 480, 700, 2000])
def test_topk_by_histogram_equals_a_sort(spark, monkeypatch, k):
    monkeypatch.setattr(sampling, "SORTED_ROWS", 8)
    monkeypatch.setattr(sampling, "BINS", 5)
    rng = np.random.default_rng(9)
    odd = [float("inf"), float("-inf"), float("nan"), None, 0.25, 0.25, -0.0, 0.0]
    rows = []
    for i in range(900):
        score = odd[i % 8] if i % 3 == 0 else float(np.round(rng.normal(), 2))
        rows.append((2**53 + 900 - i, score, float(rng.integers(0, 4))))
    df = spark.createDataFrame(rows, "id long, score double, coin double")
    for cut, sign in ((sampling.topk_by_score, -1), (sampling.bottomk_by_score, 1)):

        def place(row, sign=sign):
            bare = row[1] is None or row[1] != row[1]
            return (bare, 0.0 if bare else sign * row[1], row[2], row[0])

        want = [r[0] for r in sorted(rows, key=place)[:k]]
        assert [r["id"] for r in cut(df, k, ties=("coin", "id")).collect()] == want


def test_uniform_spaces_draws_the_smallest_coins(spark, sf):
    df = R.lineitem(spark, sf)
    spaces = landmarks.uniform_spaces(df, 5, 12, "s")
    ids = [r["id"] for r in df.select("id").collect()]
    for space in range(5):
        coins = sorted((brute.uniform(i, "s", space // 4, space % 4), i) for i in ids)
        got = spaces.filter(F.col("space_id") == space).orderBy("ord").collect()
        assert [r["id"] for r in got] == [i for _, i in coins[:12]]


def test_fit_refuses_groups_beyond_the_bound(spark, small):
    df, _ = small
    sp = df.select(F.lit(0).alias("space_id"), F.col("id").alias("ord"), "id", "x", F.lit(1.0).alias("reg"))
    with pytest.raises(ValueError, match="fit form='primal'"):
        fitting.fit(sp, 0.1, max_landmarks=50)
    assert fitting.fit(sp, 0.1, form="primal", max_landmarks=50).first()["m"] == 160


@pytest.mark.parametrize("beta", [None, 0.0, 0.3, 1.0])
def test_coins_of_a_block_are_those_of_the_table(spark, beta):
    texts = ["", "a", "äÿ€", "x" * 46, "y" * 47, "z" * 300, None, *map(str, range(-20, 400))]
    df = spark.createDataFrame([(t, [1.0]) for t in texts], "id string, x array<double>")
    coin = hash_uniform("id", 42, 17)
    if beta is not None:
        coin = F.when(hash_uniform("id", "42/stage", 17) < beta, coin)
    want = [r["c"] for r in df.select(coin.alias("c")).collect()]
    keys = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    got = selection._Coins(42, 17, beta).of(keys)
    assert [None if np.isnan(c) else c for c in got] == want


def test_a_packed_copy_holds_every_row(spark):
    rows = [(f"r{i}" if i % 7 else None, [float(i), -1.0] if i % 5 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "id string, x array<double>")
    packed = selection._Packed.of(df, 3)
    assert 6 < packed.cells.count() < 200
    found = [(r["id"], r["x"]) for r in packed.rows().collect()]
    assert sorted(found, key=str) == sorted(rows, key=str)
    assert selection._Packed.of(df.limit(0), 3).rows().count() == 0


def test_a_scan_of_packed_cells_draws_as_one_of_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3).round(1)]) for i in range(40_000)]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(2)
    now, upcoming = [Space(0, np.eye(3), None, True)], [Space(0, np.diag([0.5, 0.2, 0.1]), None, True)]

    def drawn(table):
        shared = selection._shared(df, now, upcoming)
        scan = selection._reduced_scan(table, selection._Coins(1, 2), shared, kernels.linear(), 2.0, True, 5)
        found = scan.collect()
        best = sorted((-r["rank"], r["coin"], r["id"]) for r in found if r["total"] is None)[:5]
        return best, round(sum(r["total"] or 0.0 for r in found), 6)

    score = {i: min(2.0 * ((0.5 * a) ** 2 + (0.2 * b) ** 2 + (0.1 * c) ** 2), 1.0) for i, (a, b, c) in rows}
    coins = {i: brute.uniform(i, 1, 2) for i, _ in rows}
    want = sorted((-round(s, 9), coins[i], i) for i, s in score.items() if s >= coins[i])[:5]
    for table in (df, selection._Packed.of(df, 2)):
        best, total = drawn(table)
        assert [b[1:] for b in best] == [w[1:] for w in want]
        assert total == pytest.approx(sum(v * v for _, x in rows for v in x))


def test_the_first_draw_of_a_copied_table_is_one_scan(spark, monkeypatch):
    rng = np.random.default_rng(31)
    rows = [(i, [float(v) for v in rng.normal(size=3) * rng.choice([0.01, 1.0])]) for i in range(600)]
    df = spark.createDataFrame([*rows, (None, [1.0, 2.0, 3.0]), (900, None)], "id long, x array<double>")

    def kept():
        bless = selection.nystrom_bless(df, max_rows=40, max_rounds=2).spaces
        spaces = selection.nystrom_spaces(df, max_rows=30, max_rounds=2).spaces
        return [sorted(t.select("space_id", "ord", "id", "x", F.round("reg", 9)).collect()) for t in (bless, spaces)]

    expected = kept()
    monkeypatch.setattr(selection, "SPREAD_ROWS", 0)
    monkeypatch.setattr(selection, "_draw", None)
    assert kept() == expected and all(expected)
