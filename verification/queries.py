"""One query per operator. Each takes (spark, folder) and returns a DataFrame.

Doubles are rounded so that two engines agree on them; arrays are exploded to
scalar rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernspan.functions import images, kernels
from kernspan.functions import vectors as V
from kernspan.functions.uniform import hash_uniform
from kernspan.operators import classify, landmarks, packing, ridge, sampling, stats
from kernspan.operators import fit as fitting
from kernspan.operators import score as S
from kernspan.operators import tiles
from kernspan.operators.spaces import SubspaceCollection
from kernspan.plans import selection
from kernspan.session import materialize, scratch_path
from kernspan.sources import (
    assign_row_id,
    combine_splits,
    drop_header_rows,
    scan_labeled_csv,
    scan_parquet_vectors,
    sink_parquet_vectors,
)
from verification import relations as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: parameters shared with the SQL
PACK_SIZE = 5_000
SMALL_PACK = 250
SAMPLE_SHARE = 0.3
TOP_K = 50
SCORE_FACTOR = 0.8
OFFSETS = [0.5, -1.0, 2.0, 0.25]
BLESS_ROWS = 5_000
SELECT_ROWS = 1_000
SELECT_SPACES = 5
SELECT_MISSES = 10
REFINE_ROUNDS = 20
NEAREST = 7
#: landmarks of a block where a query cuts its few landmarks into several tiles
SMALL_TILE = 5
RBF_GAMMA = 0.02
LEVELS = 6
QUANTILE_ERROR = 1e-5
CSV_HEADER = "label,quantity,price,discount,tax"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: Column | str, digits: int = 6) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column, digits) + F.lit(0.0)


def exploded(df: DataFrame, array: Column | str, *keys: str, digits: int = 6) -> DataFrame:
    """keys, pos, value of an array column."""
    return df.select(*keys, F.posexplode(array).alias("pos", "v")).select(
        *keys, F.col("pos").cast("long").alias("pos"), r6("v", digits).alias("value")
    )


def per_vector(fn: Callable[[str], Column], table=R.events, digits: int = 6) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return exploded(table(spark, sf).select("id", fn("x").alias("y")), "y", "id", digits=digits)

    return run


def fitted(table: DataFrame, lam: float = R.LAMBDA, **options) -> tuple[DataFrame, DataFrame]:
    sp = R.spaces(table)
    return sp, fitting.fit(sp, lam, **options)


# ------------------------------------------------------------ sources and sinks


def _write_csv(spark: SparkSession, sf: str) -> str:
    """The order lines as compressed CSV, label first, a header in each file."""
    table = R.lineitem(spark, sf)
    path = scratch_path(spark, "csv")
    named = table.select(
        F.col("label").cast("double").alias("label"),
        *[F.col("x")[i].alias(n) for i, n in enumerate(CSV_HEADER.split(",")[1:])],
    )
    named.write.csv(path, header=True, compression="gzip")
    return path


@query
def scan_labeled_csv_(spark, sf):
    table = scan_labeled_csv(spark, _write_csv(spark, sf), ["quantity"])
    values = [F.col("x")[i].alias(f"x{i}") for i in range(4)]
    return table.groupBy("label", F.size("x").cast("long").alias("dim"), *values).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def drop_header_rows_(spark, sf):
    lines = spark.read.text(_write_csv(spark, sf))
    kept = drop_header_rows(lines, ["quantity", "label"])
    return kept.groupBy(F.substring_index("value", ",", 1).alias("label_text")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def scan_parquet_vectors_(spark, sf):
    table = scan_parquet_vectors(
        spark, f"{sf}/embeddings.parquet", features="embedding", row_id="vec_id"
    )
    return exploded(table, "x", "id", "label")


@query
def sink_parquet_vectors_(spark, sf):
    path = scratch_path(spark, "vectors")
    sink_parquet_vectors(R.events_raw(spark, sf), path)
    return exploded(spark.read.parquet(path), "x", "id", "label")


@query
def combine_splits_(spark, sf):
    table = R.vectors(spark, sf)
    u = hash_uniform("id", "split")
    return combine_splits(
        {
            "train": table.filter(u < 0.7),
            "valid": table.filter((u >= 0.7) & (u < 0.8)),
            "test": table.filter(u >= 0.8),
        }
    ).select("id", "label", "split", F.size("x").alias("dim"))


# ------------------------------------------------------------ projections, filters


@query
def select_struct_fields(spark, sf):
    pairs = R.events(spark, sf).select(F.struct("id", "label", "x").alias("row"))
    return pairs.select(
        F.col("row.id").alias("id"),
        F.col("row.label").alias("label"),
        r6(F.col("row.x")[0]).alias("first"),
    )


@query
def assign_row_id_(spark, sf):
    table = assign_row_id(R.lineitem(spark, sf).drop("id"))
    return table.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"))


@query
def vector_dim(spark, sf):
    return reduce(
        DataFrame.unionByName,
        [
            stats.vector_dim(table(spark, sf)).withColumn("relation", F.lit(name))
            for name, table in (("embeddings", R.vectors), ("lineitem", R.lineitem))
        ],
    )


@query
def filter_by_ids(spark, sf):
    table = R.events(spark, sf)
    return landmarks.filter_by_ids(table, R.spaces(table)).select("id", "label")


def _scored(table: DataFrame) -> DataFrame:
    """Min leverage as the score, scaled into the range of probabilities."""
    _, models = fitted(table)
    return S.leverage_min(table, models, out="score")


@query
def cap_to_one(spark, sf):
    scored = R.events(spark, sf).withColumn("score", V.norm("x") * SCORE_FACTOR)
    return scored.select("id", r6(V.cap_to_one("score")).alias("capped"))


@query
def scale_scores(spark, sf):
    scored = sampling.scale_scores(_scored(R.events(spark, sf)), 1.5 / R.LAMBDA)
    return scored.select("id", r6("score").alias("score"))


def _probable(spark, sf) -> DataFrame:
    """Scores between 0 and 2: some rows are certain, most are not."""
    return sampling.scale_scores(_scored(R.events(spark, sf)), 10.0)


@query
def bernoulli_by_score(spark, sf):
    kept = sampling.bernoulli_by_score(_probable(spark, sf), R.SEED, 7)
    return kept.select("id", r6("score").alias("score"))


@query
def bernoulli_two_stage(spark, sf):
    kept = sampling.bernoulli_two_stage(_probable(spark, sf), SAMPLE_SHARE, R.SEED, 7)
    return kept.select("id", r6("score").alias("score"))


@query
def bernoulli_by_scaled_score(spark, sf):
    scored = materialize(_scored(R.events(spark, sf)).select("id", "score"))
    kept = sampling.bernoulli_by_scaled_score(scored, R.SEED, 7, delta=0.1)
    return kept.select("id", r6("score").alias("score"))


@query
def sample_fraction(spark, sf):
    return sampling.sample_fraction(R.lineitem(spark, sf), SAMPLE_SHARE, R.SEED, 3).select("id")


@query
def level_filter(spark, sf):
    leveled = sampling.with_nested_level(R.lineitem(spark, sf), LEVELS, R.SEED)
    return sampling.level_filter(leveled, 2).select("id", "level")


# ------------------------------------------------------------ joins


@query
def landmark_cross_join(spark, sf):
    table = R.vectors(spark, sf)
    pairs = S.landmark_pairs(table, R.spaces(table))
    return pairs.select("id", "space_id", "ord", "landmark_id")


@query
def landmark_semi_join(spark, sf):
    table = R.events(spark, sf)
    joined = landmarks.landmark_semi_join(table, R.spaces(table))
    return joined.select("space_id", "ord", "id", "label")


@query
def align_labels_to_landmarks(spark, sf):
    table = R.events(spark, sf)
    aligned = landmarks.align_labels_to_landmarks(table, R.spaces(table))
    return exploded(aligned, "labels", "space_id")


# ------------------------------------------------------------ aggregates


@query
def vec_sum(spark, sf):
    # cents are exact in both engines; the sum of a price column is not
    return exploded(stats.vec_sum(R.lineitem(spark, sf)), "sum", digits=2)


@query
def vec_sum_packed(spark, sf):
    packs = packing.pack_vectors(R.events(spark, sf), PACK_SIZE)
    return exploded(stats.vec_sum(packs, "x_pack", "cols"), "sum")


@query
def vec_mean(spark, sf):
    return exploded(stats.vec_mean(R.lineitem(spark, sf)), "mean")


@query
def vec_var(spark, sf):
    return exploded(stats.vec_var(R.lineitem(spark, sf)), "var", digits=2)


@query
def vec_var_wide(spark, sf):
    return exploded(stats.vec_var(R.vectors(spark, sf)), "var", digits=9)


@query
def row_count(spark, sf):
    return stats.row_count(R.lineitem(spark, sf))


def _chosen(table: DataFrame) -> DataFrame:
    return landmarks.filter_by_ids(table, R.spaces(table))


@query
def label_histogram(spark, sf):
    return stats.label_histogram(_chosen(R.events(spark, sf)))


@query
def collect_by_label(spark, sf):
    blocks = packing.collect_by_label(R.events(spark, sf), pack_size=500)
    return blocks.select(
        "label", "block", "label_rows", F.posexplode(F.arrays_zip("ids", "xs")).alias("pos", "m")
    ).select(
        "label",
        "block",
        "label_rows",
        F.col("pos").cast("long").alias("pos"),
        F.col("m.ids").alias("id"),
        *[r6(F.col("m.xs")[i]).alias(f"x{i}") for i in range(4)],
    )


@query
def total_leverage(spark, sf):
    total = stats.total_leverage(_scored(R.events(spark, sf)), "score")
    return total.select(r6("total_leverage", 5).alias("total_leverage"))


@query
def total_leverage_lineitem(spark, sf):
    """The scale fixture: every order line scored against three subspaces."""
    table = stats.standardize(R.lineitem(spark, sf), by="std")
    _, models = fitted(table, form="primal")
    total = stats.total_leverage(S.leverage_min(table.select("x"), models))
    return total.select(r6("total_leverage", 4).alias("total_leverage"))


@query
def mean_leverage(spark, sf):
    mean = stats.mean_leverage(_scored(R.events(spark, sf)), "score")
    return mean.select(r6("mean_leverage").alias("mean_leverage"))


@query
def score_describe(spark, sf):
    described = stats.score_describe(_scored(R.events(spark, sf)), "score")
    return described.select("n", *[r6(c).alias(c) for c in ("mean", "stddev", "min", "max")])


@query
def score_quantiles(spark, sf):
    """The deciles, with a sketch fine enough to be exact below 100,000 rows."""
    quantiles = stats.score_quantiles(
        _scored(R.events(spark, sf)), "score", relative_error=QUANTILE_ERROR
    )
    return quantiles.select("probability", r6("value").alias("value"))


@query
def match_summary(spark, sf):
    summary = stats.match_summary(_classified(spark, sf))
    return summary.select("is_match", "n_rows", r6("residual_sum", 5).alias("residual_sum"))


@query
def space_sizes(spark, sf):
    return landmarks.space_sizes(R.spaces(R.events(spark, sf)))


# ------------------------------------------------------------ sorts and set operations


@query
def topk_by_score(spark, sf):
    best = sampling.topk_by_score(_scored(R.events(spark, sf)), TOP_K)
    return best.select("id", r6("score").alias("score"))


@query
def bottomk_by_score(spark, sf):
    least = sampling.bottomk_by_score(_scored(R.events(spark, sf)), TOP_K)
    return least.select("id", r6("score").alias("score"))


@query
def landmark_union(spark, sf):
    sp = R.spaces(R.events(spark, sf))
    first = sp.filter(F.col("space_id") < 2)
    second = sp.filter(F.col("space_id") > 0)
    return landmarks.landmark_union(first, second).select("space_id", "ord", "id")


@query
def chosen_ids_union(spark, sf):
    return landmarks.chosen_ids_union(R.spaces(R.events(spark, sf)))


# ------------------------------------------------------------ vector functions


@query
def vec_norm_sqr(spark, sf):
    return R.events(spark, sf).select("id", r6(V.norm_sqr("x")).alias("norm_sqr"))


@query
def vec_norm(spark, sf):
    return R.events(spark, sf).select("id", r6(V.norm("x")).alias("norm"))


QUERIES["vec_normalize"] = per_vector(V.normalize)
QUERIES["vec_add_vec"] = per_vector(lambda x: V.add_vec(x, OFFSETS))
QUERIES["vec_mul_vec"] = per_vector(lambda x: V.mul_vec(x, OFFSETS))
QUERIES["vec_div_vec"] = per_vector(lambda x: V.div_vec(x, OFFSETS))
QUERIES["vec_add_scalar"] = per_vector(lambda x: V.add_scalar(x, 1.25))
QUERIES["vec_mul_scalar"] = per_vector(lambda x: V.mul_scalar(x, -3.0))
QUERIES["vec_div_scalar"] = per_vector(lambda x: V.div_scalar(x, 7.0))
QUERIES["vec_square"] = per_vector(V.square)
QUERIES["vec_reciprocal"] = per_vector(V.reciprocal, table=R.events_raw)
QUERIES["max_pool"] = per_vector(lambda x: images.max_pool(x, 8, 3, 2), table=R.vectors)
QUERIES["avg_pool_normalize"] = per_vector(
    lambda x: images.avg_pool_normalize(x, 8, 2), table=R.vectors
)


@query
def split_array(spark, sf):
    table = R.vectors(spark, sf)
    rows = table.select("id", F.posexplode(V.split_array("x", F.lit(8))).alias("slice", "part"))
    return exploded(rows.withColumn("slice", F.col("slice").cast("long")), "part", "id", "slice")


@query
def standardize(spark, sf):
    return exploded(stats.standardize(R.lineitem(spark, sf), by="std"), "x", "id")


@query
def standardize_by_variance(spark, sf):
    return exploded(stats.standardize(R.events_raw(spark, sf)), "x", "id", digits=9)


# ------------------------------------------------------------ packing


@query
def repartition_by_size(spark, sf):
    table = packing.repartition_by_size(R.lineitem(spark, sf), 5000)
    sizes = table.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_partitions"))


def _packs(spark, sf) -> DataFrame:
    return packing.pack_vectors(R.events(spark, sf), PACK_SIZE)


@query
def pack_vectors(spark, sf):
    """Every element of every block, with the row it belongs to."""
    packs = _packs(spark, sf)
    width = (F.size("x_pack") / F.col("cols")).cast("int")
    elements = packs.select("pack_id", "cols", "ids", width.alias("width"), F.posexplode("x_pack").alias("at", "v"))
    row = F.floor(F.col("at") / F.col("width")).cast("int")
    return elements.select(
        "pack_id", "cols", row.cast("long").alias("pos"), F.get("ids", row).alias("id"),
        F.pmod("at", "width").cast("long").alias("dim"), r6("v").alias("value"),
    )


@query
def unpack_vectors(spark, sf):
    scored = S.kernel_norms_packed(_packs(spark, sf))
    rows = packing.unpack_vectors(scored, "k_norms")
    return rows.select(
        "id", *[r6(F.col("x")[i]).alias(f"x{i}") for i in range(4)], r6("k_norms").alias("k_norm")
    )


@query
def explode_scores(spark, sf):
    scores = packing.explode_scores(S.kernel_norms_packed(_packs(spark, sf)), "k_norms")
    return scores.select(r6("score").alias("score"))


# ------------------------------------------------------------ kernels


def _cross_values(kernel, table=R.vectors) -> Query:
    def run(spark, sf):
        rows = table(spark, sf)
        crosses = S.kernel_crosses(rows, R.spaces(rows), kernel)
        return crosses.select("id", "space_id", "ord", r6("k").alias("k"))

    return run


QUERIES["kernel_linear"] = _cross_values(kernels.linear(), R.events)
QUERIES["kernel_cosine"] = _cross_values(kernels.cosine(), R.events)
QUERIES["kernel_rbf"] = _cross_values(kernels.rbf(0.5), R.events)
QUERIES["kernel_crosses"] = _cross_values(kernels.linear(), R.vectors)


@query
def kernel_norm(spark, sf):
    return S.kernel_norm(R.events(spark, sf)).select("id", r6("k_norm").alias("k_norm"))


@query
def kernel_norms_packed(spark, sf):
    packs = S.kernel_norms_packed(_packs(spark, sf))
    return exploded(packs, "k_norms", "pack_id")


@query
def kernel_cross(spark, sf):
    table = R.vectors(spark, sf)
    return exploded(S.kernel_cross(table, R.spaces(table)), "k_cross", "id")


@query
def kernel_top(spark, sf):
    """The landmarks nearest to each row under the rbf kernel, out of blocks of them."""
    table = R.events(spark, sf)
    top = tiles.kernel_top(table, R.spaces(table), kernels.rbf(0.5), NEAREST, SMALL_TILE)
    return top.withColumn("k", r6("k"))


@query
def vec_normalize_packed(spark, sf):
    """A vector function over the vectors of a packed block."""
    packs = packing.pack_vectors(R.events(spark, sf), SMALL_PACK)
    packs = packs.select("pack_id", V.on_pack("x_pack", "cols", V.normalize).alias("y"))
    return exploded(packs, "y", "pack_id")


@query
def kernel_gram(spark, sf):
    return tiles.kernel_gram(R.spaces(R.vectors(spark, sf))).withColumn("k", r6("k"))


@query
def fit_subspace(spark, sf):
    _, models = fitted(R.vectors(spark, sf))
    return fitting.gram_inverse(models).withColumn("g_inv", r6("g_inv"))


@query
def fit_subspace_pinv(spark, sf):
    _, models = fitted(R.vectors(spark, sf), method="pinv")
    return fitting.gram_inverse(models).withColumn("g_inv", r6("g_inv"))


@query
def fit_subspace_tiled(spark, sf):
    """The same inverse from tiles: each subspace is four blocks."""
    model = tiles.fit_tiled(R.spaces(R.vectors(spark, sf)), R.LAMBDA, tile=SMALL_TILE)
    return tiles.tiled_inverse_entries(model).withColumn("g_inv", r6("g_inv"))


@query
def kernel_proj(spark, sf):
    table = R.events(spark, sf)
    sp = R.spaces(table).filter(F.col("space_id") == 0)
    return exploded(S.kernel_proj(table, fitting.fit(sp, R.LAMBDA)), "proj", "id")


@query
def kernel_projs(spark, sf):
    """The same feature map of the wide vectors, under the rbf kernel."""
    table = R.vectors(spark, sf)
    sp = R.spaces(table).filter(F.col("space_id") == 0)
    kernel = kernels.rbf(0.5)
    return exploded(S.kernel_proj(table, fitting.fit(sp, R.LAMBDA, kernel), kernel), "proj", "id")


@query
def kernel_proj_spaces(spark, sf):
    table = R.vectors(spark, sf)
    _, models = fitted(table)
    return exploded(S.kernel_proj(table, models), "proj", "id")


def _leverage_of(table, kernel=None, **options) -> Query:
    def run(spark, sf):
        rows = table(spark, sf)
        sp = R.spaces(rows).filter(F.col("space_id") == 1)
        models = fitting.fit(sp, R.LAMBDA, kernel, **options)
        return S.leverage(rows, models, kernel).select("id", r6("leverage").alias("leverage"))

    return run


def _inverse_quadratic(a, b):
    """1 / (1 + |a - b|^2), a kernel the library does not have."""
    gaps = (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    return 1 / (1 + gaps.clip(0))


QUERIES["leverage"] = _leverage_of(R.vectors)
QUERIES["leverage_block"] = _leverage_of(R.events)
QUERIES["leverage_pinv"] = _leverage_of(R.vectors, method="pinv")
QUERIES["leverage_rbf"] = _leverage_of(R.events, kernels.rbf(0.5))
QUERIES["leverage_poly"] = _leverage_of(R.events, kernels.poly(2, 1.0))
QUERIES["leverage_custom"] = _leverage_of(R.events, kernels.custom(_inverse_quadratic))
QUERIES["leverage_cosine"] = _leverage_of(R.events, kernels.cosine())


@query
def leverage_tiled_rbf(spark, sf):
    """The smallest rbf leverage over three subspaces of four blocks each."""
    table = R.events(spark, sf)
    model = tiles.fit_tiled(R.spaces(table), R.LAMBDA, kernels.rbf(0.5), tile=SMALL_TILE)
    return tiles.tiled_leverage_min(table, model).select("id", r6("leverage").alias("leverage"))


@query
def leverage_pinv_deficient(spark, sf):
    """Landmarks that are there twice, without a regulariser: a singular matrix."""
    table = R.vectors(spark, sf)
    sp = R.spaces(table).filter(F.col("space_id") == 1)
    again = sp.withColumn("ord", F.col("ord") + R.LANDMARKS)
    model = tiles.fit_tiled(sp.unionByName(again), 0.0, method="pinv", tile=SMALL_TILE)
    return tiles.tiled_leverage_min(table, model).select("id", r6("leverage").alias("leverage"))


@query
def leverage_pseudo(spark, sf):
    table = R.events(spark, sf)
    _, models = fitted(table)
    return S.leverage_pseudo(table, models).select("id", r6("leverage").alias("leverage"))


@query
def leverage_min(spark, sf):
    table = R.events(spark, sf)
    _, models = fitted(table, form="primal")
    return S.leverage_min(table, models).select("id", r6("leverage").alias("leverage"))


@query
def leverage_min_lineitem(spark, sf):
    table = stats.standardize(R.lineitem(spark, sf), by="std")
    _, models = fitted(table, form="primal")
    return S.leverage_min(table, models).select("id", r6("leverage").alias("leverage"))


@query
def leverage_min_packed(spark, sf):
    table = R.events(spark, sf)
    _, models = fitted(table)
    packs = S.leverage_min_packed(packing.pack_vectors(table, PACK_SIZE), models)
    return exploded(packs, "leverages", "pack_id")


@query
def cross_leverage_matrix(spark, sf):
    sp, models = fitted(R.events(spark, sf))
    matrix = S.cross_leverage_matrix(sp, models)
    return matrix.withColumn("total_leverage", r6("total_leverage"))


# ------------------------------------------------------------ collections


def _sample(sp: DataFrame, space_id: int) -> DataFrame:
    return sp.filter(F.col("space_id") == space_id).drop("space_id")


def _collection(spark, sf, build: Callable[[DataFrame], SubspaceCollection]) -> DataFrame:
    """The landmarks of a built collection and their total leverage under it."""
    table = R.events(spark, sf)
    built = build(R.spaces(table))
    total = built.leverage_min(table).agg(F.sum("leverage").alias("total")).select(
        r6("total", 5).alias("total")
    )
    return built.spaces.select(
        "space_id", "ord", "id", total.scalar().alias("total_leverage")
    )


def _filled(sp: DataFrame, capacity: int = 3, count: int = 3) -> SubspaceCollection:
    built = SubspaceCollection.create(_sample(sp, 0), R.LAMBDA, capacity=capacity)
    for space_id in range(1, count):
        built = built.append(_sample(sp, space_id))
    return built


@query
def spaces_create(spark, sf):
    return _collection(spark, sf, lambda sp: _filled(sp, count=1))


@query
def space_update(spark, sf):
    """A single-slot collection whose landmarks and lambda are replaced."""
    return _collection(
        spark,
        sf,
        lambda sp: _filled(sp, capacity=1, count=1)
        .append_circular(_sample(sp, 2))
        .update_lambda(0.5),
    )


@query
def spaces_append(spark, sf):
    return _collection(spark, sf, _filled)


@query
def spaces_append_circular(spark, sf):
    return _collection(
        spark, sf, lambda sp: _filled(sp, capacity=2, count=2).append_circular(_sample(sp, 2))
    )


@query
def spaces_remove(spark, sf):
    return _collection(spark, sf, lambda sp: _filled(sp).remove(0))


@query
def spaces_update_lambda(spark, sf):
    return _collection(spark, sf, lambda sp: _filled(sp).update_lambda(0.5))


@query
def spaces_update_lambda_dual(spark, sf):
    """Two other lambdas from one factorisation of each subspace."""
    table = R.events(spark, sf)
    sp = R.spaces(table)
    built = SubspaceCollection.create(_sample(sp, 0), R.LAMBDA, capacity=3, form="eigen")
    for space_id in (1, 2):
        built = built.append(_sample(sp, space_id))
    totals = [
        built.update_lambda(2.0).update_lambda(lam).leverage_min(table).agg(F.sum("leverage").alias("total"))
        .select(F.lit(lam).alias("lambda"), r6("total", 5).alias("total_leverage"))
        for lam in (0.5, R.LAMBDA)
    ]
    return reduce(DataFrame.unionByName, totals)


@query
def spaces_describe(spark, sf):
    described = _filled(R.spaces(R.events(spark, sf))).describe()
    members = F.posexplode(F.arrays_zip("ids", "reg")).alias("pos", "member")
    return described.select("space_id", "m", "lambda", members).select(
        "space_id",
        "m",
        "lambda",
        F.col("pos").cast("long").alias("pos"),
        F.col("member.ids").alias("id"),
        F.col("member.reg").alias("reg"),
    )


# ------------------------------------------------------------ selection


def _spaces_options() -> dict:
    return {
        "seed": R.SEED,
        "max_rows": SELECT_ROWS,
        "max_spaces": SELECT_SPACES,
        "max_non_improv": SELECT_MISSES,
    }


def _history(chosen: selection.Selection) -> DataFrame:
    table = chosen.history_table()
    return table.select(
        "round",
        r6("lambda", 9).alias("lambda"),
        "n_landmarks",
        r6("total_leverage", 4).alias("total_leverage"),
        "is_best",
    )


def _kept(chosen: selection.Selection) -> DataFrame:
    return chosen.spaces.select("space_id", "ord", "id", r6("reg").alias("reg"))


@query
def nystrom_spaces(spark, sf):
    return _kept(selection.nystrom_spaces(R.events(spark, sf), **_spaces_options()))


@query
def nystrom_spaces_history(spark, sf):
    return _history(selection.nystrom_spaces(R.events(spark, sf), **_spaces_options()))


@query
def nystrom_spaces_packed(spark, sf):
    packs = materialize(_packs(spark, sf))
    return _kept(selection.nystrom_spaces_packed(packs, **_spaces_options()))


@query
def nystrom_spaces_full(spark, sf):
    """The loop over the wide vectors, to its own end."""
    return _kept(selection.nystrom_spaces(R.vectors(spark, sf), **_spaces_options()))


@query
def nystrom_bless(spark, sf):
    return _kept(
        selection.nystrom_bless(R.events(spark, sf), seed=R.SEED, max_rows=BLESS_ROWS)
    )


@query
def nystrom_bless_history(spark, sf):
    return _history(
        selection.nystrom_bless(R.events(spark, sf), seed=R.SEED, max_rows=BLESS_ROWS)
    )


@query
def nested_bernoulli_levels(spark, sf):
    leveled = sampling.with_nested_level(R.lineitem(spark, sf), LEVELS, R.SEED)
    return leveled.select("id", "level")


@query
def nystrom_halving(spark, sf):
    chosen = selection.nystrom_halving(R.events(spark, sf), seed=R.SEED)
    return chosen.spaces.select("ord", "id")


def _refined(table: DataFrame) -> selection.Selection:
    start = selection.nystrom_halving(table, seed=R.SEED).spaces
    return selection.nystrom_refine(table, start, seed=R.SEED, rounds=REFINE_ROUNDS)


@query
def nystrom_refine(spark, sf):
    """Refinement of the halving result over the whole table."""
    return _refined(R.events(spark, sf)).spaces.select("ord", "id")


POLY_ROUNDS = 3


def _unit(table: DataFrame) -> DataFrame:
    return table.select("id", "label", V.normalize("x").alias("x"))


def _refined_by(table: DataFrame, kernel: kernels.Kernel) -> selection.Selection:
    first = selection.nystrom_halving(table, kernel, seed=R.SEED)
    return selection.nystrom_refine(
        table, first.spaces, kernel, seed=R.SEED, rounds=POLY_ROUNDS, model=first.models
    )


@query
def nystrom_halving_poly(spark, sf):
    """Halving under a kernel that the library knows no features of, over unit vectors."""
    chosen = selection.nystrom_halving(_unit(R.events(spark, sf)), kernels.poly(2, 1.0), seed=R.SEED)
    return chosen.spaces.select("ord", "id")


@query
def nystrom_refine_poly(spark, sf):
    return _refined_by(_unit(R.events(spark, sf)), kernels.poly(2, 1.0)).spaces.select("ord", "id")


@query
def nystrom_halving_rbf(spark, sf):
    chosen = selection.nystrom_halving(R.events(spark, sf), kernels.rbf(RBF_GAMMA), seed=R.SEED)
    return chosen.spaces.select("ord", "id")


@query
def nystrom_refine_rbf(spark, sf):
    """Refinement of the rbf halving, going on from its model."""
    return _refined_by(R.events(spark, sf), kernels.rbf(RBF_GAMMA)).spaces.select("ord", "id")


@query
def refined_leverage_describe(spark, sf):
    """Halving, its refinement, and the leverages that are left, described."""
    table = R.events(spark, sf)
    chosen = _refined(table)
    scored = S.leverage_min(table, chosen.models, kernels.cosine())
    described = stats.score_describe(scored)
    return described.select("n", *[r6(c).alias(c) for c in ("mean", "stddev", "min", "max")])


@query
def refined_leverage_quantiles(spark, sf):
    table = R.events(spark, sf)
    chosen = _refined(table)
    scored = S.leverage_min(table, chosen.models, kernels.cosine())
    quantiles = stats.score_quantiles(scored, relative_error=QUANTILE_ERROR)
    return quantiles.select("probability", r6("value").alias("value"))


def _selected_matches(spark, sf, form: str) -> DataFrame:
    table = R.events(spark, sf)
    chosen = selection.nystrom_spaces(table, **_spaces_options())
    rows = landmarks.filter_by_ids(table, chosen.spaces)
    models = classify.fit_class_subspaces(rows, table.count(), form=form)
    summary = stats.match_summary(classify.classify_max_projection(table, models))
    return summary.select("is_match", "n_rows", r6("residual_sum", 4).alias("residual_sum"))


@query
def selected_match_summary_tiled(spark, sf):
    """The same with class subspaces of landmark size, as tiles."""
    return _selected_matches(spark, sf, "tiled")


@query
def selected_match_summary(spark, sf):
    """Selected landmarks become class subspaces; matches over the whole table."""
    return _selected_matches(spark, sf, "primal")


# ------------------------------------------------------------ models


def _class_models(table: DataFrame) -> DataFrame:
    return classify.fit_class_subspaces(_chosen(table), table.count())


@query
def fit_class_subspaces(spark, sf):
    models = _class_models(R.vectors(spark, sf))
    return fitting.gram_inverse(models).select(
        F.col("space_id").alias("label"), "i", "j", r6("g_inv").alias("g_inv")
    )


def _classified(spark, sf) -> DataFrame:
    table = R.vectors(spark, sf)
    return classify.classify_max_projection(table, _class_models(table))


@query
def classify_max_projection(spark, sf):
    return _classified(spark, sf).select("id", "pred_label", r6("residual").alias("residual"))


@query
def classify_max_projection_events(spark, sf):
    table = R.events(spark, sf)
    classified = classify.classify_max_projection(table, _class_models(table))
    return classified.select("id", "pred_label", r6("residual").alias("residual"))


@query
def match_summary_held_out(spark, sf):
    """Matches among the rows that are no landmark of a class."""
    table = R.vectors(spark, sf)
    unseen = table.join(R.spaces(table).select("id").distinct(), "id", "left_anti")
    classified = classify.classify_max_projection(unseen, _class_models(table))
    summary = stats.match_summary(classified)
    return summary.select("is_match", "n_rows", r6("residual_sum", 5).alias("residual_sum"))


@query
def ridge_fit(spark, sf):
    table = R.vectors(spark, sf)
    coefficients = ridge.ridge_fit(R.spaces(table), table, "label", R.LAMBDA)
    return coefficients.select("space_id", "ord", "id", r6(F.col("alpha")[0]).alias("alpha"))


def _one_vs_all(table: DataFrame) -> tuple[list, DataFrame]:
    classes = ridge.class_list(table)
    targets = ridge.one_hot("label", classes)
    return classes, ridge.ridge_fit_multi(R.spaces(table), table, targets, R.LAMBDA)


@query
def ridge_fit_multi(spark, sf):
    _, coefficients = _one_vs_all(R.vectors(spark, sf))
    parts = coefficients.select("space_id", "ord", "id", F.posexplode("alpha").alias("output", "alpha"))
    return parts.select("space_id", "output", "ord", "id", r6("alpha").alias("alpha"))


@query
def ridge_fit_iterative(spark, sf):
    """The coefficients of all outputs by conjugate gradients."""
    table = R.vectors(spark, sf)
    targets = ridge.one_hot("label", ridge.class_list(table))
    solved = ridge.ridge_fit_multi(R.spaces(table), table, targets, R.LAMBDA, solver="iterative")
    parts = solved.select("space_id", "ord", "id", F.posexplode("alpha").alias("output", "alpha"))
    return parts.select("space_id", "output", "ord", "id", r6("alpha").alias("alpha"))


@query
def ridge_vote_selected(spark, sf):
    """Selected landmarks, a ridge classifier on each of their subspaces, and the vote."""
    table = R.events(spark, sf)
    chosen = selection.nystrom_spaces(table, **_spaces_options())
    classes = ridge.class_list(table)
    fitted = ridge.ridge_fit_multi(chosen.spaces, table, ridge.one_hot("label", classes), R.LAMBDA)
    voted = ridge.ridge_classify_vote(table, fitted, classes)
    return voted.groupBy("pred_label", (F.col("label") == F.col("pred_label")).alias("is_match")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


@query
def ridge_predict(spark, sf):
    table = R.events(spark, sf)
    sp = R.spaces(table).filter(F.col("space_id") == 2)
    coefficients = ridge.ridge_fit(sp, table, "label", R.LAMBDA)
    return ridge.ridge_predict(table, coefficients).select("id", r6("pred").alias("pred"))


@query
def ridge_predict_multi(spark, sf):
    table = R.events(spark, sf)
    sp = R.spaces(table).filter(F.col("space_id") == 2)
    targets = ridge.one_hot("label", ridge.class_list(table))
    coefficients = ridge.ridge_fit_multi(sp, table, targets, R.LAMBDA)
    return exploded(ridge.ridge_predict_multi(table, coefficients), "preds", "id")


@query
def ridge_classify_vote(spark, sf):
    table = R.vectors(spark, sf)
    classes, coefficients = _one_vs_all(table)
    voted = ridge.ridge_classify_vote(table, coefficients, classes)
    return voted.select("id", "pred_label")


# names shared with the library functions they call
for _name in [name for name in QUERIES if name.endswith("_")]:
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
