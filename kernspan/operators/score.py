"""Scoring every row of a table against fitted subspaces.

Models are small; their size is checked before they are broadcast. Each Arrow
batch is scored as one matrix, in row blocks of bounded size. Scores are Column
expressions added to the table, so Spark still prunes and filters around them,
nothing is shuffled, and the same code scores a stream.

Models whose total size exceeds the broadcast bound come in chunks: each is
collected and broadcast before the next, each is one more expression of the same
scan, and the parts are reduced by a built-in function. Nothing is materialised.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernspan.functions.kernels import Kernel, linear
from kernspan.functions.vectors import split_array
from kernspan.operators.fit import eigen_scale, primal_factor

#: bytes of model matrices broadcast for one pass
MAX_MODEL_BYTES = 256 * 1024 * 1024

#: doubles a scoring task holds at once per intermediate matrix
BLOCK_DOUBLES = 4_000_000


# ---------------------------------------------------------------- model loading


@dataclass
class Space:
    """What a scoring task needs of one subspace.

    ``factor`` maps phi(y) (explicit) or k(X, y) to a vector whose squared
    length is the energy, or the leverage itself when ``residual``.
    """

    space_id: object
    factor: np.ndarray
    landmarks: np.ndarray | None
    residual: bool = False


def _matrix(flat, rows: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(rows, -1)


#: model rows that may come in one go when each is a small enough share
FEW_MODELS = 64


def load_models(
    models: DataFrame,
    kernel: Kernel,
    projection: bool = False,
    max_bytes: int = MAX_MODEL_BYTES,
) -> list[list[Space]]:
    """All chunks of ``model_chunks`` at once, for models that are known to be few."""
    return list(model_chunks(models, kernel, projection, max_bytes))


def model_chunks(
    models: DataFrame,
    kernel: Kernel,
    projection: bool = False,
    max_bytes: int = MAX_MODEL_BYTES,
) -> Iterator[list[Space]]:
    """Collect the model matrices, one chunk of at most ``max_bytes`` after the other.

    Only the matrices the asked score needs are collected. A few models that
    each are within their share of the bound come with the first job; otherwise
    that job only brings the sizes, and the matrices follow chunk by chunk.
    """
    if not kernel.explicit:
        matrices = {"landmarks": F.col("x_flat"), "factor": F.col("w_flat")}
    elif projection:
        matrices = {"factor": F.col("b_flat")}
    else:
        # the moments where there are fewer features than landmarks
        matrices = {"factor": F.coalesce("s_flat", "b_flat")}
    residual = F.col("s_flat").isNotNull() if kernel.explicit and not projection else F.lit(False)
    size = sum((F.size(m) for m in matrices.values()), F.lit(0)) * 8
    shaped = models.select(
        "space_id",
        "m",
        "rank",
        "lambda",
        residual.alias("residual"),
        F.col("e_flat").alias("eigen"),
        F.coalesce(size, F.lit(-1)).alias("bytes"),
        *[m.alias(name) for name, m in matrices.items()],
    )
    share = max_bytes // FEW_MODELS
    small = [F.when(F.col("bytes") <= share, F.col(name)).alias(name) for name in matrices]
    first = shaped.select("space_id", "m", "rank", "lambda", "residual", "eigen", "bytes", *small)
    rows = first.coalesce(1).limit(FEW_MODELS + 1).collect()
    if not rows:
        raise ValueError("no models to score against")
    if len(rows) <= FEW_MODELS and all(0 < row["bytes"] <= share for row in rows):
        yield sorted(map(_space, rows), key=lambda s: s.space_id)
        return

    sizes = shaped.select("space_id", "bytes").collect()
    chunks: list[list] = [[]]
    filled = 0
    for row in sorted(sizes, key=lambda row: row["space_id"]):
        if row["bytes"] <= 0:
            raise ValueError("these models lack the matrices for this score; fit form='dual'")
        if row["bytes"] > max_bytes:
            raise ValueError(f"one subspace needs {row['bytes']} bytes, more than {max_bytes}")
        if filled + row["bytes"] > max_bytes:
            chunks.append([])
            filled = 0
        chunks[-1].append(row["space_id"])
        filled += row["bytes"]

    for ids in chunks:
        rows = shaped.filter(F.col("space_id").isin(ids)).collect()
        yield sorted(map(_space, rows), key=lambda s: s.space_id)


def _space(row) -> Space:
    """A collected model row as matrices."""
    row = row.asDict()
    flat = row["factor"]
    if row["residual"]:
        # moments are square; they become the factor of the model's lambda
        s = _matrix(flat, math.isqrt(len(flat)))
        return Space(row["space_id"], primal_factor(s, row["lambda"]), None, True)
    landmarks = _matrix(row["landmarks"], row["m"]) if "landmarks" in row else None
    factor = _matrix(flat, row["rank"])
    if row["eigen"] is not None:
        factor = factor * eigen_scale(np.asarray(row["eigen"]), row["lambda"])[:, None]
    return Space(row["space_id"], factor, landmarks)


# ---------------------------------------------------------------- Arrow <-> NumPy


def rows_of(x: pa.Array, ids: pa.Array | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The vectors of an Arrow list column as matrix rows, and the null mask."""
    present = None
    if x.null_count:
        present = np.asarray(pc.is_valid(x))
        x = x.drop_null()
    lengths = np.asarray(pc.list_value_length(x))
    if len(lengths) and (lengths != lengths[0]).any():
        odd = int(np.flatnonzero(lengths != lengths[0])[0])
        who = ""
        if ids is not None:
            kept = ids if present is None else ids.filter(pa.array(present))
            who = f" (id {kept[odd].as_py()!r})"
        raise ValueError(f"vectors of unequal length: {lengths[0]} and {lengths[odd]}{who}")
    width = int(lengths[0]) if len(lengths) else 0
    flat = x.flatten()
    if flat.null_count:
        odd = int(np.flatnonzero(np.asarray(pc.is_null(flat)))[0]) // width
        kept = ids if ids is None or present is None else ids.filter(pa.array(present))
        raise ValueError("a vector has a null element" + ("" if kept is None else f" (id {kept[odd].as_py()!r})"))
    values = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(x), width), present


def blocks(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, BLOCK_DOUBLES // max(1, width))
    for start in range(0, len(rows), step):
        yield rows[start : start + step]


def list_column(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A list column from its flat values and the length of each entry."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _to_arrow(result: np.ndarray, present: np.ndarray | None) -> pa.Array:
    """A scalar or list column; rows that had no vector become null."""
    if result.ndim == 1:
        column = pa.array(result)
    else:
        column = list_column(result.ravel(), np.full(len(result), result.shape[1]))
    return with_nulls(column, present)


def with_nulls(column: pa.Array, present: np.ndarray | None) -> pa.Array:
    """Spread the results of the present rows, nulls in between."""
    if present is None:
        return column
    where = np.full(len(present), -1, dtype=np.int64)
    where[present] = np.arange(int(present.sum()))
    return column.take(pa.array(where, mask=where < 0))


def row_scorer(
    compute: Callable[[np.ndarray], np.ndarray], data_type: str, width: int
) -> Callable[[Column], Column]:
    """A Column function from a block computation ``(n, d) -> (n,) or (n, r)``."""

    def evaluate(x: pa.Array, ids: pa.Array) -> pa.Array:
        rows, present = rows_of(x, ids)
        parts = [compute(block) for block in blocks(rows, width)]
        if not parts:
            kind = pa.list_(pa.float64()) if "array" in data_type else pa.float64()
            return pa.nulls(len(x), kind)
        return _to_arrow(np.concatenate(parts), present)

    return F.arrow_udf(evaluate, data_type)


def _id_or_null(df: DataFrame) -> Column:
    """The id only serves error messages: it is left out unless it is a number,
    so that a text key is neither read nor sent along."""
    numeric = "id" in df.columns and isinstance(df.schema["id"].dataType, T.NumericType)
    return F.col("id") if numeric else F.lit(None).cast("long")


# ---------------------------------------------------------------- block math


def mapped(rows: np.ndarray, space: Space, kernel: Kernel, phi: np.ndarray | None) -> np.ndarray:
    """factor * phi(y), or factor * k(X, y), one row per vector."""
    if space.landmarks is None:
        return phi @ space.factor.T
    return kernel.block(rows, space.landmarks) @ space.factor.T


def leverage_block(rows: np.ndarray, spaces: list[Space], kernel: Kernel) -> np.ndarray:
    """Leverages of a block against each subspace, (n, number of subspaces)."""
    phi = kernel.features(rows) if kernel.explicit else None
    norms = kernel.diagonal(rows)
    out = np.empty((len(rows), len(spaces)))
    for s, space in enumerate(spaces):
        image = mapped(rows, space, kernel, phi)
        squares = np.einsum("ij,ij->i", image, image)
        out[:, s] = squares if space.residual else norms - squares
    return out


def _width(spaces: list[Space]) -> int:
    """Widest intermediate row while scoring."""
    widths = [max(s.factor.shape) for s in spaces]
    return max(widths)


def _with_scores(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None,
    x: str,
    out: str,
    projection: bool,
    reduce_block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None,
    combine: Callable[[list[Column], Column], Column] | None,
    max_model_bytes: int,
    single: bool = False,
    data_type: str = "double",
    sizes: list[int] | None = None,
) -> DataFrame:
    """Add per-subspace leverages (or projections), reduced over subspaces.

    ``reduce_block`` works on the (n, subspaces) leverages of a block under one chunk of
    models and on its k(y, y); ``combine`` joins the results of several chunks, whose
    numbers of subspaces ``sizes`` receives.
    """
    kernel = kernel or linear()
    spark, parts, known = df.sparkSession, [], 0
    for spaces in model_chunks(models, kernel, projection, max_model_bytes):
        known += len(spaces)
        if sizes is not None:
            sizes.append(len(spaces))
        if single and known != 1:
            raise ValueError("this score needs exactly one model; see leverage_min")
        kind = data_type if reduce_block else "array<double>"
        scorer = _broadcast_scorer(spark, spaces, kernel, projection, reduce_block, kind)
        parts.append(scorer(F.col(x), _id_or_null(df)))
    if len(parts) == 1:
        return df.withColumn(out, parts[0])
    if reduce_block is None:
        return df.withColumn(out, F.concat(*parts))
    # each part is evaluated once, however often the combination refers to it
    names = [f"_{out}_{number}" for number in range(len(parts))]
    parted = df.select("*", *[p.alias(n) for p, n in zip(parts, names, strict=True)])
    joined = combine([F.col(n) for n in names], kernel_norm_column(parted, kernel, x))
    return parted.withColumn(out, joined).drop(*names)


def _broadcast_scorer(
    spark: SparkSession,
    spaces: list[Space],
    kernel: Kernel,
    projection: bool,
    reduce_block: Callable[[np.ndarray], np.ndarray] | None,
    data_type: str,
) -> Callable[[Column, Column], Column]:
    shared = spark.sparkContext.broadcast(spaces)
    width = _width(spaces)

    def compute(rows: np.ndarray) -> np.ndarray:
        known = shared.value
        if projection:
            phi = kernel.features(rows) if kernel.explicit else None
            return np.hstack([mapped(rows, s, kernel, phi) for s in known])
        leverages = leverage_block(rows, known, kernel)
        return leverages if reduce_block is None else reduce_block(leverages, kernel.diagonal(rows))

    return row_scorer(compute, data_type, width)


# ---------------------------------------------------------------- operators


def kernel_norm_column(df: DataFrame, kernel: Kernel, x: str = "x") -> Column:
    """k(y, y), as a built-in expression where the kernel has one."""
    try:
        return kernel.norm_column(F.col(x))
    except TypeError:
        return row_scorer(kernel.diagonal, "double", 1)(F.col(x), _id_or_null(df))


def kernel_norm(
    df: DataFrame, kernel: Kernel | None = None, x: str = "x", out: str = "k_norm"
) -> DataFrame:
    return df.withColumn(out, kernel_norm_column(df, kernel or linear(), x))


def kernel_norms_packed(
    packs: DataFrame, kernel: Kernel | None = None, out: str = "k_norms"
) -> DataFrame:
    """k(y, y) of each vector of a pack, as an array in pack order."""
    kernel = kernel or linear()
    vectors = split_array("x_pack", "cols")
    return packs.withColumn(out, F.transform(vectors, kernel.norm_column))


def kernel_cross(
    df: DataFrame,
    spaces: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "k_cross",
    max_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """k(X_i, y) of each row y with all landmarks, in (space_id, ord) order.

    Landmarks beyond ``max_bytes`` are several expressions of the same scan.
    """
    kernel = kernel or linear()
    parts = [
        _cross_scorer(df, chunk, kernel)(F.col(x), _id_or_null(df))
        for chunk in landmark_chunks(spaces, max_bytes)
    ]
    return df.withColumn(out, F.concat(*parts) if len(parts) > 1 else parts[0])


def landmark_chunks(spaces: DataFrame, max_bytes: int) -> Iterator[np.ndarray]:
    """The landmark vectors in (space_id, ord) order, at most ``max_bytes`` at a time."""
    sizes = spaces.groupBy("space_id").agg(F.sum(F.size("x") * 8).alias("bytes")).collect()
    if not sizes:
        raise ValueError("no landmarks to compare with")
    groups: list[list] = [[]]
    filled = 0
    for row in sorted(sizes):
        if row["bytes"] > max_bytes:
            raise ValueError(f"one subspace needs {row['bytes']} bytes, more than {max_bytes}")
        if filled + row["bytes"] > max_bytes:
            groups.append([])
            filled = 0
        groups[-1].append(row["space_id"])
        filled += row["bytes"]

    for ids in groups:
        wanted = spaces if len(groups) == 1 else spaces.filter(F.col("space_id").isin(ids))
        rows = wanted.select("space_id", "ord", "x").collect()
        yield np.array([row["x"] for row in sorted(rows)], dtype=float)


def _cross_scorer(
    df: DataFrame, landmarks: np.ndarray, kernel: Kernel
) -> Callable[[Column, Column], Column]:
    shared = df.sparkSession.sparkContext.broadcast(landmarks)
    return row_scorer(
        lambda rows: kernel.block(rows, shared.value), "array<double>", max(landmarks.shape)
    )


def kernel_crosses(
    df: DataFrame, spaces: DataFrame, kernel: Kernel | None = None, x: str = "x"
) -> DataFrame:
    """The cross matrix in long form: ``id, space_id, ord, k``.

    Each row is paired with the landmarks where it lies: no join, no shuffle.
    """
    return landmark_pairs(df, spaces, kernel, x).select("id", "space_id", "ord", "k")


def landmark_pairs(
    df: DataFrame, spaces: DataFrame, kernel: Kernel | None = None, x: str = "x"
) -> DataFrame:
    """Every row with every landmark: ``id, space_id, ord, landmark_id, k``.

    The landmarks come as one array value, sorted like the cross values.
    """
    keys = spaces.agg(
        F.array_sort(
            F.collect_list(F.struct("space_id", "ord", F.col("id").alias("landmark_id")))
        ).alias("keys")
    )
    crossed = kernel_cross(df.select("id", x), spaces, kernel, x).select(
        "id", keys.scalar().alias("keys"), "k_cross"
    )
    pairs = crossed.select("id", F.inline(F.arrays_zip("keys", "k_cross")))
    return pairs.select("id", "keys.*", F.col("k_cross").alias("k"))


def kernel_proj(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "proj",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """Nystrom features L^-1 k(X, y); of several subspaces, concatenated in order."""
    return _with_scores(df, models, kernel, x, out, True, None, None, max_model_bytes)


def leverage_per_space(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "leverages",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """k(y, y) - energy for each subspace, as an array in space order."""
    return _with_scores(df, models, kernel, x, out, False, None, None, max_model_bytes)


def least_leverage(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "least",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """An array of two: the number (from 0, in space order) of the subspace of least
    leverage, and that leverage.

    Leverages that differ by rounding noise are equal, and the first of them wins.
    """
    chunk_sizes: list[int] = []

    def noise(norms):
        return np.maximum(norms, 1e-300) * 1e-12

    def reduce(leverages: np.ndarray, norms: np.ndarray) -> np.ndarray:
        least = leverages.min(axis=1)
        first = np.argmax(leverages <= (least + noise(norms))[:, None], axis=1)
        return np.column_stack([first.astype(float), least])

    def combine(parts: list[Column], norm: Column) -> Column:
        margin = F.greatest(norm, F.lit(1e-300)) * 1e-12
        best, before = parts[0], 0
        for number, part in enumerate(parts[1:], 1):
            before += chunk_sizes[number - 1]
            moved = F.array(part[0] + before, part[1])
            best = F.when(part[1] < best[1] - margin, moved).otherwise(best)
        return best

    return _with_scores(
        df, models, kernel, x, out, False, reduce, combine, max_model_bytes,
        data_type="array<double>", sizes=chunk_sizes,
    )


def leverage_min(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "leverage",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """The smallest leverage over all subspaces."""
    return _with_scores(
        df,
        models,
        kernel,
        x,
        out,
        False,
        lambda leverages, norms: leverages.min(axis=1),
        lambda parts, norm: F.least(*parts),
        max_model_bytes,
    )


def leverage(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "leverage",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """k(y, y) - energy(y) with respect to a single subspace."""
    return _with_scores(
        df,
        models,
        kernel,
        x,
        out,
        False,
        lambda leverages, norms: leverages[:, 0],
        None,
        max_model_bytes,
        single=True,
    )


def leverage_pseudo(
    df: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "leverage",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """k(y, y) minus the energies of all subspaces; may be negative."""

    def joined(parts: list[Column], norm: Column) -> Column:
        # every part has k(y, y) once
        return sum(parts[1:], parts[0]) - norm * (len(parts) - 1)

    return _with_scores(
        df,
        models,
        kernel,
        x,
        out,
        False,
        lambda leverages, norms: leverages.sum(axis=1) - norms * (leverages.shape[1] - 1),
        joined,
        max_model_bytes,
    )


def leverage_min_packed(
    packs: DataFrame,
    models: DataFrame,
    kernel: Kernel | None = None,
    out: str = "leverages",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """The smallest leverage of each vector of a pack, as an array in pack order."""
    kernel = kernel or linear()
    smallest: Column | None = None
    for spaces in model_chunks(models, kernel, False, max_model_bytes):
        part = _pack_scorer(packs.sparkSession, spaces, kernel)(F.col("x_pack"), F.col("cols"))
        smallest = part if smallest is None else F.zip_with(smallest, part, F.least)
    return packs.withColumn(out, smallest)


def _pack_scorer(
    spark: SparkSession, spaces: list[Space], kernel: Kernel
) -> Callable[[Column, Column], Column]:
    shared = spark.sparkContext.broadcast(spaces)
    width = _width(spaces)

    def evaluate(x: pa.Array, cols: pa.Array) -> pa.Array:
        counts = np.asarray(cols).astype(np.int64)
        scores = []
        for pack, count in zip(x, counts):
            rows = np.asarray(pack.values, dtype=float).reshape(count, -1)
            for block in blocks(rows, width):
                scores.append(leverage_block(block, shared.value, kernel).min(axis=1))
        flat = np.concatenate(scores) if scores else np.empty(0)
        return list_column(flat, counts)

    return F.arrow_udf(evaluate, "array<double>")


def cross_leverage_matrix(
    spaces: DataFrame, models: DataFrame, kernel: Kernel | None = None
) -> DataFrame:
    """Total leverage of each subspace's landmarks under each model.

    One row ``(model_id, space_id, total_leverage)`` per ordered pair.
    """
    ids = models.agg(F.array_sort(F.collect_list("space_id"))).scalar()
    scored = leverage_per_space(spaces, models, kernel).select(
        "space_id", F.arrays_zip(ids.alias("model_id"), F.col("leverages")).alias("scores")
    )
    return (
        scored.select("space_id", F.inline("scores"))
        .groupBy("model_id", "space_id")
        .agg(F.sum("leverages").alias("total_leverage"))
    )


