"""Fitting subspaces: landmark table in, model table out.

With landmarks X, weights p and kernel k, a subspace is described by
G = k(X, X) + lambda * diag(p). Three equivalent forms are fitted:

``dual``    W = L^-1 with G = L L'. Gives projections W k(X, y) and, through
            their squared length, the energy of a row. Costs m^2 memory and m^3
            time for m landmarks, one task per subspace, so m is bounded.
``primal``  for kernels with a feature map phi of dimension D: with the moments
            S = sum_i phi(X_i) phi(X_i)' / p_i and A = I + S / lambda,
            leverage(y) = |chol(A)^-1 phi(y)|^2 by the Woodbury identity. S is a
            sum over landmarks, computed by distributed partial sums, so m has no
            bound; the model has D^2 numbers, and another lambda needs no refit.

``eigen``   the dual form with P^-1/2 K P^-1/2 = U E U': W = (E + lambda)^-1/2 U' P^-1/2,
            so another lambda only rescales the rows of W and needs no refit.

A model row holds ``space_id, m, dim, rank, lambda, ids, x_flat, w_flat,
b_flat, s_flat, e_flat``; matrices are row-major. ``b_flat`` is W phi(X), mapping
phi(y) straight to the projection; ``s_flat`` holds the moments S. With eigenvalues in
``e_flat``, W and W phi(X) are still to be scaled by (e + lambda)^-1/2.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernspan.functions.kernels import Kernel, linear
from kernspan.session import materialize

#: landmarks one dual subspace may have; its W then takes 200 MB
MAX_LANDMARKS = 5_000

#: groups in which the partial sums of a subspace's tasks are added first
PARTIAL_SALTS = 32

#: smallest weight of a landmark in the regulariser
MIN_REG = 1e-12


def model_schema(spaces: DataFrame, by: str) -> T.StructType:
    numbers = T.ArrayType(T.DoubleType())
    return T.StructType(
        [
            T.StructField("space_id", spaces.schema[by].dataType),
            T.StructField("m", T.LongType()),
            T.StructField("dim", T.LongType()),
            T.StructField("rank", T.LongType()),
            T.StructField("lambda", T.DoubleType()),
            T.StructField("ids", T.ArrayType(spaces.schema["id"].dataType)),
            T.StructField("x_flat", numbers),
            T.StructField("w_flat", numbers),
            T.StructField("b_flat", numbers),
            T.StructField("s_flat", numbers),
            T.StructField("e_flat", numbers),
        ]
    )


def stack_vectors(column, ids=None) -> np.ndarray:
    """Vectors of a pandas column as the rows of one matrix."""
    lengths = column.map(len)
    if lengths.nunique() > 1:
        odd = lengths != lengths.iloc[0]
        who = "" if ids is None else f" (id {ids[odd].iloc[0]!r})"
        raise ValueError(f"vectors of unequal length{who}")
    return np.array(column.tolist(), dtype=float)


def gram(rows: np.ndarray, reg: np.ndarray, lam: float, kernel: Kernel) -> np.ndarray:
    """k(X, X) + lambda * diag(reg)."""
    out = kernel.block(rows, rows)
    out[np.diag_indices_from(out)] += lam * np.maximum(reg, MIN_REG)
    return out


def inverse_root(g: np.ndarray, method: str) -> np.ndarray:
    """W with W'W = G^-1 (or the pseudo-inverse of G)."""
    if method == "chol":
        try:
            return np.linalg.inv(np.linalg.cholesky(g))
        except np.linalg.LinAlgError:
            pass
    values, vectors = np.linalg.eigh(g)
    keep = values > values.max() * len(g) * np.finfo(float).eps
    return (vectors[:, keep] / np.sqrt(values[keep])).T


def eigen_root(g: np.ndarray, reg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """V and e with V' (e + lambda)^-1 V = (G + lambda P)^-1 for every lambda."""
    weights = 1 / np.sqrt(np.maximum(reg, MIN_REG))
    values, vectors = np.linalg.eigh(weights[:, None] * g * weights)
    return vectors.T * weights, np.maximum(values, 0.0)


def eigen_scale(e: np.ndarray, lam: float) -> np.ndarray:
    """(e + lambda)^-1/2, zero where there is nothing but rounding."""
    size = e + lam
    keep = size > max(size.max(initial=0.0), 0.0) * len(size) * np.finfo(float).eps
    return np.where(keep, 1 / np.sqrt(np.where(keep, size, 1.0)), 0.0)


def moments(features: np.ndarray, reg: np.ndarray) -> np.ndarray:
    """S = sum_i phi_i phi_i' / p_i."""
    return (features / np.maximum(reg, MIN_REG)[:, None]).T @ features


def primal_factor(s: np.ndarray, lam: float) -> np.ndarray:
    """C with |C phi(y)|^2 = leverage(y)."""
    return np.linalg.inv(np.linalg.cholesky(np.eye(len(s)) + s / lam))


#: landmarks from which on each dual subspace should get a task of its own
PARALLEL_LANDMARKS = 500


def bounded_groups(rows: DataFrame, limit: int) -> DataFrame:
    """Landmark rows, checked to have no group beyond ``limit``.

    Groups are small in bytes but cubic in work: large ones are spread so that
    adaptive coalescing does not fit one after the other in a single task.
    """
    sizes = rows.groupBy("space_id").count()
    groups, worst = sizes.agg(F.count(F.lit(1)), F.max("count")).first()
    if (worst or 0) > limit:
        raise ValueError(
            f"a subspace has {worst} landmarks, more than {limit} fit the dual form; "
            "fit form='primal' or raise max_landmarks"
        )
    if (worst or 0) < PARALLEL_LANDMARKS or groups < 2:
        return rows
    return rows.repartition(4 * groups, "space_id")


def fit(
    spaces: DataFrame,
    lam: float | Column,
    kernel: Kernel | None = None,
    form: str = "dual",
    method: str = "chol",
    by: str = "space_id",
    max_landmarks: int = MAX_LANDMARKS,
) -> DataFrame:
    """Fit every subspace of a landmark table; all of them in parallel.

    ``lam`` may be a Column, e.g. computed from a table total. ``method`` is
    'chol' or 'pinv' (dual form only). The result is materialised.
    """
    kernel = kernel or linear()
    lam_column = lam if isinstance(lam, Column) else F.lit(float(lam))
    rows = spaces.select(
        F.col(by).alias("space_id"), "ord", "id", "x", "reg", lam_column.alias("lambda")
    )
    schema = model_schema(spaces, by)
    if form == "primal":
        return materialize(_fit_primal(rows, kernel, schema))
    if form not in ("dual", "eigen"):
        raise ValueError(f"form must be 'dual', 'eigen' or 'primal', not {form!r}")
    rows = bounded_groups(rows, max_landmarks)

    def one_space(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "id"], kind="stable")
        x = stack_vectors(pdf["x"], pdf["id"])
        reg, lam_value = pdf["reg"].to_numpy(float), float(pdf["lambda"].iloc[0])
        b = s = e = None
        if form == "eigen":
            w, e = eigen_root(kernel.block(x, x), reg)
        else:
            w = inverse_root(gram(x, reg, lam_value, kernel), method)
        if kernel.explicit:
            phi = kernel.features(x)
            b = w @ phi
            if form == "dual" and method == "chol" and phi.shape[1] < len(x):
                s = moments(phi, reg)
        row = {
            "space_id": pdf["space_id"].iloc[0],
            "m": len(x),
            "dim": x.shape[1],
            "rank": len(w),
            "lambda": lam_value,
            "ids": pdf["id"].tolist(),
            "x_flat": x.ravel(),
            "w_flat": w.ravel(),
            "b_flat": None if b is None else b.ravel(),
            "s_flat": None if s is None else s.ravel(),
            "e_flat": e,
        }
        return pd.DataFrame([row])

    return materialize(rows.groupBy("space_id").applyInPandas(one_space, schema))


def _fit_primal(rows: DataFrame, kernel: Kernel, schema: T.StructType) -> DataFrame:
    if not kernel.explicit:
        raise ValueError("the primal form needs a kernel with a feature map")
    partial_schema = T.StructType(
        [
            schema["space_id"],
            T.StructField("salt", T.IntegerType()),
            T.StructField("m", T.LongType()),
            T.StructField("dim", T.LongType()),
            T.StructField("lambda", T.DoubleType()),
            T.StructField("s_flat", T.ArrayType(T.DoubleType())),
        ]
    )

    def partial_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for pdf in batches:
            for space_id, part in pdf.groupby("space_id"):
                x = stack_vectors(part["x"], part["id"])
                s = moments(kernel.features(x), part["reg"].to_numpy(float))
                known = sums.get(space_id)
                if known is None:
                    sums[space_id] = [len(x), x.shape[1], float(part["lambda"].iloc[0]), s]
                else:
                    if known[3].shape != s.shape:
                        raise ValueError(f"vectors of unequal length in subspace {space_id!r}")
                    known[0] += len(x)
                    known[3] = known[3] + s
        salt = TaskContext.get().partitionId() % PARTIAL_SALTS
        for space_id, (m, dim, lam_value, s) in sums.items():
            yield pd.DataFrame(
                [
                    {
                        "space_id": space_id,
                        "salt": salt,
                        "m": m,
                        "dim": dim,
                        "lambda": lam_value,
                        "s_flat": s.ravel(),
                    }
                ]
            )

    def summed(pdf: pd.DataFrame) -> np.ndarray:
        if pdf["s_flat"].map(len).nunique() > 1:
            raise ValueError(f"vectors of unequal length in subspace {pdf['space_id'].iloc[0]!r}")
        flat = np.zeros(len(pdf["s_flat"].iloc[0]))
        for part in pdf["s_flat"]:
            flat += part
        return flat

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        """The partial sums of one salt as one."""
        first = pdf.iloc[:1].copy()
        first["m"] = int(pdf["m"].sum())
        first["s_flat"] = [summed(pdf)]
        return first

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        flat = summed(pdf)
        row = {
            "space_id": pdf["space_id"].iloc[0],
            "m": int(pdf["m"].sum()),
            "dim": int(pdf["dim"].iloc[0]),
            "rank": math.isqrt(len(flat)),
            "lambda": float(pdf["lambda"].iloc[0]),
            "ids": None,
            "x_flat": None,
            "w_flat": None,
            "b_flat": None,
            "s_flat": flat,
            "e_flat": None,
        }
        return pd.DataFrame([row])

    # each task's D x D sums meet in two steps, so that no group has those of all tasks
    partials = rows.mapInPandas(partial_sums, partial_schema)
    joined = partials.groupBy("space_id", "salt").applyInPandas(join, partial_schema)
    return joined.groupBy("space_id").applyInPandas(finish, schema)


def gram_inverse(models: DataFrame) -> DataFrame:
    """Entries of G^-1 = W'W of each dual model: ``(space_id, i, j, g_inv)``."""
    schema = T.StructType(
        [
            models.schema["space_id"],
            T.StructField("i", T.LongType()),
            T.StructField("j", T.LongType()),
            T.StructField("g_inv", T.DoubleType()),
        ]
    )

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                w = np.asarray(row.w_flat).reshape(row.rank, row.m)
                if row.e_flat is not None:
                    w = w * eigen_scale(np.asarray(row.e_flat), row.lam)[:, None]
                yield pd.DataFrame(
                    {
                        "space_id": row.space_id,
                        "i": np.repeat(np.arange(row.m), row.m),
                        "j": np.tile(np.arange(row.m), row.m),
                        "g_inv": (w.T @ w).ravel(),
                    }
                )

    return models.select("space_id", "m", "rank", "w_flat", "e_flat", F.col("lambda").alias("lam")).mapInPandas(
        entries, schema
    )
