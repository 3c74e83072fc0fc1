"""Kernel ridge regression on landmark sets, and a one-vs-all vote over subspaces.

A ridge table has the columns ``space_id, ord, id, x, alpha``: one row per landmark,
with its coefficients of all outputs as an array.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kernspan.functions.kernels import Kernel, linear
from kernspan.operators import conjugate
from kernspan.operators import fit as fitting
from kernspan.operators.landmarks import landmark_semi_join
from kernspan.operators.score import (
    MAX_MODEL_BYTES,
    _id_or_null,
    blocks,
    list_column,
    rows_of,
    with_nulls,
)
from kernspan.session import materialize

#: classes a one-vs-all fit may have; their list is collected
MAX_CLASSES = 10_000


def one_hot(label: Column | str, classes: list) -> Column:
    label = F.col(label) if isinstance(label, str) else label
    return F.transform(F.lit(classes), lambda c: F.when(label == c, 1.0).otherwise(0.0))


def class_list(df: DataFrame, label: str = "label") -> list:
    """The distinct labels in order (null is none), after checking there are few."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(row[0] for row in found)


def with_targets(
    spaces: DataFrame, df: DataFrame, targets: Column, out: str = "targets"
) -> DataFrame:
    """Landmarks joined to the target values of their rows in ``df``."""
    values = landmark_semi_join(df.select("id", targets.alias(out)), spaces)
    return spaces.join(values.select("space_id", "ord", out), ["space_id", "ord"])


def _fit(
    spaces: DataFrame, lam: float, kernel: Kernel, max_landmarks: int, solver: str | None
) -> DataFrame:
    if solver not in (None, "direct", "iterative"):
        raise ValueError(f"solver must be 'direct' or 'iterative', not {solver!r}")
    if solver is None:
        most = spaces.groupBy("space_id").count().agg(F.max("count")).first()[0] or 0
        solver = "direct" if most <= max_landmarks or lam <= 0 else "iterative"
    if solver == "iterative":
        return conjugate.solve(spaces, lam, kernel)
    schema = T.StructType(
        [
            spaces.schema["space_id"],
            T.StructField("ord", spaces.schema["ord"].dataType),
            spaces.schema["id"],
            T.StructField("x", T.ArrayType(T.DoubleType())),
            T.StructField("alpha", T.ArrayType(T.DoubleType())),
        ]
    )

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord", kind="stable")
        x = fitting.stack_vectors(pdf["x"], pdf["id"])
        g = fitting.gram(x, pdf["reg"].to_numpy(float), lam, kernel)
        w = fitting.inverse_root(g, "chol")
        alpha = w.T @ (w @ fitting.stack_vectors(pdf["targets"], pdf["id"]))
        return pdf[["space_id", "ord", "id", "x"]].assign(alpha=list(alpha))

    rows = fitting.bounded_groups(
        spaces.select("space_id", "ord", "id", "x", "reg", "targets"), max_landmarks
    )
    return materialize(rows.groupBy("space_id").applyInPandas(solve, schema))


def ridge_fit(
    spaces: DataFrame,
    df: DataFrame,
    target: Column | str,
    lam: float,
    kernel: Kernel | None = None,
    max_landmarks: int = fitting.MAX_LANDMARKS,
    solver: str | None = None,
) -> DataFrame:
    """alpha = G^-1 f per subspace, f the target of its landmarks; in parallel.

    The direct solver factors each subspace in one task, the iterative one multiplies by
    blocks and bounds no subspace. Unless one is named, a table with a subspace of more
    than ``max_landmarks`` is solved iteratively; the results agree to 1e-8.
    """
    target = F.col(target) if isinstance(target, str) else target
    joined = with_targets(spaces, df, F.array(target.cast("double")))
    return _fit(joined, lam, kernel or linear(), max_landmarks, solver)


def ridge_fit_multi(
    spaces: DataFrame,
    df: DataFrame,
    targets: Column,
    lam: float,
    kernel: Kernel | None = None,
    max_landmarks: int = fitting.MAX_LANDMARKS,
    solver: str | None = None,
) -> DataFrame:
    """The same for an array of targets per row, e.g. ``one_hot`` labels."""
    joined = with_targets(spaces, df, targets.cast("array<double>"))
    return _fit(joined, lam, kernel or linear(), max_landmarks, solver)


def _coefficients(ridge: DataFrame, kernel: Kernel, max_bytes: int) -> Iterator[list[tuple]]:
    """``(landmarks or None, coefficients)`` per subspace, in space order, in groups of
    at most ``max_bytes``, collected one after the other.

    With a feature map the landmarks fold into one weight vector per output, so what
    several groups fold into may come as one.
    """
    values = F.size("x") + F.size("alpha")
    sizes = ridge.groupBy("space_id").agg((F.sum(values) * 8).alias("bytes")).collect()
    if not sizes:
        raise ValueError("no ridge coefficients to predict with")
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
    folded: list[tuple] = []
    for ids in groups:
        found = _collect(ridge, ids, kernel, len(groups) > 1)
        if not kernel.explicit:
            yield found
            continue
        if folded and sum(alpha.nbytes for _, alpha in [*folded, *found]) > max_bytes:
            yield folded
            folded = []
        folded = [*folded, *found]
    if folded:
        yield folded


def _collect(ridge: DataFrame, ids: list, kernel: Kernel, some: bool) -> list[tuple]:
    rows = ridge.filter(F.col("space_id").isin(ids)) if some else ridge
    spaces = defaultdict(list)
    for row in rows.select("space_id", "ord", "x", "alpha").collect():
        spaces[row["space_id"]].append((row["ord"], row["x"], row["alpha"]))
    out = []
    for space_id in sorted(spaces):
        _, x, alpha = zip(*sorted(spaces[space_id]), strict=True)
        x, alpha = np.array(x, dtype=float), np.array(alpha).T
        out.append((None, alpha @ kernel.features(x)) if kernel.explicit else (x, alpha))
    return out


def ridge_predict_spaces(
    df: DataFrame,
    ridge: DataFrame,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "predictions",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """Add the predictions of every subspace: an array of arrays over outputs."""
    kernel = kernel or linear()
    parts = [
        _predictor(df, models, kernel)(F.col(x), _id_or_null(df))
        for models in _coefficients(ridge, kernel, max_model_bytes)
    ]
    return df.withColumn(out, F.concat(*parts) if len(parts) > 1 else parts[0])


def _predictor(
    df: DataFrame, models: list[tuple], kernel: Kernel
) -> Callable[[Column, Column], Column]:
    shared = df.sparkSession.sparkContext.broadcast(models)
    outputs = np.array([len(alpha) for _, alpha in models])
    width = max(max(alpha.shape) for _, alpha in models)

    def evaluate(x: pa.Array, ids: pa.Array) -> pa.Array:
        rows, present = rows_of(x, ids)
        parts = [np.hstack(_outputs(block, shared.value, kernel)) for block in blocks(rows, width)]
        flat = np.concatenate(parts).ravel() if parts else np.empty(0)
        inner = list_column(flat, np.tile(outputs, len(rows)))
        offsets = np.arange(0, len(inner) + 1, len(outputs), dtype=np.int32)
        return with_nulls(pa.ListArray.from_arrays(pa.array(offsets), inner), present)

    return F.arrow_udf(evaluate, "array<array<double>>")


def _outputs(block: np.ndarray, models: list[tuple], kernel: Kernel) -> list[np.ndarray]:
    """The predictions of each subspace for a block of rows, (n, outputs)."""
    phi = kernel.features(block) if kernel.explicit else None
    return [
        (phi if seen is None else kernel.block(block, seen)) @ alpha.T for seen, alpha in models
    ]


def _voter(
    df: DataFrame, models: list[tuple], kernel: Kernel, n_classes: int
) -> Callable[[Column, Column], Column]:
    """How many subspaces give each class their highest output."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    width = max(max(alpha.shape) for _, alpha in models)

    def evaluate(x: pa.Array, ids: pa.Array) -> pa.Array:
        rows, present = rows_of(x, ids)
        parts = [np.empty((0, n_classes), np.int32)]
        for block in blocks(rows, width):
            votes = np.zeros((len(block), n_classes), np.int32)
            for outputs in _outputs(block, shared.value, kernel):
                votes[np.arange(len(block)), outputs.argmax(axis=1)] += 1
            parts.append(votes)
        counted = np.concatenate(parts)
        column = list_column(counted.ravel(), np.full(len(counted), n_classes))
        return with_nulls(column, present)

    return F.arrow_udf(evaluate, "array<int>")


def ridge_predict(
    df: DataFrame, ridge: DataFrame, kernel: Kernel | None = None, x: str = "x", out: str = "pred"
) -> DataFrame:
    """sum_i alpha_i k(X_i, y) of a single-output model of one subspace."""
    predicted = ridge_predict_spaces(df, ridge, kernel, x, "_predictions")
    return predicted.withColumn(out, F.col("_predictions")[0][0]).drop("_predictions")


def ridge_predict_multi(
    df: DataFrame, ridge: DataFrame, kernel: Kernel | None = None, x: str = "x", out: str = "preds"
) -> DataFrame:
    """The predictions of all outputs of one subspace, as an array."""
    predicted = ridge_predict_spaces(df, ridge, kernel, x, "_predictions")
    return predicted.withColumn(out, F.col("_predictions")[0]).drop("_predictions")


def ridge_classify_vote(
    df: DataFrame,
    ridge: DataFrame,
    classes: list,
    kernel: Kernel | None = None,
    x: str = "x",
    out: str = "pred_label",
    label_type: str = "long",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """Each subspace votes for its highest output; ties go to the smaller label."""
    kernel, votes = kernel or linear(), None
    for models in _coefficients(ridge, kernel, max_model_bytes):
        part = _voter(df, models, kernel, len(classes))(F.col(x), _id_or_null(df))
        votes = part if votes is None else F.zip_with(votes, part, lambda a, b: a + b)
    labels = F.lit(classes).cast(f"array<{label_type}>")
    counted = df.withColumn("_votes", votes)
    winner = F.array_position("_votes", F.array_max("_votes")).cast("int")
    return counted.withColumn(out, F.element_at(labels, winner)).drop("_votes")
