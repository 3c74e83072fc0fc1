"""Classifying rows by the class subspace that captures most of their energy."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernspan.functions.kernels import Kernel
from kernspan.operators.fit import MAX_LANDMARKS, fit
from kernspan.operators.score import MAX_MODEL_BYTES, least_leverage
from kernspan.operators.tiles import TiledModel, fit_tiled, tiled_leverage_min


def fit_class_subspaces(
    chosen: DataFrame,
    n_rows: int,
    kernel: Kernel | None = None,
    form: str = "dual",
    max_landmarks: int = MAX_LANDMARKS,
) -> DataFrame | TiledModel:
    """One subspace per label of the chosen rows ``(id, label, x)``.

    All weights are 1 and lambda is 1 / sqrt(n) for a table of n rows. The
    models' ``space_id`` is the label. Classes beyond the landmark bound of the
    dual form want ``form='primal'`` or, for any kernel, ``form='tiled'``, where a
    label's rows are many blocks and no task fits a whole label.
    """
    landmarks = chosen.select(
        F.col("label").cast("long").alias("label"),
        F.lit(0).alias("ord"),
        "id",
        "x",
        F.lit(1.0).alias("reg"),
    )
    lam = 1.0 / math.sqrt(n_rows)
    if form == "tiled":
        return fit_tiled(landmarks, lam, kernel, by="label")
    return fit(landmarks, lam, kernel, form, by="label", max_landmarks=max_landmarks)


def classify_max_projection(
    df: DataFrame,
    class_models: DataFrame | TiledModel,
    kernel: Kernel | None = None,
    x: str = "x",
    max_model_bytes: int = MAX_MODEL_BYTES,
) -> DataFrame:
    """Add ``pred_label`` and ``residual`` = k(y, y) - best energy.

    Most energy is least leverage. Equal energies go to the smallest label.
    """
    if isinstance(class_models, TiledModel):
        labels = class_models.blocks.agg(F.array_sort(F.collect_set("space_id"))).scalar()
        renamed = df.withColumnRenamed(x, "x") if x != "x" else df
        scored = tiled_leverage_min(renamed, class_models, "_least").withColumnRenamed("x", x)
        return scored.select(
            *df.columns, F.get(labels, F.col("best")).alias("pred_label"), F.col("_least").alias("residual")
        )
    labels = class_models.agg(F.array_sort(F.collect_list("space_id"))).scalar()
    scored = least_leverage(df, class_models, kernel, x, "_least", max_model_bytes)
    return scored.select(
        *df.columns,
        F.get(labels, F.col("_least")[0].cast("int")).alias("pred_label"),
        F.col("_least")[1].alias("residual"),
    )
