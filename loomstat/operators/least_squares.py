"""Linear least squares by a tree of QR factorisations.

Forming X'X squares the condition number, which columns like x and x^5 do not survive.  Here every task factorises its rows
[1, X, y], scaled by the columns' largest values, and only the triangles go on: two of them stacked are factorised again, up
the tree.  The last triangle holds all that is needed; columns that depend on others get the smallest coefficients
(singular values below ``RCOND`` of the largest count as none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.blocks import batch_matrix, tree_reduce
from loomstat.operators.stages import Stored, load_json, store_json

RCOND = 1e-12
STEP_ROWS = 8192


def triangle(a: np.ndarray) -> np.ndarray:
    """R of a, with at most as many rows as columns."""
    return np.linalg.qr(a, mode="r") if len(a) > a.shape[1] else a


def qr_triangle(rows: DataFrame, names: list[str], scale: np.ndarray) -> np.ndarray:
    """R of the table [1, *names] (array or number columns), each column divided by its ``scale``."""
    def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        r = np.zeros((0, len(scale)))
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.hstack([np.ones((batch.num_rows, 1)), *(batch_matrix(batch, c) if pa.types.is_list(batch.schema.field(c).type)
                                                            else batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)[:, None] for c in names)]) / scale
            for at in range(0, len(a), STEP_ROWS):
                r = triangle(np.vstack([r, a[at:at + STEP_ROWS]]))
        return {0: r}
    return tree_reduce(rows, task, lambda blocks: triangle(np.vstack(blocks)), 8 * len(scale) ** 2).get(0, np.zeros((0, len(scale))))


def solve(rows: DataFrame, x: str = "x", y: str = "y") -> tuple[float, np.ndarray]:
    """(intercept, coefficients) of y on the array column x."""
    head = rows.select(F.size(x).alias("p")).first()
    if head is None:
        raise ValueError("least squares needs at least one row")
    p = head["p"]

    def largest(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        top = np.zeros(p + 1)
        for batch in batches:
            if batch.num_rows:
                top[:p] = np.maximum(top[:p], np.abs(batch_matrix(batch, x)).max(0))
                top[p] = max(top[p], np.abs(batch.column(batch.schema.get_field_index(y)).to_numpy(zero_copy_only=False)).max())
        return {0: top}
    top = tree_reduce(rows, largest, lambda blocks: np.max(blocks, 0))[0]
    scale = np.r_[1.0, np.where(top > 0, top, 1.0)]
    r = qr_triangle(rows, [x, y], scale)
    # Coefficients of a centred fit: the triangle without its first column's share is that of the centred table.
    centred = r.copy()
    if len(centred):
        first = centred[:, 0]
        centred -= np.outer(first, first @ centred) / max(float(first @ first), 1e-300)
    u, s, vt = np.linalg.svd(centred[:, 1:p + 1], full_matrices=False)
    keep = s > RCOND * (s[0] if len(s) else 0.0)
    beta = vt[keep].T @ ((u[:, keep].T @ centred[:, p + 1]) / s[keep])
    mean = (r[:, 0] @ r) / max(float(r[:, 0] @ r[:, 0]), 1e-300)  # means of all columns: [1, X, y]'1 / n
    intercept = (mean[p + 1] - mean[1:p + 1] @ beta) * scale[p + 1]
    return float(intercept), beta * scale[p + 1] / scale[1:p + 1]


class LeastSquaresModel(Model, Stored):
    def __init__(self, intercept: float, coefficients: np.ndarray, featuresCol: str):
        super().__init__()
        self.intercept, self.coefficients, self.featuresCol = intercept, DenseVector(coefficients), featuresCol

    def _transform(self, dataset: DataFrame) -> DataFrame:
        b, w = self.intercept, self.coefficients.toArray()

        @F.pandas_udf(T.DoubleType())
        def predict(x: pd.Series) -> pd.Series:
            return pd.Series(np.stack(x.to_numpy()) @ w + b if len(x) else [], dtype=float)
        return dataset.withColumn("prediction", predict(vector_to_array(self.featuresCol)))

    def _store(self, spark: SparkSession, path: str) -> None:
        store_json(spark, path, "state", {"intercept": self.intercept, "coefficients": self.coefficients.toArray().tolist(),
                                          "featuresCol": self.featuresCol})

    @classmethod
    def _restore(cls, spark: SparkSession, path: str) -> LeastSquaresModel:
        s = load_json(spark, path, "state")
        return cls(s["intercept"], np.array(s["coefficients"]), s["featuresCol"])


class LeastSquares(Estimator):
    """Ordinary least squares of ``labelCol`` on ``featuresCol``."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label"):
        super().__init__()
        self.featuresCol, self.labelCol = featuresCol, labelCol

    def _fit(self, dataset: DataFrame) -> LeastSquaresModel:
        rows = dataset.select(vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y"))
        return LeastSquaresModel(*solve(rows.where("y IS NOT NULL")), self.featuresCol)
