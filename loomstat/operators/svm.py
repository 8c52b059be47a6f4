"""RBF-kernel SVM on Nystroem features, with cross-fitted class probabilities.

The kernel ``K(x, y) = exp(-gamma |x - y|^2)`` is replaced by the inner product of ``z(x) = K_mm^-1/2 k_m(x)``, where ``k_m(x)``
are the kernel values of x with m landmark rows of the data (a hash sample).  Landmarks are doubled until the kernel error,
measured on other rows (``kernel_error``: the root mean square of K - z.z'), is at most ``KERNEL_TOLERANCE`` or ``MAX_LANDMARKS``
is reached; a table with no more rows than that is its own landmarks, and the kernel is exact.

All one-vs-rest machines are fitted together: C times the sum of a hinge smoothed over a width of ``SMOOTH`` around the margin,
plus half the squared weights, by Newton steps (on the straight part of the hinge, which has no curvature, with that of the
parabola that touches it there and bounds it).  A step is one pass over the stored rows for all machines, a tree of sums
of losses, gradients and Hessians, so passes grow neither with the data nor with the classes or folds.

Probabilities are Platt's, cross-fitted: the decision values that the logistic map is fitted to come from machines that did not
see their rows (``PLATT_FOLDS`` folds by a hash of the row).
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.functions.blocks import batch_matrix, tree_reduce
from loomstat.operators.stages import Stored, load_json, store_json

START_LANDMARKS, MAX_LANDMARKS, KERNEL_TOLERANCE = 64, 512, 0.01
PROBES = 400
SMOOTH, MAX_STEPS, STEP_TOLERANCE = 0.25, 40, 1e-4
PACE = 1.8  # steps of a bound may go almost twice as far
PLATT_FOLDS = 3


def rbf(X: np.ndarray, L: np.ndarray, gamma: float) -> np.ndarray:
    d = (X * X).sum(1)[:, None] + (L * L).sum(1) - 2 * X @ L.T
    return np.exp(-gamma * np.maximum(d, 0.0))


def root_inverse(L: np.ndarray, gamma: float) -> np.ndarray:
    """K_mm^-1/2, without the directions that landmarks near one another add nothing in."""
    s, u = np.linalg.eigh(rbf(L, L, gamma))
    keep = s > 1e-10 * s[-1]
    return u[:, keep] / np.sqrt(s[keep])


def choose_landmarks(dataset: DataFrame, features: str, gamma: float) -> tuple[np.ndarray, np.ndarray, float]:
    """(landmarks, K_mm^-1/2, kernel error)."""
    order = F.xxhash64(vector_to_array(features), F.lit(7))
    rows = dataset.select(vector_to_array(features).alias("x")).distinct().orderBy(order, "x").limit(MAX_LANDMARKS + PROBES).collect()
    X = np.array([r["x"] for r in rows], float)
    if len(X) <= MAX_LANDMARKS:
        return X, root_inverse(X, gamma), 0.0
    probe = X[MAX_LANDMARKS:]
    true, m = rbf(probe, probe, gamma), START_LANDMARKS
    while True:
        root = root_inverse(X[:m], gamma)
        z = rbf(probe, X[:m], gamma) @ root
        error = float(np.sqrt(((true - z @ z.T) ** 2).mean()))
        if error <= KERNEL_TOLERANCE or m >= MAX_LANDMARKS:
            return X[:m], root, error
        m *= 2


def smooth_hinge(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(loss, slope, curvature) of the hinge 1 - margin, rounded over ``SMOOTH`` on both sides of 1."""
    d = 1 + SMOOTH - margin
    inside = (d > 0) & (d < 2 * SMOOTH)
    loss = np.where(inside, d * d / (4 * SMOOTH), np.maximum(1 - margin, 0.0))
    slope = np.where(inside, -d / (2 * SMOOTH), np.where(margin < 1, -1.0, 0.0))
    return loss, slope, np.where(inside, 1 / (2 * SMOOTH), 0.0)


def fit_machines(rows: DataFrame, k: int, dim: int, C: float, folds: int = 0,
                 lift: Callable[[np.ndarray], np.ndarray] = lambda z: z) -> np.ndarray:
    """Weights (folds + 1 sets x machines x features + intercept) of k one-vs-rest machines on ``(z, y, w, fold)``: one set
    for all rows and one without each fold, all in the same passes.  ``lift`` makes ``dim`` features of the stored z."""
    n = k * (folds + 1)
    ridge = np.r_[np.ones(dim), 1e-6]

    def parts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features, signs by machine, and weights by set of a batch."""
        column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
        z = np.hstack([lift(batch_matrix(batch, "z")), np.ones((batch.num_rows, 1))])
        y = column["y"].to_numpy(zero_copy_only=False).astype(int)
        sign = np.where(y[:, None] == (np.arange(k) if k > 1 else [1]), 1.0, -1.0)
        seen = np.ones((batch.num_rows, folds + 1))
        if folds:
            seen[:, 1:] = column["fold"].to_numpy(zero_copy_only=False)[:, None] != np.arange(folds)
        return z, sign, C * seen * column["w"].to_numpy(zero_copy_only=False)[:, None]

    def state_at(W: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss, gradient and bounding Hessian of every machine."""
        def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            out = np.zeros((n, dim + 2, dim + 1))  # the Hessian's rows, then the gradient
            loss = np.zeros(n)
            for batch in batches:
                if batch.num_rows:
                    z, sign, weight = parts(batch)
                    for i in range(n):
                        s, w = sign[:, i % k], weight[:, i // k]
                        margin = s * (z @ W[i])
                        value, g, h = smooth_hinge(margin)
                        h = np.where(margin < 1 - SMOOTH, 1 / (2 * np.maximum(1 - margin, SMOOTH)), h) * w
                        on = h > 0
                        out[i, :-1] += (z[on] * h[on, None]).T @ z[on]
                        out[i, -1] += (w * g * s) @ z
                        loss[i] += w @ value
            return {-1: loss} | {i: out[i] for i in range(n)}
        sums = tree_reduce(rows, task, block_bytes=8 * (dim + 2) * (dim + 1))
        loss = sums[-1] + 0.5 * (ridge * W ** 2).sum(1)
        return loss, np.array([sums[i][-1] for i in range(n)]) + ridge * W, np.array([sums[i][:-1] for i in range(n)]) + np.diag(ridge)

    W = np.zeros((n, dim + 1))
    loss, gradient, hessian = state_at(W)
    step = -np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
    pace = np.full(n, PACE)
    for _ in range(MAX_STEPS):
        tried = W + pace[:, None] * step
        new_loss, new_gradient, new_hessian = state_at(tried)
        better = new_loss <= loss
        gain = (loss - new_loss)[better] / np.maximum(loss[better], 1e-12)
        settled = better.all() and (gain <= STEP_TOLERANCE).all() or pace.min() < 1e-3
        W[better], loss[better] = tried[better], new_loss[better]
        step[better] = -np.linalg.solve(new_hessian[better], new_gradient[better][:, :, None])[:, :, 0]
        pace = np.where(better, PACE, pace / 4)
        if settled:
            return W.reshape(folds + 1, k, dim + 1)
    warnings.warn(f"the SVM had not settled after {MAX_STEPS} Newton steps", stacklevel=2)
    return W.reshape(folds + 1, k, dim + 1)


class NystroemSvmModel(Model, Stored):
    def __init__(self, W: np.ndarray, landmarks: np.ndarray, root: np.ndarray, gamma: float, platt: LogisticRegressionModel,
                 featuresCol: str, kernel: str, kernel_error: float):
        super().__init__()
        self.W, self.landmarks, self.root, self.gamma, self.platt = W, landmarks, root, gamma, platt
        self.featuresCol, self.kernel, self.kernel_error = featuresCol, kernel, kernel_error

    def _transform(self, dataset: DataFrame) -> DataFrame:
        W, landmarks, root, gamma, linear = self.W, self.landmarks, self.root, self.gamma, self.kernel == "linear"

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def decide(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            X = np.stack(x.to_numpy())
            z = X if linear else rbf(X, landmarks, gamma) @ root
            f = z @ W[:, :-1].T + W[:, -1]
            return pd.Series(list(np.hstack([-f, f]) if len(W) == 1 else f))
        raw = decide(vector_to_array(self.featuresCol))
        scored = dataset.withColumn("_raw", raw).withColumn("rawPrediction", array_to_vector("_raw"))
        scored = scored.withColumn("prediction", (F.array_position("_raw", F.array_max("_raw")) - 1).cast("double"))
        return self.platt.transform(scored).drop("_raw", "_platt_raw")

    def _store(self, spark: SparkSession, path: str) -> None:
        store_json(spark, path, "state", {
            "W": self.W.tolist(), "landmarks": self.landmarks.tolist(), "root": self.root.tolist(), "gamma": self.gamma,
            "featuresCol": self.featuresCol, "kernel": self.kernel, "kernel_error": self.kernel_error})
        self.platt.write().save(f"{path}/platt")

    @classmethod
    def _restore(cls, spark: SparkSession, path: str) -> NystroemSvmModel:
        s = load_json(spark, path, "state")
        return cls(np.array(s["W"]), np.array(s["landmarks"]), np.array(s["root"]), s["gamma"],
                   LogisticRegressionModel.load(f"{path}/platt"), s["featuresCol"], s["kernel"], s["kernel_error"])


class NystroemSvmClassifier(Estimator):
    def __init__(self, featuresCol: str = "features", labelCol: str = "label", C: float = 1.0, kernel: str = "rbf",
                 gamma: float | None = None, weightCol: str | None = None):
        super().__init__()
        self.featuresCol, self.labelCol, self.C, self.kernel = featuresCol, labelCol, C, kernel
        self.gamma, self.weightCol = gamma, weightCol

    def _fit(self, dataset: DataFrame) -> NystroemSvmModel:
        first = dataset.select(self.featuresCol).first()
        p = len(first[0]) if first is not None else 1
        gamma = self.gamma or 1.0 / max(p, 1)
        landmarks, root, error = (np.zeros((0, p)), np.zeros((0, 0)), 0.0) if self.kernel == "linear" \
            else choose_landmarks(dataset, self.featuresCol, gamma)
        linear, C = self.kernel == "linear", self.C

        def lift(X: np.ndarray) -> np.ndarray:
            return X if linear else rbf(X, landmarks, gamma) @ root
        rows = dataset.select(vector_to_array(self.featuresCol).alias("z"), F.col(self.labelCol).cast("double").alias("y"),
                              (F.col(self.weightCol).cast("double") if self.weightCol else F.lit(1.0)).alias("w"))
        # The few raw features are stored: hundreds of kernel features a row are cheaper made again than read.
        data = rows.withColumn("fold", F.pmod(F.xxhash64("z"), F.lit(PLATT_FOLDS)).cast("int")).persist(StorageLevel.MEMORY_AND_DISK)
        k = int(data.agg(F.max("y")).first()[0] or 0) + 1
        machines, dim = (1 if k <= 2 else k), (p if linear else root.shape[1])
        W, *held = fit_machines(data, machines, dim, C, PLATT_FOLDS, lift)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def unseen(z: pd.Series, fold: pd.Series) -> pd.Series:
            if not len(z):
                return pd.Series([], dtype=object)
            Z, at = lift(np.stack(z.to_numpy())), fold.to_numpy()
            f = np.zeros((len(Z), machines))
            for i, V in enumerate(held):
                f[at == i] = Z[at == i] @ V[:, :-1].T + V[:, -1]
            return pd.Series(list(np.hstack([-f, f]) if machines == 1 else f))
        platt = LogisticRegression(featuresCol="rawPrediction", labelCol="y", probabilityCol="probability",
                                   rawPredictionCol="_platt_raw", predictionCol="", regParam=1e-6, maxIter=50)
        platt = platt.fit(data.select(array_to_vector(unseen("z", "fold")).alias("rawPrediction"), "y"))
        data.unpersist()
        return NystroemSvmModel(W, landmarks, root, gamma, platt, self.featuresCol, self.kernel, error)
