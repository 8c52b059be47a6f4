"""Dimensionality reduction: PCA (MLlib) and FastICA.

Both work on the standardised ``(key, vec)`` matrix.  FastICA (parallel,
log-cosh contrast) whitens with the PCA of the data and runs each
fixed-point step as one tree of sums (one array comes back a round) of ``E[z·g(Wz)ᵀ]`` and
``E[g'(Wz)]`` — a k×k result — followed by symmetric decorrelation.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.blocks import batch_matrix, tree_reduce


def _fit_pca(mat: DataFrame, n: int):
    d = mat.withColumn("features", array_to_vector("vec"))
    p = len(mat.select("vec").first()[0])
    n = max(1, min(n, p, mat.count()))
    model = PCA(k=n, inputCol="features", outputCol="pcs").fit(d)
    comps = model.pc.toArray().copy()  # p × n
    for j in range(comps.shape[1]):  # sign: the largest-magnitude loading is positive
        if comps[np.argmax(np.abs(comps[:, j])), j] < 0:
            comps[:, j] = -comps[:, j]
    return comps, np.array(model.explainedVariance.toArray()), n, p


def pca(mat: DataFrame, key: str, n: int = 2) -> tuple[DataFrame, list[float]]:
    """``(key, component_1 … component_n)`` and explained-variance ratios (4 dp)."""
    comps, ev, n, _ = _fit_pca(mat, n)
    cols = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in comps[:, j]]), lambda a, b: a * b),
                        F.lit(0.0), lambda s, x: s + x).alias(f"component_{j + 1}") for j in range(n)]
    return mat.select(key, *cols), [round(float(v), 4) for v in ev]


def _sym_decorrelate(W: np.ndarray) -> np.ndarray:
    s, u = np.linalg.eigh(W @ W.T)
    s = np.clip(s, 1e-12, None)
    return (u * (1.0 / np.sqrt(s))) @ u.T @ W


def ica(mat: DataFrame, key: str, n: int = 2, seed: int = 42, max_iter: int = 200, tol: float = 1e-4):
    """``(key, component_1 … component_n)`` of FastICA; returns also the iterations used."""
    comps, ev, n, p = _fit_pca(mat, n)
    rows = mat.count()
    # eigenvalues of the sample covariance of the standardised data
    trace = p * rows / max(rows - 1, 1)
    lam = np.clip(ev[:n] * trace, 1e-12, None)
    K = comps[:, :n] / np.sqrt(lam)[None, :]  # whitening: z = x·K
    zcols = [F.aggregate(F.zip_with("vec", F.array(*[F.lit(float(x)) for x in K[:, j]]), lambda a, b: a * b),
                         F.lit(0.0), lambda s, x: s + x) for j in range(n)]
    whitened = mat.select(key, F.array(*zcols).alias("z"))
    Z = whitened.persist(StorageLevel.MEMORY_AND_DISK)
    W = _sym_decorrelate(np.random.default_rng(seed).normal(size=(n, n)))
    it = 0
    for it in range(1, max_iter + 1):
        Wb = W.copy()

        def step(batches, Wb=Wb):
            total = np.zeros((n, n + 2))  # g(Wz) z', then the derivatives and the rows
            for batch in batches:
                if batch.num_rows:
                    X = batch_matrix(batch, "z")
                    G = np.tanh(X @ Wb.T)  # rows × n
                    total[:, :n] += G.T @ X
                    total[:, n] += (1 - G ** 2).sum(0)
                    total[:, n + 1] += len(X)
            return {0: total}
        sums = tree_reduce(Z.select("z"), step)[0]
        g, dsum, c = sums[:, :n], sums[:, n], sums[0, n + 1]
        W_new = _sym_decorrelate(g / c - (dsum / c)[:, None] * W)
        lim = np.max(np.abs(np.abs(np.einsum("ij,ij->i", W_new, W)) - 1))
        W = W_new
        if lim < tol:
            break
    else:
        warnings.warn(f"FastICA did not reach tol={tol} in {max_iter} rounds", stacklevel=2)
    S = [F.aggregate(F.zip_with("z", F.array(*[F.lit(float(x)) for x in W[j]]), lambda a, b: a * b),
                     F.lit(0.0), lambda s, x: s + x).alias(f"component_{j + 1}") for j in range(n)]
    Z.unpersist()
    return whitened.select(key, *S), it


