"""Anomaly detection: isolation forest and local outlier factor.

Scores follow the usual convention (higher = more normal): isolation
forest ``−2^(−E[h]/c(ψ))``, LOF ``−lof``.  A row is an anomaly when its score
is below the ``contamination`` percentile of all scores (exact percentile,
see :mod:`loomstat.functions.quantiles`).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.functions.quantiles import exact_quantiles
from loomstat.operators.knn import knn_join
from loomstat.session import cut_lineage

EULER = 0.5772156649


def _c(n: float) -> float:
    """Average unsuccessful-search path length in a binary search tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _build_tree(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def grow(idx: np.ndarray, depth: int) -> int:
        node = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return node
        Xi = X[idx]
        lo, hi = Xi.min(0), Xi.max(0)
        usable = np.nonzero(hi > lo)[0]
        if len(usable) == 0:
            return node
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = Xi[:, f] < t
        feat[node], thr[node] = f, t
        left[node] = grow(idx[mask], depth + 1)
        right[node] = grow(idx[~mask], depth + 1)
        return node
    grow(np.arange(len(X)), 0)
    return np.array(feat), np.array(thr), np.array(left), np.array(right), np.array(size)


def _path_lengths(X: np.ndarray, tree) -> np.ndarray:
    feat, thr, left, right, size, cnode = tree
    node = np.zeros(len(X), dtype=int)
    depth = np.zeros(len(X))
    active = feat[node] >= 0
    while active.any():
        f = feat[node[active]]
        go_left = X[active, f] < thr[node[active]]
        node[active] = np.where(go_left, left[node[active]], right[node[active]])
        depth[active] += 1
        active = feat[node] >= 0
    return depth + cnode[node]


def isolation_forest(mat: DataFrame, key: str, n_trees: int = 100, max_samples: int = 256,
                     contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """``(key, anomaly_score, is_anomaly)``, the same however the rows are partitioned.

    Each tree gets the ``max_samples`` rows that are first in its own hash order (ties by key).  A row draws one
    number for each of ``ceil(trees * samples / rows)`` groups of trees, which says whether it is among the first
    rows of a tree and of which, so a large table hashes each row once.  Trees are grown in parallel with
    ``applyInPandas``, collected (at most 2 * samples nodes each) and every row is scored in ``mapInPandas``.
    """
    n = mat.count()
    psi = min(max_samples, n)
    drawn = min(n, psi + 6 * math.sqrt(psi))  # enough that the first psi rows of a tree are among them
    groups = max(1, math.ceil(n_trees * drawn / max(n, 1)))
    per_group = math.ceil(n_trees / groups)
    mask = (1 << 52) - 1

    def place(g):  # uniform in [0, n / drawn): the tree of group g that the row falls to, and where in its order
        u = F.xxhash64(F.lit(seed), g, F.col(key)).bitwiseAND(F.lit(mask)).cast("double") / float(1 << 52)
        return F.struct(g.alias("g"), (u * n / drawn).alias("at"))
    picks = F.filter(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), place), lambda s: s["at"] < per_group)
    samp = mat.select("vec", F.col(key).cast("string").alias("_k"), F.explode(picks).alias("s"))
    samp = samp.select("vec", "_k", (F.col("s.g") * per_group + F.floor("s.at")).cast("int").alias("tree"),
                       F.col("s.at").alias("_at")).where(F.col("tree") < n_trees)
    max_depth = int(math.ceil(math.log2(max(psi, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        first = pdf.sort_values(["_at", "_k"])["vec"].to_numpy()[:psi]
        rng = np.random.default_rng(seed * 1000 + t)
        f, th, lf, rt, sz = _build_tree(np.stack(first), rng, max_depth)
        return pd.DataFrame({"tree": [t], "feat": [f.tolist()], "thr": [th.tolist()], "left": [lf.tolist()],
                             "right": [rt.tolist()], "size": [sz.tolist()]})
    schema = "tree int, feat array<int>, thr array<double>, left array<int>, right array<int>, size array<long>"
    trees = samp.groupBy("tree").applyInPandas(build, schema).collect()  # bounded: n_trees small trees
    trees.sort(key=lambda r: r["tree"])
    forest = [(np.array(r["feat"]), np.array(r["thr"]), np.array(r["left"]), np.array(r["right"]),
               np.array(r["size"]), np.array([_c(x) for x in r["size"]])) for r in trees]
    c_psi = _c(psi)

    def score(it):
        for pdf in it:
            if len(pdf) == 0:
                continue
            X = np.stack(pdf["vec"].to_numpy())
            depth = np.mean([_path_lengths(X, tr) for tr in forest], axis=0) if forest else np.zeros(len(X))
            yield pd.DataFrame({key: pdf[key], "anomaly_score": -np.power(2.0, -depth / c_psi)})
    key_type = mat.schema[key].dataType.simpleString()
    scored = cut_lineage(mat.select(key, "vec").mapInPandas(score, f"{key} {key_type}, anomaly_score double"))
    return _flag(scored, contamination)


def _flag(scored: DataFrame, contamination: float) -> DataFrame:
    q = exact_quantiles(scored.select(F.lit("s").alias("g"), F.col("anomaly_score").alias("v")), [contamination])
    thr = q.get(("s", contamination))
    return scored.withColumn("is_anomaly", F.col("anomaly_score") < F.lit(thr))


def local_outlier_factor(mat: DataFrame, key: str, k: int = 20, contamination: float = 0.05) -> DataFrame:
    """``(key, anomaly_score, is_anomaly)`` with ``anomaly_score = −LOF`` (k-NN by the exact join)."""
    pts = mat.select(F.col(key).alias("rid"), "vec")
    n = pts.count()
    k = min(k, max(n - 1, 1))
    nb = cut_lineage(knn_join(pts.withColumnRenamed("rid", "qid"), pts, k, exclude_self=True))
    kdist = nb.where(F.col("rank") == k).select(F.col("qid").alias("rid"), F.col("dist").alias("kd"))
    reach = nb.join(kdist, "rid").select("qid", F.greatest("dist", "kd").alias("reach"))
    lrd = reach.groupBy("qid").agg((1.0 / (F.avg("reach") + F.lit(1e-10))).alias("lrd"))
    ratio = nb.join(lrd.withColumnRenamed("qid", "rid").withColumnRenamed("lrd", "lrd_n"), "rid") \
              .groupBy("qid").agg(F.avg("lrd_n").alias("m")).join(lrd, "qid")
    scored = ratio.select(F.col("qid").alias(key), (-(F.col("m") / F.col("lrd"))).alias("anomaly_score"))
    return _flag(cut_lineage(scored), contamination)


def top_anomalies(flagged: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` lowest scores (a top-k report)."""
    return flagged.orderBy("anomaly_score", key).limit(n)


def anomaly_detection(df: DataFrame, key: str, features: list[str] | None = None, method: str = "isolation_forest",
                      contamination: float = 0.05, save_labels: bool = False, seed: int = 42):
    """Numeric nulls → 0, standardise, score.  Returns the flagged ``(key, anomaly_score,
    is_anomaly)`` table, or — with ``save_labels`` — the input table with both columns added."""
    from loomstat.operators.cluster import prepare_matrix
    if not 0 < contamination < 0.5:
        raise ValueError("contamination must be in (0, 0.5)")
    mat = prepare_matrix(df, key, features, nulls="zero")
    if method == "isolation_forest":
        flagged = isolation_forest(mat, key, contamination=contamination, seed=seed)
    elif method == "lof":
        flagged = local_outlier_factor(mat, key, contamination=contamination)
    else:
        raise ValueError(f"Unknown method '{method}'")
    return df.join(flagged, key, "left") if save_labels else flagged
