"""Second-order gradient boosting (Newton trees on histograms).

Objectives: ``squared`` (g = f - y, h = 1), ``logistic`` (g = p - y, h = p(1 - p)) and ``softprob`` (one tree a class and
round on the softmax; h = 2p(1 - p)).  A node of a tree splits where the regularised gain

    GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)

is largest (first feature, then lowest cut, on ties), if that exceeds ``gamma`` and both sides keep ``min_child_weight``
of curvature; a leaf is ``-eta * G / (H + lambda)``.

Features are cut once, into at most ``MAX_BINS`` bins: at every distinct value where there are so few, else at
approximate quantiles.  Rows are stored as bin numbers, label and margins.  One level of all trees of a round is one pass:
each task adds up gradients and curvatures by (class, node, feature, bin), Spark sums the tasks' histograms, and the
driver, which holds at most ``MAX_CELLS`` of their cells (checked), picks the splits.  Passes do not grow with the data,
and margins are brought up to date in the stored rows every ``CUT`` rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomstat.operators.stages import Stored, load_json, store_json

MAX_BINS = 256
MAX_CELLS = 50_000_000
CUT = 10
LEAST_GAIN, LEAST_CURVATURE = 1e-6, 1e-16
OBJECTIVES = ("squared", "logistic", "softprob")


@dataclass
class Tree:
    """Nodes in heap order: children of i are 2i + 1 and 2i + 2; ``feature`` is -1 at a leaf.

    A row goes left when its value is below ``threshold`` (its bin below ``cut``)."""

    feature: np.ndarray
    cut: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n))

    def node_of(self, values: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The node each row ends in; ``limits`` is ``cut`` for bin numbers or ``threshold`` for values."""
        at = np.zeros(len(values), np.int64)
        rows = np.arange(len(values))
        while True:
            f = self.feature[at]
            if not (f >= 0).any():
                return at
            right = values[rows, np.maximum(f, 0)] >= limits[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)

    def to_lists(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "cut", "threshold", "value", "gain")}

    @classmethod
    def of_lists(cls, d: dict) -> Tree:
        return cls(np.array(d["feature"], int), np.array(d["cut"], int), *(np.array(d[k], float) for k in ("threshold", "value", "gain")))


def slopes(margin: np.ndarray, y: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature, rows x classes, of margins (rows x classes)."""
    if objective == "squared":
        return margin - y[:, None], np.ones_like(margin)
    p = probabilities(margin, objective)
    if objective == "logistic":
        p = p[:, 1:]
        return p - y[:, None], np.maximum(p * (1 - p), LEAST_CURVATURE)
    g = p.copy()
    g[np.arange(len(y)), y.astype(int)] -= 1
    return g, np.maximum(2 * p * (1 - p), LEAST_CURVATURE)


def probabilities(margin: np.ndarray, objective: str) -> np.ndarray:
    if objective == "logistic":
        p = 1 / (1 + np.exp(-np.clip(margin[:, 0], -500, 500)))
        return np.stack([1 - p, p], 1)
    e = np.exp(margin - margin.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_splits(G: np.ndarray, H: np.ndarray, lam: float, gamma: float, least: float):
    """(gain, feature, cut) of each node: histograms are nodes x features x bins.  A cut at b sends bins below b left."""
    GL, HL = G.cumsum(2)[:, :, :-1], H.cumsum(2)[:, :, :-1]
    Gt, Ht = G.sum(2)[:, :1, None], H.sum(2)[:, :1, None]
    GR, HR = Gt - GL, Ht - HL
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = GL ** 2 / (HL + lam) + GR ** 2 / (HR + lam) - Gt ** 2 / (Ht + lam)
    gain = np.where((HL >= least) & (HR >= least) & np.isfinite(gain), gain, -np.inf)
    flat = gain.reshape(len(G), -1)
    if not flat.shape[1]:
        return [(0.0, -1, 0)] * len(G)
    # Gains within a part in 10^9 are one: sums of doubles come in any order.
    top = flat.max(1, keepdims=True)
    at = (flat >= top - 1e-9 * np.abs(top)).argmax(1)
    out = []
    for i, a in enumerate(at):
        ok = flat[i, a] > max(gamma, LEAST_GAIN)
        out.append((float(flat[i, a]), int(a // gain.shape[2]), int(a % gain.shape[2]) + 1) if ok else (0.0, -1, 0))
    return out


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return col.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _packed(b: np.ndarray) -> pa.Array:
    """A binary value of each row of a matrix."""
    ends = np.arange(len(b) + 1, dtype=np.int32) * (b.shape[1] * b.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(b), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(b))])


def _unpacked(column: pa.Array, kind) -> np.ndarray:
    """The numbers of all rows of a binary column, end to end."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[column.offset]:ends[column.offset + len(column)]].view(kind)


def _lists(m: np.ndarray) -> pa.Array:
    """An array value of each row of a matrix."""
    return pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], np.ascontiguousarray(m).ravel())


def bin_cuts(rows: DataFrame, p: int, max_bins: int = MAX_BINS) -> list[np.ndarray]:
    """Cut values of every feature of ``x`` (array column): a value v is in bin #(cuts <= v)."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list = [np.zeros(0)] * p
        for batch in batches:
            x = _matrix(batch, "x")
            for f in range(p):
                if seen[f] is not None:
                    both = np.union1d(seen[f], x[:, f])
                    seen[f] = both if len(both) <= max_bins else None
        feature = [f for f in range(p) for _ in (range(len(seen[f])) if seen[f] is not None else (0,))]
        value = [v for f in range(p) for v in (seen[f].tolist() if seen[f] is not None else [None])]
        yield pa.RecordBatch.from_arrays([pa.array(feature, pa.int32()), pa.array(value, pa.float64())], names=["f", "v"])

    found = rows.select("x").mapInArrow(few, "f int, v double").distinct()
    most = found.groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("v").isNull()).alias("many"))
    small = [r["f"] for r in most.collect() if not r["many"] and r["n"] <= max_bins]
    cuts: dict[int, np.ndarray] = {f: np.zeros(0) for f in small}
    for f, g in found.where(F.col("f").isin(small or [-1])).toPandas().groupby("f"):
        cuts[f] = np.sort(g["v"].to_numpy(float))[1:]
    large = [f for f in range(p) if f not in cuts]
    for i in range(0, len(large), 50):
        part = large[i:i + 50]
        probs = F.array(*[F.lit(k / max_bins) for k in range(1, max_bins)])
        r = rows.agg(*[F.percentile_approx(F.col("x")[f], probs, 10_000).alias(f"q{f}") for f in part],
                     *[F.min(F.col("x")[f]).alias(f"m{f}") for f in part]).first()
        for f in part:
            q = np.unique(np.array(r[f"q{f}"], float))
            cuts[f] = q[q > r[f"m{f}"]]
    return [cuts[f] for f in range(p)]


class NewtonBoostModel(Model, Stored):
    """Trees by round and class; adds ``prediction`` and, for classes, ``rawPrediction`` and ``probability``."""

    def __init__(self, trees: list[list[Tree]], base: list[float], objective: str, featuresCol: str, n_features: int):
        super().__init__()
        self.trees, self.base, self.objective, self.featuresCol = trees, base, objective, featuresCol
        self.n_features = n_features

    @property
    def featureImportances(self) -> DenseVector:
        """Total gain of each feature's splits, as a share of all gain."""
        total = np.zeros(self.n_features)
        for tree in (t for group in self.trees for t in group):
            np.add.at(total, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return DenseVector(total / total.sum() if total.sum() else total)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return add_trees(np.tile(np.array(self.base), (len(x), 1)), x, self.trees, "threshold")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def margin(x: pd.Series) -> pd.Series:
            return pd.Series(list(model.margins(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

        scored = dataset.withColumn("_m", margin(vector_to_array(self.featuresCol)))
        if self.objective == "squared":
            return scored.withColumn("prediction", F.col("_m")[0]).drop("_m")
        if self.objective == "logistic":
            p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("_m")[0]))
            raw, prob = F.array(-F.col("_m")[0], F.col("_m")[0]), F.array(1 - p, p)
            best = F.when(p > 0.5, 1.0).otherwise(0.0)
        else:
            shifted = F.transform("_m", lambda v: F.exp(v - F.array_max("_m")))
            prob = F.transform(shifted, lambda v: v / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))
            raw, best = F.col("_m"), (F.array_position("_m", F.array_max("_m")) - 1).cast("double")
        return scored.withColumn("rawPrediction", array_to_vector(raw)).withColumn("probability", array_to_vector(prob)) \
                     .withColumn("prediction", best).drop("_m")

    def _store(self, spark: SparkSession, path: str) -> None:
        store_json(spark, path, "state", {"trees": [[t.to_lists() for t in g] for g in self.trees], "base": self.base,
                                          "objective": self.objective, "featuresCol": self.featuresCol, "n": self.n_features})

    @classmethod
    def _restore(cls, spark: SparkSession, path: str) -> NewtonBoostModel:
        s = load_json(spark, path, "state")
        return cls([[Tree.of_lists(t) for t in g] for g in s["trees"]], s["base"], s["objective"], s["featuresCol"], s["n"])


def add_trees(margin: np.ndarray, values: np.ndarray, trees: list[list[Tree]], limits: str) -> np.ndarray:
    for group in trees:
        for c, tree in enumerate(group):
            margin[:, c] += tree.value[tree.node_of(values, getattr(tree, limits))]
    return margin


class NewtonBoost(Estimator):
    """Fits a ``NewtonBoostModel``; ``n_classes`` 0 is regression, 2 logistic, more softprob."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", n_classes: int = 0, max_depth: int = 3,
                 eta: float = 0.3, rounds: int = 10, lam: float = 1.0, gamma: float = 0.0, min_child_weight: float = 1.0,
                 max_bins: int = MAX_BINS):
        super().__init__()
        self.featuresCol, self.labelCol, self.n_classes = featuresCol, labelCol, n_classes
        self.max_depth, self.eta, self.rounds = max_depth, eta, rounds
        self.lam, self.gamma, self.min_child_weight, self.max_bins = lam, gamma, min_child_weight, max_bins
        self.objective = OBJECTIVES[min(max(n_classes - 1, 0), 2)]

    def _start(self, rows: DataFrame) -> list[float]:
        """Starting margins: the mean, its log odds, or nothing for several classes."""
        if self.objective == "softprob":
            return [0.0] * self.n_classes
        mean = float(rows.agg(F.avg("y")).first()[0])
        if self.objective == "squared":
            return [mean]
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        return [float(np.log(mean / (1 - mean)))]

    def _fit(self, dataset: DataFrame) -> NewtonBoostModel:
        rows = dataset.select(vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y"))
        rows = rows.where("y IS NOT NULL")
        head = rows.first()
        if head is None:
            raise ValueError("boosting needs at least one labelled row")
        p = len(head["x"])
        base = self._start(rows)
        cuts = bin_cuts(rows, p, self.max_bins)
        bins = max(len(c) for c in cuts) + 1
        width = len(base)
        if width * 2 ** max(self.max_depth - 1, 0) * p * bins > MAX_CELLS:
            raise ValueError(f"a level's histograms have more than {MAX_CELLS} cells; use fewer bins or a smaller depth")
        objective, kind = self.objective, np.uint8 if bins <= 256 else np.uint16

        def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch, "x")
                b = np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(cuts)], 1).astype(kind)
                yield pa.RecordBatch.from_arrays([_packed(b), batch.column(batch.schema.get_field_index("y")),
                                                  _lists(np.tile(base, (len(b), 1)))], names=["b", "y", "m"])

        def unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            b = _unpacked(batch.column(0), kind).reshape(batch.num_rows, p)
            m = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, width).copy()
            return b, batch.column(1).to_numpy(), m

        schema = "b binary, y double, m array<double>"
        data = rows.mapInArrow(store, schema).persist(StorageLevel.MEMORY_AND_DISK)
        trees: list[list[Tree]] = []
        pending: list[list[Tree]] = []  # not yet in the stored margins

        def advance(done: list[list[Tree]]) -> DataFrame:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        b, _, m = unpack(batch)
                        m = add_trees(m, b, done, "cut")
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(m)],
                                                         names=["b", "y", "m"])
            return data.mapInArrow(run, schema).persist(StorageLevel.MEMORY_AND_DISK)

        for _ in range(self.rounds):
            group = [Tree.empty(self.max_depth) for _ in range(width)]
            for depth in range(self.max_depth + 1):
                G, H = self._histograms(data, unpack, group, list(pending), depth, p, bins, width, objective)
                if not self._grow(group, G, H, depth, cuts):
                    break
            trees.append(group)
            pending.append(group)
            if len(pending) == CUT and len(trees) < self.rounds:
                fresh = advance(list(pending))
                fresh.count()
                data.unpersist()
                data, pending = fresh, []
        data.unpersist()
        return NewtonBoostModel(trees, base, objective, self.featuresCol, p)

    def _histograms(self, data: DataFrame, unpack, group: list[Tree], done: list[list[Tree]], depth: int, p: int, bins: int,
                    width: int, objective: str) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradients and curvatures, class x node of this level x feature x bin; at the deepest level, where
        nothing splits, of the first feature only."""
        nodes, first = 2 ** depth, 2 ** depth - 1
        used = p if depth < self.max_depth else 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, width * nodes * used * bins))
            for batch in batches:
                if not batch.num_rows:
                    continue
                b, y, m = unpack(batch)
                g, h = slopes(add_trees(m, b, done, "cut"), y, objective)
                for c, tree in enumerate(group):
                    node = tree.node_of(b, tree.cut) - first
                    live = node >= 0
                    for f in range(used):
                        key = ((c * nodes + node[live]) * used + f) * bins + b[live, f]
                        for i, v in enumerate((g, h)):
                            total[i] += np.bincount(key, v[live, c], total.shape[1])
            at = np.flatnonzero(total[1])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["at", "g", "h"])

        sums = data.mapInArrow(run, "at long, g double, h double").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        found = sums.toPandas()
        out = np.zeros((2, width * nodes * used * bins))
        out[:, found["at"].to_numpy()] = found[["g", "h"]].to_numpy().T
        return tuple(out.reshape(2, width, nodes, used, bins))

    def _grow(self, group: list[Tree], G: np.ndarray, H: np.ndarray, depth: int, cuts: list[np.ndarray]) -> bool:
        """Leaf values of this level and its splits; whether anything was split."""
        first, grown = 2 ** depth - 1, False
        for c, tree in enumerate(group):
            g, h = G[c, :, 0].sum(1), H[c, :, 0].sum(1)
            tree.value[first:first + len(g)] = -self.eta * g / np.where(h + self.lam > 0, h + self.lam, 1)
            if depth == self.max_depth:
                continue
            for i, (gain, f, cut) in enumerate(best_splits(G[c], H[c], self.lam, self.gamma, self.min_child_weight)):
                if f >= 0:
                    at, grown = first + i, True
                    tree.feature[at], tree.cut[at], tree.threshold[at], tree.gain[at] = f, cut, cuts[f][cut - 1], gain
        return grown
