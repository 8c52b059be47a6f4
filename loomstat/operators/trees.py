"""Decision trees of any depth, with exact splits, and forests of them.

A node splits at the midpoint of two neighbouring values of a feature, where the children's impurity (Gini, or variance) is
smallest; on ties the first feature and the lowest value win.  It is a leaf when it is pure, when no feature tells its rows
apart, or at ``max_depth``.

A node of at most ``NODE_ROWS`` rows is finished where it is: Spark groups its rows in one task, which keeps them sorted by
each feature and tries every cut of all nodes of a level at once, down to the leaves.  So a table of that size gives the exact
tree.  Larger nodes are split first, a level of them in a pass: tasks add up class weights (or moments) by (node, feature,
bin), the sums are combined in a tree, and the best of at most ``MAX_BINS`` cuts a feature is taken (exact where a feature has
no more distinct values).

Rows that are equal in all features never part.  Where a table above ``NODE_ROWS`` rows has at most that many different ones, their
statistics are added up first, in one pass for all trees, and each tree is grown from these points: exact, whatever the rows.

A model of at most ``LOCAL_NODES`` nodes is held whole.  Of a larger one, the driver and the tasks hold the upper part only;
below it, subtrees of at most ``PIECE_NODES`` nodes are rows of a table, which scoring joins with.  An upper part of more than
``MAX_NODES`` nodes (chains) is refused, with the depth to give, never cut.

All trees of a forest grow in the same passes.  A tree counts each row as often as a Poisson draw says (by row and tree), and a
node looks at ``n_features`` features drawn among those that differ in it.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

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

from loomstat.functions.blocks import batch_matrix, tree_reduce
from loomstat.operators.boosting import MAX_BINS, bin_cuts
from loomstat.operators.stages import Stored, load_json, store_json
from loomstat.session import cut_lineage

NODE_ROWS = 50_000
MAX_NODES = 2_000_000
LOCAL_NODES = 500_000
PIECE_NODES = 256
LOT_BYTES = 64 << 20  # histograms of a pass
PACK_ROWS = 200_000  # rows that leave a task together, packed by tree and node
#: Scores within this share of the best one are as good: sums of doubles come in any order.
TIE = 1e-10
#: Poisson(1): chances of at most 0, 1, 2, ... draws.
DRAWS = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(18)])


def mix(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash (splitmix) of unsigned numbers."""
    a = a + np.uint64(0x9E3779B97F4A7C15)
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def drawn(ids: np.ndarray, key: np.uint64) -> np.ndarray:
    """How often a tree (by its key) draws each row."""
    share = (mix(ids.astype(np.uint64) ^ key) >> np.uint64(11)) * 2.0 ** -53
    out = (share >= DRAWS[0]).astype(float)
    for d in DRAWS[1:3]:
        out += share >= d
    rest = np.flatnonzero(out == 3)  # one in twelve
    out[rest] = np.searchsorted(DRAWS, share[rest], side="right")
    return out


def score(stats: np.ndarray, classes: int) -> np.ndarray:
    """What a node keeps of its spread, the larger the purer: sum of squared class weights by weight, or (sum wy)^2 / sum w."""
    if classes:
        total = stats.sum(-1)
        top = (stats ** 2).sum(-1)
    else:
        total, top = stats[..., 0], stats[..., 1] ** 2
    return np.divide(top, total, out=np.zeros_like(top), where=total > 0)


def row_stats(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    """The statistics of single rows: weight by class, or (w, wy, wy^2)."""
    if classes:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y.astype(int)] = w
        return out
    return np.stack([w, w * y, w * y * y], 1)


def is_pure(stats: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        return np.count_nonzero(stats, -1) < 2
    w, s, q = np.moveaxis(stats, -1, 0)
    return q - np.divide(s * s, w, out=np.zeros_like(s), where=w > 0) <= 1e-12 * np.maximum(q, 1e-300)


def some_features(keys: np.ndarray, differs: np.ndarray, m: int) -> np.ndarray:
    """Features x nodes: ``m`` features that differ in a node, drawn by the node's key."""
    order = mix(keys[None, :] + np.arange(len(differs), dtype=np.uint64)[:, None])
    rank = np.where(differs, order >> np.uint64(1), np.uint64(1 << 63)).argsort(0, kind="stable").argsort(0, kind="stable")
    return differs & (rank < m)


def child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the left and right children, one after the other."""
    return mix(np.stack([keys, ~keys], 1).ravel())


def firsts(groups: np.ndarray) -> np.ndarray:
    """Whether each item is the first of its group (groups lie together)."""
    return np.r_[True, groups[1:] != groups[:-1]][:len(groups)]


class Nodes:
    """A growing list of nodes: feature (-1 leaf), threshold, children, statistics, level, tree and key."""

    def __init__(self, width: int):
        self.feature, self.threshold, self.left, self.right, self.gain = [], [], [], [], []
        self.level, self.tree, self.key = [], [], []
        self.stats: list[np.ndarray] = []
        self.width = width

    def add(self, stats: np.ndarray, level: int, tree: int, key: np.uint64) -> int:
        for column, value in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.gain, 0.0),
                              (self.level, level), (self.tree, tree), (self.key, key)):
            column.append(value)
        self.stats.append(stats)
        return len(self.feature) - 1

    def arrays(self) -> dict[str, np.ndarray]:
        return {"feature": np.array(self.feature, np.int32), "threshold": np.array(self.threshold, float),
                "left": np.array(self.left, np.int32), "right": np.array(self.right, np.int32), "gain": np.array(self.gain, float),
                "stats": np.array(self.stats, float).reshape(-1, self.width), "piece": np.full(len(self.feature), -1, np.int64)}


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int | None, m: int | None = None,
         key: int = 0) -> dict[str, np.ndarray]:
    """The exact tree of some rows, level by level; with ``m``, a node looks at that many features."""
    return grow_points(x, row_stats(y, w, classes), classes, depth, m, key)


def grow_points(x: np.ndarray, every: np.ndarray, classes: int, depth: int | None, m: int | None = None,
                key: int = 0) -> dict[str, np.ndarray]:
    """``grow`` from points and their statistics: rows that are equal in all features never part."""
    columns = [np.ascontiguousarray(c) for c in every.T[:classes or 2]]
    n, p = x.shape
    values = [np.ascontiguousarray(v) for v in x.T]
    orders = [np.argsort(v, kind="stable").astype(np.int32) for v in values]  # rows by (node, value)
    sizes, keys = np.array([n]), np.array([key], np.uint64)
    levels: list[dict[str, np.ndarray]] = []
    done, goes_left = 0, np.zeros(n, bool)
    while len(sizes):
        starts = sizes.cumsum() - sizes
        k = len(sizes)
        now = {"feature": np.full(k, -1, np.int32), "threshold": np.zeros(k), "left": np.full(k, -1, np.int32),
               "right": np.full(k, -1, np.int32), "gain": np.zeros(k), "stats": np.add.reduceat(every[orders[0]], starts),
               "level": np.full(k, len(levels), np.int32)}
        levels.append(now)
        done += k
        alive = np.flatnonzero((sizes > 1) & ~is_pure(now["stats"], classes)) if len(levels) - 1 != depth else np.zeros(0, int)
        orders, sizes = _only(orders, sizes, alive)
        feature, at, gain, split = _cuts(values, columns, orders, sizes, now["stats"][alive], classes, m, keys[alive])
        orders, sizes = _only(orders, sizes, split)
        if not len(split):
            break
        alive, feature, gain = alive[split], feature[split], gain[split]
        starts, seg = sizes.cumsum() - sizes, np.repeat(np.arange(len(sizes)), sizes)
        low, high = np.zeros((2, len(split)))
        for f in np.unique(feature):
            mine = np.flatnonzero(feature == f)
            place = starts[mine] + at[split[mine]]
            low[mine], high[mine] = x[orders[f][place], f], x[orders[f][place + 1], f]
        middle = (low + high) / 2
        threshold = np.where(middle < high, middle, low)
        rows = orders[0]
        goes_left[rows] = x[rows, feature[seg]] <= threshold[seg]
        to_left = np.add.reduceat(goes_left[rows].astype(np.int64), starts)
        both = np.stack([to_left, sizes - to_left], 1).ravel()
        lefts = np.repeat(np.arange(len(both)) % 2 == 0, both)  # the children's places
        for f, o in enumerate(orders):
            side = goes_left[o]
            orders[f] = new = np.empty_like(o)
            new[lefts], new[~lefts] = o[side], o[~side]
        now["feature"][alive], now["threshold"][alive], now["gain"][alive] = feature, threshold, gain
        now["left"][alive] = done + 2 * np.arange(len(split))
        now["right"][alive] = now["left"][alive] + 1
        sizes, keys = both, child_keys(keys[alive])
    return {c: np.concatenate([level[c] for level in levels]) for c in levels[0]}


def _only(orders: list[np.ndarray], sizes: np.ndarray, nodes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows and sizes of some nodes."""
    if len(nodes) == len(sizes):
        return orders, sizes
    stays = np.zeros(len(sizes), bool)
    stays[nodes] = True
    stays = np.repeat(stays, sizes)
    return [o[stays] for o in orders], sizes[nodes]


def _cuts(values: list[np.ndarray], columns: list[np.ndarray], orders: list[np.ndarray], sizes: np.ndarray, stats: np.ndarray,
          classes: int, m: int | None, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node the feature, place (the last row on the left) and gain of its best cut; and the nodes that have one.

    ``columns`` are the rows' weights by class, or w and wy.  Only the features that a node looks at are tried."""
    k, p = len(sizes), len(orders)
    whole = score(stats, classes)
    ends = sizes.cumsum()
    tops, slack, place = np.full((p, k), -np.inf), np.zeros((p, k)), np.zeros((p, k), np.int64)
    usable = np.array([v[o[ends - sizes]] != v[o[ends - 1]] for v, o in zip(values, orders)], bool).reshape(p, k)
    if m is not None:
        usable = some_features(keys, usable, m)
    for f, o in enumerate(orders):
        mine = np.flatnonzero(usable[f])
        if not len(mine):
            continue
        (o,), few = _only([o], sizes, mine)
        starts, v = few.cumsum() - few, values[f][o]
        differs = v[1:] != v[:-1]
        differs[starts[1:] - 1] = False
        at = np.flatnonzero(differs)
        seg = np.repeat(np.arange(len(mine)), few)
        node = seg[at]
        edge = np.flatnonzero(firsts(node))
        if classes:
            lefts, rights = [np.zeros(len(at)), np.zeros(len(at))], [np.zeros(len(at)), np.zeros(len(at))]
            for c, column in enumerate(columns):
                sums = column[o].cumsum()
                left = sums[at] - np.where(starts > 0, sums[starts - 1], 0)[node]
                right = stats[mine, c][node] - left
                for (total, top), part in ((lefts, left), (rights, right)):
                    total += part
                    part *= part
                    top += part
            gains = lefts[1] / lefts[0] + rights[1] / rights[0] - whole[mine][node]
        else:  # around the node's mean: the sums stay small
            w, wy = columns[0][o], columns[1][o]
            sums = w.cumsum()
            left = sums[at] - np.where(starts > 0, sums[starts - 1], 0)[node]
            sums = (wy - (stats[mine, 1] / stats[mine, 0])[seg] * w).cumsum()
            gains = (sums[at] - np.where(starts > 0, sums[starts - 1], 0)[node]) ** 2 * (1 / left + 1 / (stats[mine, 0][node] - left))
        top = np.maximum.reduceat(gains, edge)
        room = TIE * np.maximum(np.abs(top), whole[mine])
        good = np.flatnonzero(gains >= (top - room)[node])
        good = good[firsts(node[good])]
        tops[f, mine], slack[f, mine], place[f, mine] = top, room, at[good] - starts[node[good]]
    feature, best = np.full(k, -1), np.zeros(k)
    for f in range(p):
        better = usable[f] & ((feature < 0) | (tops[f] > best + slack[f]))
        feature[better], best[better] = f, tops[f, better]
    return feature, place[np.maximum(feature, 0), np.arange(k)] if p else best, best, np.flatnonzero(feature >= 0)


def leaf_of(x: np.ndarray, tree: dict[str, np.ndarray], root: int | np.ndarray = 0) -> np.ndarray:
    at, live, flat = np.full(len(x), root, np.int64), np.arange(len(x)), np.ascontiguousarray(x).ravel()
    while True:
        node = at[live]
        f = tree["feature"][node]
        inside = f >= 0
        if not inside.all():
            live, node, f = live[inside], node[inside], f[inside]
        if not len(live):
            return at
        left = flat.take(live * x.shape[1] + f) <= tree["threshold"][node]
        at[live] = np.where(left, tree["left"][node], tree["right"][node])


PARTS = ("node int, at int, feature array<int>, threshold array<double>, left array<int>, right array<int>, gain array<double>, "
         "stats array<double>, piece array<long>, depth int")


def lots(batches: Iterator[pa.RecordBatch], weights) -> Iterator[tuple]:
    """(x, y, weights of a tree) of many rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if held and (batch is None or sum(b.num_rows for b in held) >= PACK_ROWS or sum(b.nbytes for b in held) >= LOT_BYTES // 2):
            x, y = (np.concatenate(c) for c in zip(*[(batch_matrix(b, "x"), b.column(1).to_numpy(zero_copy_only=False)) for b in held]))
            yield x, y, lambda t, held=held: np.concatenate([weights(b, t) for b in held])
            held = []


def in_pieces(part: dict[str, np.ndarray], node: int) -> pa.Table:
    """A grown tree as rows of ``PARTS``: its upper part (``at`` -1), whose leaves name pieces, and the pieces."""
    level, inner = part["level"], part["feature"] >= 0
    bounds = np.r_[np.flatnonzero(firsts(level)), len(level)]
    size, parent = np.ones(len(level), np.int64), np.zeros(len(level), np.int64)
    for a, b in zip(bounds[-2::-1], bounds[::-1]):
        i = a + np.flatnonzero(inner[a:b])
        size[i] += size[part["left"][i]] + size[part["right"][i]]
    for side in ("left", "right"):
        parent[part[side][inner]] = np.flatnonzero(inner)
    upper = size > PIECE_NODES
    root = ~upper & upper[parent]
    root[0] = not upper[0]
    number = np.where(root, root.cumsum() - 1, -1)
    for a, b in zip(bounds[1:], bounds[2:]):
        below = a + np.flatnonzero(~upper[a:b] & ~root[a:b])
        number[below] = number[parent[below]]
    order = np.argsort(number, kind="stable")
    order = order[np.searchsorted(number[order], 0):]
    count = np.bincount(number[order])
    first = count.cumsum() - count
    local = np.zeros(len(level), np.int64)
    local[order] = np.arange(len(order)) - np.repeat(first, count)
    top = np.flatnonzero(upper | root)
    place = np.zeros(len(level), np.int64)
    place[top] = np.arange(len(top))
    offsets = np.r_[0, len(top) + np.r_[0, count.cumsum()]].astype(np.int32)
    both, width = np.r_[top, order], part["stats"].shape[1]

    def lists(in_top: np.ndarray, kind: pa.DataType, below: np.ndarray, each: int = 1) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets * each, pa.int32()), pa.array(np.r_[in_top, below].ravel(), kind))
    columns = {"node": pa.array(np.full(len(count) + 1, node), pa.int32()), "at": pa.array(np.arange(-1, len(count)), pa.int32()),
               "feature": lists(np.where(upper[top], part["feature"][top], -1), pa.int32(), part["feature"][order]),
               "threshold": lists(part["threshold"][top], pa.float64(), part["threshold"][order])}
    for side in ("left", "right"):
        columns[side] = lists(np.where(upper[top], place[part[side][top]], -1), pa.int32(),
                              np.where(inner[order], local[part[side][order]], -1))
    columns["gain"] = lists(np.where(upper[top], part["gain"][top], 0), pa.float64(), part["gain"][order])
    columns["stats"] = lists(part["stats"][top], pa.float64(), part["stats"][order], width)
    columns["piece"] = lists(np.where(upper[top], -1, number[top]), pa.int64(), np.full(len(order), -1))
    deep = np.maximum.reduceat(level[order], first) - level[order][first]
    columns["depth"] = pa.array(np.r_[0, deep], pa.int32())
    return pa.table(columns)


def graft(top: dict[str, np.ndarray], parts: dict[int, dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The whole tree: leaves of ``top`` replaced by the trees that were grown for them."""
    out = {k: [v] for k, v in top.items()}
    n = len(top["feature"])
    for leaf, part in sorted(parts.items()):
        shift = n - 1  # node 0 of the part is the leaf itself
        moved = {k: np.where(part[k] >= 0, part[k] + shift, -1) for k in ("left", "right")}
        moved = part | moved
        for k in out:
            out[k][0] = out[k][0].copy()
            out[k][0][leaf] = moved[k][0]
            out[k].append(moved[k][1:])
        n += len(part["feature"]) - 1
    return {k: np.concatenate(v) for k, v in out.items()}


def part_arrays(row: dict, width: int) -> dict[str, np.ndarray]:
    """A row of ``PARTS`` as arrays."""
    kinds = {"feature": np.int32, "threshold": float, "left": np.int32, "right": np.int32, "gain": float, "stats": float, "piece": np.int64}
    out = {k: np.array(row[k], kind) for k, kind in kinds.items()}
    return out | {"stats": out["stats"].reshape(-1, width)}


def piece_id(node, at):
    """One number of a piece: the open leaf above it and its place among that leaf's pieces."""
    return node * 2 ** 31 + at


class ExactTreeModel(Model, Stored):
    """One tree, or several whose class shares (or means) are averaged.  ``tree`` holds all nodes, or the upper part of a larger
    model, whose leaves with a ``piece`` go on in the table ``pieces``."""

    def __init__(self, tree: dict[str, np.ndarray], classes: int, featuresCol: str, n_features: int, roots: list[int] | None = None,
                 importances: list[float] | None = None, pieces: DataFrame | None = None):
        super().__init__()
        self.tree, self.classes, self.featuresCol, self.n_features = tree, classes, featuresCol, n_features
        self.roots, self.pieces = [0] if roots is None else roots, pieces
        self.importances = importances or [0.0] * n_features

    @property
    def depth(self) -> int:
        level = np.zeros(len(self.tree["feature"]), int)
        for i in range(len(level)):  # children come after their parents
            for side in ("left", "right"):
                if self.tree[side][i] >= 0:
                    level[self.tree[side][i]] = level[i] + 1
        return int(level.max())

    @property
    def featureImportances(self) -> DenseVector:
        """Share of the impurity decrease that each feature's cuts bring (of several trees: the average)."""
        return DenseVector(self.importances)

    def _values(self, stats: np.ndarray) -> np.ndarray:
        """What a leaf says: class shares, or the mean."""
        top, total = (stats, stats.sum(1, keepdims=True)) if self.classes else (stats[:, 1:2], stats[:, :1])
        return np.divide(top, total, out=np.zeros_like(top), where=total > 0)

    def _place(self, dataset: DataFrame):
        """A function of ``x``: the sum of the leaves' values in the upper part, and the pieces where trees go on."""
        roots = self.roots
        tree = {k: self.tree[k] for k in ("feature", "threshold", "left", "right", "piece")}
        shared = dataset.sparkSession.sparkContext.broadcast((tree, self._values(self.tree["stats"])))

        @F.pandas_udf("v array<double>, at array<long>")
        def place(x: pd.Series) -> pd.DataFrame:
            if not len(x):
                return pd.DataFrame({"v": pd.Series([], dtype=object), "at": pd.Series([], dtype=object)})
            tree, value = shared.value
            x = np.stack(x.to_numpy())
            total, ends = np.zeros((len(x), value.shape[1])), np.empty((len(x), len(roots)), np.int64)
            for i, root in enumerate(roots):
                leaf = leaf_of(x, tree, root)
                ends[:, i] = tree["piece"][leaf]
                total += np.where(ends[:, i:i + 1] < 0, value[leaf], 0)
            return pd.DataFrame({"v": list(total), "at": [e[e >= 0] for e in ends]})
        return place

    def _walked(self, dataset: DataFrame, at: str) -> DataFrame:
        """Adds ``_w``, the value of the leaf that a row's ``_x`` reaches in the piece of number ``at`` (null without one)."""
        width = self.classes or 3
        t = self.pieces.select(F.col("id").alias("_id"), F.struct("feature", "threshold", "left", "right", "stats", "depth").alias("_t"))

        def step(i, _):
            f = F.get(F.col("_t.feature"), i)
            goes = F.when(F.get(F.col("_x"), f) <= F.get(F.col("_t.threshold"), i), F.get(F.col("_t.left"), i)).otherwise(F.get(F.col("_t.right"), i))
            return F.when(f < 0, i).otherwise(goes)
        leaf = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("_t.depth"), F.lit(1))), F.lit(0), step)
        found = dataset.join(t, F.col(at) == F.col("_id"), "left").withColumn("_s", F.slice("_t.stats", leaf * width + 1, width))
        if self.classes:
            total = F.aggregate("_s", F.lit(0.0), lambda a, b: a + b)
            return found.withColumn("_w", F.transform("_s", lambda s: s / total)).drop("_id", "_t", "_s")
        return found.withColumn("_w", F.when(F.col("_s").isNotNull(), F.array(F.col("_s")[1] / F.col("_s")[0]))).drop("_id", "_t", "_s")

    def _sums(self, dataset: DataFrame) -> DataFrame:
        """Adds ``_v``, the sum of all trees' values."""
        width = self.classes or 1
        placed = dataset.withColumn("_x", vector_to_array(self.featuresCol))
        if self.pieces is None:
            return placed.withColumn("_v", self._place(dataset)("_x")["v"]).drop("_x")
        if len(self.roots) == 1 or dataset.isStreaming:  # rows stay as they are: a join for every tree
            placed = placed.withColumn("_p", self._place(dataset)("_x")).withColumn("_v", F.col("_p.v"))
            for i in range(len(self.roots)):
                placed = self._walked(placed.withColumn("_a", F.get("_p.at", F.lit(i))), "_a")
                placed = placed.withColumn("_v", F.when(F.col("_w").isNull(), F.col("_v"))
                                           .otherwise(F.zip_with("_v", "_w", lambda a, b: a + b))).drop("_w", "_a")
            return placed.drop("_p", "_x")
        # A row and tree each: numbers of rows stay the same in a checkpoint.
        kept = cut_lineage(placed.withColumn("_row", F.monotonically_increasing_id()))
        probes = kept.select("_row", "_x", self._place(dataset)("_x").alias("_p"))
        direct = probes.select("_row", F.col("_p.v").alias("_w"))
        below = self._walked(probes.select("_row", "_x", F.explode("_p.at").alias("_a")), "_a").select("_row", "_w")
        sums = direct.unionByName(below).groupBy("_row").agg(*[F.sum(F.col("_w")[c]).alias(f"_{c}") for c in range(width)])
        sums = sums.select("_row", F.array(*[F.col(f"_{c}") for c in range(width)]).alias("_v"))
        return kept.join(sums, "_row").drop("_row", "_x")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        scored, trees = self._sums(dataset), float(len(self.roots))
        if not self.classes:
            return scored.withColumn("prediction", F.col("_v")[0] / trees).drop("_v")
        best = (F.array_position("_v", F.array_max("_v")) - 1).cast("double")
        return scored.withColumn("rawPrediction", array_to_vector("_v")) \
                     .withColumn("probability", array_to_vector(F.transform("_v", lambda v: v / trees))) \
                     .withColumn("prediction", best).drop("_v")

    def _store(self, spark: SparkSession, path: str) -> None:
        store_json(spark, path, "state", {"classes": self.classes, "featuresCol": self.featuresCol, "n": self.n_features, "roots": self.roots,
                                          "importances": self.importances, "pieces": self.pieces is not None})
        rows = zip(*(self.tree[k].tolist() for k in ("feature", "threshold", "left", "right", "gain", "stats", "piece")))
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "node int, feature int, threshold double, left int, right int, "
                              "gain double, stats array<double>, piece long").write.parquet(f"{path}/nodes")
        if self.pieces is not None:
            self.pieces.write.parquet(f"{path}/pieces")

    @classmethod
    def _restore(cls, spark: SparkSession, path: str) -> ExactTreeModel:
        s = load_json(spark, path, "state")
        rows = spark.read.parquet(f"{path}/nodes").orderBy("node").toPandas()
        tree = {k: rows[k].to_numpy() for k in ("feature", "threshold", "left", "right", "gain", "piece")}
        return cls(tree | {"stats": np.array(rows["stats"].tolist(), float)}, s["classes"], s["featuresCol"], s["n"], s["roots"],
                   s["importances"], spark.read.parquet(f"{path}/pieces") if s["pieces"] else None)


class ExactTree(Estimator):
    """Fits an ``ExactTreeModel``; ``n_classes`` 0 is regression."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", n_classes: int = 0, max_depth: int | None = None,
                 weightCol: str | None = None):
        super().__init__()
        self.featuresCol, self.labelCol, self.n_classes = featuresCol, labelCol, n_classes
        self.max_depth, self.weightCol = max_depth, weightCol
        self.keys: list[np.uint64] = [np.uint64(0)]
        self.bagged, self.root_features = False, False

    def _fit(self, dataset: DataFrame) -> ExactTreeModel:
        rows = dataset.select(vector_to_array(self.featuresCol).alias("x"), F.col(self.labelCol).cast("double").alias("y"),
                              (F.col(self.weightCol).cast("double") if self.weightCol else F.lit(1.0)).alias("w"))
        rows = rows.where("y IS NOT NULL AND w > 0")
        if self.bagged:  # draws go by the row's number
            rows = rows.withColumn("id", F.monotonically_increasing_id())
        seen = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("p"), F.approx_count_distinct("x").alias("points")).first()
        n, p = seen["n"], seen["p"]
        if not n:
            raise ValueError("a tree needs at least one labelled row")
        m = math.ceil(math.sqrt(p)) if self.root_features else None
        if n > NODE_ROWS and seen["points"] <= NODE_ROWS:
            grown = self._from_points(rows, p, m)
            if grown is not None:
                return self._model(self._roots().arrays(), grown, p)
        if self.bagged:  # a checkpoint keeps the numbers for all passes
            rows = cut_lineage(rows)
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        top, open_ = self._top(rows, n, p, m)
        tree, grown = top.arrays(), None
        if open_:
            grown = self._bottom(rows, top, tree, open_, m)
        rows.unpersist()
        return self._model(tree, grown, p)

    def _weights(self, batch: pa.RecordBatch, tree: int) -> np.ndarray:
        w = batch.column(2).to_numpy(zero_copy_only=False)
        return w * drawn(batch.column(3).to_numpy(), self.keys[tree]) if self.bagged else w

    def _roots(self) -> Nodes:
        nodes = Nodes(self.n_classes or 3)
        for t, key in enumerate(self.keys):
            nodes.add(np.zeros(nodes.width), 0, t, key)
        return nodes

    def _from_points(self, rows: DataFrame, p: int, m: int | None) -> DataFrame | None:
        """The exact trees of the distinct feature vectors, as rows of ``PARTS``; None where they or their statistics are too many."""
        classes, depth, weights, keys = self.n_classes, self.max_depth, self._weights, self.keys
        width, trees = classes or 3, range(len(keys))
        every = rows.select("x").distinct().limit(NODE_ROWS + 1).toPandas()["x"]
        if len(every) > NODE_ROWS or 8 * len(every) * width * len(keys) > LOT_BYTES:
            return None
        points = np.unique(np.stack(every.to_numpy()) + 0.0, axis=0)  # 0.0: no negative zero
        # A vector's number: its first features' number and the next feature's place, renumbered feature by feature.
        steps, number = [], np.zeros(len(points), np.int64)
        for f in range(p):
            own = np.unique(points[:, f])
            code = number * len(own) + np.searchsorted(own, points[:, f])
            known = np.unique(code)
            steps.append((own, known))
            number = np.searchsorted(known, code)
        place = np.argsort(number)

        def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            sums = {t: np.zeros((width, len(place))) for t in trees}
            for x, y, w_of in lots(batches, weights):
                at = np.zeros(len(x), np.int64)
                for f, (own, known) in enumerate(steps):
                    at = np.searchsorted(known, at * len(own) + np.searchsorted(own, x[:, f]))
                for t in trees:
                    w = w_of(t)
                    if classes:
                        sums[t] += np.bincount(at * width + y.astype(np.int64), w, width * len(place)).reshape(-1, width).T
                    else:
                        for j, v in enumerate((w, w * y, w * y * y)):
                            sums[t][j] += np.bincount(at, v, len(place))
            return sums
        # A tree may have drawn no row of a point.
        found = tree_reduce(rows, task, block_bytes=8 * width * len(place))
        held = [(t, found[t].tobytes()) for t in trees if found[t].any()]
        ordered = points[place]

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    stats = np.frombuffer(data).reshape(width, -1).T
                    live = (stats if classes else stats[:, :1]).any(1)
                    yield from in_pieces(grow_points(ordered[live], stats[live], classes, depth, m, int(keys[t])), t).to_batches()
        each = rows.sparkSession.createDataFrame(held, "node int, data binary").repartition(len(held), "node")
        return cut_lineage(each.mapInArrow(finish, PARTS))

    def _top(self, rows: DataFrame, n: int, p: int, m: int | None) -> tuple[Nodes, list[int]]:
        """Nodes down to those of at most ``NODE_ROWS`` rows, and the leaves among them that are to be finished."""
        classes, depth, weights = self.n_classes, self.max_depth, self._weights
        width, roots, nodes = classes or 3, len(self.keys), self._roots()
        if n <= NODE_ROWS:
            return nodes, list(range(roots))
        small, large = [], list(range(roots))
        cuts = bin_cuts(rows, p, MAX_BINS)
        bins = max(len(c) for c in cuts) + 1
        lot = max(1, LOT_BYTES // (8 * p * bins * (width + 1)))
        while large:
            tree, found = nodes.arrays(), {}
            for i in range(0, len(large), lot):
                by_tree: dict[int, list[int]] = {}
                for node in large[i:i + lot]:
                    by_tree.setdefault(nodes.tree[node], []).append(node)

                def task(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
                    sums = {t: np.zeros((p, len(mine) * bins, width + 1)) for t, mine in by_tree.items()}  # statistics, then rows
                    number = np.full(len(tree["feature"]), -1)
                    for mine in by_tree.values():
                        number[mine] = np.arange(len(mine))
                    for every, y, w_of in lots(batches, weights):
                        binned = [np.searchsorted(cuts[f], every[:, f], side="right") for f in range(p)]
                        for t, mine in by_tree.items():
                            w = w_of(t)
                            own = number[leaf_of(every, tree, t)]
                            live = np.flatnonzero((own >= 0) & (w > 0))
                            own, v, w = own[live], y[live], w[live]
                            for f in range(p):
                                key = own * bins + binned[f][live]
                                sums[t][f, :, -1] += np.bincount(key, minlength=len(mine) * bins)
                                if classes:
                                    sums[t][f, :, :-1] += np.bincount(key * classes + v.astype(np.int64), w, len(mine) * bins * classes).reshape(-1, classes)
                                    continue
                                for j, part in enumerate((w, w * v, w * v * v)):
                                    sums[t][f, :, j] += np.bincount(key, part, len(mine) * bins)
                    return {node: sums[t].reshape(p, len(mine), bins, width + 1)[:, k] for t, mine in by_tree.items() for k, node in enumerate(mine)}
                found |= tree_reduce(rows, task, block_bytes=8 * p * bins * (width + 1))
            before, large = large, []
            for node in before:
                stats = found[node][:, :, :-1]
                nodes.stats[node] = stats[0].sum(0)
                if nodes.level[node] == depth or is_pure(nodes.stats[node], classes):
                    continue
                left = stats.cumsum(1)[:, :-1]
                counted = found[node][:, :, -1].cumsum(1)
                whole = score(nodes.stats[node], classes)
                gains = score(left, classes) + score(nodes.stats[node] - left, classes) - whole
                gains[(counted[:, :-1] == 0) | (counted[:, :-1] == counted[:, -1:])] = -np.inf
                if m is not None and bins > 1:
                    usable = some_features(np.array([nodes.key[node]], np.uint64), np.isfinite(gains.max(1))[:, None], m)
                    gains[~usable[:, 0]] = -np.inf
                flat = gains.ravel()
                if not len(flat) or not np.isfinite(flat.max()):
                    small.append(node)  # all features fall in one bin: finished in a task
                    continue
                at = int(np.argmax(flat >= flat.max() - TIE * max(abs(flat.max()), whole)))
                f, b = divmod(at, bins - 1)
                nodes.feature[node], nodes.threshold[node], nodes.gain[node] = f, float(np.nextafter(cuts[f][b], -np.inf)), float(flat[at])
                keys = child_keys(np.array([nodes.key[node]], np.uint64))
                for side, stat, size, key in (("left", left[f, b], counted[f, b], keys[0]),
                                              ("right", nodes.stats[node] - left[f, b], counted[f, -1] - counted[f, b], keys[1])):
                    child = nodes.add(stat, nodes.level[node] + 1, nodes.tree[node], key)
                    getattr(nodes, side)[node] = child
                    (large if size > NODE_ROWS else small).append(child)
        return nodes, small

    def _bottom(self, rows: DataFrame, top: Nodes, tree: dict[str, np.ndarray], open_: list[int], m: int | None) -> DataFrame:
        """The exact trees of the open leaves, each grown in one task, as rows of ``PARTS``."""
        classes, depth, weights, roots = self.n_classes, self.max_depth, self._weights, len(self.keys)
        unfinished = np.zeros(len(tree["feature"]), bool)
        unfinished[open_] = True
        found = {node: (top.level[node], int(top.key[node])) for node in open_}

        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, y, w_of in lots(batches, weights):
                for t in range(roots):
                    leaf, w = leaf_of(x, tree, t), w_of(t)
                    live = np.flatnonzero(unfinished[leaf] & (w > 0))
                    live = live[np.argsort(leaf[live], kind="stable")]
                    first = np.flatnonzero(firsts(leaf[live]))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[live[first]], pa.int32()), *[packed(a[live], first) for a in (x, y, w)]],
                                                     names=["node", "x", "y", "w"])

        def packed(rows: np.ndarray, first: np.ndarray) -> pa.Array:
            """The bytes of each node's rows."""
            data = np.ascontiguousarray(rows, float)
            ends = (np.r_[first, len(data)] * (data.itemsize * (data.shape[1] if data.ndim > 1 else 1))).astype(np.int32)
            return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data)])

        def finish(group: pa.Table) -> pa.Table:
            node = group.column("node")[0].as_py()
            x, y, w = (np.frombuffer(b"".join(group.column(c).to_pylist())) for c in ("x", "y", "w"))
            level, key = found[node]
            part = grow(x.reshape(len(y), -1), y, w, classes, None if depth is None else depth - level, m, key)
            return in_pieces(part, node)
        open_rows = rows.mapInArrow(rows_of, "node int, x binary, y binary, w binary")
        return cut_lineage(open_rows.groupBy("node").applyInArrow(finish, PARTS))

    def _model(self, tree: dict[str, np.ndarray], grown: DataFrame | None, p: int) -> ExactTreeModel:
        classes, n_roots, width = self.n_classes, len(self.keys), self.n_classes or 3
        pieces = None
        if grown is not None:
            sizes = grown.agg(F.sum(F.when(F.col("at") >= 0, F.size("feature")).otherwise(0)).alias("all"),
                              F.sum(F.when(F.col("at") < 0, F.size("feature")).otherwise(0)).alias("upper")).first()
            whole = sizes["all"] + sizes["upper"] + len(tree["feature"]) <= LOCAL_NODES
            if (sizes["all"] if whole else sizes["upper"]) + len(tree["feature"]) > MAX_NODES:
                raise ValueError(f"the tree's upper part has more than {MAX_NODES} nodes; give max_depth (at most {MAX_NODES.bit_length() - 2} always fits)")
            parts = {}
            for r in grown.where("at < 0").collect():
                part = part_arrays(r.asDict(), width)
                parts[r["node"]] = part | {"piece": np.where(part["piece"] < 0, -1, piece_id(r["node"], part["piece"]))}
            tree = graft(tree, parts)
            if whole:
                leaf = {int(i): at for at, i in enumerate(tree["piece"]) if i >= 0}
                rows = grown.where("at >= 0").select("node", "at", *tree).collect()
                tree = graft(tree, {leaf[piece_id(r["node"], r["at"])]: part_arrays(r.asDict(), width) for r in rows})
            else:
                pieces = grown.where("at >= 0").select(piece_id(F.col("node").cast("long"), F.col("at")).alias("id"), "feature", "threshold",
                                                       "left", "right", "gain", "stats", "depth")
        roots = [t for t in range(n_roots) if tree["stats"][t].any()]  # a tree may have drawn no row at all
        return ExactTreeModel(tree, classes, self.featuresCol, p, roots, self._importances(tree, pieces, p, roots), pieces)

    def _importances(self, tree: dict[str, np.ndarray], pieces: DataFrame | None, p: int, roots: list[int]) -> list[float]:
        """Shares of the gain by feature, averaged over the trees."""
        of, total = np.zeros(len(tree["feature"]), int), np.zeros((len(self.keys), p))
        of[:len(self.keys)] = np.arange(len(self.keys))
        for i in np.flatnonzero(tree["feature"] >= 0):  # children come after their parents
            of[tree["left"][i]] = of[tree["right"][i]] = of[i]
        inner = tree["feature"] >= 0
        np.add.at(total, (of[inner], tree["feature"][inner]), np.maximum(tree["gain"][inner], 0))
        if pieces is not None:
            spark = pieces.sparkSession
            linked = np.flatnonzero(tree["piece"] >= 0)
            owner = spark.createDataFrame(pd.DataFrame({"id": tree["piece"][linked], "tree": of[linked]}))
            cells = pieces.join(owner, "id").select("tree", F.explode(F.arrays_zip("feature", "gain")).alias("c")).where("c.feature >= 0")
            for r in cells.groupBy("tree", "c.feature").agg(F.sum(F.greatest(F.col("c.gain"), F.lit(0.0))).alias("g")).collect():
                total[r["tree"], r["feature"]] += r["g"]
        share = np.divide(total, total.sum(1, keepdims=True), out=np.zeros_like(total), where=total.sum(1, keepdims=True) > 0)[roots].sum(0)
        return (share / share.sum() if share.sum() else share).tolist()


class ExactForest(ExactTree):
    """``trees`` exact trees, each on rows drawn with replacement; a node of a classifier's tree looks at the square root of the
    features, of a regressor's at all of them."""

    def __init__(self, featuresCol: str = "features", labelCol: str = "label", n_classes: int = 0, max_depth: int | None = None,
                 weightCol: str | None = None, trees: int = 100, seed: int = 42):
        super().__init__(featuresCol, labelCol, n_classes, max_depth, weightCol)
        self.keys = list(mix(mix(np.array([seed], np.uint64)) + np.arange(trees, dtype=np.uint64)))
        self.bagged, self.root_features = True, n_classes > 0
