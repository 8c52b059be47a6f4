"""Sums of distances from every row to the members of each cluster, in one or two dimensions, without all pairs.

Rows are put into the leaves of a quadtree (halved until a leaf holds at most ``leaf_rows``).  A leaf meets the rows of the
leaves around it pair by pair.  A cell that is at least its own width away is met through ``NODES`` Chebyshev points a
dimension: the distance to a member is a polynomial of the member's place there, so a cluster's members enter as that many
weights, whatever their number.  The distance has no singularity within 4.2 of the cell's ellipses, which puts the error
below 1e-9 of the distance: rounding of the matrix products is no smaller.

Every row is counted; work is n log n.  A leaf and those around it are one bounded group; the driver holds the tree and the
weights of its cells, at most ``MAX_PIVOT_BYTES`` (beyond that leaves are larger).  Cells of the last level may hold any number
of rows (copies of one row): they are met as a place, and dealt to tasks in chunks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.operators.knn import MAX_BLOCK, MAX_PIVOT_BYTES, _distances
from loomstat.session import cut_lineage

MAX_DIM = 2
LEVELS, STEP = 30, 3
LEAF_ROWS = 1500
NODES = 12

_T = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))


def weights(s: np.ndarray) -> np.ndarray:
    """Interpolation weights of places in [-1, 1] at the Chebyshev points: (n, NODES)."""
    k = np.arange(NODES)
    at = np.cos(np.arccos(np.clip(s, -1, 1))[:, None] * k)
    scale = np.where(k == 0, 1.0, 2.0) / NODES
    return (at * scale) @ np.cos(np.arccos(_T)[:, None] * k).T


def _grid(values: list[np.ndarray]) -> np.ndarray:
    """Products of weights by dimension: (n, NODES ** d)."""
    out = values[0]
    for v in values[1:]:
        out = (out[:, :, None] * v[:, None, :]).reshape(len(out), -1)
    return out


#: Weights of a child's points in its parent, by side.
_UP = [weights(_T / 2 - 0.5), weights(_T / 2 + 0.5)]


class Space:
    """The square that all rows lie in, cut ``LEVELS`` times."""

    def __init__(self, lo: np.ndarray, side: float):
        self.lo, self.side = lo, side

    def places(self, X: np.ndarray) -> np.ndarray:
        return np.clip(((X - self.lo) / self.side * 2.0 ** LEVELS).astype(np.int64), 0, 2 ** LEVELS - 1)

    def centres(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.lo + (at + 0.5) * (self.side * 0.5 ** level)[:, None]


def codes(places: np.ndarray, level: int) -> np.ndarray:
    """One number for the cell of a level that holds each place."""
    out = np.zeros(len(places), np.int64)
    for j in range(places.shape[1]):
        out = (out << LEVELS) | (places[:, j] >> (LEVELS - level))
    return out


def _places_of(code: np.ndarray, dim: int) -> np.ndarray:
    return np.stack([(code >> (LEVELS * (dim - 1 - j))) & (2 ** LEVELS - 1) for j in range(dim)], 1)


def _up(code: np.ndarray, dim: int, by: int) -> np.ndarray:
    """The code of the cell ``by`` levels above."""
    out = np.zeros(len(code), np.int64)
    for c in _places_of(code, dim).T:
        out = (out << LEVELS) | (c >> by)
    return out


def find_leaves(rows: DataFrame, space: Space, dim: int, n: int, leaf_rows: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """level -> (sorted codes, rows) of the leaves; ``STEP`` levels are counted in a pass."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if n <= leaf_rows:
        return {0: (np.zeros(1, np.int64), np.array([n]))}
    level, open_ = 0, np.zeros(1, np.int64)
    sc = rows.sparkSession.sparkContext
    while len(open_):
        shared, now, fine = sc.broadcast(open_), level, min(level + STEP, LEVELS)

        def count(it):
            for pdf in it:
                if len(pdf):
                    p = space.places(pdf.iloc[:, :dim].to_numpy(float))
                    code, times = np.unique(codes(p[np.isin(codes(p, now), shared.value)], fine), return_counts=True)
                    yield pd.DataFrame({"c": code, "n": times})
        got = rows.mapInPandas(count, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).toPandas().sort_values("c")
        code, size = got["c"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
        for at in range(level + 1, fine + 1):
            mine = np.isin(_up(code, dim, fine - at + 1), open_)
            cells, back = np.unique(_up(code[mine], dim, fine - at), return_inverse=True)
            sizes = np.bincount(back, size[mine], len(cells)).astype(np.int64)
            done = (sizes <= leaf_rows) | (at == LEVELS)
            if done.any():
                found[at] = (cells[done], sizes[done])
            open_ = cells[~done]
        level = fine
        shared.unpersist()
    return found


class Tree:
    """Cells of all levels, leaves first, in the order of ``find_leaves``; arrays only."""

    def __init__(self, space: Space, dim: int, leaves: dict[int, tuple[np.ndarray, np.ndarray]], leaf_rows: int):
        self.space, self.dim = space, dim
        self.by_level, first = [], 0
        for level, (code, _) in sorted(leaves.items()):
            self.by_level.append((level, code, first))
            first += len(code)
        self.n_leaves = first
        self.sizes = np.concatenate([leaves[level][1] for level, _, _ in self.by_level])
        number = {(level, int(c)): start + i for level, code, start in self.by_level for i, c in enumerate(code)}
        self.level, self.code = [k[0] for k in number], [k[1] for k in number]
        self.children: list[list[int]] = [[] for _ in number]
        for i in range(first):
            at = i
            while self.level[at]:
                above = (self.level[at] - 1, int(_up(np.array([self.code[at]]), dim, 1)[0]))
                known = above in number
                if not known:
                    number[above] = len(self.level)
                    self.level.append(above[0])
                    self.code.append(above[1])
                    self.children.append([])
                self.children[number[above]].append(at)
                at = number[above]
                if known:
                    break
        self.level, self.at = np.array(self.level), _places_of(np.array(self.code, np.int64), dim)
        self.root = number[(0, 0)]
        self.centre = space.centres(self.level, self.at)
        self.half = space.side * 0.5 ** (self.level + 1)
        self.spot = np.zeros(len(self.level), bool)  # copies of a row: a place
        self.spot[:first] = self.sizes > leaf_rows
        self.is_leaf = np.arange(len(self.level)) < first

    def parts(self) -> dict:
        """What is broadcast: arrays and lists only, so that executors need no class to read them."""
        return vars(self) | {"space": (self.space.lo, self.space.side)}

    @classmethod
    def of(cls, parts: dict) -> "Tree":
        tree = cls.__new__(cls)
        vars(tree).update(parts | {"space": Space(*parts["space"])})
        return tree

    def leaf_of(self, X: np.ndarray) -> np.ndarray:
        p, out = self.space.places(X), np.full(len(X), -1)
        for level, code, first in self.by_level:
            c = codes(p, level)
            i = np.minimum(np.searchsorted(code, c), len(code) - 1)
            out = np.where(code[i] == c, first + i, out)
        return out

    def near_and_far(self, leaf: int) -> tuple[list[int], list[int]]:
        """Leaves that a leaf meets row by row, and cells that it meets through their points."""
        near, far, todo = [], [], [self.root]
        while todo:
            cells = np.array(todo)
            gap = np.maximum(np.abs(self.centre[cells] - self.centre[leaf]) - (self.half[cells] + self.half[leaf])[:, None], 0)
            away = (np.sqrt((gap * gap).sum(1)) >= 2 * self.half[cells] * (1 - 1e-6)) | self.spot[cells]
            far += cells[away & ~((cells == leaf) & self.spot[leaf])].tolist()  # copies are at no distance from each other
            near += cells[~away & self.is_leaf[cells]].tolist()
            todo = [c for x in cells[~away & ~self.is_leaf[cells]] for c in self.children[x]]
        return near, far

    def points(self, cells: np.ndarray) -> np.ndarray:
        """The Chebyshev points of cells, one after the other."""
        t = np.stack(np.meshgrid(*[_T] * self.dim, indexing="ij"), -1).reshape(-1, self.dim)
        return (self.centre[cells][:, None] + self.half[cells][:, None, None] * t).reshape(-1, self.dim)

    def member_weights(self, leaf: int, X: np.ndarray) -> np.ndarray:
        s = (X - self.centre[leaf]) / self.half[leaf]
        return _grid([weights(s[:, j]) for j in range(self.dim)])

    def sum_up(self, W: np.ndarray) -> np.ndarray:
        """Weights of all cells from those of the leaves: (cells, NODES ** d, clusters)."""
        out = np.zeros((len(self.level), *W.shape[1:]))
        out[:len(W)] = W
        for cell in np.argsort(-self.level, kind="stable"):
            for c in self.children[cell]:
                sides = [_UP[b] for b in self.at[c] & 1]
                out[cell] += (sides[0] if self.dim == 1 else np.kron(*sides)).T @ out[c]
        return out


def hot(labels: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """(rows, clusters of all labellings): 1 where a row is a member."""
    out = np.zeros((len(labels), width))
    out[np.arange(len(labels))[:, None], labels + starts] = 1.0
    return out


def sums_by_leaf(points: DataFrame, dim: int, n: int, starts: np.ndarray, width: int, use, out_schema: str,
                 leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``use(S, labels, codes)`` for the rows of each leaf: S holds a row's sums of distances to each cluster of each labelling.

    ``points`` has ``vec``, ``labels`` (an array of cluster numbers, one for each entry of ``starts``) and a number ``code``."""
    from loomstat.operators.silhouette import exact_distances
    leaf_rows = max(leaf_rows, math.ceil(n * NODES ** dim * width * 8 * 2 / MAX_PIVOT_BYTES))
    m = len(starts)
    xs, ls = [f"x{j}" for j in range(dim)], [f"l{j}" for j in range(m)]
    slots = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(points.select(*[F.col("vec")[j].alias(x) for j, x in enumerate(xs)],
                                     *[F.col("labels")[j].alias(x) for j, x in enumerate(ls)], "code").repartition(slots))
    box = rows.agg(*[F.min(x) for x in xs], *[F.max(x) for x in xs]).first()
    lo, hi = np.array(box[:dim]), np.array(box[dim:])
    space = Space(lo, float((hi - lo).max()) * (1 + 1e-9) or 1.0)
    tree = Tree(space, dim, find_leaves(rows, space, dim, n, leaf_rows), leaf_rows)
    sc = points.sparkSession.sparkContext
    shared = sc.broadcast(tree.parts())

    def place(it):
        tree = Tree.of(shared.value)
        chunks = -(-tree.sizes // leaf_rows)
        for pdf in it:
            if len(pdf):
                leaf = tree.leaf_of(pdf[xs].to_numpy(float))
                chunk = np.random.default_rng(len(pdf)).integers(0, 1 << 30, len(pdf)) % chunks[leaf]
                yield pdf.assign(leaf=leaf.astype("int32"), chunk=chunk.astype("int32"))

    def pack(key, pdf):
        X, L = pdf[xs].to_numpy(float), pdf[ls].to_numpy("int32")
        w = Tree.of(shared.value).member_weights(key[0], X).T @ hot(L, starts, width)
        return pd.DataFrame({"leaf": [key[0]], "chunk": [key[1]], "x": [X.tobytes()], "l": [L.tobytes()],
                             "c": [pdf["code"].to_numpy("int64").tobytes()], "w": [w.tobytes()]})
    fields = ", ".join([f"{x} double" for x in xs] + [f"{x} int" for x in ls] + ["code long"])
    # A small table holds much work: without a number, its few bytes would be put into a few tasks.
    spread = max(slots, min(4 * slots, tree.n_leaves // 8))
    placed = rows.mapInPandas(place, f"{fields}, leaf int, chunk int").repartition(spread, "leaf", "chunk")
    packed = cut_lineage(placed.groupBy("leaf", "chunk").applyInPandas(pack, "leaf int, chunk int, x binary, l binary, c binary, w binary"))
    W = np.zeros((tree.n_leaves, NODES ** dim, width))
    for r in packed.select("leaf", "w").toLocalIterator():
        W[r["leaf"]] += np.frombuffer(r["w"]).reshape(-1, width)
    moments = sc.broadcast(tree.sum_up(W))

    def meet(it):
        for pdf in it:
            for leaf, chunk in zip(pdf["leaf"], pdf["chunk"]):
                near, _ = Tree.of(shared.value).near_and_far(leaf)
                yield pd.DataFrame({"leaf": leaf, "chunk": chunk, "other": np.array(near, "int32")})

    pairs = packed.select("leaf", "chunk").mapInPandas(meet, "leaf int, chunk int, other int")
    around = pairs.join(packed.select(F.col("leaf").alias("other"), "x", "l"), "other").select("leaf", "chunk", F.lit(False).alias("own"), "x", "l",
                                                                                                  F.lit(b"").alias("c"))
    every = around.unionByName(packed.select("leaf", "chunk", F.lit(True).alias("own"), "x", "l", "c"))

    def solve(key, pdf):
        tree, W = Tree.of(shared.value), moments.value
        c = tree.centre[key[0]]
        read = [(np.frombuffer(x).reshape(-1, dim) - c, np.frombuffer(y, "int32").reshape(-1, m)) for x, y in zip(pdf["x"], pdf["l"])]
        mine = int(np.flatnonzero(pdf["own"])[0])
        X, L = read[mine]
        S = np.zeros((len(X), width))
        for own, (Y, other) in zip(pdf["own"], read):
            if not own:
                S += exact_distances(X, Y) @ hot(other, starts, width)
        far = np.array(tree.near_and_far(key[0])[1], int)
        step = max(1, MAX_BLOCK // (max(len(X), 1) * NODES ** dim))
        for i in range(0, len(far), step):
            cells = far[i:i + step]
            S += _distances(X, tree.points(cells) - c) @ W[cells].reshape(-1, width)
        return use(S, L, np.frombuffer(pdf["c"].iloc[mine], "int64"))
    return every.repartition(spread, "leaf", "chunk").groupBy("leaf", "chunk").applyInPandas(solve, out_schema)
