"""Silhouettes from a quadtree and from packed blocks, against all pairs."""

import numpy as np
import pytest

from loomstat.operators import far_field as FF
from loomstat.operators import silhouette as S


def brute(X, labels):
    d = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    names, sizes = np.unique(labels, return_counts=True)
    sums = np.stack([d[:, labels == k].sum(1) for k in names], 1)
    own = labels[:, None] == names
    n = sizes[own.argmax(1)]
    a = sums[own] / np.maximum(n - 1, 1)
    b = np.where(own, np.inf, sums / sizes).min(1)
    return float(np.where((n <= 1) | (np.maximum(a, b) == 0), 0, (b - a) / np.maximum(np.maximum(a, b), 1e-300)).mean())


def cases():
    rng = np.random.default_rng(3)
    blobs = np.vstack([rng.normal(c, s, (300, 2)) for c, s in (((0, 0), 1), ((50, 3), 0.1), ((0, 0.3), 1), ((9, 9), 1e-3))])
    copies = np.vstack([np.tile([1.0, 2.0], (500, 1)), rng.uniform(0, 3, (500, 2))])
    return {"blobs": blobs, "line": rng.normal(0, 1, (900, 1)), "copies": copies, "same": np.ones((400, 2))}


@pytest.mark.parametrize("name", ["blobs", "line", "copies", "same"])
def test_quadtree_is_all_pairs(spark, name, monkeypatch):
    X = cases()[name]
    rng = np.random.default_rng(5)
    L = np.stack([rng.integers(0, 3, len(X)), rng.integers(0, 5, len(X))], 1)
    rows = spark.createDataFrame([(i, x.tolist(), w.tolist()) for i, (x, w) in enumerate(zip(X, L))],
                                 "id long, vec array<double>, labels array<int>").repartition(3)
    sizes = [{int(c): int(k) for c, k in zip(*np.unique(L[:, j], return_counts=True))} for j in range(2)]
    want = [brute(X, L[:, j]) for j in range(2)]
    assert np.allclose(S.silhouettes_of_labellings(rows, "id", sizes), want, atol=1e-9)  # blocks
    monkeypatch.setattr(FF.sums_by_leaf, "__defaults__", (40,))  # many leaves
    assert np.allclose(S.silhouettes_of_labellings(rows, "id", sizes, tree_rows=0), want, atol=1e-9)


def test_work_of_the_quadtree_is_not_quadratic():
    """A leaf meets a bounded number of other leaves row by row, however many there are."""
    for level in (4, 6):
        at = np.stack(np.meshgrid(*[np.arange(2 ** level)] * 2, indexing="ij"), -1).reshape(-1, 2).astype(np.int64)
        code = np.sort(FF.codes(at << (FF.LEVELS - level), level))
        tree = FF.Tree(FF.Space(np.zeros(2), 1.0), 2, {level: (code, np.full(len(code), 9))}, 9)
        met = [tree.near_and_far(i) for i in range(0, len(code), 37)]
        assert max(len(n) for n, _ in met) <= 9 and max(len(f) for _, f in met) <= 40 * level


def test_block_pairs_are_not_copied(spark):
    """The pairs of blocks come from a cartesian product or broadcast, not from a shuffle of a copy for every pair."""
    rows = spark.range(50).selectExpr("id", "array(id * 1.0, 1.0, 2.0) AS vec", "array(cast(id % 2 AS int)) AS labels", "id AS code")
    plan = S._sums_by_block(rows, 3, 50, np.array([0, 2]), 2, lambda s, l, c: None, "k int")._jdf.queryExecution().toString()
    assert "sequence(" not in plan and ("CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan)


@pytest.mark.parametrize("tree_rows", [0, 10_000])
def test_rows_of_one_key_count_once(spark, tree_rows):
    X = cases()["blobs"][::4]
    L = np.arange(len(X)) % 3
    at = np.r_[np.arange(len(X)), np.arange(50)]  # 50 keys, one of them null, have two equal rows
    rows = spark.createDataFrame([(None if i == 7 else int(i), X[i].tolist(), [int(L[i])]) for i in at],
                                 "id long, vec array<double>, labels array<int>").repartition(3)
    d = np.sqrt(((X[:, None] - X[at][None]) ** 2).sum(2))
    n = np.bincount(L[at])
    s = np.stack([d[:, L[at] == k].sum(1) for k in range(3)], 1)
    own = L[:, None] == np.arange(3)
    a, b = s[own] / (n[L] - 1), np.where(own, np.inf, s / n).min(1)
    got = S.silhouettes_of_labellings(rows, "id", [{k: int(n[k]) for k in range(3)}], tree_rows)
    assert abs(got[0] - ((b - a) / np.maximum(a, b)).mean()) < 1e-9
