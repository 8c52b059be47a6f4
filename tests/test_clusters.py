import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import cluster as CL
from loomstat.operators import silhouette as S


def points(spark, X):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<double>").repartition(5)


def plain_silhouette(X, y):
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    out = []
    for i in range(len(X)):
        own = y == y[i]
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = D[i][own].sum() / (own.sum() - 1)
        b = min(D[i][y == c].mean() for c in set(y.tolist()) if c != y[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def labelled():
    """Overlapping groups, one of equal points (a third of all rows), a cluster of one, noise."""
    rng = np.random.default_rng(3)
    X = np.vstack([rng.normal(c, 1.0, (70, 3)) for c in ((0, 0, 0), (1, 1, 0), (8, 0, 0))] + [np.full((120, 3), 1e4)] + [[[50, 0, 0]]]
                  + [rng.normal(size=(9, 3))])
    return X, np.array([0] * 70 + [1] * 70 + [5] * 70 + [7] * 120 + [9] + [-1] * 9)


@pytest.mark.parametrize("chunk", [2048, 32])
def test_silhouette_over_all_rows(spark, labelled, monkeypatch, chunk):
    from loomstat.operators import knn as K
    for module in (K, S):
        monkeypatch.setattr(module, "QUERY_CHUNK", chunk)
    monkeypatch.setattr(K, "REF_CHUNK", chunk)
    X, y = labelled
    df = points(spark, X).join(spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "id long, cluster int"), "id")
    want = plain_silhouette(X[y >= 0], y[y >= 0])
    assert abs(CL.silhouette(df, "id") - want) < 1e-7
    assert CL.silhouette(df.where("cluster = 0"), "id") is None and CL.silhouette(df.where("id < 0"), "id") is None
    few = CL.silhouette(df, "id", sample=50)
    assert -1 <= few <= 1


def test_all_k_in_the_same_passes(spark):
    rng = np.random.default_rng(12)
    X = np.vstack([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (5, 0), (0, 5), (5, 5))])
    df = points(spark, X)
    centres, cost = CL.kmeans_of_sizes(df, "id", [2, 3, 4, 17], 1, tol=0.0)
    for C, c in zip(centres, cost):
        d = ((X[:, None] - C[None]) ** 2).sum(-1)
        assert np.isclose(d.min(1).sum(), c)
        own = d.argmin(1)
        for k in np.unique(own):  # each centre is the mean of its rows: a fixed point
            assert np.allclose(C[k], X[own == k].mean(0))
    tried = {r.k: r for r in CL.best_k(df, "id", 17).collect()}
    assert len(tried) == 16 and [k for k, r in tried.items() if r.best] == [4]
    assert abs(tried[4].silhouette - plain_silhouette(X, np.repeat(np.arange(4), 60))) < 1e-4
    assert CL.best_k(points(spark, X[:2]), "id", 5).count() == 0
    assert len(CL.best_k(points(spark, X[:8]), "id", 50).collect()) == 6


def test_bandwidth_from_all_rows(spark):
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(size=(300, 3)), np.zeros((40, 3))])
    D = np.sort(np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)), 1)
    got = CL.estimate_bandwidth(points(spark, X), "id", 0.3)
    assert abs(got - D[:, int(len(X) * 0.3) - 1].mean()) < 1e-6
    few = CL.estimate_bandwidth(points(spark, X), "id", 0.3, queries=60)
    assert abs(few - got) < 0.2


def test_modes_merge_as_one_by_one(spark):
    rng = np.random.default_rng(5)
    V, n = rng.uniform(0, 6, (120, 2)), rng.integers(1, 9, 120)
    order = sorted(range(120), key=lambda i: (-n[i], V[i].tolist(), i))
    kept = []
    for i in order:
        if all(np.sqrt(((V[i] - V[k]) ** 2).sum()) >= 0.9 for k in kept):
            kept.append(i)
    modes = spark.createDataFrame([(i, V[i].tolist(), int(n[i])) for i in range(120)], "sid long, vec array<double>, n long")
    got = CL.merge_modes(modes, 0.9).orderBy("cluster").collect()
    assert [(r.vec, r.n) for r in got] == [(V[i].tolist(), n[i]) for i in kept]


def test_mean_shift_finds_the_groups(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (6, 0), (0, 6))] + [rng.normal((6, 6), 0.3, (20, 2))])
    labels, centres = CL.mean_shift(points(spark, X), "id", bandwidth=1.5)
    got = [r.cluster for r in labels.orderBy("id").collect()]
    assert [set(got[a:b]) for a, b in ((0, 60), (60, 120), (120, 180), (180, 200))].count(set()) == 0
    assert len(set(got)) == centres.count() == 4 and got[180:] == [3] * 20
    with pytest.raises(ValueError):
        CL.mean_shift(points(spark, np.zeros((30, 2))), "id")


def _plain_dbscan(ids, X, eps, least):
    """All pairs, keys as points."""
    near = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) <= eps
    keys = sorted({i for i in ids if i is not None})
    degree = {k: sum(int(near[r].sum()) for r in range(len(ids)) if ids[r] == k) for k in keys}
    core = {k for k in keys if degree[k] >= least}
    lab = {k: k for k in core}
    while True:
        new = {k: min([lab[k]] + [lab[ids[c]] for r in range(len(ids)) if ids[r] == k for c in np.flatnonzero(near[r]) if ids[c] in core]) for k in core}
        if new == lab:
            break
        lab = new
    for k in (k for k in keys if k not in core):
        found = [lab[ids[c]] for r in range(len(ids)) if ids[r] == k for c in np.flatnonzero(near[r]) if ids[c] in core]
        if found:
            lab = lab | {k: min(found)}
    number = {x: i for i, x in enumerate(sorted(set(lab.values())))}
    return sorted(((i, number[lab[i]] if i in lab else -1) for i in ids), key=str)


def test_dbscan_on_a_grid_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    for dim, eps, least in ((1, 0.1, 3), (2, 0.1, 3), (3, 0.5, 5)):
        rings = rng.normal(0, 1, (60, dim))
        rings = rings / np.sqrt((rings ** 2).sum(1))[:, None] * 1.1
        X = np.vstack([rng.normal(0, 0.05, (60, dim)), rings, np.round(rng.uniform(-2, 2, (70, dim)), 1), np.full((6, dim), 1.5)])
        X = np.vstack([X, X[:5] + 0.7])
        ids = [*range(196), 3, 70, 150, None, None]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, X)], "id long, vec array<double>")
        got = sorted(((r["id"], r["cluster"]) for r in CL.dbscan(df, "id", eps, least).collect()), key=str)
        assert got == _plain_dbscan(ids, X, eps, least), dim


def test_dbscan_of_a_dense_group_compares_no_pairs(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("compared the rows of a dense group in blocks")
    for name in ("range_sums", "range_forest", "range_min"):
        monkeypatch.setattr(CL, name, refuse)
    x = F.array((F.col("id") % 997) / 1e5 + F.col("id") % 2 * 5, (F.col("id") % 1009) / 1e5)
    out = CL.dbscan(spark.range(20_000).select("id", x.alias("vec")), "id", 0.3, 5)
    assert {(r["id"] % 2, r["cluster"]) for r in out.collect()} == {(0, 0), (1, 1)}


def test_dbscan_says_how_it_joins(spark, monkeypatch):
    """No join is left to Spark's guess from compressed bytes, and none broadcasts a table of a row per point."""
    from loomstat import session
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(c, 0.05, (30, 2)) for c in ((0, 0), (3, 0), (6, 6))])
    plans = []

    def seen(df, cut=CL.cut_lineage):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return cut(df)
    monkeypatch.setattr(CL, "cut_lineage", seen)
    for module in (session, CL):
        monkeypatch.setattr(module, "FEW_ROWS", 0)
    found = {r["id"]: r["cluster"] for r in CL.dbscan(points(spark, X), "id", 1.0, 5).collect()}
    assert found == {i: i // 30 for i in range(90)}
    joins = [line for p in plans for line in p.splitlines() if "Join " in line]
    assert len(joins) > 5 and all("strategy=" in j for j in joins)
    assert not [j for j in joins if "strategy=broadcast" in j and "(v#" in j]
