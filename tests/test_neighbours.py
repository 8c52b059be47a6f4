import numpy as np
import pytest

from loomstat.operators import knn as K


def points(spark, X, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], f"{name} long, vec array<double>").repartition(4)


@pytest.mark.parametrize("m", [1, 5, 200])
def test_tree_finds_and_reaches(m):
    rng = np.random.default_rng(m)
    X = rng.normal(size=(400, 3))
    X[50:120] = X[50]  # a hot point
    tree = K.PivotTree(X[:m].copy())
    cell = tree.nearest(X)
    used = np.unique(cell)
    tree.learn_radii(used, np.array([np.sqrt(((X[cell == c] - tree.P[c]) ** 2).sum(1)).max() for c in used]))
    assert (tree.nearest(X)[:5] < len(tree.P)).all() and sorted(map(tuple, tree.P)) == sorted(map(tuple, X[:m]))
    Q, u = rng.normal(size=(50, 3)), rng.uniform(0, 1, 50)
    row, got = tree.reach(Q, u)
    open_ = set(zip(row.tolist(), got.tolist()))
    for i, q in enumerate(Q):
        for c in np.unique(cell[np.sqrt(((X - q) ** 2).sum(1)) <= u[i]]):
            assert (i, c) in open_
    row, got = tree.reach(Q, np.full(50, np.inf), 3)
    assert np.bincount(row, minlength=50).max() <= 3
    again = K.PivotTree.of(tree.parts())
    assert (again.nearest(Q) == tree.nearest(Q)).all()


def test_plan_does_not_grow_with_the_pivots(spark):
    rng = np.random.default_rng(1)
    df = points(spark, rng.normal(size=(900, 2)))
    q, r = df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid")
    sizes = []
    for m in (4, 300):
        plan = K.knn_join(q, r, 3, n_pivots=m)._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(len(plan))
    assert abs(sizes[0] - sizes[1]) < 0.1 * sizes[0]


@pytest.mark.parametrize("given, most", [(True, 16), (False, 3)])
def test_approximate_recall_in_64_dimensions(spark, given, most):
    """The given embeddings have no clusters, so most cells are needed; with clusters a few are enough."""
    from loomstat.operators.cluster import array_column
    if given:
        emb = array_column(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), "embedding", "vec_id")
    else:
        rng = np.random.default_rng(8)
        emb = points(spark, rng.normal(scale=4, size=(12, 64))[rng.integers(0, 12, 900)] + rng.normal(size=(900, 64)), "vec_id")
    q, r = emb.withColumnRenamed("vec_id", "qid"), emb.withColumnRenamed("vec_id", "rid")
    assert K.recall_of(K.knn_join(q, r, 5, exclude_self=True), q, r, 5, exclude_self=True) == 1.0
    stats = {}
    near = K.knn_join(q, r, 5, exclude_self=True, approximate=most, stats=stats)
    assert K.recall_of(near, q, r, 5, exclude_self=True) >= 0.9
    assert stats["mean_cells"] <= most + 2 < stats["cells"]


def test_pivot_bytes_bound_the_tree(spark, monkeypatch):
    monkeypatch.setattr(K, "MAX_PIVOT_BYTES", 8 * 2 * 6)
    df = points(spark, np.random.default_rng(4).normal(size=(200, 2)))
    state = K.assign_cells(df, "id")
    assert len(state.tree.value[0]) == 6
    X = {r.id: np.array(r.vec) for r in df.collect()}
    got = {}
    for r in K.knn_join(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid"), 3).collect():
        got.setdefault(r.qid, []).append((r.dist, r.rid))
    for i, x in X.items():
        assert sorted(got[i]) == sorted((float(np.sqrt(((x - y) ** 2).sum())), j) for j, y in X.items())[:3]


def test_pairs_leave_a_task_in_bounded_slices(spark):
    """In 64 dimensions every query meets every cell: no batch may hold the vectors of all pairs."""
    import loomstat.operators.knn as K
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(0, 1, (3000, 64)))], "rid long, vec array<double>")
    state = K.assign_cells(rows, n_pivots=50)
    seen = {}

    class Probe:
        def __init__(self, df):
            self.schema = df.schema

        def select(self, *names):
            return self

        def mapInPandas(self, task, schema):
            seen["task"] = task
    K._candidates(Probe(rows.withColumnRenamed("rid", "qid")), "qid", "vec", state, own=False, eps=100.0)
    batch = rows.withColumnRenamed("rid", "qid").toPandas()
    sizes = [len(out) for out in seen["task"](iter([batch]))]
    assert sum(sizes) == 3000 * 50 and max(sizes) * 64 * 8 <= 32 << 20
    assert K._pivots(120_000, 64) == 64 and K._pivots(120_000, 2) == 346 and K._pivots(2000, 64) == 44


def test_many_dimensions_copy_no_query_for_a_cell(spark, monkeypatch):
    """Neighbours, counts and links in 20 dimensions equal all pairs, and a query is written once, not once a cell."""
    from loomstat.operators import cluster as CL
    for name, value in (("REF_CHUNK", 16), ("QUERY_CHUNK", 50), ("PACK_BYTES", 20_000), ("MANY_DIM_CELLS", 4)):
        monkeypatch.setattr(K, name, value)
    copies = []

    def cut(df, real=K.cut_lineage):
        out = real(df)
        if "_qv" in out.columns:
            copies.append(out.count())
        return out
    monkeypatch.setattr(K, "cut_lineage", cut)
    X = np.random.default_rng(1).normal(size=(260, 20))
    X[250:] = X[:10]
    df = points(spark, X)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    found = {(r["qid"], r["rank"]): r["rid"] for r in K.knn_join(points(spark, X, "qid"), points(spark, X, "rid"), 3, exclude_self=True).collect()}
    assert found == {(i, k + 1): j for i in range(260) for k, j in enumerate(np.lexsort((np.arange(260), D[i]))[:3])}
    assert max(copies) <= 260
    copies.clear()
    assert {r["id"]: r["cluster"] for r in CL.dbscan(df, "id", 40.0, 5).collect()} == dict.fromkeys(range(260), 0)
    assert max(copies) == 0  # every cell lies within reach as a whole
