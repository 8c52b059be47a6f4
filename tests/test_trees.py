import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from loomstat.operators import train as TR
from loomstat.operators import trees as D


def frame(spark, X, y, w=None):
    w = np.ones(len(y)) if w is None else w
    return spark.createDataFrame([(i, Vectors.dense(x), float(v), float(u)) for i, (x, v, u) in enumerate(zip(X, y, w))],
                                 ["id", "features", "label", "w"]).repartition(5)


def impurity(y, w, classes):
    if not classes:
        return float((w * (y - np.average(y, weights=w)) ** 2).sum())
    shares = np.array([w[y == c].sum() for c in range(classes)]) / w.sum()
    return float(w.sum() * (1 - (shares ** 2).sum()))


def plain(X, y, w, classes, depth):
    """(feature, threshold, left, right) or a leaf value, by trying every midpoint."""
    whole = impurity(y, w, classes)
    leaf = np.average(y, weights=w) if not classes else np.array([w[y == c].sum() for c in range(classes)]) / w.sum()
    if depth == 0 or whole <= 1e-11 * max(1.0, (w * y * y).sum()):
        return leaf
    best = None
    for f in range(X.shape[1]):
        v = np.unique(X[:, f])
        for a, b in zip(v, v[1:]):
            t = (a + b) / 2
            left = X[:, f] <= t
            after = impurity(y[left], w[left], classes) + impurity(y[~left], w[~left], classes)
            if best is None or after < best[0] - 1e-9 * max(whole, 1.0):
                best = (after, f, t)
    if best is None:
        return leaf
    left = X[:, best[1]] <= best[2]
    deeper = None if depth is None else depth - 1
    return (best[1], best[2], plain(X[left], y[left], w[left], classes, deeper), plain(X[~left], y[~left], w[~left], classes, deeper))


def same(tree, at, want):
    if not isinstance(want, tuple):
        assert tree["feature"][at] == -1
        stats = tree["stats"][at]
        assert np.allclose(stats / stats.sum() if np.ndim(want) else stats[1] / stats[0], want)
        return 1
    assert tree["feature"][at] == want[0] and np.isclose(tree["threshold"][at], want[1])
    return 1 + same(tree, tree["left"][at], want[2]) + same(tree, tree["right"][at], want[3])


@pytest.mark.parametrize("classes", [0, 2, 3])
@pytest.mark.parametrize("depth", [None, 3])
def test_small_table_equals_brute_force(spark, classes, depth):
    """Labels at random: the tree grows until every leaf is pure, whatever its depth."""
    rng = np.random.default_rng(7 + classes)
    X = np.stack([rng.integers(0, 12, 180), rng.normal(size=180).round(1), np.ones(180)], 1).astype(float)
    y = rng.integers(0, classes, 180).astype(float) if classes else rng.normal(size=180)
    w = rng.integers(1, 4, 180).astype(float)
    m = D.ExactTree(n_classes=classes, max_depth=depth, weightCol="w").fit(frame(spark, X, y, w))
    assert same(m.tree, 0, plain(X, y, w, classes, depth)) == len(m.tree["feature"])
    assert m.depth == 3 if depth else m.depth > 6


def test_large_nodes_are_split_first(spark, monkeypatch):
    """Nodes above the limit by histograms, the rest in tasks: with few distinct values, still the exact tree."""
    rng = np.random.default_rng(5)
    X = np.stack([rng.integers(0, 9, 600), rng.integers(0, 7, 600), rng.integers(0, 5, 600)], 1).astype(float)
    for classes, y in ((0, X[:, 0] * X[:, 1] + rng.normal(size=600)), (3, rng.integers(0, 3, 600).astype(float))):
        one = D.ExactTree(n_classes=classes).fit(frame(spark, X, y))
        with monkeypatch.context() as m:
            m.setattr(D, "NODE_ROWS", 60)
            two = D.ExactTree(n_classes=classes).fit(frame(spark, X, y))
        assert len(one.tree["feature"]) == len(two.tree["feature"]) and one.depth == two.depth
        a, b = (D.leaf_of(X, t.tree) for t in (one, two))
        assert np.allclose(one.tree["stats"][a], two.tree["stats"][b])
        assert np.allclose(list(one.featureImportances), list(two.featureImportances))


def test_deeper_than_thirty_levels(spark):
    """A chain: every cut takes one row off."""
    X = (2.0 ** np.arange(60))[:, None]
    y = np.cumsum(np.arange(60) ** 3.0) ** 2
    m = D.ExactTree().fit(frame(spark, X, y))
    got = [r.prediction for r in m.transform(frame(spark, X, y)).orderBy("id").collect()]
    assert np.allclose(got, y) and len(m.tree["feature"]) == 119
    exclusive = np.array([[0, 0], [0, 1], [1, 0], [1, 1]] * 3, float)  # no single cut gains anything
    t = D.ExactTree(n_classes=2).fit(frame(spark, exclusive, exclusive.sum(1) % 2)).tree
    assert (t["feature"] >= 0).sum() == 3


def test_train_save_and_limits(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 17), "abc"[i % 3], ("lo", "hi")[i % 17 > 8 and i % 3 > 0]) for i in range(300)],
                               "id long, a double, t string, cls string")
    r = TR.train_model(df, "cls", "dtc", "classification", key="id", class_weight="balanced")
    assert r.metrics["accuracy"] == 1.0 and {f for f, _ in TR.feature_importance(r.model, r.plan)} == {"a", "t"}
    r.model.write().save(f"{tmp_path}/m")
    a = TR.score(r.model, df).orderBy("id").select("predicted_label", "probability").collect()
    assert a == TR.score(PipelineModel.load(f"{tmp_path}/m"), df).orderBy("id").select("predicted_label", "probability").collect()
    p = r.predictions.select(vector_to_array("probability").alias("p")).first().p
    assert sum(p) == 1.0
    monkeypatch.setattr(D, "MAX_NODES", 10)
    with pytest.raises(ValueError, match="max_depth"):
        rng = np.random.default_rng(1)
        D.ExactTree().fit(frame(spark, rng.normal(size=(50, 1)), rng.normal(size=50)))
    with pytest.raises(ValueError):
        D.ExactTree().fit(frame(spark, np.ones((1, 1)), [1.0]).where("id < 0"))
    flat = D.ExactTree().fit(frame(spark, np.ones((5, 2)), np.arange(5)))
    assert flat.tree["feature"].tolist() == [-1]


@pytest.mark.parametrize("classes", [0, 3])
def test_more_nodes_than_the_driver_holds(spark, tmp_path, monkeypatch, classes):
    """A tree above the limit of nodes goes on in a table of pieces: same predictions, importances, stored and streamed."""
    rng = np.random.default_rng(8)
    X = np.stack([rng.integers(0, 40, 700), rng.normal(size=700).round(2)], 1).astype(float)
    y = rng.integers(0, classes, 700).astype(float) if classes else rng.normal(size=700)
    df = frame(spark, X, y)
    whole = D.ExactTree(n_classes=classes).fit(df)
    for name, value in (("NODE_ROWS", 200), ("LOCAL_NODES", 0), ("PIECE_NODES", 16), ("MAX_NODES", 600)):
        monkeypatch.setattr(D, name, value)
    large = D.ExactTree(n_classes=classes).fit(df)
    assert whole.pieces is None and large.pieces.count() > 20 and len(large.tree["feature"]) < 600 < len(whole.tree["feature"])
    assert abs(sum(large.importances) - 1) < 1e-9
    large.write().save(f"{tmp_path}/m")
    df.write.parquet(f"{tmp_path}/rows")
    stream = large.transform(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/rows")).select("id", "prediction")
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    # Grown to the end, a leaf holds the rows with equal features.
    group = np.unique(X, axis=0, return_inverse=True)[1].ravel()
    counts = np.stack([np.bincount(group, y == c) for c in range(classes)], 1) if classes else None
    want = counts.argmax(1)[group] if classes else (np.bincount(group, y) / np.bincount(group))[group]
    for scored in (large.transform(df), D.ExactTreeModel.load(f"{tmp_path}/m").transform(df), spark.read.parquet(f"{tmp_path}/out")):
        assert np.allclose([r.prediction for r in scored.orderBy("id").select("prediction").collect()], want)


def test_forest_in_pieces_equals_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(900, 4)).round(2)
    y = (X[:, 0] + X[:, 1] > 0).astype(float) + (X[:, 2] > 1)
    df = frame(spark, X, y).cache()
    one = D.ExactForest(n_classes=3, trees=8).fit(df)
    assert len(one.roots) == 8 and abs(sum(one.importances) - 1) < 1e-9 and np.argmin(one.importances) == 3
    with monkeypatch.context() as m:
        m.setattr(D, "LOCAL_NODES", 0)
        m.setattr(D, "PIECE_NODES", 8)
        two = D.ExactForest(n_classes=3, trees=8).fit(df)
    a, b = ([(r.prediction, *r.p) for r in f.transform(df).orderBy("id").select("prediction", vector_to_array("probability").alias("p")).collect()] for f in (one, two))
    assert two.pieces is not None and np.allclose(a, b) and np.allclose(one.importances, two.importances)
    assert np.mean([r[0] for r in a] == y) > 0.97 and np.allclose([sum(r[1:]) for r in a], 1)
    monkeypatch.setattr(D, "NODE_ROWS", 100)  # large nodes first: another forest, as good
    three = [r.prediction for r in D.ExactForest(n_classes=3, trees=8).fit(df).transform(df).orderBy("id").select("prediction").collect()]
    assert np.mean(three == y) > 0.97
    mean = D.ExactForest(trees=5).fit(df.withColumn("label", df.label * 2))
    assert np.corrcoef([r.prediction for r in mean.transform(df).orderBy("id").select("prediction").collect()], y)[0, 1] > 0.95


def test_draws_are_poisson_and_features_are_few():
    ids = np.arange(200_000)
    w = D.drawn(ids, np.uint64(5))
    assert abs(w.mean() - 1) < 0.02 and abs((w == 0).mean() - np.exp(-1)) < 0.01 and (w != D.drawn(ids, np.uint64(6))).any()
    keys = D.mix(np.arange(1000, dtype=np.uint64))
    differs = np.ones((4, 1000), bool)
    differs[2, :500] = False
    some = D.some_features(keys, differs, 2)
    assert (some.sum(0) == 2).all() and not some[2, :500].any() and (abs(some[:, 500:].mean(1) - 0.5) < 0.1).all()


@pytest.mark.parametrize("classes", [0, 3])
def test_equal_rows_are_added_up_first(spark, monkeypatch, classes):
    """A table of few different rows gives the trees of all its rows, without a pass per level."""
    rng = np.random.default_rng(6)
    X = np.c_[rng.integers(0, 7, 900), rng.integers(0, 3, 900) / 8, rng.integers(0, 4, 900)].astype(float)
    y = rng.integers(0, 3, 900).astype(float) if classes else rng.normal(size=900)
    df = frame(spark, X, y).checkpoint()
    forest = D.ExactForest(n_classes=classes, trees=4, seed=5)
    want = forest.fit(df)
    monkeypatch.setattr(D, "NODE_ROWS", 100)
    monkeypatch.setattr(D.ExactTree, "_top", None)
    got = forest.fit(df)
    assert np.array_equal(got.tree["feature"], want.tree["feature"]) and np.allclose(got.tree["threshold"], want.tree["threshold"])
    assert np.allclose(got.tree["stats"], want.tree["stats"]) and np.allclose(got.importances, want.importances)
    one = D.ExactTree(n_classes=classes).fit(df).tree
    whole = D.grow(X, y, np.ones(900), classes, None)
    assert sorted(zip(one["feature"], one["threshold"])) == sorted(zip(whole["feature"], whole["threshold"]))
