import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors

from loomstat.operators import boosting as B
from loomstat.operators import train as TR


def plain_tree(x, g, h, depth, lam, least):
    """(feature, threshold, left, right) or a leaf value, by trying every cut of every feature."""
    def value(rows):
        return g[rows].sum() ** 2 / (h[rows].sum() + lam)

    best = (1e-6, None, None)
    if depth:
        for f in range(x.shape[1]):
            for t in np.unique(x[:, f])[1:]:
                left = x[:, f] < t
                if h[left].sum() >= least and h[~left].sum() >= least:
                    gain = value(left) + value(~left) - value(slice(None))
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, f, t)
    if best[1] is None:
        return -g.sum() / (h.sum() + lam)
    left = x[:, best[1]] < best[2]
    return (best[1], best[2], plain_tree(x[left], g[left], h[left], depth - 1, lam, least),
            plain_tree(x[~left], g[~left], h[~left], depth - 1, lam, least))


def walk(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree


def plain_boost(x, y, classes, rounds, depth=3, eta=0.3):
    """Margins after every round, by the definitions."""
    if classes > 2:
        m = np.zeros((len(y), classes))
    else:
        mean = y.mean()
        m = np.full((len(y), 1), mean if not classes else np.log(mean / (1 - mean)))
    for _ in range(rounds):
        if not classes:
            g, h = m - y[:, None], np.ones_like(m)
        elif classes == 2:
            p = 1 / (1 + np.exp(-m))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(m) / np.exp(m).sum(1, keepdims=True)
            g, h = p - np.eye(classes)[y.astype(int)], 2 * p * (1 - p)
        trees = [plain_tree(x, g[:, c], h[:, c], depth, 1.0, 1.0) for c in range(m.shape[1])]
        m = m + eta * np.array([[walk(t, row) for t in trees] for row in x])
    return m


def frame(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(r), float(v)) for i, (r, v) in enumerate(zip(x, y))],
                                 ["id", "features", "label"]).repartition(5)


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    x = np.stack([rng.integers(0, 9, 240), rng.normal(size=240).round(2), rng.integers(0, 3, 240), np.ones(240)], 1).astype(float)
    return x, x[:, 0] * (x[:, 1] > 0.2) + 0.3 * x[:, 2] + rng.normal(scale=0.3, size=240)


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_margins_equal_plain_boosting(spark, table, classes):
    x, target = table
    y = target if not classes else np.digitize(target, np.quantile(target, np.arange(1, classes) / classes)).astype(float)
    rounds = 12 if classes == 2 else 4  # beyond one update of the stored margins
    model = B.NewtonBoost(n_classes=classes, rounds=rounds).fit(frame(spark, x, y))
    want = plain_boost(x, y, classes, rounds)
    assert np.allclose(model.margins(x), want, atol=1e-9)
    out = model.transform(frame(spark, x, y)).orderBy("id")
    if not classes:
        assert np.allclose([r.prediction for r in out.collect()], want[:, 0])
        return
    rows = out.select("prediction", vector_to_array("probability").alias("p")).collect()
    p = np.array([r.p for r in rows])
    plain = np.exp(want) / np.exp(want).sum(1, keepdims=True) if classes > 2 else np.stack([1 / (1 + np.exp(want[:, 0])), 1 / (1 + np.exp(-want[:, 0]))], 1)
    assert np.allclose(p, plain) and (p.argmax(1) == [r.prediction for r in rows]).all()
    assert (p.argmax(1) == y).mean() > 0.7


def test_one_split(spark):
    """Leaf values and threshold of one split, by hand."""
    x, y = np.array([[1.0], [2.0], [3.0], [4.0]]), np.array([0.0, 0.0, 4.0, 4.0])
    t = B.NewtonBoost(max_depth=1, rounds=1).fit(frame(spark, x, y)).trees[0][0]
    assert (t.feature.tolist(), t.threshold[0]) == ([0, -1, -1], 3.0)
    assert np.allclose(t.value[1:], [-0.3 * 4 / 3, 0.3 * 4 / 3]) and np.isclose(t.gain[0], 32 / 3)


def test_quantile_cuts_above_the_bins(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=3000), rng.integers(0, 4, 3000)], 1).astype(float)
    cuts = B.bin_cuts(frame(spark, x, x[:, 0]).select(vector_to_array("features").alias("x")), 2, 32)
    assert len(cuts[0]) <= 31 and np.allclose(cuts[0], np.quantile(x[:, 0], np.arange(1, 32) / 32), atol=0.02)
    assert cuts[1].tolist() == [1.0, 2.0, 3.0]
    model = B.NewtonBoost(rounds=20, max_bins=32).fit(frame(spark, x, np.sin(2 * x[:, 0]) + x[:, 1]))
    assert np.mean((model.margins(x)[:, 0] - np.sin(2 * x[:, 0]) - x[:, 1]) ** 2) < 0.02
    assert np.isclose(sum(model.featureImportances), 1) and min(model.featureImportances) > 0.1


def test_train_save_and_awkward_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), "abc"[i % 3], None if i % 10 == 0 else float(i % 7)) for i in range(300)]
    df = spark.createDataFrame([(i, a, t, n, ("lo", "mid", "hi")[(a > -0.5) + (a > 0.5)] if i % 30 else None) for i, a, t, n in rows],
                               "id long, a double, t string, n double, cls string")
    r = TR.train_model(df, "cls", "xgb", "classification", key="id")
    assert r.metrics["accuracy"] > 0.95
    r.model.write().save(f"{tmp_path}/m")
    a = TR.score(r.model, df).orderBy("id").select("predicted_label", "probability").collect()
    assert a == TR.score(PipelineModel.load(f"{tmp_path}/m"), df).orderBy("id").select("predicted_label", "probability").collect()
    assert TR.feature_importance(r.model, r.plan)[0][0] == "a"
    same = B.NewtonBoost(rounds=2).fit(frame(spark, np.ones((30, 2)), np.full(30, 5.0)))
    assert np.allclose(same.margins(np.zeros((3, 2))), 5.0)
    with pytest.raises(ValueError):
        B.NewtonBoost().fit(frame(spark, np.ones((1, 2)), [1.0]).where("id < 0"))
    same.transform(frame(spark, np.ones((1, 2)), [1.0]).where("id < 0")).collect()
