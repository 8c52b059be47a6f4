import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from loomstat.functions import blocks as B
from loomstat.operators import least_squares as LS
from loomstat.operators import reduce as RD
from loomstat.operators import svm as SV
from loomstat.operators import train as TR


def frame(spark, X, y):
    return spark.createDataFrame([(i, Vectors.dense(x), float(v)) for i, (x, v) in enumerate(zip(X, y))],
                                 ["id", "features", "label"]).repartition(5)


@pytest.mark.parametrize("wide", [0, 1 << 22])
def test_blocks_are_combined_in_a_tree(spark, wide):
    rows = spark.range(1000).repartition(9).select(F.array(F.col("id").cast("double")).alias("x"))

    def task(batches):
        out = {0: np.zeros((2, 1)), 3: np.zeros(1)}
        for b in batches:
            if b.num_rows:
                out[0] += [[B.batch_matrix(b, "x").sum()], [b.num_rows]]
                out[3] += 1
        return out
    got = B.tree_reduce(rows, task, block_bytes=wide)
    assert got[0].tolist() == [[499500.0], [1000.0]] and got[3][0] >= 9


def test_degree_five_against_numpy(spark):
    """Powers up to the fifth of a column around 50: X'X has a condition number near 1e25."""
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 100, 500)
    y = 1e-8 * x ** 5 - 3e-4 * x ** 3 + 0.5 * x + rng.normal(scale=0.1, size=500)
    X = np.stack([x ** k for k in range(1, 6)], 1)
    m = LS.LeastSquares().fit(frame(spark, X, y))
    Z = np.c_[np.ones(500), X / np.abs(X).max(0)]
    want = Z @ np.linalg.lstsq(Z, y, rcond=None)[0]
    got = [r.prediction for r in m.transform(frame(spark, X, y)).orderBy("id").collect()]
    assert np.abs(np.array(got) - want).max() < 1e-6 * np.abs(want).max()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    r = TR.train_model(df, "y", "pr", "regression", key="id")  # degree 5 is the default
    assert r.metrics["r2"] > 0.999


def test_dependent_columns_get_the_smallest_coefficients(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=60)
    X = np.stack([x, x, np.zeros(60), np.full(60, 3.0)], 1)
    b, w = LS.solve(frame(spark, X, 2 * x + 1).select(vector_to_array("features").alias("x"), F.col("label").alias("y")))
    assert np.allclose(w, [1, 1, 0, 0], atol=1e-8) and abs(b - 1) < 1e-8


def exact_rbf_machine(X, y, gamma, C):
    """Hinge machine on the full kernel by coordinate ascent on its dual (no intercept: data centred by design)."""
    K = SV.rbf(X, X, gamma) + 1.0  # the constant feature stands for the intercept
    a = np.zeros(len(y))
    for _ in range(300):
        for i in range(len(y)):
            a[i] = np.clip(a[i] + (1 - y[i] * ((a * y) @ K[i])) / K[i, i], 0, C)
    return lambda Q: (SV.rbf(Q, X, gamma) + 1.0) @ (a * y)


def test_kernel_error_and_accuracy_against_the_exact_kernel(spark, monkeypatch):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(500, 2))
    y = ((X ** 2).sum(1) < 1.2).astype(float)
    fresh = rng.normal(size=(400, 2))
    df = frame(spark, X, y)
    exact = SV.NystroemSvmClassifier(gamma=0.5).fit(df)  # every row is a landmark
    assert exact.kernel_error == 0.0 and len(exact.landmarks) == 500
    monkeypatch.setattr(SV, "MAX_LANDMARKS", 64)
    monkeypatch.setattr(SV, "START_LANDMARKS", 16)
    few = SV.NystroemSvmClassifier(gamma=0.5).fit(df)
    z = SV.rbf(fresh, few.landmarks, 0.5) @ few.root
    assert np.sqrt(((z @ z.T - SV.rbf(fresh, fresh, 0.5)) ** 2).mean()) < 2 * max(few.kernel_error, 0.002)
    assert few.kernel_error < 0.05 and len(few.landmarks) <= 64
    plain = exact_rbf_machine(X, 2 * y - 1, 0.5, 1.0)(fresh) > 0
    truth = (fresh ** 2).sum(1) < 1.2
    for m in (exact, few):
        out = m.transform(frame(spark, fresh, truth.astype(float))).orderBy("id")
        got = np.array([r.prediction for r in out.collect()]) == 1
        assert (got == plain).mean() > 0.96 and (got == truth).mean() > (plain == truth).mean() - 0.02
    p = np.array([r.p for r in out.select(vector_to_array("probability")[1].alias("p")).collect()])
    for lo, hi in ((0, 0.2), (0.8, 1.01)):
        part = (p >= lo) & (p < hi)
        assert part.sum() > 20 and abs(truth[part].mean() - p[part].mean()) < 0.12


def test_machines_of_several_classes_and_weights(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(c, 0.8, (80, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    y = np.repeat([0.0, 1.0, 2.0], 80)
    m = SV.NystroemSvmClassifier(C=2.0).fit(frame(spark, X, y))
    out = m.transform(frame(spark, X, y)).select("prediction", "label", vector_to_array("probability").alias("p")).collect()
    assert np.mean([r.prediction == r.label for r in out]) > 0.95 and all(abs(sum(r.p) - 1) < 1e-9 for r in out)
    # A row with weight 3 is as good as three rows.
    Z, s = X[:80], (X[:80, 0] > 0.3).astype(float)
    w = rng.integers(1, 4, 80)
    one = spark.createDataFrame([(Z[i].tolist(), float(s[i]), float(w[i])) for i in range(80)], "z array<double>, y double, w double")
    three = spark.createDataFrame([(Z[i].tolist(), float(s[i]), 1.0) for i in range(80) for _ in range(w[i])], "z array<double>, y double, w double")
    a, b = SV.fit_machines(one, 1, 2, 1.0), SV.fit_machines(three, 1, 2, 1.0)
    assert a.shape == (1, 1, 3) and np.allclose(a, b, atol=1e-6)
    # A fold's machines are those of the other rows.
    folded = one.withColumn("fold", F.pmod(F.xxhash64("z"), F.lit(2)).cast("int"))
    both = SV.fit_machines(folded, 1, 2, 1.0, 2)
    assert np.allclose(both[0], a, atol=1e-2) and np.allclose(both[2], SV.fit_machines(folded.where("fold = 0"), 1, 2, 1.0)[0], atol=1e-2)


def test_smooth_hinge_by_differences():
    m = np.linspace(-1, 3, 4001)
    loss, slope, curve = SV.smooth_hinge(m)
    assert np.abs(np.gradient(loss, m) - slope).max() < 3e-3 and np.abs(np.gradient(slope, m) - curve)[np.abs(np.abs(m - 1) - SV.SMOOTH) > 0.01].max() < 1e-6
    assert np.allclose(loss[m > 1 + SV.SMOOTH], 0) and np.allclose(loss[m < 1 - SV.SMOOTH], 1 - m[m < 1 - SV.SMOOTH])


def test_ica_recovers_sources(spark):
    rng = np.random.default_rng(5)
    t = np.linspace(0, 8, 600)
    S = np.c_[np.sign(np.sin(3 * t)), rng.uniform(-1, 1, 600)]
    X = S @ np.array([[1, 0.6], [0.4, 1]]).T
    X = (X - X.mean(0)) / X.std(0)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<double>").repartition(4)
    out, rounds = RD.ica(df, "id", 2)
    got = np.array([[r.component_1, r.component_2] for r in out.orderBy("id").collect()])
    c = np.abs(np.corrcoef(got.T, S.T)[:2, 2:])
    assert rounds < 200 and c.max(1).min() > 0.98 and len(set(c.argmax(1))) == 2
