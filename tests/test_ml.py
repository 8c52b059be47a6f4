"""Model-side operators: exactness of the custom distributed algorithms and
quality floors for the learners."""

import ast

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from loomstat.operators import anomaly as AN
from loomstat.operators import cluster as CL
from loomstat.operators import metrics as M
from loomstat.operators import train as TR
from loomstat.operators.knn import knn_join
from loomstat.operators.stages import TextCodes


def test_knn_join_is_exact(spark):
    rng = np.random.default_rng(7)
    X = np.vstack([rng.normal(0, 1, (150, 5)), rng.normal(6, 1, (150, 5))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(X)), "vec": [list(map(float, r)) for r in X]}))
    got = knn_join(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid"), 4, exclude_self=True,
                   n_pivots=9).collect()
    got = {(r["qid"], r["rank"]): r["rid"] for r in got}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for q in range(len(X)):
        exp = np.lexsort((np.arange(len(X)), D[q]))[:4]
        assert [got[(q, r + 1)] for r in range(4)] == exp.tolist()


def test_dbscan_two_blobs_and_noise(spark):
    rng = np.random.default_rng(0)
    X = np.vstack([rng.normal(0, 0.1, (40, 2)), rng.normal(5, 0.1, (40, 2)), [[20.0, 20.0]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(X)), "vec": [list(map(float, r)) for r in X]}))
    lab = {r["id"]: r["cluster"] for r in CL.dbscan(df, "id", eps=0.5, min_samples=5).collect()}
    assert lab[80] == -1 and lab[0] == 0 and lab[40] == 1
    assert len({lab[i] for i in range(40)}) == 1 and len({lab[i] for i in range(40, 80)}) == 1


def test_anomaly_share_matches_contamination(spark):
    rng = np.random.default_rng(5)
    X = np.vstack([rng.normal(0, 1, (380, 2)), rng.normal(0, 8, (20, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(X)), "vec": [list(map(float, r)) for r in X]}))
    for res in (AN.isolation_forest(df, "id", n_trees=30, contamination=0.05),
                AN.local_outlier_factor(df, "id", k=10, contamination=0.05)):
        flagged = {r["id"] for r in res.where("is_anomaly").collect()}
        assert 15 <= len(flagged) <= 21 and len(flagged & set(range(380, 400))) >= 10


def test_isolation_forest_does_not_depend_on_the_partitioning(spark):
    rng = np.random.default_rng(8)
    X = rng.normal(size=(3000, 3))
    df = spark.createDataFrame(pd.DataFrame({"id": range(3000), "vec": [list(map(float, r)) for r in X]}))
    runs = [AN.isolation_forest(df.repartition(n, "id") if n > 1 else df.coalesce(1), "id", n_trees=20).orderBy("id").collect()
            for n in (1, 7)]
    assert runs[0] == runs[1]


def test_classifier_quality_floor(spark):
    rng = np.random.default_rng(2)
    n = 400
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = np.where(x1 + 0.5 * x2 > 0, "yes", "no")
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "x1": x1, "x2": x2, "y": y}))
    for model in ("lr", "nb", "knn"):
        r = TR.train_model(df, "y", model, key="id")
        assert r.metrics["accuracy"] > 0.8, (model, r.metrics)
    assert set(r.predictions.select("predicted_label").distinct().toPandas()["predicted_label"]) <= {"yes", "no"}


def test_regressor_recovers_line(spark):
    x = np.arange(100, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(100), "x": x, "y": 3 * x + 2}))
    c = {r["term"]: r["coefficient"] for r in TR.fit_coefficients(df, "y", ["x"]).collect()}
    assert abs(c["x"] - 3) < 1e-9 and abs(c["intercept"] - 2) < 1e-7


def test_ridge_and_lasso_match_closed_forms(spark):
    rng = np.random.default_rng(0)
    n = 2000
    x = rng.normal(10, 3, n)
    y = 50 * x + rng.normal(0, 400, n)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    xc, yc = x - x.mean(), y - y.mean()
    sxx, sxy = (xc * xc).sum(), (xc * yc).sum()
    alpha = 1e5  # RSS + α‖w‖²
    c = {r["term"]: r["coefficient"] for r in TR.fit_coefficients(df, "y", ["x"], "rr", alpha=alpha).collect()}
    assert abs(c["x"] - sxy / (sxx + alpha)) < 1e-8
    alpha = 100.0  # (1/2n)·RSS + α‖w‖₁ → soft threshold
    r = sxy / n
    exp = np.sign(r) * max(abs(r) - alpha, 0) / (sxx / n)
    c = {r_["term"]: r_["coefficient"] for r_ in
         TR.fit_coefficients(df, "y", ["x"], "lar", alpha=alpha, max_iter=500).collect()}
    assert abs(c["x"] - exp) < 1e-4


def test_logistic_penalty_matches_objective(spark):
    """At the MLlib optimum, the gradient of C·Σ logloss + ½‖w‖² (intercept unpenalised) vanishes."""
    from pyspark.ml.feature import VectorAssembler
    rng = np.random.default_rng(4)
    n = 1500
    X = rng.normal(size=(n, 2)) * [1.0, 5.0]
    y = (X[:, 0] + 0.2 * X[:, 1] + rng.normal(size=n) > 0).astype(float)
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(pd.DataFrame({"a": X[:, 0], "b": X[:, 1], "label": y})))
    C = 0.01
    m = TR.make_estimator("lr", "classification", n, 2, "features", C=C, tol=1e-10, max_iter=1000).fit(df)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1 / (1 + np.exp(-(X @ w + b)))
    grad_w = C * X.T @ (p - y) + w
    grad_b = C * (p - y).sum()
    assert np.abs(grad_w).max() < 1e-4 and abs(grad_b) < 1e-4


CODINGS = {"text": ("no", "yes"), "boolean": (False, True), "-1,1": (-1, 1), "1,2": (1, 2), "0,2": (0.0, 2.0),
           "9,10": (9, 10)}


@pytest.mark.parametrize("model", TR.CLASSIFIERS)
def test_every_label_coding_trains_every_classifier(spark, model):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 2))
    side = (x[:, 0] + 0.3 * x[:, 1] > 0).astype(int)
    codings = CODINGS if model == "lr" else {k: CODINGS[k] for k in (("boolean", "1,2") if model == "nb" else ("0,2",))}
    for name, classes in codings.items():
        df = spark.createDataFrame([(i, float(a), float(b), classes[s]) for i, ((a, b), s) in enumerate(zip(x, side))],
                                   ["id", "a", "b", "y"])
        params = {"n_estimators": 5} if model in ("rf", "xgb") else {}
        r = TR.train_model(df, "y", model, key="id", class_weight="balanced", **params)
        assert r.metrics["accuracy"] > 0.7 and r.metrics["auc"] > 0.75, (model, name, r.metrics)
        assert r.plan.labels == TR.class_names(df, "y") and len(r.plan.labels) == 2
        if "probability" in r.predictions.columns:
            assert len(r.predictions.first()["probability"]) == 2
        named = TR.score(r.model, df.drop("y")).first()["predicted_label"]
        assert named in r.plan.labels
        assert r.extra["confusion"].agg({"cnt": "sum"}).first()[0] == r.metrics["n_test"]


def test_number_classes_are_in_number_order(spark):
    df = spark.createDataFrame([(10,), (9,), (10,), (-1,)], ["y"])
    assert TR.class_names(df, "y") == ["-1", "9", "10"]


def test_three_classes_and_one_vs_rest_roc(spark):
    rng = np.random.default_rng(5)
    k = rng.integers(0, 3, 300)
    x = rng.normal(size=300) + 3 * k
    df = spark.createDataFrame([(i, float(v), f"c{c}") for i, (v, c) in enumerate(zip(x, k))], ["id", "x", "y"])
    for model in ("lr", "svm", "xgb"):
        assert TR.train_model(df, "y", model, key="id").metrics["accuracy"] > 0.75
    r = TR.train_model(df, "y", "nb", key="id")
    points, areas = TR.roc_by_class(r.model, df, "y")
    p = np.stack(TR.score(r.model, df).orderBy("id").toPandas()["probability"].to_numpy())
    for a in areas.collect():
        c = int(a["class"][1])
        own, rest = p[k == c, c], p[k != c, c]
        want = ((own[:, None] > rest).mean() + 0.5 * (own[:, None] == rest).mean())
        assert abs(a["auc"] - want) < 1e-3
    assert points.where("fpr = 1 AND tpr = 1").select("class").distinct().count() == 3


def test_text_features_and_all_models_survive_saving(spark, tmp_path):
    from loomstat.sources.models import load_model, save_model
    n = 200
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "name": [f"n{i}" for i in range(n)],
                                             "grp": [("a", "b", None)[i % 3] for i in range(n)],
                                             "x": [float(i % 7) for i in range(n)],
                                             "y": ["no" if i % 3 else "yes" for i in range(n)]}))
    for model in ("dtc", "svm", "knn"):
        r = TR.train_model(df.drop("name") if model != "dtc" else df, "y", model, key="id")
        assert r.metrics["accuracy"] > 0.9, model
        save_model(spark, r.model, f"{tmp_path}/{model}", r.metrics)
        again, meta = load_model(spark, f"{tmp_path}/{model}")
        assert meta["accuracy"] == r.metrics["accuracy"]
        rows = [sorted((x["id"], x["predicted_label"]) for x in TR.score(m, df.drop("y")).collect())
                for m in (r.model, again)]
        assert rows[0] == rows[1] and len(rows[0]) == n
        unseen = df.limit(1).drop("y").withColumn("grp", F.lit("never seen"))
        assert TR.score(again, unseen).count() == 1


def test_search_returns_the_best_model(spark):
    rng = np.random.default_rng(1)
    x = rng.uniform(-3, 3, 200)
    df = spark.createDataFrame([(i, float(v), "in" if abs(v) < 1.5 else "out") for i, v in enumerate(x)],
                               ["id", "x", "y"])
    found = TR.tune(df, "y", "dtc", grid={"max_depth": [1, 6]}, cv=3, key="id")
    assert found.best_params == {"max_depth": 6} and found.table.first()["params"] == "{'max_depth': 6}"
    assert TR.evaluate_model(found.best_model, df, "y").first()["accuracy"] > 0.95
    table, best = TR.compare_models(df, "y", models=["lr", "dtc", "nope"], key="id")
    rows = table.orderBy("rank").collect()
    assert [r["model"] for r in rows] == ["dtc", "lr", "nope"] and rows[2]["status"] == "failed"
    assert best.metrics["model"] == "dtc"
    assert TR.importance_report(best)[0][0][0] == "x"


def test_one_vs_rest_roc_counts_scores_once_a_class(spark, monkeypatch):
    rng = np.random.default_rng(6)
    k = rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, float(v), f"c{c}") for i, (v, c) in enumerate(zip(rng.normal(size=90) + k, k))], ["id", "x", "y"])
    model, asked, plain = TR.train_model(df, "y", "nb", key="id").model, [], M.score_counts
    monkeypatch.setattr(M, "score_counts", lambda *a: asked.append(a[3]) or plain(*a))
    points, areas = TR.roc_by_class(model, df, "y")
    assert sorted(asked) == ["0.0", "1.0", "2.0"]
    scored = TR.with_label(model.transform(df), "y", ["c0", "c1", "c2"])
    for i in range(3):
        own = scored.select("label", vector_to_array("probability")[i].alias("s"))
        want = M.auc_exact(own, "label", "s", f"{float(i)}", 4).first()
        assert tuple(areas.where(f"class = 'c{i}'").first())[1:] == tuple(want)
        curve = points.where(f"class = 'c{i}'").drop("class")
        assert sorted(map(str, curve.collect())) == sorted(map(str, M.roc_points(own, "label", "s", f"{float(i)}").collect()))


def _text_table(spark):
    rng = np.random.default_rng(8)
    x, g = rng.uniform(-3, 3, 150), rng.integers(0, 3, 150)
    return spark.createDataFrame([(i, float(v), "abc"[c], "in" if abs(v) < 1 + c / 2 else "out") for i, (v, c) in enumerate(zip(x, g))],
                                 ["id", "x", "g", "y"])


def _count_code_fits(monkeypatch):
    fits, plain = [], TextCodes._fit
    monkeypatch.setattr(TextCodes, "_fit", lambda self, rows: fits.append(1) or plain(self, rows))
    return fits


def test_search_fits_the_features_once_a_fold(spark, monkeypatch):
    df = _text_table(spark)
    fits = _count_code_fits(monkeypatch)
    found = TR.tune(df, "y", "dtc", grid={"max_depth": [1, 2, 4]}, cv=2, key="id")
    assert len(fits) == 3  # a fold each, and the refit
    for r in found.table.collect():
        _, summary, _ = TR.cross_validate(df, "y", "dtc", n_splits=2, key="id", **ast.literal_eval(r["params"]))
        assert (summary["f1_weighted_mean"], summary["f1_weighted_std"]) == (r["mean_score"], r["std_score"])
    assert TR.tune(df.drop("y"), "x", "pr", "regression", grid={"degree": [1, 2]}, cv=2, key="id").table.count() == 2


def test_comparison_fits_shared_features_once(spark, monkeypatch):
    df = _text_table(spark)
    fits = _count_code_fits(monkeypatch)
    table, best = TR.compare_models(df, "y", models=["nb", "dtc", "lr", "knn"], key="id")
    assert len(fits) == 2  # plain and scaled features
    for r in table.collect():
        m = TR.train_model(df, "y", r["model"], key="id").metrics
        assert (r["status"], r["primary"], r["secondary"]) == ("ok", m["f1_weighted"], m["accuracy"])
    again = TR.train_model(df, "y", best.metrics["model"], key="id")
    assert best.metrics == again.metrics
    rows = [sorted(map(tuple, b.predictions.select("id", "predicted_label").collect())) for b in (best, again)]
    assert rows[0] == rows[1] and sorted(map(str, best.extra["confusion"].collect())) == sorted(map(str, again.extra["confusion"].collect()))


def _points(spark, X):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(X)), "vec": [list(map(float, r)) for r in X]}))


def test_neighbour_search_visits_few_cells_in_two_dimensions(spark):
    rng = np.random.default_rng(3)
    X = np.vstack([rng.uniform(0, 10, (1500, 2)), np.repeat(rng.uniform(0, 10, (1, 2)), 40, 0)])
    df, stats = _points(spark, X), {}
    nb = knn_join(df.withColumnRenamed("id", "qid"), df.withColumnRenamed("id", "rid"), 5, exclude_self=True,
                  stats=stats).collect()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    got = {}
    for r in nb:
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"]))
    for q in range(len(X)):
        assert [x for _, x in sorted(got[q])] == np.lexsort((np.arange(len(X)), D[q]))[:5].tolist()
    assert stats["mean_cells"] < 0.3 * stats["cells"], stats


def test_dbscan_against_plain_search(spark):
    rng = np.random.default_rng(6)
    X = np.vstack([rng.normal(c, 0.4, (60, 2)) for c in ((0, 0), (2.2, 0), (6, 6))] + [rng.uniform(-4, 10, (40, 2))])
    eps, least = 0.45, 5
    near = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1)) <= eps
    core = near.sum(1) >= least
    label = np.full(len(X), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            stack, label[i] = [i], i
            while stack:
                for j in np.flatnonzero(near[stack.pop()] & core & (label < 0)):
                    label[j] = i
                    stack.append(j)
    for i in np.flatnonzero(~core):
        adjacent = label[near[i] & core]
        label[i] = adjacent.min() if len(adjacent) else -1
    number = {x: k for k, x in enumerate(sorted(set(label[label >= 0])))}
    want = [number.get(x, -1) for x in label]
    got = {r["id"]: r["cluster"] for r in CL.dbscan(_points(spark, X), "id", eps, least).collect()}
    assert [got[i] for i in range(len(X))] == want and len(number) >= 3 and -1 in want
    nothing = CL.dbscan(_points(spark, X[:3]), "id", 1e-6, 5).collect()
    assert [r["cluster"] for r in nothing] == [-1] * 3


def test_kmeans_cost_and_silhouettes(spark):
    rng = np.random.default_rng(9)
    X = np.vstack([rng.normal(c, 0.5, (50, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    df = _points(spark, X)
    lab, centres, inertia = CL.kmeans(df, "id", 3)
    d = ((X[:, None] - np.array(centres)[None]) ** 2).sum(-1)
    got = [r["cluster"] for r in lab.orderBy("id").collect()]
    assert got == d.argmin(1).tolist() and abs(inertia - d.min(1).sum()) < 1e-6
    y = np.array(got)
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))

    def silhouette(dist):
        out = []
        for i in range(len(X)):
            a = dist[i][y == y[i]].sum() / ((y == y[i]).sum() - 1)
            b = min(dist[i][y == c].mean() for c in set(got) if c != y[i])
            out.append((b - a) / max(a, b))
        return np.mean(out)
    both = lab.join(df, "id")
    assert abs(CL.silhouette(both, "id", squared=True) - silhouette(D ** 2)) < 1e-6
    assert abs(CL.silhouette(both, "id") - silhouette(D)) < 1e-9
    assert abs(CL.silhouette(both, "id", sample=1000) - silhouette(D)) < 1e-9
    tried = CL.best_k(df, "id", 5).collect()
    best = next(r for r in tried if r["best"])
    assert len(tried) == 4 and best["silhouette"] == max(r["silhouette"] for r in tried) > 0.6
    flat, variance = CL.cluster_points(df, lab, "id")
    assert flat.columns == ["id", "component_1", "component_2", "cluster"] and abs(sum(variance) - 1) < 1e-3
