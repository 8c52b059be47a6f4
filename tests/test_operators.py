"""Operator semantics pinned on the reference's small inline cases."""

import numpy as np
import pandas as pd
import pytest

from loomstat.operators import clean as C
from loomstat.operators import filters as FL
from loomstat.operators import joins as J
from loomstat.operators import metrics as M
from loomstat.operators import quality as QA
from loomstat.operators import split as S
from loomstat.plans.pipeline import PipelineError, parse, run_preprocessing


@pytest.fixture
def people(spark):
    return spark.createDataFrame([("Alice", 90, "a"), ("Bob", 80, "b"), (None, 70, "c"), ("Dan", 60, "a"),
                                  ("Eve", 50, "b")], "name string, score int, tag string")


def test_filter_eq_ne_keep_nulls(people):
    assert FL.filter_rows(people, "name", "eq", "Bob").count() == 1
    assert FL.filter_rows(people, "name", "ne", "Bob").count() == 4  # the null name is kept
    assert FL.filter_rows(people, "name", "eq", "nan").count() == 1
    assert FL.filter_rows(people, "score", "gt", 65).count() == 3
    assert FL.filter_rows(people, "name", "contains", "^[AE]").count() == 2
    assert FL.filter_rows(people, "name", "is_null").count() == 1
    with pytest.raises(ValueError):
        FL.filter_rows(people, "name", "like", "x")


def test_join_types(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id long, val_a string")
    right = spark.createDataFrame([(2, "p"), (3, "q"), (4, "r")], "id long, val_b string")
    assert J.merge(left, right, "id", "right").count() == 3
    assert J.merge(left, right, "id", "outer").count() == 4
    assert J.merge(left, right, "id", "inner").count() == 2
    assert sorted(r["id"] for r in J.merge(left, right, "id", "outer").collect()) == [1, 2, 3, 4]


def test_join_suffix_and_null_keys(spark):
    a = spark.createDataFrame([(None, 1), (1, 2)], "k long, v long")
    b = spark.createDataFrame([(None, 10), (1, 20)], "k long, v long")
    out = J.merge(a, b, "k", "inner")
    assert out.columns == ["k", "v", "v_right"] and out.count() == 2


def test_auto_preprocess(spark):
    df = spark.createDataFrame([(1.0, "yes"), (None, "no"), (3.0, None), (4.0, "yes")], "age double, target string")
    out, maps = C.auto_preprocess(df, "target")
    rows = out.collect()
    assert len(rows) == 3 and {r["target"] for r in rows} <= {0, 1}
    assert all(r["age"] is not None for r in rows) and "__target__target" in maps


def test_quality_alert_triggers(spark):
    n = 100
    pdf = pd.DataFrame({"const": [1] * n, "miss": [None if i % 4 == 0 else float(i) for i in range(n)],
                        "dom": ["a" if i < 92 else "b" for i in range(n)], "x": np.arange(n, dtype=float),
                        "y": np.arange(n, dtype=float) * 2 + 1})
    df = spark.createDataFrame(pdf)
    types = {r["alert_type"] for r in QA.quality_alerts(df, mode="eda").collect()}
    assert {"constant_column", "high_missing", "class_imbalance", "multicollinearity"} <= types
    score = QA.quality_score(df, mode="eda").first()["score"]
    assert 0 <= score < 100


def test_bin_numeric_labels_match_pandas_cut(spark):
    vals = [1.0, 2.5, 3.0, 7.25, 10.0, 4.4]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    out, _ = C.bin_numeric(df, "x", 3)
    got = [r["x_bin"] for r in out.collect()]
    exp = [str(c) for c in pd.cut(pd.Series(vals), 3)]
    assert got == exp


def test_scale_and_label_encode(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, None), (3.0, "a"), (None, "b")], "x double, s string")
    sc, _ = C.scale(df, ["x"], "standard")
    xs = [r["x"] for r in sc.collect()]
    assert abs(xs[0] + 1.224744871391589) < 1e-12 and xs[3] is None  # population std
    le, _ = C.label_encode(df, "s")
    assert [r["s"] for r in le.collect()] == [1, 2, 0, 1]  # a < b < nan


def test_pipeline_validation_and_soft_errors(spark, people):
    with pytest.raises(ValueError):
        parse([{"op": "explode"}])
    out, summ = run_preprocessing(people, [{"op": "drop_column", "col": "missing"},
                                           {"operation": "fillna", "column": "score", "method": "mean"}])
    assert "error" in summ[0] and out.count() == 5


def test_split_sizes_exact(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(103)], "id long, c long")
    sp = S.split_dataset(df, "id", 0.2, stratify="c")
    assert sp.where("split = 'test'").count() == 21  # ceil(103 * 0.2)
    folds = S.kfold(df, "id", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [20, 20, 21, 21, 21]


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.random(300), 2)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    got = M.auc_exact(df, "y", "s", dp=10).first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-9


def test_roc_drop_intermediate_matches_numpy(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 40) / 40  # 41 distinct scores, many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    got = sorted((r["fpr"], r["tpr"]) for r in M.roc_points(df, "y", "s").collect())
    thr = np.unique(s)[::-1]
    tps = np.cumsum([((s == t) & (y == 1)).sum() for t in thr])
    fps = np.cumsum([((s == t) & (y == 0)).sum() for t in thr])
    keep = np.where(np.r_[True, np.logical_or(np.diff(fps, 2), np.diff(tps, 2)), True])[0]
    exp = sorted([(0.0, 0.0)] + [(round(fps[i] / (y == 0).sum(), 6), round(tps[i] / (y == 1).sum(), 6)) for i in keep])
    assert got == exp


def test_pipeline_reports_every_problem_together(people):
    with pytest.raises(PipelineError) as e:
        parse([{"op": "explode"}, {"op": "fill_nulls", "strategy": "guess"}, {"op": "rename_column", "from": "a"}, 7])
    assert len(e.value.problems) == 5
    with pytest.raises(PipelineError):
        parse({"op": "drop_column"})
    with pytest.raises(PipelineError):
        parse([{"op": "drop_null_rows"}] * 3, limit=2)
    assert parse([{"operation": "fillna", "col": "a", "method": "mean"}]) == [
        {"op": "fill_nulls", "column": "a", "strategy": "mean"}]


def test_too_few_bin_labels_are_a_reported_failure(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], ["x"])
    out, summary = run_preprocessing(df, [{"op": "bin_numeric", "column": "x", "bins": 3, "labels": ["a"]}])
    assert out.columns == ["x"] and "labels" in summary[0]["error"]
