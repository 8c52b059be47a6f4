import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.llm import mixing as M


def test_query_meets_its_targets(spark, sf):
    out = M.op4_soft_mixing(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(docs) and all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in out)
    assert sum(docs[r.doc_id].lang == r.domain for r in out) / len(out) > 0.9
    assert all(r.n_tokens == len(docs[r.doc_id].text.split()) for r in out)
    tokens = sum(r.n_tokens for r in out)
    named = {r.domain: r for r in out}
    assert named.keys() == M.WEIGHTS.keys()
    for d, r in named.items():
        assert abs(r.target - M.WEIGHTS[d] * tokens) < 1e-6 * tokens and abs(r.total - r.target) <= r.residual * tokens + 1e-6
        # posteriors are near one here, so what the most likely language is given is near its target
        assert abs(sum(x.rate * x.n_tokens for x in out if x.domain == d) - r.target) < 0.1 * r.target
    assert out[0].residual < 1e-3
    present = {d: sum(r.n_tokens for r in out if r.domain == d) for d in named}
    assert present["en"] > 1.2 * named["en"].target  # so English shrinks
    english = [r.rate for r in out if r.domain == "en"]
    assert np.mean(english) < 0.95 and min(x.rate for x in out if x.domain == "es") > 1


def test_bounds_are_active(spark):
    """A domain with no weight: its documents fall to the floor, by the optimality conditions of the bounded problem."""
    df, n, p = members(spark, 2)
    fitted = M.fit_rates(df, ["a", "b", "c"], {"a": 0.75, "b": 0.25, "c": 0.0})
    r = np.array([x.r for x in df.select(fitted.rate(F.col("_p")).alias("r")).collect()])
    slope = p @ np.linalg.inv((p.T * n) @ p) @ (p.T @ (r * n) - fitted.targets)
    assert (r == 0).mean() > 0.1 and (r[p[:, 2] > 0.9] < 0.05).all()
    assert np.abs(np.where(r > 0, slope, np.minimum(slope, 0))).max() < 0.05


def test_a_fit_that_does_not_end_warns(spark, monkeypatch):
    df, _, _ = members(spark, 1)
    monkeypatch.setattr(M, "MAX_ITERATIONS", 2)
    with pytest.warns(UserWarning, match="after 2 steps"):
        M.fit_rates(df, ["a", "b", "c"], {"a": 0.98, "b": 0.01, "c": 0.01}, floor=0.5)


def test_weights_of_unlisted_domains():
    assert M.weights_for(["en", "it"], {"en": 0.6, "de": 0.3}) == {"en": 0.6, "it": 0.3}


def members(spark, seed=0, n=400):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([0.3, 0.3, 0.3], n)
    tokens = rng.integers(0, 900, n)
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(tokens, p)]
    return spark.createDataFrame(rows, "_n long, _p array<double>"), tokens, p


def test_rates_against_numpy_projected_gradient(spark):
    df, n, p = members(spark)
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    fitted = M.fit_rates(df, ["a", "b", "c"], weights)
    r = np.array([x.r for x in df.select(fitted.rate(F.col("_p")).alias("r")).collect()])
    target = np.array([0.7, 0.2, 0.1]) * n.sum()
    assert fitted.residual < 1e-5 and (r >= 0).all()
    assert np.allclose((r * n) @ p, target, rtol=1e-4)
    want = at = np.ones(len(n))
    inverse = np.linalg.inv((p.T * n) @ p)
    for _, momentum in fitted.steps:
        last, want = want, np.maximum(0, at - p @ inverse @ (p.T @ (at * n) - target))
        at = want + momentum * (want - last)
    assert np.allclose(r, want, atol=1e-6)


def test_bounds_make_it_least_squares(spark):
    """Targets that rates above the floor cannot meet: the rates meet the optimality conditions of the bounded problem."""
    df, n, p = members(spark, 1)
    fitted = M.fit_rates(df, ["a", "b", "c"], {"a": 0.98, "b": 0.01, "c": 0.01}, floor=0.5)
    r = np.array([x.r for x in df.select(fitted.rate(F.col("_p")).alias("r")).collect()])
    slope = p @ np.linalg.inv((p.T * n) @ p) @ (p.T @ (r * n) - fitted.targets)
    assert (r >= 0.5).all() and fitted.residual > 1e-4
    assert np.abs(np.where(r > 0.5, slope, np.minimum(slope, 0))).max() < 0.05


def test_rows_are_repeated(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("_p", F.lit(1)).withColumn("_n", F.lit("x"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows, fitted, model = M.mix(docs, M.labelled_domains(docs, labels), floor=1.0)
    out = M.repeat_rows(docs, fitted, model)
    assert out.columns == docs.columns
    assert out.select("doc_id").distinct().count() == docs.count() < out.count()
    copies = rows.select(M.copies_column(fitted.rate(F.col("_p")), F.col("_u")).alias("c")).agg(F.sum("c")).first()[0]
    assert out.count() == copies
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(spark, odd_docs, no_docs):
    labelled = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z"), (None, "x"), (9, None)], "doc_id long, domain string")
    rows, fitted, model = M.mix(odd_docs, labelled)
    assert rows.count() == 12 and model.domains == ["x", "y"]
    assert M.repeat_rows(odd_docs, fitted, model).columns == odd_docs.columns
    one = M.fit_domains(odd_docs, labelled.limit(0))
    assert one.domains == ["all"] and one.model is None
    rows, fitted, model = M.mix(odd_docs, labelled.limit(0))
    assert M.repeat_rows(odd_docs, fitted, model).count() == 12
    rows, fitted, model = M.mix(no_docs, labelled.limit(0))
    assert rows.count() == 0 and M.repeat_rows(no_docs, fitted, model).count() == 0
    zero = M.fit_rates(rows, ["all"])
    assert zero.residual == 0.0


def test_copies_have_the_rate_as_mean(spark):
    df = spark.range(20000).select(M.copies_column(F.lit(1.3), F.col("id")).alias("c"))
    assert abs(df.agg(F.avg("c")).first()[0] - 1.3) < 0.02
