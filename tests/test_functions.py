"""Distributed helpers against numpy / pandas on small inputs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loomstat.functions import quantiles as Q
from loomstat.functions.ordered import average_ranks, cumulative_sums, dense_positions, fill_forward, row_positions


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.full(500, 2.5), rng.integers(0, 5, 400).astype(float)])
    df = spark.createDataFrame(pd.DataFrame({"g": ["a"] * len(vals), "v": vals}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = Q.exact_quantiles(df, probs)
    for p in probs:
        assert abs(got[("a", p)] - np.quantile(vals, p)) < 1e-12


def test_kth_values_narrowing_path(spark):
    # a tiny bracket limit forces the histogram narrowing passes
    vals = np.arange(5000, dtype=float)[::-1]
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "v": vals}))
    got = Q.kth_values(df, {1: [0, 17, 2500, 4999]}, {1: 5000}, max_bracket=50)
    assert got == {(1, 0): 0.0, (1, 17): 17.0, (1, 2500): 2500.0, (1, 4999): 4999.0}


def test_fill_forward_and_backward_match_pandas(spark):
    v = [None, 1.0, None, None, 4.0, None, 6.0, None]
    pdf = pd.DataFrame({"k": range(len(v)), "v": v})
    df = spark.createDataFrame(pdf)
    ff = fill_forward(df, ["v"], "k", n_buckets=3).orderBy("k").toPandas()["v"].tolist()
    bf = fill_forward(df, ["v"], "k", backward=True, n_buckets=3).orderBy("k").toPandas()["v"].tolist()
    exp_f, exp_b = pdf["v"].ffill().tolist(), pdf["v"].bfill().tolist()
    assert [x if x == x else None for x in ff] == [x if x == x else None for x in exp_f]
    assert [x if x == x else None for x in bf] == [x if x == x else None for x in exp_b]


def test_average_ranks_match_pandas(spark):
    vals = [3.0, 1.0, 2.0, 2.0, 5.0, 3.0, 3.0]
    r = average_ranks(spark.createDataFrame([(v,) for v in vals], "v double"), "v", n_buckets=3)
    got = {row["v"]: row["avg_rank"] for row in r.collect()}
    exp = pd.Series(vals).rank(method="average")
    for v, rk in zip(vals, exp):
        assert got[v] == rk


def test_cumulative_sums_descending(spark):
    df = spark.createDataFrame([(float(i % 5), 1) for i in range(50)], "s double, c long")
    out = {r["s"]: r["cum_c"] for r in cumulative_sums(df, "s", ["c"], descending=True, n_buckets=4).collect()}
    assert out == {4.0: 10, 3.0: 20, 2.0: 30, 1.0: 40, 0.0: 50}


def test_dense_positions_and_row_positions(spark):
    words = ["pear", "apple", "fig", "apple", "kiwi"]
    pos, n = dense_positions(spark.createDataFrame([(w,) for w in words], "w string"), "w", n_parts=3)
    assert n == 4 and {r["w"]: r["pos"] for r in pos.collect()} == {"apple": 0, "fig": 1, "kiwi": 2, "pear": 3}
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, g long")
    rp, sizes = row_positions(df, ["k"], ["g"], n_buckets=4)
    got = {r["k"]: r["pos"] for r in rp.collect()}
    assert all(got[i] == i // 3 for i in range(30)) and {r["g"]: r["n"] for r in sizes.collect()} == {0: 10, 1: 10, 2: 10}


def test_skew_is_bias_corrected(spark):
    from loomstat.functions.exprs import skew_corrected
    vals = [1.0, 2.0, 2.0, 3.0, 10.0, 11.0]
    got = spark.createDataFrame([(v,) for v in vals], "x double").agg(skew_corrected(F.col("x"))).first()[0]
    assert abs(got - pd.Series(vals).skew()) < 1e-12
    const = spark.createDataFrame([(1.0,)] * 5, "x double").agg(skew_corrected(F.col("x"))).first()[0]
    assert const == 0.0
