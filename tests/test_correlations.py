import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.functions import cell_ranks as R
from loomstat.functions import moments as M
from loomstat.operators import profile as P
from loomstat.operators import quality as Q


@pytest.fixture(scope="module")
def gappy(spark):
    rng = np.random.default_rng(11)
    n = 900
    x = rng.normal(1e6, 1, n)
    pdf = pd.DataFrame({"a": x, "b": 3 * x + rng.normal(size=n), "c": rng.integers(0, 3, n).astype(float),
                        "d": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)), "e": np.full(n, 1 / 3)})
    for c, share in (("b", 0.2), ("c", 0.1)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    pdf.loc[pdf["c"].isna(), "d"] = np.nan
    df = spark.createDataFrame(pdf).repartition(6)
    return pdf, df


def as_dict(df):
    return {(r.col_a, r.col_b): r.r for r in df.collect()}


def check(found, pdf, method):
    want = pdf.corr(method=method)
    assert len(found) == 10
    for (a, b), r in found.items():
        w = want.loc[a, b]
        assert (r is None and math.isnan(w)) or (r is not None and abs(r - w) < 1e-8), (a, b, r, w)


def test_pearson_with_gaps(gappy):
    pdf, df = gappy
    check(as_dict(P.pearson_pairs(df, dp=12)), pdf, "pearson")
    n = {(r.col_a, r.col_b): r.n for r in P.pair_stats(df, list(pdf)).collect()}
    assert all(v == pdf[[a, b]].dropna().shape[0] for (a, b), v in n.items())


def test_spearman_with_gaps(gappy):
    """Lists with and without gaps in one shuffle; the hot values 7.0 and 0-2 lie over several partitions."""
    pdf, df = gappy
    check(as_dict(P.spearman_pairs(df, None, "key", dp=12)), pdf, "spearman")


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_ranks_on_every_partitioning(spark, partitions):
    rng = np.random.default_rng(5)
    lists = {0: rng.integers(0, 4, 300).astype(float), 1: np.full(200, 2.5), 2: rng.normal(size=100), 5: np.array([-0.0, 0.0, 1.0])}
    cells = spark.createDataFrame([(k, float(v), i) for k, vs in lists.items() for i, v in enumerate(vs)],
                                  "list int, value double, row long")
    out, sizes = R.average_cell_ranks(cells, partitions)
    assert sizes == {k: len(v) for k, v in lists.items()}
    got = out.toPandas()
    for k, vs in lists.items():
        mine = got[got["list"] == k].sort_values("row")["rank"].to_numpy()
        assert (mine == pd.Series(vs).rank().to_numpy()).all()


def test_hot_value_is_spread(spark):
    """Half the cells are one value: no partition holds more than twice its share."""
    cells = spark.range(20000).select(F.lit(0).alias("list"), F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.rand(3)).alias("value"),
                                      F.col("id").alias("row"))
    parts = cells.repartitionByRange(8, "list", "value", "row").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 2 * 20000 / 8


def test_column_moments(gappy):
    pdf, df = gappy
    cols = list(pdf)
    for c, m in zip(cols, M.column_moments(M.value_array(df, cols), M.centres(df, cols))):
        v = pdf[c].dropna()
        assert m["n"] == len(v) and m["zeros"] == (v == 0).sum() and (m["min"], m["max"]) == (v.min(), v.max())
        assert np.isclose(m["mean"], v.mean()) and np.isclose(m["m2"], v.var(ddof=0), rtol=1e-6, atol=1e-12)
        assert np.isclose(M.skewness(m), 0.0 if c == "e" else v.skew(), rtol=1e-6, atol=1e-9)
    assert M.skewness({"n": 2}) is None


def test_pairs_do_not_widen_the_plan(spark):
    """40 columns are 780 pairs: one aggregate of six sums, whatever their number."""
    df = spark.range(50).select(*[(F.col("id") * (i + 1) % 17).alias(f"c{i}") for i in range(40)])
    plan = P.pair_stats(df, df.columns)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sum(") <= 12
    assert P.pair_stats(df, df.columns).count() == 780


def test_alerts_on_awkward_tables(spark):
    big = 2 ** 60
    df = spark.createDataFrame([(big, 5.0, None, "x"), (big + 1, 5.0, None, "x"), (big + 2, 5.0, None, "x")],
                               "near long, flat double, void double, word string")
    kinds = {(r.alert_type, r.column_name) for r in Q.quality_alerts(df).collect()}
    assert {("constant_column", "flat"), ("constant_column", "void"), ("constant_column", "word"), ("high_missing", "void")} <= kinds
    assert ("constant_column", "near") not in kinds
    assert Q.quality_alerts(df.limit(0)).count() == 0 and Q.quality_alerts(df.select("word"), mode="eda").count() >= 1
    assert P.pearson_pairs(df.limit(0)).where("r IS NOT NULL").count() == 0
    assert P.spearman_pairs(df.limit(0), None, "key").where("r IS NOT NULL").count() == 0


def test_more_cells_make_more_partitions(spark, monkeypatch):
    """What a task holds of the ranks does not grow with the table."""
    from loomstat.functions import cell_ranks as CR
    cells = spark.range(4000).selectExpr("int(id % 2) AS list", "double(id % 97) AS value", "id AS row")
    want = {(r["list"], r["row"]): r["rank"] for r in CR.average_cell_ranks(cells)[0].collect()}
    monkeypatch.setattr(CR, "TASK_CELLS", 100)
    seen, whole = [], CR.cut_lineage
    monkeypatch.setattr(CR, "cut_lineage", lambda df: seen.append(whole(df)) or seen[-1])
    got = {(r["list"], r["row"]): r["rank"] for r in CR.average_cell_ranks(cells)[0].collect()}
    assert got == want and len(got) == 4000
    assert max(r["count"] for r in seen[0].groupBy("pid").count().collect()) <= 300
