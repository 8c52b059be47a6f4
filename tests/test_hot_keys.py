"""Operators on keys that hold a large share of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.functions import ordered as O
from loomstat.operators import clean as C
from loomstat.operators import joins as J
from loomstat.operators import profile as P
from loomstat.operators import split as S


@pytest.fixture(scope="module")
def hot(spark):
    """Half the rows share a key, another key a fifth; null keys; gaps."""
    rng = np.random.default_rng(4)
    n = 4000
    k = np.where(rng.random(n) < 0.5, 50.0, rng.integers(0, 100, n))
    k = np.where(rng.random(n) < 0.2, 77.0, k)
    pdf = pd.DataFrame({"k": k, "t": rng.permutation(n), "v": np.where(rng.random(n) < 0.7, np.nan, rng.normal(size=n))})
    pdf.loc[rng.random(n) < 0.02, "k"] = np.nan
    return pdf, C.nan_to_null(spark.createDataFrame(pdf))


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("kind", ["double", "bigint", "string", "timestamp"])
def test_fill_with_a_hot_key(spark, hot, backward, kind):
    pdf, df = hot
    key = F.lpad(F.col("k").cast("int").cast("string"), 3, "0") if kind == "string" else F.timestamp_seconds(F.col("k")) \
        if kind == "timestamp" else F.col("k").cast(kind)
    df = df.withColumn("k", key)
    want = pdf.sort_values(["k", "t"], na_position="last")
    want = (want.bfill() if backward else want.ffill()).set_index("t")["v"]
    for parts, buckets in ((3, 8), (11, 13), (2, 1)):
        got = O.fill_forward(df.repartition(parts), ["v"], "k", backward, buckets, ["t"]).toPandas().set_index("t")["v"].sort_index()
        assert np.array_equal(got.to_numpy(), want.sort_index().to_numpy(), equal_nan=True)


def test_hot_key_is_spread_over_tasks(hot):
    _, df = hot
    for ties in (["t"], None):
        parts, order = O.total_order_buckets(df, "k", ties, 8)
        sizes = [r["count"] for r in parts.groupBy(O.BUCKET).count().collect()]
        assert max(sizes) <= 2 * np.median(sizes) and max(sizes) <= 1.5 * df.count() / 8 and len(sizes) >= 8
        # contiguous: no bucket begins before the one below it ends
        ends = parts.groupBy(O.BUCKET).agg(F.min(F.struct(*order)).alias("a"), F.max(F.struct(*order)).alias("b")).orderBy(O.BUCKET).collect()
        assert all(tuple(x["b"])[:2] <= tuple(y["a"])[:2] for x, y in zip(ends, ends[1:]) if x["b"][1] is not None and y["a"][1] is not None)


def test_fill_without_ties_does_not_depend_on_partitions(hot):
    _, df = hot
    one, two = (sorted(map(tuple, O.fill_forward(df.repartition(p), ["v"], "k", n_buckets=b).toPandas().fillna(-9).to_numpy().tolist()))
                for p, b in ((2, 5), (9, 17)))
    assert one == two


def test_long_keys_beyond_doubles(spark):
    base = 2 ** 60
    df = spark.createDataFrame([(base + i // 40, i, float(i) if i % 7 == 0 else None) for i in range(400)], "k long, t long, v double")
    got = O.fill_forward(df.repartition(4), ["v"], "k", n_buckets=6, ties=["t"]).orderBy("t").collect()
    assert [r.v for r in got] == [float(i - i % 7) for i in range(400)]


def test_outer_join_with_hot_and_null_keys(spark):
    rng = np.random.default_rng(2)
    left = pd.DataFrame({"k": np.where(rng.random(300) < 0.4, 7, rng.integers(0, 40, 300)).astype(object), "a": np.arange(300)})
    left.loc[rng.random(300) < 0.2, "k"] = None
    right = pd.DataFrame({"k": list(range(20, 60)) + [None, None], "b": np.arange(42), "a": 0})
    L = spark.createDataFrame([(None if pd.isna(k) else int(k), int(a)) for k, a in left.to_numpy()], "k long, a long")
    R = spark.createDataFrame([(None if pd.isna(k) else int(k), int(b), 0) for k, b, _ in right.to_numpy()], "k long, b long, a long")
    got = J.merge(L, R, "k", "outer")
    want = L.join(R.withColumnRenamed("a", "a_right").withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2")), "full_outer")
    want = want.select(F.coalesce("k", "k2").alias("k"), "a", "b", "a_right")
    assert got.columns == ["k", "a", "b", "a_right"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "LeftAnti" in plan


def test_stratified_splits_have_no_literal_per_class(spark):
    """Thousands of classes, one with a third of the rows: sizes as by hand, and a plan that does not grow."""
    rng = np.random.default_rng(3)
    cls = np.where(rng.random(6000) < 0.33, -1, rng.integers(0, 2000, 6000))
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(cls)], "id long, c long")
    out = S.split_dataset(df, "id", 0.25, stratify="c")
    counts = out.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "test").alias("m")).toPandas()
    assert counts["m"].sum() == 1500
    exact = counts["n"] * 1500 / 6000
    assert ((counts["m"] - np.floor(exact)).isin([0, 1])).all()
    up = counts[counts["m"] > np.floor(exact)]
    rest = counts[counts["m"] == np.floor(exact)]
    frac = lambda d: (d["n"] * 1500 / 6000) % 1
    assert frac(up).min() >= frac(rest).max()
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    folds = S.kfold(df, "id", 5, stratify="c").groupBy("c", "fold").count().groupBy("c").agg((F.max("count") - F.min("count")).alias("d"))
    assert folds.where("d > 1").count() == 0


def test_onehot_above_the_limit_is_sparse(spark):
    df = spark.createDataFrame([(i, None if i == 5 else f"v{i % 30:02}") for i in range(90)], "id long, c string")
    out, told = C.onehot_encode(df, "c", max_categories=10)
    assert told["sparse"] and told["categories"] == 30 and out.columns == ["id", "c_onehot"]
    for r in out.collect():
        want = [] if r.id == 5 else [r.id % 30]
        assert (r.c_onehot.size, r.c_onehot.indices, r.c_onehot["values"]) == (30, want, [1.0] * len(want))


def test_mappings_are_broadcast_by_bytes(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"{'x' * 50}{i % 9}") for i in range(50)], "id long, c string")
    mapping, n = C.label_mapping(df, "c")
    for limit, used in ((64 << 20, True), (100, False)):
        monkeypatch.setattr(C, "BROADCAST_MAX_BYTES", limit)
        out = C.apply_mapping(df, "c", mapping, n)
        assert out._jdf.queryExecution().analyzed().toString().count("ResolvedHint") == 1 + used  # one is the mapping's own
        assert [r.c for r in out.orderBy("id").collect()] == [i % 9 for i in range(50)]


def test_target_candidates_count_only_likely_columns(spark):
    df = spark.range(3000).select(F.col("id"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).alias("more"),
                                  (F.col("id") % 2 == 0).alias("flag"), F.lit(None).cast("string").alias("void"))
    got = {r.column_name: r.nunique for r in P.target_candidates(df).collect()}
    assert got == {"twenty": 20, "flag": 2, "void": 0}
