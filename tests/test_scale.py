"""Steps that must stay even however few values a column has or however many rows a table has."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from loomstat.operators import svm as SV
from loomstat.operators import train as TR
from loomstat.operators.split import hash_order, split_dataset
from loomstat.operators.stages import TextCodes


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_codes_of_a_few_values_move_no_rows(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("v"), F.col("id") % 3)).alias("t"))
    out = TextCodes(["t"], ["c"]).fit(df).transform(df)
    assert "BroadcastHashJoin" in plan_of(out) and "SortMergeJoin" not in plan_of(out)
    assert {(r.t, r.c) for r in out.collect()} == {(None, 0.0), ("v1", 1.0), ("v2", 2.0)} and out.count() == 300


def test_split_ranks_the_rows_at_its_cut_only(spark):
    rows = [(i if i % 10 else None, "ab"[i % 2] if i % 7 else None) for i in range(700)] * 2
    df = spark.createDataFrame(rows, "k int, g string")
    for by in (None, "g"):
        out = split_dataset(df, "k", 0.3, 5, by)
        assert out.columns == ["k", "g", "split"] and out.count() == len(rows)
        assert out.where("split = 'test'").count() == math.ceil(0.3 * len(rows))
        assert "_rb" not in plan_of(out)  # no range buckets of all rows
        # Rows before the cut are test rows, those behind it are not.
        kept = out.withColumn("h", hash_order("k", 5)).groupBy(*[by] if by else [], "split").agg(F.min("h").alias("a"), F.max("h").alias("b")).collect()
        for r in (r for r in kept if r.split == "test"):
            assert all(r.b <= o.a for o in kept if o.split == "train" and (by is None or o[by] == r[by]))


def test_stored_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(TR, "PART_ROWS", 10)
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("x"), F.lit(1.0).alias("y"))
    both, train, test = TR._split(TR.prepare(df, "y", "regression", "id", 42), 0.2)
    sizes = [r["count"] for r in both.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 20 and sum(sizes) == 400 and test.count() == 80
    both.unpersist()


def test_svm_stores_the_raw_features_only(spark, monkeypatch):
    seen = {}

    def machines(rows, k, dim, C, folds=0, lift=None):
        seen["stored"] = max(len(r["z"]) for r in rows.select("z").collect())
        seen["lifted"] = lift(np.zeros((1, 2))).shape[1]
        return np.zeros((folds + 1, k, dim + 1))
    monkeypatch.setattr(SV, "fit_machines", machines)
    rows = [(float(i % 17), float(i % 13), float(i % 2)) for i in range(120)]
    df = spark.createDataFrame(rows, "a double, b double, label double").select(array_to_vector(F.array("a", "b")).alias("features"), "label")
    SV.NystroemSvmClassifier().fit(df)
    assert seen["stored"] == 2 and seen["lifted"] > 2
