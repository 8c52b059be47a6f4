"""Physical plan shape: pushdown, pruning, no cartesian / nested-loop joins."""

from pyspark.sql import functions as F

from loomstat.operators import filters as FL
from loomstat.operators import joins as J
from loomstat.operators.knn import knn_join
from loomstat.sources.tables import load_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_string_filter_is_pushed_down(spark, sf):
    part = load_table(spark, sf, "part")
    plan = _plan(FL.filter_rows(part, "p_brand", "eq", "Brand#13"))
    assert "PushedFilters: [IsNotNull(p_brand), EqualTo(p_brand,Brand#13)]" in plan
    plan = _plan(FL.filter_rows(part, "p_retailprice", "gt", 1500))
    assert "GreaterThan(p_retailprice,1500.0)" in plan


def test_projection_is_pruned(spark, sf):
    li = load_table(spark, sf, "lineitem")
    plan = _plan(li.select("l_quantity").where(F.col("l_quantity") > 10).agg(F.avg("l_quantity")))
    assert "ReadSchema: struct<l_quantity:double>" in plan


def test_joins_are_equi_joins(spark, sf):
    o = load_table(spark, sf, "orders").withColumnRenamed("o_custkey", "ck")
    c = load_table(spark, sf, "customer").withColumnRenamed("c_custkey", "ck")
    plan = _plan(J.merge(o, c, "ck", "outer"))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_knn_join_has_no_cartesian_product(spark, sf):
    emb = load_table(spark, sf, "embeddings").select(
        F.col("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    nb = knn_join(emb.withColumnRenamed("vec_id", "qid"), emb.withColumnRenamed("vec_id", "rid"), 3)
    plan = _plan(nb)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert nb.count() == 3 * emb.count()
