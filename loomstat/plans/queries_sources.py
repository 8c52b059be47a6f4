"""Registered source / sink / versioning / streaming queries.

File inputs are written first from the given tables (so the work grows with
them) into a fresh folder under the session's checkpoint directory — the
shared folder on a cluster.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomstat.plans.catalog import T, register
from loomstat.plans.queries_profile import CUSTOMER_N_SQL, customer_n
from loomstat.session import ensure_checkpoint_dir
from loomstat.sources import csv as CSV
from loomstat.sources import sinks as SK
from loomstat.sources.slice import read_rows


def scratch(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/loomstat-scratch/{name}-{uuid.uuid4().hex}"


CN_CAST = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _typed(df):
    return df.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), F.col("c_name").cast("string"),
                     F.col("c_nationkey").cast("int").alias("c_nationkey"),
                     F.col("c_acctbal").cast("double").alias("c_acctbal"), F.col("c_mktsegment").cast("string"))


@register("src_parquet",
          "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice * "
          "(1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _q_parquet(spark, sf):
    li = T(spark, sf, "lineitem")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.count(F.lit(1)).alias("n"))


@register("src_csv", f"SELECT * FROM {CUSTOMER_N_SQL}")
def _q_csv(spark, sf):
    path = scratch(spark, "csv")
    # header names padded with spaces: the reader trims them
    customer_n(spark, sf).toDF(*[f" {c} " for c in CN_CAST]).write.option("header", True).csv(path)
    return _typed(CSV.read_csv(spark, path))


@register("src_csv_enc", "SELECT c_custkey, c_name || ' café à ñ' AS label FROM customer")
def _q_csv_enc(spark, sf):
    path = scratch(spark, "csvlatin1")
    c = T(spark, sf, "customer").select("c_custkey", F.concat("c_name", F.lit(" café à ñ")).alias("label"))
    c.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    d = CSV.read_csv(spark, path)  # utf-8 first; U+FFFD found → single-byte fallback
    return d.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "label")


@register("src_csv_bad", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey <> 3")
def _q_csv_bad(spark, sf):
    path = scratch(spark, "csvbad")
    c = T(spark, sf, "customer")
    line = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey")
    line = F.when(F.col("c_nationkey") == 3, F.concat(line, F.lit(",extra"))).otherwise(line)
    # every part file starts with the header, as a folder of CSV files does
    parts = c.select(line.alias("value"), F.spark_partition_id().alias("_p"), F.lit(1).alias("_o"))
    heads = parts.select("_p").distinct().select(F.lit("c_custkey,c_name,c_nationkey").alias("value"), "_p",
                                                 F.lit(0).alias("_o"))
    whole = parts.unionByName(heads).repartition("_p").sortWithinPartitions("_p", "_o")
    whole.select("value", "_p").write.partitionBy("_p").text(path)
    path = f"{path}/*"
    d = CSV.read_csv(spark, path)
    return d.select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
                    F.col("c_nationkey").cast("int").alias("c_nationkey"))


@register("src_csv_max_rows", "SELECT count(*) AS n FROM (SELECT * FROM customer LIMIT 250)")
def _q_csv_max(spark, sf):
    path = scratch(spark, "csvmax")
    T(spark, sf, "customer").write.option("header", True).csv(path)
    return CSV.read_csv(spark, path, max_rows=250).agg(F.count(F.lit(1)).alias("n"))


@register("src_slice",
          "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 200 OFFSET 1000")
def _q_slice(spark, sf):
    o = T(spark, sf, "orders")
    return read_rows(o, "o_orderkey", 1000, 1200).select("o_orderkey", "o_custkey", "o_totalprice")


@register("snk_table", "SELECT * FROM part")
def _q_sink(spark, sf):
    path = scratch(spark, "sink")
    SK.write_table(T(spark, sf, "part"), path)
    return spark.read.parquet(path)


@register("ver_restore", "SELECT * FROM customer")
def _q_ver_restore(spark, sf):
    root = scratch(spark, "versions")
    c = T(spark, sf, "customer")
    SK.write_version(c, root, "20260101T000000000000Z")
    SK.write_version(c.where(F.col("c_nationkey") < 5), root, "20260102T000000000000Z")
    SK.restore_version(spark, root, "20260101")
    return SK.read_version(spark, root)


@register("ver_list",
          "SELECT '20260102T000000000000Z' AS version, count(*) AS rows FROM customer WHERE c_nationkey < 5 "
          "UNION ALL SELECT '20260101T000000000000Z', count(*) FROM customer")
def _q_ver_list(spark, sf):
    root = scratch(spark, "versions")
    c = T(spark, sf, "customer")
    SK.write_version(c, root, "20260101T000000000000Z")
    SK.write_version(c.where(F.col("c_nationkey") < 5), root, "20260102T000000000000Z")
    return SK.list_versions(spark, root)


@register("mdl_save")
def _q_model_save(spark, sf):
    from loomstat.operators import train as TR
    from loomstat.sources.models import load_model, save_model
    o = T(spark, sf, "orders").drop("o_orderdate")
    r = TR.train_model(o, "o_orderstatus", "nb", "classification", key="o_orderkey")
    path = scratch(spark, "model")
    save_model(spark, r.model, path, {"target": "o_orderstatus", **r.metrics})
    m, meta = load_model(spark, path)
    return TR.prediction_distribution(TR.score(m, o.drop("o_orderstatus")))


@register("stream_score")
def _q_stream(spark, sf):
    from loomstat.operators import train as TR
    from loomstat.streaming.scoring import score_stream, write_batches
    o = T(spark, sf, "orders").drop("o_orderdate")
    r = TR.train_model(o, "o_orderstatus", "dtc", "classification", key="o_orderkey")
    src = scratch(spark, "stream-src")
    o.drop("o_orderstatus").repartition(4).write.parquet(src)
    stream = spark.readStream.schema(o.drop("o_orderstatus").schema).parquet(src)
    out = scratch(spark, "stream-out")
    q = write_batches(score_stream(r.model, stream, ["o_orderkey"]), out, scratch(spark, "stream-ck"))
    q.processAllAvailable()
    q.stop()
    return spark.read.parquet(out).groupBy("predicted_label").agg(F.count(F.lit(1)).alias("cnt"))
