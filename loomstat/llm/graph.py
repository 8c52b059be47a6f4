"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); component is the smallest node reachable.

    Large-star and small-star rounds until every component is a star around its smallest node.  A round is two
    aggregations (with map-side partial minima) and two equi-joins, whose hot
    keys adaptive execution can split; every round is written out.
    """
    e = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
                    .distinct(), "links")
    while True:
        both = e.unionByName(e.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").filter("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v")
        e = materialize(small.filter("m > low").select(F.col("m").alias("v"), F.col("low").alias("m"))
                        .unionByName(low.withColumnRenamed("low", "m")).distinct(), "links")
        links_left, nodes = e.agg(F.count("*"), F.count_distinct("v")).first()
        if links_left == nodes and e.join(e.select(F.col("m").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = e.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct()
    return e.select(F.col("v").alias("node"), F.col("m").alias("component")).unionByName(roots)
