"""Sinks and versioned datasets.

A versioned dataset is a folder of ``version=<UTC timestamp>`` sub-folders,
one per write; the newest version is the current table.  Every overwrite
therefore keeps the previous data (the reference snapshots a file before
overwriting it), listing is a partition scan, and restoring copies an old
version forward as the newest one.  Never write to a path being read.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "version"


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def _stamp() -> str:
    return _dt.datetime.now(_dt.timezone.utc).strftime("%Y%m%dT%H%M%S%fZ")


def write_version(df: DataFrame, root: str, stamp: str | None = None) -> str:
    """Write ``df`` as a new version under ``root``; returns the version stamp."""
    stamp = stamp or _stamp()
    df.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{VERSION}={stamp}")
    return stamp


def list_versions(spark: SparkSession, root: str) -> DataFrame:
    """``(version, rows)`` newest first."""
    t = spark.read.option("basePath", root).parquet(root)
    return t.groupBy(F.col(VERSION).cast("string").alias(VERSION)).agg(F.count(F.lit(1)).alias("rows")) \
            .orderBy(F.desc(VERSION))


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The newest version, or the newest whose stamp contains ``version``."""
    cand = (spark.read.option("basePath", root).option("spark.sql.sources.partitionColumnTypeInference.enabled", False)
            .parquet(root).select(F.col(VERSION).cast("string").alias(VERSION)).distinct())
    if version:
        cand = cand.where(F.col(VERSION).contains(version))
    pick = cand.orderBy(F.desc(VERSION)).limit(1).collect()
    if not pick:
        raise ValueError(f"no version matches '{version}'")
    # That folder alone: versions may differ in their columns.
    return spark.read.parquet(f"{root.rstrip('/')}/{VERSION}={pick[0][0]}")


def restore_version(spark: SparkSession, root: str, version: str) -> str:
    """Copy the matching version forward as the newest one; returns the new stamp."""
    return write_version(read_version(spark, root, version), root)
