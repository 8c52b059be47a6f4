"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.session import ensure_checkpoint_dir

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Bytes of the Arrow batches that executors pass to Python: texts are long, and a batch is held several times over.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder.  Arrow batches of the session are bounded to ``BATCH_BYTES`` (a smaller setting stays)."""
    size, unit = re.fullmatch(r"(-?\d+)\s*([kmg]?)b?", spark.conf.get(_BATCH_SETTING).lower()).groups()
    now = int(size) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(c, _UPPER, _UPPER.lower())


#: Names this process's folder below the checkpoint folder.
RUN = uuid.uuid4().hex


def run_folder(spark: SparkSession) -> str:
    """The folder of all intermediate tables of this process, below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/loomstat-{RUN}"


def fresh_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in the run's folder."""
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def remove_run(spark: SparkSession) -> None:
    """Delete the run's folder.  Results of operators are lazy and read from it: call this when they are written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage: a lost executor re-reads the files.  The schema is passed on,
    so an empty frame comes back with its columns.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect a table whose size the caller documents; more rows are an error, never a cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the documented bound or split the table")
    return rows


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
