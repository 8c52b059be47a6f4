"""Session helpers.

Library code never creates its own cluster settings: it reads what the
session already has.  ``get_session`` exists for tests, the bench and the
driver entry point, where no session is configured yet.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings used when *we* create the session (tests, bench). On a cluster the
# session comes from the submitter and these are not applied.
_LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "loomstat") -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app_name)
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  Only when it is unset and the master is this one process (local
    tests) do we pick a scratch folder: executors could not share one elsewhere.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError(f"spark.checkpoint.dir is not set: a cluster ({sc.master}) needs a folder all executors share")
    local = tempfile.mkdtemp(prefix="loomstat-ckpt-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint folder).

    Used by iterative algorithms so a lost executor re-reads the last
    iteration instead of recomputing the whole loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def rewritten(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet next to the checkpoints and read again, for tables that a loop joins with themselves.

    A checkpoint keeps the size that was estimated for its plan.  That of a join is the product of both sides, so over some
    twenty rounds it becomes a number of millions of digits, which takes the driver longer than the rounds themselves; files
    have the size that they have."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/rewritten-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of the largest table that ``sized`` sends to every task.
FEW_ROWS = 100_000


def sized(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join: broadcast if it has at most ``FEW_ROWS`` rows, else never.

    Left alone, Spark decides by compressed bytes.  Keys in order compress to a tenth and less, so tables of a row per input row
    would be collected by the driver."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df.hint("merge")
