"""Pipeline stages of our own that save and load like MLlib's.

``TextCodes`` codes text features by a distributed mapping (value -> position in alphabetical order): the mapping
is a table, joined at scoring, so no label list is held on the driver however many values a column has.
"""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.functions.exprs import text_of
from loomstat.operators.clean import BROADCAST_MAX_BYTES, label_mapping, mapping_bytes
from loomstat.session import cut_lineage


class StoredWriter(MLWriter):
    """Writes a stage as its metadata and whatever its ``_store(spark, path)`` adds."""

    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage._store(self.sparkSession, path)


class StoredReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind._restore(self.sparkSession, path)
        stage._resetUid(meta["uid"])
        return stage


class Stored(MLWritable, MLReadable):
    """A stage that keeps its state through ``_store`` and ``_restore``."""

    def write(self) -> MLWriter:
        return StoredWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return StoredReader(cls)


def store_json(spark: SparkSession, path: str, name: str, value: dict) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.parquet(f"{path}/{name}")


def load_json(spark: SparkSession, path: str, name: str) -> dict:
    return json.loads(spark.read.parquet(f"{path}/{name}").first()["value"])


class TextCodesModel(Model, Stored):
    """Adds ``out`` columns: the code of each ``columns`` value; a value not seen in the fit gets the next code."""

    def __init__(self, columns: list[str], out: list[str], mapping: DataFrame, sizes: list[int]):
        super().__init__()
        self.columns, self.out, self.mapping, self.sizes = columns, out, mapping, sizes
        self._small: dict[str, bool] = {}

    def _own(self, column: str, size: int) -> DataFrame:
        """The mapping of a column, broadcast if it is small in bytes: a join on a few values would move all rows to a few tasks."""
        own = self.mapping.where(F.col("column") == column)
        if column not in self._small:
            self._small[column] = size * 48 <= BROADCAST_MAX_BYTES and mapping_bytes(own) <= BROADCAST_MAX_BYTES
        return F.broadcast(own) if self._small[column] else own

    def _transform(self, dataset: DataFrame) -> DataFrame:
        for c, o, n in zip(self.columns, self.out, self.sizes):
            own = self._own(c, n).select(F.col("value").alias("__v"), F.col("code").alias(o))
            dataset = dataset.withColumn("__v", text_of(c)).join(own, "__v", "left").drop("__v")
            dataset = dataset.withColumn(o, F.coalesce(F.col(o), F.lit(n)).cast("double"))
        return dataset

    def _store(self, spark: SparkSession, path: str) -> None:
        store_json(spark, path, "state", {"columns": self.columns, "out": self.out, "sizes": self.sizes})
        self.mapping.write.parquet(f"{path}/mapping")

    @classmethod
    def _restore(cls, spark: SparkSession, path: str) -> TextCodesModel:
        state = load_json(spark, path, "state")
        return cls(state["columns"], state["out"], spark.read.parquet(f"{path}/mapping"), state["sizes"])


class TextCodes(Estimator):
    """Codes of text columns (null reads ``nan``), in alphabetical order of the distinct values."""

    def __init__(self, columns: list[str], out: list[str]):
        super().__init__()
        self.columns, self.out = columns, out

    def _fit(self, dataset: DataFrame) -> TextCodesModel:
        mapping, sizes = None, []
        for c in self.columns:
            m, n = label_mapping(dataset, c)
            sizes.append(n)
            m = m.select(F.lit(c).alias("column"), "value", "code")
            mapping = m if mapping is None else mapping.unionByName(m)
        return TextCodesModel(self.columns, self.out, cut_lineage(mapping), sizes)
