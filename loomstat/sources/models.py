"""Saving and loading fitted pipelines with a metadata row beside them."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def save_model(spark: SparkSession, model: PipelineModel, path: str, metadata: dict) -> None:
    """``{path}/model`` (MLlib format) and ``{path}/metadata`` (one Parquet row of JSON)."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(metadata, default=str),)], "metadata string") \
         .write.mode("overwrite").parquet(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    model = PipelineModel.load(f"{path}/model")
    meta = json.loads(spark.read.parquet(f"{path}/metadata").first()["metadata"])
    return model, meta
