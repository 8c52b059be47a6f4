"""Scoring a stream with a fitted pipeline.

Fitted pipelines are stateless row transforms, so a ``readStream`` frame is
scored exactly like a table; results go to any sink (``foreachBatch`` lets each
micro-batch be written idempotently by batch id).  Per-batch class counts of
the predictions are a windowed aggregate with a watermark.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_stream(model: PipelineModel, stream: DataFrame, keep: list[str]) -> DataFrame:
    out = model.transform(stream)
    return out.select(*keep, "prediction", *[c for c in ("predicted_label",) if c in out.columns])


def prediction_counts(scored: DataFrame, ts: str, window: str = "1 hour", watermark: str = "1 hour") -> DataFrame:
    """Predictions per event-time window (append mode once the watermark passes)."""
    return scored.withWatermark(ts, watermark).groupBy(F.window(ts, window), "prediction") \
                 .agg(F.count(F.lit(1)).alias("cnt"))


def write_batches(scored: DataFrame, path: str, checkpoint: str):
    """Append each micro-batch to Parquet under ``path/batch_id=<id>`` (re-runs overwrite the same batch)."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return scored.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
