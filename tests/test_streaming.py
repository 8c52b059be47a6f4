"""Structured Streaming: scoring a file stream with a fitted pipeline, windowed
prediction counts with a watermark, and the idempotent foreachBatch sink."""

import uuid

from pyspark.sql import functions as F

from loomstat.operators import train as TR
from loomstat.session import ensure_checkpoint_dir
from loomstat.sources.tables import load_table
from loomstat.streaming.scoring import prediction_counts, score_stream, write_batches


def test_stream_scoring_counts_and_sink(spark, sf):
    ev = load_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    r = TR.train_model(ev.drop("props", "ts"), "event_type", "nb", key="event_id")
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = ev.drop("event_type", "props")
    src.repartition(3).write.parquet(f"{base}/src")
    stream = spark.readStream.schema(src.schema).parquet(f"{base}/src")
    scored = score_stream(r.model, stream, ["event_id", "ts"])

    name = "s_" + uuid.uuid4().hex[:8]
    q = scored.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{base}/ck1").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table(name).count() == src.count()

    counts = prediction_counts(scored, "ts", "1 day", "1 hour")
    name2 = "c_" + uuid.uuid4().hex[:8]
    q2 = counts.writeStream.format("memory").outputMode("update").queryName(name2) \
        .option("checkpointLocation", f"{base}/ck2").start()
    q2.processAllAvailable()
    q2.stop()
    assert spark.table(name2).agg(F.sum("cnt")).first()[0] >= 1

    q3 = write_batches(scored, f"{base}/out", f"{base}/ck3")
    q3.processAllAvailable()
    q3.stop()
    assert spark.read.parquet(f"{base}/out").count() == src.count()
