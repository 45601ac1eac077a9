"""The running meter (G20) as a Structured Streaming aggregation.

Event-time windows with a watermark keep the state bounded; the stream runs
in update mode and every micro-batch appends its updated rows (tagged with
the batch id) to a parquet folder through ``foreachBatch``.  The current
value of each window is the row from its latest batch (``max_by``).  Both
the sink and the checkpoint live under ``spark.checkpoint.dir``, so a
restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqforge.operators.metrics import exact


def windowed_meter(stream: DataFrame, ts: str, key: str, value: str, window: str = "1 hour",
                   watermark: str = "2 hours", scale: int = 6) -> DataFrame:
    """Streaming ``(window_start, key, total, count)`` per event-time window."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    return (s.groupBy(F.window(ts, window).alias("w"), key)
             .agg(F.sum(exact(F.col(value), scale)).alias("total"), F.count(F.lit(1)).alias("count"))
             .select(F.col("w.start").alias("window_start"), key, "total", "count"))


def run_meter(spark: SparkSession, source_dir: str, pattern: str, out_dir: str, checkpoint: str,
              ts: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour") -> DataFrame:
    """Run the meter over the files available now and return the current
    window values (latest micro-batch wins per window and key)."""
    schema = spark.read.parquet(f"{source_dir}/{pattern}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source_dir)
    meter = windowed_meter(stream, ts, key, value, window)

    def sink(batch: DataFrame, batch_id: int):
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(out_dir)

    q = (meter.writeStream.outputMode("update").foreachBatch(sink)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(out_dir)
    latest = out.groupBy("window_start", key).agg(F.max_by(F.struct("total", "count"), "batch_id").alias("v"))
    return latest.select("window_start", key, F.col("v.total").cast("double").alias("total"),
                         F.col("v.count").alias("count"),
                         (F.col("v.total").cast("double") / F.col("v.count")).alias("average"))
