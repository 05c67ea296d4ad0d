"""The deployment rule on streams: an extension, as the evaluation itself is batch work.

A stream of scored rows meets a static table of thresholds by predicted class; what is over its threshold is flagged and
counted by event-time window, with a watermark for late rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Events from Parquet files that arrive in a folder: ts, frame_id, predclass, score."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return raw.select("ts", F.col("user_id").alias("frame_id"), F.floor(F.hour("ts") / 4.0).cast("int").alias("predclass"), F.col("value").alias("score"))


def flag_stream(rows: DataFrame, thresholds: DataFrame, fallback: float, cls: str = "predclass", score: str = "score") -> DataFrame:
    """rows with flag: strictly over the class's threshold, or over the fallback where the class has none."""
    out = rows.join(F.broadcast(thresholds.select(cls, "tau")), cls, "left")
    return out.withColumn("flag", F.col(score) > F.coalesce("tau", F.lit(float(fallback)))).drop("tau")


def counts(flagged: DataFrame, window: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows and flags by window; rows later than the watermark are left out."""
    return flagged.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), F.count_if("flag").alias("flagged"))


def start(counted: DataFrame, sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    out = counted.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if available_now else out).start()
