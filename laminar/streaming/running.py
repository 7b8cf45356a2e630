"""The corpus's running reports as Structured Streaming queries over an append-only event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New files of a folder as they come, one a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def windowed(events: DataFrame, window: str = "1 hour", late: str = "2 hours", time: str = "ts", kind: str = "event_type", value: str = "value") -> DataFrame:
    """Count, sum and largest value per window and kind; rows later than the watermark are left out. Batch tables work too."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.window(time, window).alias("w"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("largest"))
    return out.select(F.col("w.start").alias("window_start"), kind, "n", "total", "largest")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", by: str = "user_id") -> DataFrame:
    """Runs of events without a gap, by user."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def run_once(frame: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Takes what is new into a Parquet folder and stops; a second call goes on where the first ended."""
    frame.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
