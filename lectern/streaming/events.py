"""Streams: event-time windows with late data, sessions, deduplication, and incremental batches.

These are additions for archives that grow all the time; each has a batch query with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    window = F.window("ts", width).alias("w")
    return events.withWatermark("ts", late).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")).select(F.col("w.start").alias("begins"), "event_type", "events", "total")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("begins"), "events")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("begins"), "events")


def once(events: DataFrame, key: str = "event_id", late: str = "1 day") -> DataFrame:
    """Events without repeats that come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Handles all that is there and ends; a later run goes on behind it."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def append_once(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that a repeated micro-batch overwrites with the same rows."""
    return lambda rows, epoch: rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
