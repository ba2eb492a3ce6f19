"""Incremental publication: files that arrive are processed and shown one micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, folder: str, schema: str, per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


def publish(stream: DataFrame, target: str, checkpoint: str, transform=None):
    """Append each micro-batch, transformed, to target; each file once, also across restarts.

    It runs until what has arrived is done (the availableNow trigger); returns the query.
    """
    out = transform(stream) if transform else stream
    return out.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Counts and sums by time window; rows that come later than `late` are left out of closed windows."""
    w = F.window(time, width)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def new_only(candidates: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed build has left to do."""
    return candidates.join(done.select(key).distinct(), key, "left_anti")
