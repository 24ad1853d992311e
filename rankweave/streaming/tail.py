"""Streams run to the end of what is there, and windows that a watermark closes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_to_end(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that is available now, written as Parquet and read back."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(path)


def daily_windows(events: DataFrame, time: str, kind: str, value: str, late: str = "2 hours") -> DataFrame:
    """Counts and sums by day and kind; rows later than `late` are left out of closed windows."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("day"), kind, "n", "total")
