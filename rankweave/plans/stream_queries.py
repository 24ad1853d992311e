"""Queries that run a stream over a table to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.core.shared import shared_folder
from rankweave.operators.history import Feature
from rankweave.plans.registry import query
from rankweave.streaming import tail
from rankweave.streaming.incremental import Build, Family


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events.parquet*")


@query("""
SELECT user_id, event_id, round(CASE WHEN count(value) OVER w >= 2 THEN avg(value) OVER w END, 9) AS prior_mean, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS prior_count
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)
""")
def stateful_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of a user's five events before and their number, from tails that are carried from one trigger to the next."""
    folder = shared_folder(spark)
    build = Build(spark, f"{folder}/build", [Family(("user_id",), (Feature("prior_mean", "value", 5, 2),))], ["ts", "event_id"], counted="prior_count")
    build.follow(event_stream(spark, sf_dir), f"{folder}/checkpoint").awaitTermination()
    return build.rows().select("user_id", "event_id", F.round("prior_mean", 9).alias("prior_mean"), "prior_count")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY CAST(ts AS DATE), event_type")
def daily_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums by day and type, as far as the watermark has closed the days."""
    folder = shared_folder(spark)
    # the table's times have no zone: they are read as UTC, whatever the session's zone is
    events = event_stream(spark, sf_dir).withColumn("ts", F.expr("timestamp_micros(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts))"))
    found = tail.run_to_end(tail.daily_windows(events, "ts", "event_type", "value"), f"{folder}/out", f"{folder}/state")
    return found.select(F.expr("date_from_unix_date(cast(floor(unix_seconds(day) / 86400) as int))").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))
