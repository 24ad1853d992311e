"""Tables in folders by month, read in groups of months between two days."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_of(day: str | Column) -> Column:
    """yyyyMM as a number, the name of a month's folder."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def write_months(df: DataFrame, path: str, day: str = "race_date") -> None:
    """df in folders by month; a month is written by as many tasks as it has shuffle partitions, not by one."""
    df.withColumn("month", month_of(day)).write.partitionBy("month").mode("append").parquet(path)


def read_months(spark: SparkSession, path: str, months: Sequence[int] | None = None, first: date | None = None, last: date | None = None, day: str = "race_date") -> DataFrame:
    """Rows of the months and of the days from first to last: months prune folders, days are pushed to the files."""
    df = spark.read.parquet(path)
    if months is not None:
        df = df.where(F.col("month").isin(list(months)))
    if first is not None:
        df = df.where((F.col("month") >= first.year * 100 + first.month) & (F.col(day) >= F.lit(first)))
    if last is not None:
        df = df.where((F.col("month") <= last.year * 100 + last.month) & (F.col(day) <= F.lit(last)))
    return df


def month_groups(spark: SparkSession, path: str, size: int = 1, first: date | None = None, last: date | None = None) -> list[list[int]]:
    """The months that have files, in groups of `size` in order of time; only the names of folders and no column is read."""
    if size < 1:
        raise ValueError("a group has at least one month")
    months = spark.read.parquet(path).select("month").distinct()
    if first is not None:
        months = months.where(F.col("month") >= first.year * 100 + first.month)
    if last is not None:
        months = months.where(F.col("month") <= last.year * 100 + last.month)
    found = sorted(r["month"] for r in months.collect())  # a calendar
    return [found[i : i + size] for i in range(0, len(found), size)]
