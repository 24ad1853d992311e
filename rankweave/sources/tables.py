"""Scans, sinks and the calendar of what is there and what is missing."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_between(spark: SparkSession, path: str, start: date, end: date, columns: Sequence[str] | None = None, day: str = "race_date") -> DataFrame:
    """Rows of a period; the bounds and the columns reach the scan."""
    df = spark.read.parquet(path).where(F.col(day).between(F.lit(start), F.lit(end)))
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet by its suffix, else CSV with a header; columns by the schema."""
    if path.rstrip("/").endswith(".parquet"):
        return conform(spark.read.parquet(path), schema)
    return spark.read.schema(schema).option("header", True).csv(path)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in order, cast; columns that df lacks are typed nulls."""
    have = set(df.columns)
    return df.select([(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append(df: DataFrame, path: str, schema: T.StructType, month_of: str | None = None) -> None:
    """Add rows with exactly this schema, in folders by month if a day column is named."""
    out = conform(df, schema)
    if month_of:
        out = out.withColumn("month", F.date_format(month_of, "yyyyMM"))
        out.write.mode("append").partitionBy("month").parquet(path)
    else:
        out.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_metrics(long_metrics: DataFrame, path: str) -> None:
    long_metrics.write.mode("overwrite").json(path)


def calendar(spark: SparkSession, start: date, end: date, kinds: Sequence[str]) -> DataFrame:
    """(day, kind) of a period."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("day"))
    return days.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def calendar_over(df: DataFrame, kinds: Sequence[str], day: str = "race_date") -> DataFrame:
    """(day, kind) from the first to the last day of df; nothing if df has no day."""
    days = df.agg(F.min(day).alias("first"), F.max(day).alias("last")).select(F.explode(F.sequence("first", "last")).alias("day"))
    return days.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))


def gaps(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """What of the calendar isn't there."""
    return wanted.join(present.select("day", "kind").distinct(), ["day", "kind"], "left_anti")


def gap_report(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """(status, n): present or missing."""
    marked = wanted.join(present.select("day", "kind").distinct().withColumn("there", F.lit(True)), ["day", "kind"], "left")
    return marked.groupBy(F.when(F.col("there"), "present").otherwise("missing").alias("status")).agg(F.count("*").alias("n"))


def gap_states(wanted: DataFrame, complete: DataFrame, seen: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(status, n): present where a complete one is there, skipped where only something else was seen, else missing."""
    keys = list(keys)
    marked = wanted.join(complete.select(*keys).distinct().withColumn("complete", F.lit(True)), keys, "left").join(seen.select(*keys).distinct().withColumn("seen", F.lit(True)), keys, "left")
    return marked.groupBy(F.when(F.col("complete"), "present").when(F.col("seen"), "skipped").otherwise("missing").alias("status")).agg(F.count("*").alias("n"))


def latest_common_day(present: DataFrame, a: str, b: str) -> DataFrame:
    """The last day that has both kinds."""
    of = lambda kind: present.where(F.col("kind") == kind).select("day")
    return of(a).intersect(of(b)).agg(F.max("day").alias("day"))


def unique_or_raise(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, if no key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").head(1)
    if twice:
        raise ValueError(f"{', '.join(keys)} must be unique, but {twice[0]} is not")
    return df


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of two tables that both have each key at most once."""
    return unique_or_raise(left, keys).join(unique_or_raise(right, keys), list(keys))


def join_many_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of a table with one that has each key at most once."""
    return left.join(unique_or_raise(right, keys), list(keys), "left")


def named_by_code(df: DataFrame, dimension: DataFrame, code: str, out: str) -> DataFrame:
    """df with the name of each code of a dimension (code, name); an unknown code is its own name."""
    return df.join(dimension.select(F.col("code").alias(code), F.col("name").alias(out)), code, "left").withColumn(out, F.coalesce(out, code))


def coded_by_name(df: DataFrame, dimension: DataFrame, name: str, out: str) -> DataFrame:
    """df with the code of each name; an unknown name is an error where the row is read."""
    known = df.join(dimension.select(F.col("name").alias(name), F.col("code").alias(out)), name, "left")
    return known.withColumn(out, F.when(F.col(out).isNull() & F.col(name).isNotNull(), F.raise_error(F.concat(F.lit("unknown name "), F.col(name)))).otherwise(F.col(out)))


def write_together(frames: Mapping[str, DataFrame], path: str) -> str:
    """Write several tables under a new version of the folder and name it in a marker file last.

    Readers follow the marker, so they see all tables of one version or none;
    a write that fails half-way leaves the version before in place.
    """
    version = uuid.uuid4().hex
    for name, df in frames.items():
        df.write.parquet(f"{path}/{version}/{name}")
    any_ = next(iter(frames.values())).sparkSession
    any_.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def read_latest(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the version that was marked last."""
    marked = spark.read.parquet(f"{path}/versions").select("version", F.col("_metadata.file_modification_time").alias("t"))
    return spark.read.parquet(f"{path}/{marked.agg(F.max_by('version', 't')).head()[0]}/{name}")
