"""The folder that driver and executors share, and tables written there so that what follows reads them once written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a table of records that one task sorts in memory, also where their contests are expanded to tickets.
ROWS_A_TASK = 1 << 18


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder in spark.checkpoint.dir, or a local one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: steps that read it again don't compute it again, and lost executors cost nothing of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df shuffled by the keys where the session's partitions would hold more than ROWS_A_TASK of its rows: sorts then stay in memory at any size. Smaller tables stay as they are."""
    parts = -(-rows // ROWS_A_TASK)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df shuffled by the keys once for all that follows: in as many parts as `spread` makes, else in the session's."""
    out = spread(df, rows, *keys)
    return df.repartition(*keys) if out is df else out
