"""Sends the package to the executors, where it isn't installed on them."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Once for each Spark context; Spark itself hands the archive to every executor, later ones too."""
    context = spark.sparkContext
    if getattr(context, "_rankweave_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "rankweave.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(PACKAGE)))
    context.addPyFile(archive)
    context._rankweave_shipped = True
