"""Spark session with the settings that the operators rely on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Maps merge like dictionaries (the last value wins), times are UTC, Python gets Arrow batches, page sources see filters.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def session(name: str = "foliospark", **settings: str) -> SparkSession:
    """A session with the settings of the operators, and this package on its workers."""
    spark = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()
    ship_package(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Applies the settings to a session that exists already, and ships this package to its workers."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, "_foliospark_shipped", False):
        return
    root = Path(__file__).parent
    fd, archive = tempfile.mkstemp(suffix=".zip", prefix="foliospark-")
    os.close(fd)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(archive)
    context._foliospark_shipped = True
