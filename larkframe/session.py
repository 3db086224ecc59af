"""The Spark session of the engine."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any size. Partition counts, memory and cores belong to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    # Nanosecond timestamps load as whole numbers; Spark has no type for them.
    "spark.sql.legacy.parquet.nanosAsLong": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(name: str = "larkframe", master: str | None = None, **settings: str) -> SparkSession:
    """The running session or a new one; `master` defaults to all local cores where none is set outside."""
    builder = SparkSession.builder.appName(name)
    if master or not (os.environ.get("SPARK_MASTER") or os.environ.get("MASTER")):
        builder = builder.master(master or "local[*]")
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
