"""Session factory with the settings the engine is designed around."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that hold at any scale. Adaptive execution joins small shuffle partitions and splits skewed join partitions at run time, but
#: never makes more partitions than a shuffle starts with: on a cluster that number is the cluster's (``spark.sql.shuffle.partitions``, a few per core), on one machine one per core.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(master: str | None = None, app: str = "orrery", **extra: str) -> SparkSession:
    """A session with the engine's settings; ``extra`` settings override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = SETTINGS | {
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("ORRERY_DRIVER_MEMORY", "8g"),
    }
    if partitions := os.environ.get("ORRERY_SHUFFLE_PARTITIONS") or ("8" if master and master.startswith("local") else None):
        settings["spark.sql.shuffle.partitions"] = partitions
    return builder.config(map=settings | extra).getOrCreate()
