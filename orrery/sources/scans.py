"""Scans: snapshots of any format Spark reads, by table name or path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orrery.sources.versioned import VersionedTable


def scan(spark: SparkSession, name: str, fmt: str = "versioned", options: dict[str, str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A full snapshot. ``versioned`` is this engine's table; other formats go to ``spark.read``, as a path if the name has a slash, else as a table."""
    if fmt == "versioned":
        return VersionedTable(spark, name).snapshot()
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(name) if "/" in name else reader.table(name)


def scan_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """CSV with a given schema: nothing is inferred, a malformed row fails."""
    return spark.read.schema(schema).csv(path, header=header, mode="FAILFAST")


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """No rows of a schema: stands for a source that has nothing new, so that SQL over it still binds."""
    return spark.createDataFrame([], schema)
