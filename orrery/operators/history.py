"""History of changing entity attributes: the type-two merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.times import OPEN_END_US
from orrery.operators.hot import LEAST, SHARE, neighbours, split_hot


def loose(text: Column) -> Column:
    """A text for comparison: case and blanks don't count, and an empty text is NULL."""
    return F.nullif(F.lower(F.regexp_replace(text, r"\s+", "")), F.lit(""))


def attribute_hash(columns: list[Column]) -> Column:
    """One 64-character hash of several values in which NULL differs from every text."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("~")) for c in columns]), 256)


def merge_history(incoming: DataFrame, *, key: str, at: str, tracked: list[str], hashed: list[Column] | None = None, tie: list[str] | None = None, current: DataFrame | None = None, repeats: bool = False, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The whole history after ``incoming`` was merged: (key, tracked columns, valid_from_us, valid_to_us, is_current).

    ``incoming`` holds snapshots or updates: the key, the BIGINT instant ``at`` from which its values hold and the tracked
    attributes. Rows with NULL key or instant are left out. Of rows with the same key and instant the one with the largest
    ``tie`` columns counts, then the largest attribute hash. ``current`` is a history of this function's form, to which
    the rows are added, late ones included: what it holds is changed only where a version is split or cut short.

    With ``repeats`` rows that confirm a version come out too, as empty intervals with ``is_version`` false. A history that keeps them and takes loads one after the other gives the versions that
    all loads at once give, whatever came late: a value that held again after a late change is a version then. Drop them (``is_version``) to read it.

    Attribute hashes (``hashed`` expressions, by default of the tracked columns) are compared along each key's instants; a row
    that differs from the version before it closes that version and opens a new one, a row that doesn't is dropped.
    Intervals are half-open; the last ends 9999-12-31. Hot keys are cut into pieces (see ``hot``).
    """
    digest = attribute_hash(hashed or [F.col(c) for c in tracked])
    tie = tie or []
    rows = incoming.select(key, F.col(at).alias("valid_from_us"), F.lit(1).alias("__new"), F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)], digest.alias("digest"), *tracked).alias("v"))
    if current is not None:
        ties = [F.lit(None).cast(incoming.schema[c].dataType).alias(f"t{i}") for i, c in enumerate(tie)]
        rows = rows.unionByName(current.select(key, "valid_from_us", F.lit(0).alias("__new"), F.struct(*ties, digest.alias("digest"), *tracked).alias("v")))
    rows = rows.filter(F.col(key).isNotNull() & F.col("valid_from_us").isNotNull())
    counted = incoming.select(key) if current is None else incoming.select(key).unionByName(current.select(key))
    split = split_hot(rows, [key], "valid_from_us", share, least, counted)
    # one shuffle: one row per instant, the comparison and the closing all run on the partitions of the key
    once = split.df.repartition(*split.parts).groupBy(*split.parts, "valid_from_us").agg(F.max(F.struct("__new", "v")).alias("m")).select(*split.parts, "valid_from_us", F.col("m.v").alias("v"), F.col("m.v.digest").alias("digest"))
    compared = neighbours(once, split, ["valid_from_us"], lag={"__before": "digest"})
    opens = F.col("__before").isNull() | (F.col("__before") != F.col("digest"))
    changed = compared.filter(opens).drop("__before")
    closed = neighbours(changed, split, ["valid_from_us"], lead={"__next": "valid_from_us"})
    values = [F.col(f"v.{c}").alias(c) for c in tracked]
    versions = closed.select(key, *values, "valid_from_us", F.coalesce("__next", F.lit(OPEN_END_US).cast("bigint")).alias("valid_to_us"), F.col("__next").isNull().alias("is_current"))
    if not repeats:
        return versions
    confirmed = compared.filter(~opens).select(key, *values, "valid_from_us", F.col("valid_from_us").alias("valid_to_us"), F.lit(False).alias("is_current"), F.lit(False).alias("is_version"))
    return versions.withColumn("is_version", F.lit(True)).unionByName(confirmed)
