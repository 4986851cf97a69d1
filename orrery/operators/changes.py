"""Applying a stream of inserts, updates and deletes as a signed multiset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.hot import LEAST, SHARE, neighbours, split_hot


def apply_changes(feed: DataFrame, *, key: str, order: list[str], deleted: str, image: list[str], base: DataFrame | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """The rows that exist after all changes: (key, image columns).

    ``feed`` has one row per change: ``key``, the ``order`` columns in which changes truly happened (the first a BIGINT; NULL is
    before all), the BOOLEAN ``deleted`` and the ``image`` columns after the change. ``base`` (key, image) is the
    table before the feed, each key once; its rows count as changes before all others.

    Repeated changes (equal key and order) count once; should their images differ, the largest counts. Every
    change adds its after-image with multiplicity +1 (a delete adds none) and its before-image, the after-image of the change
    before it in true order, with -1. Multiplicities are summed per image and rows with a positive sum remain. An
    update of a missing row creates it, a delete of a missing row does nothing. Rows with a NULL key are left out.

    One shuffle: deduplication, order and sum all run on the partitions of the key. Keys that hold a large
    share of the feed are cut into consecutive pieces first, whose sums are added up.
    """
    after = F.when(~F.col(deleted), F.struct(*image))
    first_order = F.coalesce(F.col(order[0]), F.lit(1 - 2**63).cast("bigint")).alias(order[0])
    rows = feed.filter(F.col(key).isNotNull()).select(key, first_order, *order[1:], after.alias("after"), F.lit(1).alias("later"))
    if base is not None:
        first = [F.lit(None).cast(feed.schema[c].dataType).alias(c) for c in order[1:]]
        start = base.filter(F.col(key).isNotNull()).select(key, F.lit(-(2**63)).cast("bigint").alias(order[0]), *first, F.struct(*image).alias("after"), F.lit(0).alias("later"))
        rows = rows.unionByName(start)
    ranks = ["later", *order]
    split = split_hot(rows, [key], order[0], share, least)
    once = split.df.repartition(*split.parts).groupBy(*split.parts, *ranks).agg(F.max("after").alias("after"))
    chained = neighbours(once, split, [order[0], "later", *order[1:]], lag={"before": "after"})
    signed = chained.select(*split.parts, F.explode(F.array(F.struct(F.col("after").alias("row"), F.lit(1).alias("n")), F.struct(F.col("before").alias("row"), F.lit(-1).alias("n")))).alias("x")).filter("x.row IS NOT NULL")
    summed = signed.groupBy(*split.parts, F.col("x.row").alias("row")).agg(F.sum("x.n").alias("n")).filter("n <> 0")
    if split.hot:
        summed = summed.groupBy(key, "row").agg(F.sum("n").alias("n"))
    return summed.filter("n > 0").select(key, "row.*")
