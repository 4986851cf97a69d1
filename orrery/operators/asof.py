"""Attributes as known at event time: point-in-time joins over time buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from orrery.operators.hot import LEAST, SHARE, neighbours, split_hot
from orrery.runtime import counted_cut, cut

#: A crowded bucket is split into 2^REFINE finer ones, down to 2^FINEST microseconds.
REFINE, FINEST = 6, 5
#: A bucket in which an entity has more intervals than this is split into finer ones.
DENSE = 64
#: Buckets that one interval is exploded into at once.
_AT_ONCE = 4096


def validity_intervals(changes: DataFrame, entity: str, at: str, share: float = SHARE, least: int = LEAST, *, carry: Sequence[str] = (), tie: Sequence[str] = ()) -> DataFrame:
    """(entity, from_us, to_us, carried columns): half-open validity between successive change instants; the last has to_us NULL.

    Rows with NULL entity or instant are left out; repeated instants count once, of their rows the one with the largest ``tie`` columns, then the largest carried ones.
    """
    image = F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]) if carry else F.lit(1)
    rows = changes.filter(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(F.col(entity).alias("entity"), F.col(at).alias("from_us"), image.alias("image"))
    split = split_hot(rows, ["entity"], "from_us", share, least, changes.select(F.col(entity).alias("entity")))
    instants = split.df.repartition(*split.parts).groupBy(*split.parts, "from_us").agg(F.max("image").alias("image"))  # one shuffle for this and the window
    closed = neighbours(instants, split, ["from_us"], lead={"to_us": "from_us"})
    return closed.select("entity", "from_us", "to_us", *[F.col(f"image.c{i}").alias(c) for i, c in enumerate(carry)])


def _bucket(column: Column, bits: int) -> Column:
    return F.shiftright(column, bits)


def _into_buckets(intervals: DataFrame, bits: int, span: int) -> DataFrame:
    """A row for each bucket an interval (__ij_lo, __ij_hi inclusive) touches, clipped to it.

    An interval as long as ``span`` may touch very many: it is exploded in steps of ever finer buckets, so that no row ever holds a long array.
    """
    steps = [bits]
    while span >> steps[0] > _AT_ONCE:
        steps.insert(0, steps[0] + REFINE)
    for b in steps:
        start = F.shiftleft(F.col("__ij_bucket"), b)
        intervals = (
            intervals.withColumn("__ij_bucket", F.explode(F.sequence(_bucket(F.col("__ij_lo"), b), _bucket(F.col("__ij_hi"), b))))
            .withColumns({"__ij_lo": F.greatest("__ij_lo", start), "__ij_hi": F.least("__ij_hi", start + F.lit((1 << b) - 1))})
        )
    return intervals


def interval_join(events: DataFrame, intervals: DataFrame, *, on: dict[str, str], at: Column, start: Column, end: Column, carry: Sequence[str], how: str = "inner", dense: int = DENSE, moments: DataFrame | None = None) -> DataFrame:
    """Events with the carried columns of the interval of their entity that holds ``at``: ``start`` <= ``at`` < ``end``.

    ``on`` maps event columns to the intervals' columns (equal and not NULL); ``at``, ``start`` and ``end`` are BIGINT; ``end`` NULL is open, ``start`` NULL no interval.
    ``left`` keeps events without an interval, with NULLs. Where intervals of an entity overlap an event has a row for each that holds it. Carried columns replace event columns of their names.

    Intervals are exploded into the time buckets they touch and equi-joined by entity and bucket. Buckets are as wide as the average interval, so the exploded table is about twice the
    intervals. Where an entity has more than ``dense`` intervals in a bucket, that bucket is replaced by 64 finer ones, down to 32 microseconds, so an event meets at most ``dense`` intervals
    that don't overlap, however many versions its entity has. A hot entity's events are dealt by bucket; adaptive execution splits what is still skewed.
    The first and last moment of the events are asked for first: where they are long to compute give ``moments``, a table of one column that holds all of their moments.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    kept = [c for c in events.columns if c not in carry]
    events = events.select(*kept, at.cast("bigint").alias("__ij_at"))
    keys = {f"__ij_k{i}": (a, b) for i, (a, b) in enumerate(on.items())}
    present = reduce(Column.__and__, [F.col(b).isNotNull() for b in on.values()])
    known = intervals.filter(present & start.isNotNull()).select(
        *[F.col(b).alias(k) for k, (_, b) in keys.items()], start.cast("bigint").alias("__ij_lo"), (end.cast("bigint") - 1).alias("__ij_hi"), *[F.col(c).alias(f"__ij_c{i}") for i, c in enumerate(carry)]
    )
    asked = (events.select("__ij_at") if moments is None else moments).toDF("t")
    ends = asked.agg(F.min("t"), F.max("t")).first()
    first, last = ends[0], ends[1]
    carried = [F.col(f"__ij_c{i}").alias(c) for i, c in enumerate(carry)]
    if first is None:  # no event has a moment
        nothing = events.select(*kept, *[F.lit(None).cast(known.schema[f"__ij_c{i}"].dataType).alias(c) for i, c in enumerate(carry)])
        return nothing if how == "left" else nothing.limit(0)
    low, high = F.lit(first).cast("bigint"), F.lit(last).cast("bigint")
    size = Observation()
    rest = known.withColumns({"__ij_lo": F.greatest("__ij_lo", low), "__ij_hi": F.least(F.coalesce("__ij_hi", high), high)}).filter("__ij_lo <= __ij_hi")
    rest = cut(rest.observe(size, F.avg(F.col("__ij_hi") - F.col("__ij_lo")).alias("length")), "intervals")
    coarsest = max(FINEST, int(size.get["length"] or 1).bit_length())
    waiting, parts, span = events, [], last - first
    for bits in [*range(coarsest, FINEST, -REFINE), FINEST]:
        pieces = _into_buckets(rest, bits, span)
        places, crowded = [*keys, "__ij_bucket"], None
        if bits != FINEST:
            crowded, n = counted_cut(pieces.groupBy(*places).count().filter(F.col("count") > dense).select(*places), "crowded")
            crowded = crowded if n else None
        here, side = waiting.withColumn("__ij_b", _bucket(F.col("__ij_at"), bits)), pieces
        if crowded is not None:
            marks = crowded.select(*[F.col(k).alias(f"__ij_m{k}") for k in keys], F.col("__ij_bucket").alias("__ij_m"))
            same = reduce(Column.__and__, [F.col(a) == F.col(f"__ij_m{k}") for k, (a, _) in keys.items()], F.col("__ij_b") == F.col("__ij_m"))
            side = pieces.join(crowded, places, "left_anti")
            waiting, here = here.join(marks, same, "left_semi").drop("__ij_b"), here.join(marks, same, "left_anti")
        inside = reduce(Column.__and__, [F.col(a) == F.col(k) for k, (a, _) in keys.items()], F.col("__ij_b") == F.col("__ij_bucket"))
        inside &= (F.col("__ij_at") >= F.col("__ij_lo")) & (F.col("__ij_at") <= F.col("__ij_hi"))
        parts.append(here.join(side, inside, how).select(*kept, *carried))
        if crowded is None:
            break
        rest = pieces.join(crowded, places, "left_semi").drop("__ij_bucket")
    return reduce(DataFrame.unionByName, parts)


def asof_join(events: DataFrame, changes: DataFrame, *, entity: str, event_at: str, change_entity: str, change_at: str, dense: int = DENSE, share: float = SHARE, least: int = LEAST, carry: Sequence[str] = (), tie: Sequence[str] = (), how: str = "inner", moments: DataFrame | None = None) -> DataFrame:
    """Every event with what was known of its entity at that moment: events' columns, ``known_at``, the instant of the entity's latest change at or before it, and the ``carry`` columns of that change.

    Inner: events with NULL entity or instant, or before the entity's first change, have no row; ``how="left"`` keeps them with NULLs. Repeated
    events stay repeated. ``known_at`` and carried columns replace event columns of those names. Of changes of one entity and instant the one with the largest ``tie`` columns counts, then the largest carried ones.

    Validity intervals run from one change to the next (half-open) and are joined by ``interval_join``: exploded into time buckets, equi-joined by entity and bucket, contained.
    """
    if how == "inner":
        events = events.filter(F.col(entity).isNotNull() & F.col(event_at).isNotNull())
    known = validity_intervals(changes, change_entity, change_at, share, least, carry=carry, tie=tie).withColumn("known_at", F.col("from_us"))
    return interval_join(events, known, on={entity: "entity"}, at=F.col(event_at), start=F.col("from_us"), end=F.col("to_us"), carry=["known_at", *carry], how=how, dense=dense, moments=moments)
