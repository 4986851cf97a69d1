"""Overlapping and gapped intervals: a map of disjoint intervals per entity."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.hot import CHUNK, LEAST, SHARE, key_hash, split_hot

#: Intervals that a partition keeps in maps before it hands them on.
HELD = 100_000


class IntervalMap:
    """Ordered disjoint closed intervals of whole numbers, and the gaps between them; touching intervals are one.

    ``insert`` finds the intervals it overlaps by binary search (an interval behind all others goes to the end at once), merges them and
    replaces the gaps around them.
    """

    __slots__ = ("between", "ends", "starts")

    def __init__(self, intervals: list[tuple[int, int]] | None = None):
        self.starts: list[int] = []
        self.ends: list[int] = []
        #: the gap after each interval but the last
        self.between: list[tuple[int, int]] = []
        for a, b in intervals or []:
            self.insert(a, b)

    @classmethod
    def of(cls, starts: list[int], ends: list[int]) -> IntervalMap:
        """A map of intervals that are disjoint and in order already."""
        m = cls()
        m.starts, m.ends = list(starts), list(ends)
        m.between = [(e + 1, s - 1) for e, s in zip(m.ends, m.starts[1:], strict=False)]
        return m

    def insert(self, a: int, b: int) -> None:
        if b < a:
            return
        starts, ends, between = self.starts, self.ends, self.between
        if not starts or a > ends[-1] + 1:
            if starts:
                between.append((ends[-1] + 1, a - 1))
            starts.append(a)
            ends.append(b)
            return
        i = bisect_left(ends, a - 1)
        j = bisect_right(starts, b + 1)
        if i + 1 == j and a >= starts[i] and b <= ends[i]:
            return  # nothing new
        last = len(starts) - 1
        if i < j:
            a, b = min(a, starts[i]), max(b, ends[j - 1])
        around = [(ends[i - 1] + 1, a - 1)] if i else []
        if j <= last:
            around.append((b + 1, starts[j] - 1))
        between[max(i - 1, 0) : min(j, last)] = around
        starts[i:j] = [a]
        ends[i:j] = [b]

    def periods(self) -> list[tuple[int, int]]:
        return list(zip(self.starts, self.ends, strict=True))

    def gaps(self) -> list[tuple[int, int]]:
        return list(self.between)

    def __len__(self) -> int:
        return len(self.starts)


def _combine(held: int):
    """Unions per key of what a partition holds, in any order, handed on whenever ``held`` intervals are in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[tuple, IntervalMap] = {}
        seen, schema = 0, None

        def out() -> pa.RecordBatch:
            rows = [(*k, a, b) for k, m in maps.items() for a, b in m.periods()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            schema = batch.schema
            columns = [c.to_pylist() for c in batch.columns]
            for *key, a, b in zip(*columns, strict=True):
                key = tuple(key)
                if (m := maps.get(key)) is None:
                    m = maps[key] = IntervalMap()
                m.insert(a, b)
                seen += 1
            if seen >= held:
                yield out()
                maps, seen = {}, 0
        if maps:
            yield out()

    return run


def _merge_sorted(n_keys: int, held: int):
    """Periods and gaps per key from rows sorted by key and start; only one key's map is held at a time, and of it no more than ``held`` intervals: what lies before the last can't change any more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m, rows, schema, first = None, IntervalMap(), [], None, True

        def hand_on(whole: bool) -> IntervalMap:
            nonlocal first
            last = len(m) - 1
            for i, (a, b) in enumerate(m.periods() if whole else m.periods()[:-1]):
                rows.append((*key, "period", a, b, first and i == 0, whole and i == last))
            rows.extend((*key, "gap", a, b, False, False) for a, b in m.gaps())
            first = whole
            return IntervalMap() if whole else IntervalMap.of(m.starts[-1:], m.ends[-1:])

        def out() -> pa.RecordBatch:
            types = [*schema.types[:n_keys], pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            names = [*schema.names[:n_keys], "kind", "from_us", "to_us", "is_first", "is_last"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            schema = batch.schema
            for *k, a, b in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if k != key:
                    if key is not None:
                        m = hand_on(True)
                    key = k
                elif len(m) > held:
                    m = hand_on(False)
                if len(rows) >= 50_000:
                    yield out()
                    rows.clear()
                m.insert(a, b)
        if key is not None:
            hand_on(True)
        if rows:
            yield out()

    return run


def _stitch(edges, names: list[str]):
    """Joins what touches across the pieces of one hot key: its pieces' first and last periods, in order."""
    import pandas as pd

    rows, key = [], tuple(edges[n].iloc[0] for n in names)
    edges = edges.sort_values(["from_us"])
    opened = None
    for first, a, b in zip(edges["is_first"], edges["from_us"], edges["to_us"], strict=True):
        if opened is None:
            opened = [a, b]
        elif first and a <= opened[1] + 1:
            opened[1] = max(opened[1], b)
        else:
            rows.append((*key, "period", opened[0], opened[1]))
            if first:
                rows.append((*key, "gap", opened[1] + 1, a - 1))
            opened = [a, b]
    rows.append((*key, "period", opened[0], opened[1]))
    return pd.DataFrame(rows, columns=[*names, "kind", "from_us", "to_us"])


def periods_and_gaps(spans: DataFrame, keys: list[str], start: str, end: str, *, held: int = HELD, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(keys, kind, from_us, to_us): each key's unbroken periods, and the gaps between them.

    ``start`` and ``end`` are BIGINT and both belong to the span; rows with either NULL, or reversed, are no spans. NULL is a
    key like any other. Spans that overlap, nest, repeat or follow without a missing unit form one period; what is
    missing between two periods of a key is a gap. Other columns are ignored.

    Each partition first unites what it holds of every key (``IntervalMap``), so that repeats and overlaps aren't shuffled; then one map per
    key takes the unions. A hot key is cut at quantiles of the spans' starts into pieces that are united apart; spans across
    a cut are divided there, and the pieces' outermost periods, a bounded number, are joined at the end.
    """
    valid = spans.filter(f"`{start}` IS NOT NULL AND `{end}` >= `{start}`").select(*keys, F.col(start).cast("bigint").alias("__a"), F.col(end).cast("bigint").alias("__b"))
    fields = [valid.schema[k] for k in keys]
    combined = valid.mapInArrow(_combine(held), T.StructType([*fields, T.StructField("__a", T.LongType()), T.StructField("__b", T.LongType())]))
    split = split_hot(valid, keys, "__a", share, least)
    if not split.hot:
        placed, parts = combined, keys
    else:
        cut = split.cuts.withColumnRenamed("__orrery_hash", "__h").withColumnRenamed("__orrery_cuts", "__cuts")
        located = combined.withColumn("__k", key_hash(keys)).join(F.broadcast(cut), F.col("__k") == F.col("__h"), "left")
        piece = lambda x: F.coalesce(F.size(F.filter("__cuts", lambda c: c <= F.col(x))), F.lit(0))
        placed = (
            located.withColumn(CHUNK, F.explode(F.when(F.col("__cuts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(piece("__a"), piece("__b")))))
            .withColumns({
                "__a": F.when(F.col("__cuts").isNotNull() & (F.col(CHUNK) > 0), F.greatest("__a", F.try_element_at("__cuts", F.col(CHUNK)))).otherwise(F.col("__a")),
                "__b": F.when(F.col("__cuts").isNotNull(), F.least("__b", F.coalesce(F.try_element_at("__cuts", F.col(CHUNK) + 1) - 1, F.col("__b")))).otherwise(F.col("__b")),
            })
            .select(*keys, CHUNK, "__a", "__b")
        )
        parts = [*keys, CHUNK]
    out = T.StructType([
        *[placed.schema[k] for k in parts], T.StructField("kind", T.StringType()), T.StructField("from_us", T.LongType()), T.StructField("to_us", T.LongType()),
        T.StructField("is_first", T.BooleanType()), T.StructField("is_last", T.BooleanType()),
    ])
    merged = placed.repartition(*parts).sortWithinPartitions(*parts, "__a").mapInArrow(_merge_sorted(len(parts), held), out)
    result = [*keys, "kind", "from_us", "to_us"]
    if not split.hot:
        return merged.select(*result)
    from orrery.runtime import cut as durable

    merged = durable(merged, "pieces")
    is_hot = key_hash(keys).isin(split.hot)
    edge = is_hot & (F.col("kind") == "period") & (F.col("is_first") | F.col("is_last"))
    names = list(keys)
    schema = T.StructType([*fields, T.StructField("kind", T.StringType()), T.StructField("from_us", T.LongType()), T.StructField("to_us", T.LongType())])
    joined = merged.filter(edge).groupBy(*keys).applyInPandas(lambda pdf: _stitch(pdf, names), schema)
    return merged.filter(~edge).select(*result).unionByName(joined)
