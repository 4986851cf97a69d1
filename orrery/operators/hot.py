"""Ordered work on keys that may hold a large part of all rows.

A window over a key sorts the whole key in one task. Where one key holds a third of a table that
task never ends, so ordered operators go through this module: a heavy-hitter sketch (one scan, no
shuffle) names the keys above a share of the rows, those keys are cut into consecutive pieces at
quantiles of their order column, the window runs inside the pieces, and the pieces' edge rows
(one per piece, broadcast if they are small) carry values across the cuts. Results are the same with and without cuts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.runtime import broadcast_if_small, cut

#: A key is hot if it has more than LEAST rows, which one task sorts at ease, and more than this share of all rows, which is what the sketch can tell.
SHARE, LEAST = 0.0001, 1_000_000

_HASH, CHUNK = "__orrery_hash", "__orrery_chunk"
#: Items the sketch tracks for each key that can be hot: its error is a fraction of SHARE.
_TRACKED = 4
#: Rows of a hot key that are drawn for each of its pieces, to find where to cut.
_DRAWN = 500
#: Estimated bytes up to which a table is counted before it is sketched.
_COUNTED = 256 * 1024 * 1024
#: Sketches of the scan's tasks are united in this many groups before the last one.
_GROUPS = 256


@dataclass
class Split:
    """``df`` with the columns that make a bounded group: the keys, and a piece number if any key is hot."""

    df: DataFrame
    keys: list[str]
    hot: list[int] = field(default_factory=list)
    #: hot key hash -> its ascending cut points, as a DataFrame of at most 1 / share rows
    cuts: DataFrame | None = None

    @property
    def parts(self) -> list[str]:
        return self.keys + [CHUNK] * bool(self.hot)


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE, least: int = LEAST) -> dict[int, int]:
    """Hashes of the keys above ``share`` of the rows, with their estimated rows.

    At most 1 / share of them can exist, so the result is small however large the input.
    Runs one scan of the key columns; its tasks' sketches are united in groups first, so that no task gets all of them. An empty table has none.
    """
    return _heavy(df, keys, share, least)[0]


def _heavy(df: DataFrame, keys: list[str], share: float, least: int) -> tuple[dict[int, int], float]:
    """The heavy keys, and the number of rows from which a key is one."""
    df = df.select(*keys)
    # a small table is counted first: with ``least`` rows or fewer no key is hot, and the sketch would cost more than the count
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= _COUNTED and df.count() <= least:  # noqa: SLF001
        return {}, least
    top = int(1 / share) + 10
    tracked = _TRACKED * top
    parts = df.select(key_hash(keys).alias("h")).groupBy(F.pmod(F.spark_partition_id(), F.lit(_GROUPS)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(h, {tracked})").alias("s"), F.count(F.lit(1)).alias("n"))
    # grouped by a constant: an empty table then has no row, where a global aggregate would combine nothing and fail
    total = parts.groupBy(F.lit(0).alias("g")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"), F.sum("n").alias("n"))
    found = total.select(F.expr(f"approx_top_k_estimate(s, {top})").alias("top"), "n").first()
    if not found or not found["n"]:
        return {}, least
    bar = max(share * found["n"], least, 1)
    return {x["item"]: x["count"] for x in found["top"] or [] if x["count"] >= bar}, bar


def split_hot(df: DataFrame, keys: list[str], order: str, share: float = SHARE, least: int = LEAST, counted: DataFrame | None = None) -> Split:
    """Cut hot keys into pieces that follow one another in ``order`` (a numeric column without NULLs).

    A key gets as many pieces as it takes for none to have much more rows than a key that isn't hot. Rows that are equal in keys and ``order`` stay together.
    Where to cut is told by some rows drawn of each hot key (all rows are worked on; where the cuts lie changes no result). ``counted``: rows to find the hot keys in, if they are cheaper to read than ``df``
    and hold each of its rows.
    """
    hot, bar = _heavy(df if counted is None else counted, keys, share, least)
    if not hot:
        return Split(df, keys)
    spark = df.sparkSession
    pieces = {h: max(2, int(n / bar) + 1) for h, n in hot.items()}
    # at most 1 / share keys, and as many pieces again
    wanted = spark.createDataFrame([(h, min(1.0, _DRAWN * pieces[h] / hot[h])) for h in hot], f"{_HASH} bigint, __orrery_part double")
    hashed = df.withColumn(_HASH, key_hash(keys))
    drawn = hashed.select(_HASH, F.col(order).cast("bigint").alias("o")).join(F.broadcast(wanted), _HASH).filter(F.rand(17) < F.col("__orrery_part"))
    accuracy = max(10_000, 4 * max(pieces.values()))
    finest = max(pieces.values())
    grid = drawn.groupBy(_HASH).agg(F.percentile_approx("o", [i / finest for i in range(1, finest)], accuracy).alias("q")).collect()
    rows = []
    for h, q in grid:
        n = pieces[h]
        rows.append((h, sorted({int(q[max(0, round(i * finest / n) - 1)]) for i in range(1, n)})))
    cuts = spark.createDataFrame(rows, f"{_HASH} bigint, __orrery_cuts array<bigint>")
    chunk = F.coalesce(F.size(F.filter("__orrery_cuts", lambda c: c <= F.col(order))), F.lit(0))
    chunked = hashed.join(F.broadcast(cuts), _HASH, "left").withColumn(CHUNK, F.when(F.col("__orrery_cuts").isNull(), 0).otherwise(chunk))
    return Split(chunked.drop("__orrery_cuts", _HASH), keys, list(hot), cuts)


def neighbours(df: DataFrame, split: Split, order: list[str], lead: dict[str, str] | None = None, lag: dict[str, str] | None = None) -> DataFrame:
    """Columns of the next (``lead``) and previous (``lag``) row of the same key, new name -> column.

    ``df`` has ``split.parts`` and no two rows equal in keys and ``order``.
    """
    lead, lag = lead or {}, lag or {}
    w = Window.partitionBy(*split.parts).orderBy(*order)
    inside = {n: F.lead(c).over(w) for n, c in lead.items()} | {n: F.lag(c).over(w) for n, c in lag.items()}
    if not split.hot:
        return df.withColumns(inside)
    needed = list(dict.fromkeys([*lead.values(), *lag.values()]))
    at, image = F.struct(*order), F.struct(*needed)
    hot_rows = df.filter(key_hash(split.keys).isin(split.hot))
    across = Window.partitionBy(*split.keys).orderBy(CHUNK)  # a row per piece
    edges = cut(
        hot_rows.groupBy(*split.parts)
        .agg(F.min_by(image, at).alias("__orrery_first"), F.max_by(image, at).alias("__orrery_last"))
        .select(*[F.col(p).alias(f"__e_{p}") for p in split.parts], F.lead("__orrery_first").over(across).alias("__orrery_next"), F.lag("__orrery_last").over(across).alias("__orrery_prev")),
        "edges",
    )
    same = None
    for p in split.parts:
        equal = F.col(p).eqNullSafe(F.col(f"__e_{p}"))
        same = equal if same is None else same & equal
    marked = df.withColumns(inside | {"__orrery_is_last": F.lead(F.lit(1)).over(w).isNull(), "__orrery_is_first": F.lag(F.lit(1)).over(w).isNull()})
    joined = marked.join(broadcast_if_small(edges), same, "left")
    fixed = {n: F.when(F.col("__orrery_is_last"), F.col(f"__orrery_next.{c}")).otherwise(F.col(n)) for n, c in lead.items()}
    fixed |= {n: F.when(F.col("__orrery_is_first"), F.col(f"__orrery_prev.{c}")).otherwise(F.col(n)) for n, c in lag.items()}
    return joined.withColumns(fixed).select(*df.columns, *inside)
