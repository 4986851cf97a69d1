"""Change feeds and user SQL: deduplication, pruning, null policy, masking."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.keys import replacement

META = ("_change_type", "_commit_version", "_commit_timestamp")


def _latest(feed: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    """The row with the largest ``order`` of each key: a maximum, so Spark combines rows before it shuffles. A NULL key is a key."""
    row = F.struct(*feed.columns)
    picked = feed.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(f"__row.`{c}`").alias(c) for c in feed.columns])


def dedup_delete_wins(feed: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """One row per key: the latest commit; within it a delete before an after-image before anything else, then the largest ``tie`` columns."""
    kind = F.when(F.col("_change_type") == "delete", 2).when(F.col("_change_type") == "update_postimage", 1).otherwise(0)
    return _latest(feed, keys, [F.coalesce(F.col("_commit_version"), F.lit(-1)), kind, *[F.col(c) for c in tie]])


def dedup_upsert_wins(feed: DataFrame, keys: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """One row per key by the first of version, timestamp and processing time that is there; at a tie anything before a delete, then the largest ``tie`` columns. ValueError if none is there."""
    by = next((c for c in ("_commit_version", "_commit_timestamp", "__etl_processed_at") if c in feed.columns), None)
    if by is None:
        raise ValueError("a feed needs _commit_version, _commit_timestamp or __etl_processed_at to be deduplicated")
    alive = (F.col("_change_type") != "delete") if "_change_type" in feed.columns else F.lit(True)
    return _latest(feed, keys, [F.col(by).isNotNull(), F.col(by), F.coalesce(alive, F.lit(True)), *[F.col(c) for c in tie]])


def changes_between(feed: DataFrame, start: int, end: int | None = None, keys: Sequence[str] | None = None) -> DataFrame:
    """The feed's commits from ``start`` to ``end`` (both included) without before-images, deduplicated if keys are given."""
    rows = feed.filter((F.col("_commit_version") >= start) & (F.coalesce(F.col("_change_type"), F.lit("")) != "update_preimage"))
    if end is not None:
        rows = rows.filter(F.col("_commit_version") <= end)
    return dedup_delete_wins(rows, keys) if keys else rows


def append_rows(feed: DataFrame) -> DataFrame:
    """The feed as rows to append: without its metadata."""
    return feed.drop(*META)


def changes_from_snapshots(old: DataFrame, new: DataFrame, keys: Sequence[str], version: int) -> DataFrame:
    """The change feed that leads from one snapshot to the next: inserts, deletes, and both images of updates. Keys are unique; a NULL key is a key."""
    rest = [c for c in new.columns if c not in keys]
    a, b = old.select(*keys, F.struct(*rest).alias("__old"), F.lit(True).alias("__a")), new.select(*keys, F.struct(*rest).alias("__new"), F.lit(True).alias("__b"))
    both = full_outer(a, b, keys)
    one = lambda kind, image: F.array(F.struct(F.lit(kind).alias("kind"), F.col(image).alias("row")))
    update = F.concat(one("update_preimage", "__old"), one("update_postimage", "__new"))
    rows = F.when(F.col("__a").isNull(), one("insert", "__new")).when(F.col("__b").isNull(), one("delete", "__old")).when(~F.col("__old").eqNullSafe(F.col("__new")), update)
    out = both.withColumn("__c", F.explode(rows))
    return out.select(*keys, *[F.col(f"__c.row.`{c}`").alias(c) for c in rest], F.col("__c.kind").alias("_change_type"), F.lit(version).cast("bigint").alias("_commit_version"))


def full_outer(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A full outer join on keys in which NULL equals NULL; the keys come out once."""
    right = b.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on &= a[k].eqNullSafe(right[f"__r_{k}"])
    # a presence flag tells a NULL key of the left from no left row
    left = a.withColumn("__l", F.lit(True))
    joined = left.join(right, on, "full_outer")
    return joined.select(*[F.when(F.col("__l"), a[k]).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys], *[c for c in a.columns if c not in keys], *[c for c in b.columns if c not in keys])


def user_sql(spark: SparkSession, sources: dict[str, DataFrame], sql: str | None) -> DataFrame:
    """Run a table's transformation over its sources, named by alias. One source without SQL passes through."""
    if sql is None:
        if len(sources) != 1:
            raise ValueError("a table with several sources needs transformation_sql")
        return next(iter(sources.values()))
    check_sql(sql, list(sources))
    for alias, df in sources.items():
        df.createOrReplaceTempView(alias)
    return spark.sql(sql)


def check_sql(sql: str, aliases: Sequence[str]) -> None:
    """ValueError unless the SQL is a query that names every source and changes nothing."""
    bare = re.sub(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S)
    if not re.match(r"\s*(select|with)\b", bare, re.I):
        raise ValueError("transformation_sql must start with SELECT or WITH")
    if word := re.search(r"\b(drop|delete|truncate|update|insert|merge|alter|create)\b(?!_)", bare, re.I):
        raise ValueError(f"transformation_sql must not contain {word[0].upper()}")
    if missing := [a for a in aliases if not re.search(rf"\b{re.escape(a)}\b", bare, re.I)]:
        raise ValueError(f"transformation_sql never names {', '.join(missing)}")


def lost_change_type(sources: dict[str, DataFrame], out: DataFrame) -> bool:
    """Whether deletes will be missed: a source has _change_type, the transformed rows have not."""
    return any("_change_type" in df.columns for df in sources.values()) and "_change_type" not in out.columns


def reattach(sources: dict[str, DataFrame], out: DataFrame) -> DataFrame | None:
    """``out`` with the feed metadata that the transformation lost, from the one source that has it; None if several have it or nothing in common tells which row is which.

    Rows are told by all columns that both have under one name, in which NULL equals NULL; of several source rows that agree in all of them the latest
    commit counts (a delete before others within it), so no row of ``out`` is doubled. A row that the source lacks has NULL metadata.
    """
    feeds = [df for df in sources.values() if "_change_type" in df.columns]
    common = [c for c in out.columns if feeds and c in feeds[0].columns and c not in META]
    if len(feeds) != 1 or not common:
        return None
    meta = [c for c in META if c in feeds[0].columns]
    latest = dedup_delete_wins(feeds[0].select(*common, *meta), common) if "_commit_version" in meta else feeds[0].select(*common, *meta).dropDuplicates(common)
    known = latest.select(*[F.col(c).alias(f"__m_{c}") for c in common], *[F.col(c).alias(f"__meta_{c}") for c in meta])
    same = F.lit(True)
    for c in common:
        same &= out[c].eqNullSafe(known[f"__m_{c}"])
    kept = [c for c in out.columns if c not in meta]
    return out.join(known, same, "left").select(*[out[c] for c in kept], *[F.col(f"__meta_{c}").alias(c) for c in meta])


def prune(df: DataFrame, target: Sequence[str], protected: Sequence[str] = (), evolve: bool = False) -> DataFrame:
    """Only the columns the target has or that are protected (keys, tracked, system, feed metadata); all of them if it evolves."""
    wanted = {c.lower() for c in (*target, *protected, *META)}
    return df if evolve else df.select(*[c for c in df.columns if c.lower() in wanted or c.startswith("__")])


def evolve(target: DataFrame, source: DataFrame, fill: bool = False) -> DataFrame:
    """The target with the source's additional columns (not those beginning with ``__`` nor feed metadata), NULL or, with ``fill``, the typed replacement."""
    have = {c.lower() for c in target.columns}
    new = [f for f in source.schema if f.name.lower() not in have and not f.name.startswith("__") and f.name not in META]
    return target.select("*", *[(replacement(f.dataType) if fill else F.lit(None).cast(f.dataType)).alias(f.name) for f in new])


def null_policy(df: DataFrame, keys: Sequence[str], substitutes: dict[str, object] | None = None, policy: str = "strict") -> DataFrame:
    """Descriptive NULLs replaced by typed values, or those given; keys and columns that begin with ``_`` stay. ``legacy`` changes nothing."""
    if policy == "legacy":
        return df
    given, out = substitutes or {}, {}
    for f in df.schema:
        if f.name in keys or f.name.startswith("_"):
            continue
        value = F.lit(given[f.name]).cast(f.dataType) if f.name in given else replacement(f.dataType)
        out[f.name] = F.coalesce(F.col(f"`{f.name}`"), value)
    return df.withColumns(out) if out else df


def null_identities(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows a strict dimension refuses: a key is NULL."""
    bad = F.lit(False)
    for k in keys:
        bad |= F.col(k).isNull()
    return df.filter(bad)


def hmac_sha256(text: Column, secret: str) -> Column:
    """HMAC-SHA-256 of a text, as hex; NULL stays NULL. Two hashes of padded binaries, so it stays in the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytearray(b ^ pad for b in key) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), text.cast("binary")), 256))), 256)


def mask_columns(df: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Sensitive columns made safe; ``rules``: column -> {"method": ..., ...}. Columns that aren't there are passed over.

    ``drop``; ``null`` (typed); ``fast_hash`` (BIGINT of value and column name); ``tokenize`` (keyed SHA-256, hex, needs ``secret``);
    ``mask`` (ten times ``char``, after the first ``prefix`` characters). The last two keep NULL.
    """
    for name, rule in rules.items():
        if name not in df.columns:
            continue
        c, method = F.col(f"`{name}`"), rule["method"]
        if method == "drop":
            df = df.drop(name)
        elif method == "null":
            df = df.withColumn(name, F.lit(None).cast(df.schema[name].dataType))
        elif method in ("fast_hash", "hash"):
            df = df.withColumn(name, F.xxhash64(c.cast("string"), F.lit(name)))
        elif method == "tokenize":
            df = df.withColumn(name, hmac_sha256(c.cast("string"), rule["secret"]))
        elif method == "mask":
            kept = F.substring(c.cast("string"), 1, int(rule.get("prefix", 0)))
            df = df.withColumn(name, F.when(c.isNotNull(), F.concat(kept, F.lit(rule.get("char", "*") * 10))))
        else:
            raise ValueError(f"unknown masking method {method!r}")
    return df


def unpivot(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, value): a row per field, values as text, NULLs kept."""
    return df.unpivot(key, [F.col(f).cast("string").alias(f) for f in fields], "field", "value") if fields else df.select(key, F.lit("").alias("field"), F.lit("").alias("value")).limit(0)
