"""Slowly changing dimensions: overwrite, versions, attribute history, current columns, dual keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.keys import MEMBERS, NULL_JUNK, STATUS, VALID_FROM, VALID_TO, dual_keys, hashdiff, junk_key, surrogate_key
from orrery.functions.times import stamp_us
from orrery.operators.feed import META, dedup_upsert_wins, evolve, full_outer
from orrery.operators.hot import LEAST, SHARE, neighbours, split_hot

SYSTEM = ("__valid_from", "__valid_to", "__is_current", "__is_deleted", "__is_skeleton", "hashdiff")


def moment_us(df: DataFrame, column: str) -> Column:
    """BIGINT microseconds of a date, timestamp or zone-less timestamp column."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(column))
    return stamp_us(F.col(column).cast("timestamp_ntz"))


def _is_delete(df: DataFrame) -> Column:
    return F.coalesce(F.col("_change_type") == "delete", F.lit(False)) if "_change_type" in df.columns else F.lit(False)


def overwrite_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], *, deletes: str = "hard", schema_evolution: bool = False, tie: Sequence[str] = ()) -> DataFrame:
    """Type 1: the target after the merge, with ``__is_deleted`` and ``__action`` (keep, insert, update, delete).

    Rows match on keys in which NULL equals NULL. A matched row is updated only if a column differs (a returning row
    that was marked as deleted does); its ``__is_deleted`` becomes false. ``_change_type = 'delete'`` removes the row
    (``hard``: its action is ``delete`` and ``applied`` leaves it out) or marks it (``soft``); a delete without a match does nothing. A feed is
    deduplicated first (``tie``: what counts within a commit). Columns the source lacks keep the target's values.
    """
    if deletes not in ("hard", "soft"):
        raise ValueError(f"deletes must be hard or soft, not {deletes!r}")
    if "_commit_version" in source.columns:
        source = dedup_upsert_wins(source, keys, tie)
    if schema_evolution:
        target = evolve(target, source)
    if "__is_deleted" not in target.columns:
        target = target.withColumn("__is_deleted", F.lit(False))
    columns = [c for c in target.columns if c not in (*keys, "__is_deleted")]
    given = [c for c in columns if c in source.columns]
    old = target.select(*keys, F.struct("__is_deleted", *columns).alias("__t"))
    new = source.select(*keys, F.struct(_is_delete(source).alias("gone"), *given).alias("__s"))
    both = full_outer(old, new, keys)
    differs = F.col("__t.__is_deleted")
    for c in given:
        differs |= ~F.col(f"__t.`{c}`").eqNullSafe(F.col(f"__s.`{c}`"))
    gone = F.col("__s.gone")
    action = (
        F.when(F.col("__s").isNull(), "keep")
        .when(F.col("__t").isNull(), F.when(gone, F.lit("ignore")).otherwise("insert"))
        .when(gone, F.when(F.col("__t.__is_deleted"), "keep").otherwise("delete") if deletes == "soft" else F.lit("delete"))
        .when(differs, "update")
        .otherwise("keep")
    )
    take = F.col("__action").isin("insert", "update")
    value = lambda c: F.when(take, F.col(f"__s.`{c}`")).otherwise(F.col(f"__t.`{c}`")) if c in given else F.col(f"__t.`{c}`")
    flag = F.when(F.col("__action") == "delete", True).when(take, False).otherwise(F.col("__t.__is_deleted"))
    return both.withColumn("__action", action).filter("__action <> 'ignore'").select(*keys, *[value(c).alias(c) for c in columns], flag.alias("__is_deleted"), "__action")


def applied(merged: DataFrame, deletes: str = "hard") -> DataFrame:
    """The rows of the table after an ``overwrite_merge``."""
    return (merged.filter("__action <> 'delete'") if deletes == "hard" else merged).drop("__action")


def empty_versions(source: DataFrame, keys: Sequence[str], attributes: Sequence[str], at: str, sk: str = "sk") -> DataFrame:
    """An empty versioned dimension for a source."""
    kind = source.schema[at].dataType
    empty = source.limit(0).select(F.lit(0).cast("bigint").alias(sk), *keys, *attributes)
    return empty.select("*", F.lit(None).cast(kind).alias("__valid_from"), F.lit(None).cast(kind).alias("__valid_to"), F.lit(True).alias("__is_current"), F.lit(False).alias("__is_deleted"), F.lit(False).alias("__is_skeleton"), F.lit(0).cast("bigint").alias("hashdiff"))


def versioned_merge(target: DataFrame, source: DataFrame, keys: Sequence[str], *, at: str, tracked: Sequence[str], attributes: Sequence[str] | None = None, sk: str = "sk", strategy: str = "xxhash64", full_snapshot: bool = False, as_of: Column | None = None, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Type 2: the dimension after the merge, one row per version with half-open validity.

    ``target`` has ``sk``, keys, ``attributes`` (default: ``tracked``) and the system columns (``empty_versions`` makes an empty one); ``source`` rows take effect at ``at``, in ``_commit_version`` order
    where instants are equal (a feed's deletes end the current version). All versions of a key, the ends of those that were deleted, and its incoming rows form one chain in
    order of effect; an incoming row whose tracked hash equals that of the version before it is dropped, every other opens a version that closes the one before it. Hence several versions in
    one batch give the same table as one after the other, and replays change nothing. A late row splits the interval it falls into; existing versions
    keep their key and stay, even where a late row makes one a repeat, and none ever ends later than it did. Versions of one key start at different moments (their key is made of both).

    A skeleton is filled in place by the incoming row in force at its start, else the next one: key and start stay. With ``full_snapshot`` the current versions (not skeletons and reserved members) of keys
    that the source lacks end at ``as_of`` as deleted. Rows with NULL ``at`` are left out; NULL keys are a key.

    The target is read once and shuffled once, with the incoming rows; all else happens on the sorted partitions of the keys. Give the part of the target
    that can hold the source's keys (``VersionedTable.touched``), and materialise it and the source first if they are long to compute.
    """
    attributes = list(attributes or tracked)
    version = F.coalesce(F.col("_commit_version"), F.lit(-1)).cast("bigint") if "_commit_version" in source.columns else F.lit(0).cast("bigint")
    kind = target.schema["__valid_to"].dataType
    usable = source.filter(F.col(at).isNotNull())
    none = F.lit(None).cast(kind)
    incoming = usable.select(
        *keys, F.col(at).cast(kind).alias("__valid_from"), moment_us(source, at).alias("__us"), version.alias("__v"), _is_delete(source).alias("__gone"), F.struct(*attributes).alias("__a"), hashdiff(tracked, strategy).alias("hashdiff"),
        F.lit(False).alias("__sx"), F.struct(F.lit(None).cast("bigint").alias("sk"), none.alias("until"), F.lit(None).cast("boolean").alias("now"), F.lit(None).cast("boolean").alias("gone")).alias("__o"),
    )
    if full_snapshot:
        given = usable.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.lit(True).alias("__given")).distinct()
        same = F.lit(True)
        for k in keys:
            same &= target[k].eqNullSafe(given[f"__k_{k}"])
        ends = F.col("__given").isNull() & F.col("__is_current") & ~F.col("__is_skeleton") & ~F.col(sk).isin(*MEMBERS)
        when = as_of if as_of is not None else F.current_timestamp()
        marked = target.join(given, same, "left").select(*target.columns, F.coalesce(ends, F.lit(False)).alias("__ends"))
        target = marked.withColumns({"__valid_to": F.when(F.col("__ends"), when.cast(kind)).otherwise(F.col("__valid_to")), "__is_deleted": F.col("__is_deleted") | F.col("__ends"), "__is_current": F.col("__is_current") & ~F.col("__ends")}).drop("__ends")
    # a version that was deleted brings the end of its validity along as a row of the chain
    until = moment_us(target, "__valid_to")
    row = lambda start, us_, v, gone, skeleton, known: F.struct(start.alias("__valid_from"), us_.alias("__us"), F.lit(v).cast("bigint").alias("__v"), F.lit(gone).alias("__gone"), F.struct(*attributes).alias("__a"), hashdiff(tracked, strategy).alias("hashdiff"), skeleton.alias("__sx"), known.alias("__o"))
    o = F.struct(F.col(sk).cast("bigint").alias("sk"), F.col("__valid_to").alias("until"), F.col("__is_current").alias("now"), F.col("__is_deleted").alias("gone"))
    itself = row(F.col("__valid_from"), moment_us(target, "__valid_from"), -2, False, F.col("__is_skeleton"), o)
    its_end = row(F.col("__valid_to"), until, -3, True, F.lit(False), F.lit(None).cast(incoming.schema["__o"].dataType))
    old = target.select(*keys, F.explode(F.when(F.col("__is_deleted"), F.array(itself, its_end)).otherwise(F.array(itself))).alias("x")).select(*keys, "x.*")
    # one shuffle: one row per instant, its neighbours and the closing all run on the partitions of the keys
    split = split_hot(old.unionByName(incoming), list(keys), "__us", share, least, target.select(*keys).unionByName(source.select(*keys)))
    image = F.struct("__valid_from", "__v", "__gone", "__a", "hashdiff", "__sx")
    # an incoming row replaces a version that starts at the same moment, and takes its key
    chain = (
        split.df.repartition(*split.parts)
        .groupBy(*split.parts, "__us")
        .agg(F.max_by(image, F.struct("__v", "__gone", "hashdiff")).alias("m"), F.max("__o").alias("__o"))
        .select(*split.parts, "__us", "m.*", "__o")
    )
    # a skeleton takes the attributes in force at its start, else those that come next; a row that repeats them is dropped below
    chain = chain.withColumn("__w", F.when(~F.col("__gone") & ~F.col("__sx"), F.struct("__a", "hashdiff")))
    around = neighbours(chain, split, ["__us"], lag={"__lag_w": "__w"}, lead={"__lead_w": "__w"})
    fill = F.when(F.col("__sx"), F.coalesce("__lag_w", "__lead_w"))
    filled = around.select(
        *split.parts, "__us", "__valid_from", "__gone", F.coalesce(fill["__a"], F.col("__a")).alias("__a"), F.coalesce(fill["hashdiff"], F.col("hashdiff")).alias("hashdiff"), (F.col("__sx") & fill.isNull()).alias("__sx"), "__o",
    )
    filled = filled.withColumn("__until", F.col("__o.until"))
    seen = neighbours(filled, split, ["__us"], lag={"__before": "hashdiff", "__before_gone": "__gone", "__before_until": "__until"})
    in_force = F.col("__before_until").isNull() | (F.col("__before_until") > F.col("__valid_from"))
    known = F.col("__o.sk").isNotNull()
    repeated = (F.col("__before") == F.col("hashdiff")) & ~F.col("__before_gone") & in_force & ~known & ~F.col("__gone")
    again = F.col("__gone") & F.col("__before").isNull()
    kept = seen.filter(~F.coalesce(repeated, F.lit(False)) & ~F.coalesce(again, F.lit(False))).drop("__before", "__before_gone", "__before_until")
    closed = neighbours(kept, split, ["__us"], lead={"__next": "__valid_from", "__next_gone": "__gone"}).filter(~F.col("__gone"))
    forever = F.lit(VALID_TO).cast(kind)
    end = F.least(F.coalesce(F.col("__next"), forever), F.coalesce(F.col("__o.until"), forever))
    deleted = F.coalesce(F.col("__next_gone"), F.lit(False)) | F.coalesce(F.col("__o.gone"), F.lit(False))
    now = F.col("__next").isNull() & F.coalesce(F.col("__o.now"), F.lit(True))
    merged = closed.select(
        *keys, *[F.col(f"__a.`{c}`").alias(c) for c in attributes], "__valid_from", end.alias("__valid_to"),
        now.alias("__is_current"), deleted.alias("__is_deleted"), F.col("__sx").alias("__is_skeleton"), "hashdiff", F.col("__o.sk").alias("__sk"),
    ).withColumn(sk, F.coalesce(F.col("__sk"), surrogate_key(keys, "__valid_from", strategy)))
    return merged.select(sk, *keys, *attributes, *SYSTEM)


def with_dual_keys(versions: DataFrame, keys: Sequence[str], strategy: str = "xxhash64") -> DataFrame:
    """Type 7: the durable key of the entity, the row key of the version, and the fingerprints of both."""
    return versions.withColumns(dual_keys(list(keys), "__valid_from", strategy))


def key_collisions(rows: DataFrame, key: str, fingerprint: str, incoming: str | None = None) -> DataFrame:
    """Keys with more than one fingerprint, and reserved keys among incoming rows: (key, fingerprints, reserved)."""
    fresh = F.col(incoming) if incoming else F.lit(False)
    found = rows.groupBy(F.col(key).alias("key")).agg(F.count_distinct(fingerprint).alias("fingerprints"), F.max(fresh).alias("incoming"))
    reserved = F.col("key").isin(*MEMBERS) & F.col("incoming")
    return found.filter((F.col("fingerprints") > 1) | reserved).select("key", "fingerprints", reserved.alias("reserved"))


def current_columns(versions: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Type 6: ``current_<c>``, the values of each key's latest version, on all its rows. The latest is a maximum per key, joined back."""
    latest = versions.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(F.max_by(F.struct(*columns), F.col("__valid_from")).alias("__now"))
    on = F.lit(True)
    for k in keys:
        on &= versions[k].eqNullSafe(latest[f"__k_{k}"])
    kept = [c for c in versions.columns if c not in {f"current_{c}" for c in columns}]
    return versions.join(latest, on, "left").select(*[versions[c] for c in kept], *[F.col(f"__now.`{c}`").alias(f"current_{c}") for c in columns])


def attribute_history(history: DataFrame | None, rows: DataFrame, sk: str, fields: Sequence[str], effective: str) -> DataFrame:
    """Type 4: the attribute history (surrogate_key, field, value, valid_from, valid_to, __is_current) after ``rows`` took effect.

    Of several rows of a key the one that takes effect last counts. A field whose value differs from its open row (NULL counts as a value) closes it one
    microsecond before and opens a new one, until 9999-12-31 23:59:59. Closed rows and fields without a change stay.
    """
    kind = rows.schema[effective].dataType
    rows = rows.groupBy(sk).agg(F.max_by(F.struct(effective, *[f for f in fields if f != effective]), F.struct(effective, *[F.col(f).cast("string") for f in fields])).alias("__r")).select(sk, "__r.*")
    new = rows.select(F.col(sk).alias("surrogate_key"), F.col(effective).alias("__at"), *[F.col(f).cast("string").alias(f) for f in fields]).unpivot(["surrogate_key", "__at"], list(fields), "field", "value")
    forever = F.lit("9999-12-31 23:59:59").cast(kind)
    if history is None:
        return new.select("surrogate_key", "field", "value", F.col("__at").alias("valid_from"), forever.alias("valid_to"), F.lit(True).alias("__is_current"))
    columns = ["surrogate_key", "field", "value", "valid_from", "valid_to", "__is_current"]
    closed, opened = history.filter("NOT __is_current").select(*columns), history.filter("__is_current").select(*columns)
    both = full_outer(opened.select("surrogate_key", "field", F.struct("value", "valid_from", "valid_to").alias("o")), new.select("surrogate_key", "field", F.struct("value", "__at").alias("n")), ["surrogate_key", "field"])
    same = F.col("n").isNull() | (F.col("o").isNotNull() & F.col("n.value").eqNullSafe(F.col("o.value")))
    row = lambda value, a, b, now: F.struct(value.alias("value"), a.alias("valid_from"), b.alias("valid_to"), F.lit(now).alias("__is_current"))
    kept = F.array(row(F.col("o.value"), F.col("o.valid_from"), F.col("o.valid_to"), True))
    ended = F.array(row(F.col("o.value"), F.col("o.valid_from"), F.col("n.__at") - F.expr("INTERVAL 1 MICROSECOND"), False))
    begun = F.array(row(F.col("n.value"), F.col("n.__at"), forever, True))
    out = both.withColumn("x", F.explode(F.when(same, kept).when(F.col("o").isNull(), begun).otherwise(F.concat(ended, begun))))
    return closed.unionByName(out.select("surrogate_key", "field", "x.*"))


def default_members(spark: SparkSession, schema: T.StructType, sk: str, overrides: dict[str, object] | None = None) -> DataFrame:
    """The reserved members -1 to -4 as rows of ``schema``: labels in texts, the key in numbers, dates a day apart, current for ever; ``overrides``: column -> value."""
    given = overrides or {}
    out = spark.createDataFrame([(k, label, STATUS[k]) for k, label in MEMBERS.items()], "__key int, __label string, __status string")
    columns = []
    for f in schema:
        c, kind = f.name, f.dataType
        if c in given:
            value = F.lit(given[c])
        elif c == "__member_status":
            value = F.col("__status")
        elif c == "__valid_to":
            value = F.lit(VALID_TO)
        elif c == "__valid_from":
            value = F.lit(VALID_FROM)
        elif isinstance(kind, T.BooleanType):
            value = F.lit(c == "__is_current")
        elif isinstance(kind, T.StringType):
            value = F.col("__label")
        elif isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            value = F.date_add(F.lit("1900-01-01").cast("date"), F.abs("__key") - 1)
        elif isinstance(kind, T.NumericType):
            value = F.col("__key") if c == sk or not c.startswith("__") else F.lit(None)
        else:
            value = F.lit(None)
        columns.append(value.cast(kind).alias(c))
    return out.select(*columns)


def seeded(dimension: DataFrame, sk: str, overrides: dict[str, object] | None = None) -> DataFrame:
    """The dimension with its reserved members; those it has already are not added again."""
    members = default_members(dimension.sparkSession, dimension.schema, sk, overrides)
    have = dimension.filter(F.col(sk).isin(*MEMBERS)).select(sk)  # four rows at most
    return dimension.unionByName(members.join(have, sk, "left_anti"))


def junk_dimension(facts: DataFrame, columns: Sequence[str], key: str, strategy: str = "xxhash64", existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(dimension, facts with ``key``): the distinct combinations of low-cardinality columns under a hash key. Combinations that exist already are kept as they are."""
    combos = facts.select(junk_key(columns, strategy).alias(key), *columns).distinct()
    if existing is not None:
        combos = existing.select(key, *columns).unionByName(combos.join(existing.select(key), key, "left_anti"))
    return combos, facts.withColumn(key, junk_key(columns, strategy))


def junk_collisions(dimension: DataFrame, facts: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Keys of ``dimension`` that ``facts`` use for another combination."""
    combo = lambda: F.concat_ws("\u0000", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_JUNK)) for c in columns])
    a, b = dimension.select(key, combo().alias("a")), facts.select(key, combo().alias("b")).distinct()
    return a.join(b, key).filter("a <> b").select(key).distinct()


def drop_meta(df: DataFrame) -> DataFrame:
    return df.drop(*META)
