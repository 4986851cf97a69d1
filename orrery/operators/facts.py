"""Fact keys: lookups at event time, inferred members, identity maps, evidence of what stays unresolved; and fact snapshots."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.keys import MEMBERS, VALID_TO, business_key_hash, business_key_json, dual_keys, placeholder, reserved_member, surrogate_key
from orrery.functions.times import OPEN_END_US
from orrery.operators.asof import interval_join
from orrery.operators.dimensions import SYSTEM, moment_us
from orrery.operators.feed import full_outer
from orrery.operators.hot import CHUNK, LEAST, SHARE, key_hash, neighbours, split_hot
from orrery.runtime import broadcast_if_small, cut


class UnresolvedKeys(ValueError):
    """Facts refer to members that a relationship's policy doesn't accept."""


def _us(df: DataFrame, column: str) -> Column:
    """BIGINT of a moment: a number as it is, dates and timestamps in microseconds."""
    return F.col(column).cast("bigint") if isinstance(df.schema[column].dataType, T.NumericType) else moment_us(df, column)


def _during(facts: DataFrame, versions: DataFrame, on: dict[str, str], event_at: str, start: str, end: str, carry: Sequence[str], how: str) -> DataFrame:
    """``interval_join`` of facts with versions valid from ``start`` until before ``end``."""
    return interval_join(facts, versions, on=on, at=_us(facts, event_at), start=_us(versions, start), end=_us(versions, end), carry=carry, how=how)


def resolve_keys(facts: DataFrame, dimension: DataFrame, natural: dict[str, str], keys: dict[str, str], *, event_at: str | None = None, start: str = "__valid_from", end: str = "__valid_to", not_applicable: Column | None = None, invalid: Column | None = None) -> DataFrame:
    """Facts with their dimension keys: ``natural`` maps fact columns to the dimension's, ``keys`` new fact columns to its key columns.

    With ``event_at`` the version valid at that moment (half-open) is taken, by ``interval_join``: a fact meets few versions of its member, however many there are. Else the dimension has one row per natural key. Facts without
    a match get a reserved member: -2 not applicable, -1 a natural key is NULL, -4 blank or ``invalid``, -3 not there (yet), in this order.
    A hot natural key is a skewed partition of the facts, which adaptive execution splits.
    """
    names = {f: f"__key_{i}" for i, f in enumerate(keys)}
    if event_at:
        versions = dimension.select(*dict.fromkeys(natural.values()), F.col(start).alias("__ds"), F.col(end).alias("__de"), *[F.col(d).alias(names[f]) for f, d in keys.items()])
        joined = _during(facts, versions, natural, event_at, "__ds", "__de", list(names.values()), "left")
    else:
        side = dimension.select(*[F.col(d).alias(f"__d_{d}") for d in dict.fromkeys(natural.values())], *[F.col(d).alias(names[f]) for f, d in keys.items()])
        joined = facts.join(side, _equal(facts, natural, side), "left")
    kept = [F.col(c) for c in facts.columns if c not in keys]
    return joined.select(*kept, *[reserved_member(F.col(names[f]), natural=list(natural), not_applicable=not_applicable, invalid=invalid).alias(f) for f in keys])


def _equal(left: DataFrame, natural: dict[str, str], right: DataFrame) -> Column:
    """The natural keys are equal; the right side's are called ``__d_<name>``."""
    return reduce(Column.__and__, [left[f] == right[f"__d_{d}"] for f, d in natural.items()])


def enforce(resolved: DataFrame, key: str, *, early_arriving: str = "default", invalid_action: str = "default") -> DataFrame:
    """``resolved`` itself; UnresolvedKeys if the policy is ``error`` and a member -3 (early) or -4 (bad value) occurs. Looks for one row only."""
    for policy, member in ((early_arriving, -3), (invalid_action, -4)):
        if policy == "error" and not resolved.filter(F.col(key) == member).limit(1).isEmpty():
            raise UnresolvedKeys(f"{key}: facts with member {member} ({MEMBERS[member]})")
    return resolved


def canonical_ids(facts: DataFrame, identities: DataFrame, column: str, event_at: str) -> DataFrame:
    """``column`` replaced by the canonical identity valid at the event, where the map (source_identity, canonical_identity, valid_from, valid_to) has one."""
    m = identities.select(F.col("source_identity").alias("__si"), F.col("canonical_identity").alias("__ci"), F.col("valid_from").alias("__vf"), F.col("valid_to").alias("__vt"))
    joined = _during(facts, m, {column: "__si"}, event_at, "__vf", "__vt", ["__ci"], "left")
    return joined.select(*[F.coalesce("__ci", c).alias(c) if c == column else c for c in facts.columns])


def identity_overlaps(identities: DataFrame, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """Faulty rows of an identity map: (source_identity, valid_from, problem): NULLs, empty validity, overlap with a row that starts before (or with it and ends no later), or a chain (the canonical id is mapped itself).

    A running maximum of the ends tells overlaps. Hot identities are cut into pieces; a piece goes on from the largest end before it.
    """
    from pyspark.sql import Window

    rows = identities.withColumns({"__from": _us(identities, "valid_from"), "__to": _us(identities, "valid_to")})
    rows = rows.withColumn("__order", F.coalesce("__from", F.lit(-(2**63) + 1).cast("bigint")))
    split = split_hot(rows, ["source_identity"], "__order", share, least)
    w = Window.partitionBy(*split.parts).orderBy(F.col("__order"), F.col("__to")).rowsBetween(Window.unboundedPreceding, -1)
    rows = split.df.withColumn("__latest", F.max("__to").over(w))
    if split.hot:
        piece = split.df.filter(key_hash(split.keys).isin(split.hot)).groupBy(*split.parts).agg(F.max("__to").alias("__m"))
        before = Window.partitionBy(*split.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)  # a row per piece
        carried = cut(piece.select(*[F.col(p).alias(f"__p_{p}") for p in split.parts], F.max("__m").over(before).alias("__before")), "pieces")
        same = reduce(Column.__and__, [F.col(p).eqNullSafe(F.col(f"__p_{p}")) for p in split.parts])
        rows = rows.join(broadcast_if_small(carried), same, "left").withColumn("__latest", F.greatest("__latest", "__before"))
    mapped = identities.select(F.col("source_identity").alias("__mapped")).distinct()
    rows = rows.join(mapped, F.col("canonical_identity") == F.col("__mapped"), "left")
    nulls = F.col("source_identity").isNull() | F.col("canonical_identity").isNull() | F.col("valid_from").isNull() | F.col("valid_to").isNull()
    problem = F.when(nulls, "null").when(F.col("__to") <= F.col("__from"), "empty").when(F.col("__from") < F.col("__latest"), "overlap").when(F.col("__mapped").isNotNull(), "chain")
    return rows.select("source_identity", "valid_from", problem.alias("problem")).filter("problem IS NOT NULL")


def version_gaps(dimension: DataFrame, keys: Sequence[str], share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(keys, __gap_from, __gap_to): the times (BIGINT, half-open, NULL without bound) at which a member of a versioned dimension has no version, and ``__until``, when its next version starts."""
    us = dimension.filter(F.col("__valid_from").isNotNull()).select(*keys, _us(dimension, "__valid_from").alias("__from"), _us(dimension, "__valid_to").alias("__to"), F.col("__valid_from").alias("__start"))
    split = split_hot(us, list(keys), "__from", share, least)
    rows = neighbours(split.df, split, ["__from", "__to"], lag={"__prev": "__from"}, lead={"__next": "__from", "__next_start": "__start"})
    low, none = F.lit(-(2**62)).cast("bigint"), F.lit(None).cast("bigint")
    gap = lambda a, b, until: F.struct(a.alias("__gap_from"), b.alias("__gap_to"), until.alias("__until"))
    before = F.when(F.col("__prev").isNull(), gap(low, F.col("__from"), F.col("__start")))
    open_end = F.lit(OPEN_END_US).cast("bigint")
    after = F.when(F.col("__next").isNull(), F.when(F.col("__to") < open_end, gap(F.col("__to"), none, F.lit(None).cast(dimension.schema["__valid_from"].dataType)))).when(F.col("__next") > F.col("__to"), gap(F.col("__to"), F.col("__next"), F.col("__next_start")))
    return rows.select(*keys, F.explode(F.array_compact(F.array(before, after))).alias("g")).select(*keys, "g.*")


def missing_members(facts: DataFrame, dimension: DataFrame, natural: dict[str, str], event_at: str | None = None, first: str | None = None) -> DataFrame:
    """Identities in facts that the dimension lacks: (the dimension's natural columns, __first, with ``event_at`` also __until). NULL and blank ones are none.

    Without ``event_at`` an identity is missing if the dimension has no row of it; ``__first`` is the least ``first`` column of its facts. With ``event_at`` every event is looked at: an
    identity comes out once for each time without a version in which it has events, with the first of them and the moment at which its next version starts (NULL: none does).
    """
    usable = F.lit(True)
    for f in natural:
        usable &= F.col(f).isNotNull() & (F.trim(F.col(f).cast("string")) != "")
    names = list(natural.values())
    at = F.col(event_at or first) if event_at or first else F.lit(None).cast("timestamp_ntz")
    events = facts.filter(usable).select(*[F.col(f).alias(d) for f, d in natural.items()], at.alias("__at"))
    known = dimension.select(*[F.col(d).alias(f"__d_{d}") for d in names]).distinct()
    firsts = events.groupBy(*names).agg(F.min("__at").alias("__first"))
    unknown = firsts.join(known, _equal(firsts, {d: d for d in names}, known), "left_anti")
    if not event_at:
        return unknown
    gaps = version_gaps(dimension, names)
    inside = interval_join(events.filter("__at IS NOT NULL").distinct(), gaps, on={d: d for d in names}, at=_us(events, "__at"), start=F.col("__gap_from"), end=F.col("__gap_to"), carry=["__gap_from", "__until"], moments=events.select(_us(events, "__at")))
    early = inside.groupBy(*names, "__gap_from").agg(F.min("__at").alias("__first"), F.max("__until").alias("__until"))
    return early.select(*names, "__first", "__until").unionByName(unknown.withColumn("__until", F.lit(None).cast(early.schema["__until"].dataType)))


def skeletons(missing: DataFrame, dimension: DataFrame, natural: Sequence[str], sk: str, *, strategy: str = "xxhash64", versioned: bool = True, durable: str = "durable_key") -> DataFrame:
    """One inferred member per row of ``missing_members``, as rows of the dimension: typed placeholders, valid from its first event on until the member's next version starts; current only if none does. Dual-key dimensions get both keys and their fingerprints."""
    until = F.col("__until") if "__until" in missing.columns else F.lit(None)
    kind = dimension.schema["__valid_to"].dataType if "__valid_to" in dimension.columns else T.StringType()
    key, dual = surrogate_key(list(natural), "__first" if versioned else None, strategy), {}
    if "row_fingerprint" in dimension.columns:
        first = missing.withColumn("__first", F.col("__first").cast(dimension.schema["__valid_from"].dataType))
        missing, made = first, dual_keys(list(natural), "__first", strategy)
        key = made["row_key"]
        dual = {durable: made["durable_key"], "durable_fingerprint": made["durable_fingerprint"], "row_fingerprint": made["row_fingerprint"]}
    fixed = dual | {sk: key, "__valid_from": F.col("__first"), "__valid_to": F.coalesce(until.cast(kind), F.lit(VALID_TO).cast(kind)), "__is_current": until.isNull(), "__is_deleted": F.lit(False), "__is_skeleton": F.lit(True), "__member_status": F.lit("NOT_YET_AVAILABLE"), "__key_origin": F.lit("skeleton"), "hashdiff": F.lit(None)}
    columns = []
    for f in dimension.schema:
        value = F.col(f.name) if f.name in natural else fixed.get(f.name)
        columns.append((placeholder(f.dataType) if value is None else value.cast(f.dataType)).alias(f.name))
    return missing.select(*columns)


def hydrate(dimension: DataFrame, source: DataFrame, keys: Sequence[str], attributes: Sequence[str]) -> DataFrame:
    """Skeletons whose real row has arrived get its attributes in place; keys and validity stay. ``source`` has one row per key."""
    real = source.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.struct(*attributes).alias("__real"))
    on = dimension["__is_skeleton"]
    for k in keys:
        on &= dimension[k] == real[f"__k_{k}"]
    joined = dimension.join(real, on, "left")
    out = []
    for c in dimension.columns:
        if c in attributes:
            out.append(F.when(F.col("__real").isNotNull(), F.col(f"__real.`{c}`")).otherwise(dimension[c]).alias(c))
        elif c == "__is_skeleton":
            out.append((dimension[c] & F.col("__real").isNull()).alias(c))
        else:
            out.append(dimension[c])
    return joined.select(*out)


def fanout(facts: DataFrame, dimension: DataFrame, natural: dict[str, str], grain: Sequence[str], event_at: str | None = None) -> DataFrame:
    """(grain, matches): facts that more than one dimension row matches under the whole condition, ``grain`` naming a fact. Without a moment the dimension's rows are counted per key first, so no pairs arise."""
    if event_at is None:
        counts = dimension.groupBy(*[F.col(d).alias(f"__d_{d}") for d in natural.values()]).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
        return facts.join(counts, _equal(facts, natural, counts)).groupBy(*grain).agg(F.sum("__n").alias("matches"))
    versions = dimension.select(*dict.fromkeys(natural.values()), F.col("__valid_from").alias("__ds"), F.col("__valid_to").alias("__de"))
    return _during(facts, versions, natural, event_at, "__ds", "__de", [], "inner").groupBy(*grain).agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1")


def unmatched_identities(resolved: DataFrame, natural: Sequence[str], key: str) -> dict[str, int]:
    """The opt-in check of a resolution: distinct usable identities in the facts, and those of facts that got a key; {"given": n, "resolved": m}. Exact; counted per identity first."""
    usable = F.lit(True)
    for c in natural:
        usable &= F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")
    ok = F.max((~F.col(key).isin(*MEMBERS)).cast("int")).alias("ok")
    row = resolved.filter(usable & (F.col(key) != -2)).groupBy(*natural).agg(ok).agg(F.count(F.lit(1)).alias("given"), F.coalesce(F.sum("ok"), F.lit(0)).alias("resolved")).first()
    return {"given": row["given"], "resolved": row["resolved"]}


def resolution_stats(resolved: DataFrame, key: str) -> DataFrame:
    """One row: total, resolved (not a reserved member; hashed keys may be negative), rate."""
    ok = ~F.col(key).isin(*MEMBERS)
    stats = resolved.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(ok.cast("bigint")), F.lit(0)).alias("resolved"))
    return stats.withColumn("rate", F.when(F.col("total") > 0, F.col("resolved") / F.col("total")).otherwise(1.0))


def unresolved_registry(registry: DataFrame | None, resolved: DataFrame, *, fact: str, relationship: str, grain: Sequence[str], key: str, batch: str) -> DataFrame:
    """Evidence (fact, relationship, grain_hash, grain_json, member, status, opened_batch, closed_batch) after a batch.

    Facts with member -3 or -4 open (or reopen) an entry; entries whose fact now has a key are RESOLVED; others stay.
    Of several facts of one grain an unresolved one counts, the bad value first.
    """
    rank = F.when(F.col("member") == -4, 2).when(F.col("member") == -3, 1).otherwise(0)
    rows = resolved.select(F.lit(fact).alias("fact"), F.lit(relationship).alias("relationship"), business_key_hash(list(grain)).alias("grain_hash"), business_key_json(list(grain)).alias("grain_json"), F.col(key).alias("member"))
    rows = rows.groupBy("fact", "relationship", "grain_hash").agg(F.max(F.struct(rank.alias("rank"), "member", "grain_json")).alias("m")).select("fact", "relationship", "grain_hash", "m.grain_json", "m.member")
    open_now = F.col("n.member").isin(-3, -4)
    keys = ["fact", "relationship", "grain_hash"]
    new = rows.select(*keys, F.struct("grain_json", "member").alias("n"))
    if registry is None:
        return new.filter(open_now).select(*keys, "n.grain_json", F.col("n.member").alias("member"), F.lit("OPEN").alias("status"), F.lit(batch).alias("opened_batch"), F.lit(None).cast("string").alias("closed_batch"))
    old = registry.select(*keys, F.struct("grain_json", "member", "status", "opened_batch", "closed_batch").alias("o"))
    both = full_outer(old, new, keys).filter(F.col("o").isNotNull() | open_now)
    closes = F.col("o").isNotNull() & F.col("n").isNotNull() & ~open_now & (F.col("o.status") == "OPEN")
    opens = F.col("n").isNotNull() & open_now
    again = opens & (F.col("o").isNull() | (F.col("o.status") != "OPEN"))
    return both.select(
        *keys, F.coalesce("o.grain_json", "n.grain_json").alias("grain_json"), F.when(opens, F.col("n.member")).otherwise(F.col("o.member")).alias("member"),
        F.when(opens, "OPEN").when(closes, "RESOLVED").otherwise(F.col("o.status")).alias("status"), F.when(again, batch).otherwise(F.col("o.opened_batch")).alias("opened_batch"),
        F.when(opens, F.lit(None)).when(closes, batch).otherwise(F.col("o.closed_batch")).alias("closed_batch"),
    )


def as_is(facts: DataFrame, dimension: DataFrame, durable: str, durable_key: str = "durable_key") -> DataFrame:
    """Facts with the entity's current version (joined on the durable key)."""
    now = dimension.filter("__is_current").drop(*[c for c in SYSTEM if c in dimension.columns])
    return facts.join(now, facts[durable] == now[durable_key], "left")


def as_was(facts: DataFrame, dimension: DataFrame, row: str, row_key: str) -> DataFrame:
    """Facts with the version they were resolved to (joined on the row key)."""
    then = dimension.drop(*[c for c in SYSTEM if c in dimension.columns])
    return facts.join(then, facts[row] == then[row_key], "left")


def accumulate(target: DataFrame, source: DataFrame, keys: Sequence[str], milestones: Sequence[str]) -> DataFrame:
    """An accumulating snapshot: milestones once reached stay, missing ones are filled; rows match on keys."""
    both = full_outer(target.select(*keys, F.struct(*milestones).alias("t")), source.select(*keys, F.struct(*milestones).alias("s")), keys)
    return both.select(*keys, *[F.coalesce(F.col(f"t.`{m}`"), F.col(f"s.`{m}`")).alias(m) for m in milestones])


def periodic_snapshot(facts: DataFrame, by: Sequence[str], event_at: str, period: str, measures: dict[str, Column]) -> DataFrame:
    """One row per ``by`` columns and ``period`` (day, week, month, quarter or year, the date it begins with, column ``period``) with ``measures`` (name -> aggregate). Facts without a date belong to the period NULL."""
    start = F.trunc(F.col(event_at).cast("date"), period) if period != "day" else F.col(event_at).cast("date")
    return facts.groupBy(*by, start.alias("period")).agg(*[m.alias(n) for n, m in measures.items()])


def roll_up(df: DataFrame, by: Sequence[str], measures: dict[str, tuple[str, str]], period: str | None = None, members: Sequence[str] = ()) -> DataFrame:
    """Measures by dimensions: name -> (aggregation, additivity). ValueError for a sum of a non-additive measure.

    A semi-additive measure is not summed over ``period``: of each group's rows only those of its last period count, or, where ``members`` name what a balance belongs to (an
    account, an item), each member's own last period, so that a member which the group's last period lacks still counts.
    """
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct}
    for name, (how, kind) in measures.items():
        if how == "sum" and kind == "non_additive":
            raise ValueError(f"{name} is not additive and can't be summed")
        if how == "sum" and kind == "semi_additive" and period is None:
            raise ValueError(f"{name} is semi-additive: name the period")
    semi = [m for m, (how, kind) in measures.items() if how == "sum" and kind == "semi_additive"]
    if not semi:
        return df.groupBy(*by).agg(*[agg[how](m).alias(m) for m, (how, _) in measures.items()])
    per = df.groupBy(*by, *members, period).agg(*[F.sum(m).alias(m) for m in semi])
    latest = per.groupBy(*by, *members).agg(*[F.max_by(m, period).alias(m) for m in semi])
    if members:
        latest = latest.groupBy(*by).agg(*[F.sum(m).alias(m) for m in semi])
    rest = [(m, how) for m, (how, _) in measures.items() if m not in semi]
    if rest:
        whole = df.groupBy(*by).agg(*[agg[how](m).alias(m) for m, how in rest])
        latest = full_outer(latest, whole, list(by))
    return latest.select(*by, *measures)
