"""Data quality and supplier contracts: rules as counts, fused into few passes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.keys import MEMBERS
from orrery.operators.hot import neighbours, split_hot

_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|merge|grant|revoke)\b|;", re.I)


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n): the key values that occur more than once. NULL is a value. Counts are combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def top_duplicates(df: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k most repeated key values; equal counts in the order of the keys."""
    return duplicate_groups(df, keys).orderBy(F.desc("n"), *keys).limit(k)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows with a value that is not accepted. NULL passes."""
    return df.filter(~F.col(column).isin(*values))


def relationships(df: DataFrame, column: str, to: DataFrame, field_: str, *, current_only: bool = True) -> DataFrame:
    """Rows whose key is in no row of ``to``. NULL and reserved members pass; of versioned dimensions only current rows count unless told otherwise."""
    if current_only and "__is_current" in to.columns:
        to = to.filter("__is_current")
    known = to.select(F.col(field_).alias("__known")).distinct()
    rows = df.filter(F.col(column).isNotNull() & ~F.col(column).cast("string").isin(*[str(m) for m in MEMBERS]))
    return rows.join(known, F.col(column) == F.col("__known"), "left_anti")


def orphan_keys(facts: DataFrame, fk: str, dimension: DataFrame, sk: str) -> DataFrame:
    """Distinct foreign keys without a dimension row, reserved members excluded."""
    keys = facts.select(F.col(fk).alias("key")).filter(F.col("key").isNotNull() & ~F.col("key").isin(*MEMBERS)).distinct()
    return keys.join(dimension.select(F.col(sk).alias("key")).distinct(), "key", "left_anti")


def expression(df: DataFrame, rule: str) -> DataFrame:
    """Rows for which the SQL condition is false (NULL passes). ValueError if it contains anything but a condition."""
    if _FORBIDDEN.search(re.sub(r"'(?:[^']|'')*'", "", rule)):
        raise ValueError(f"not a condition: {rule}")
    return df.filter(~F.expr(rule))


def approximately_unique(df: DataFrame, keys: Sequence[str], ratio: float = 0.99, rsd: float = 0.01) -> DataFrame:
    """One row (total, distinct_ratio, ok): a HyperLogLog sketch instead of a shuffle."""
    n = df.agg(F.count(F.lit(1)).alias("total"), F.approx_count_distinct(F.struct(*keys), rsd).alias("d"))
    share = F.when(F.col("total") > 0, F.col("d") / F.col("total")).otherwise(1.0)
    return n.select("total", share.alias("distinct_ratio"), (share >= ratio).alias("ok"))


@dataclass
class Rule:
    """``kind``: not_null, null_rate (``limit``), accepted_values (``values``), expression (``sql``), unique (``columns``)."""

    name: str
    kind: str
    column: str = ""
    columns: list[str] = field(default_factory=list)
    values: list = field(default_factory=list)
    sql: str = ""
    limit: float = 0.0
    severity: str = "error"


def _fails(rule: Rule) -> Column:
    if rule.kind in ("not_null", "null_rate"):
        return F.col(rule.column).isNull()
    if rule.kind == "accepted_values":
        return ~F.col(rule.column).isin(*rule.values)
    if rule.kind == "expression":
        if _FORBIDDEN.search(re.sub(r"'(?:[^']|'')*'", "", rule.sql)):
            raise ValueError(f"not a condition: {rule.sql}")
        return ~F.expr(rule.sql)
    raise ValueError(f"unknown rule {rule.kind!r}")


def scalar_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, failed, total, ok): all rules that look at one row, in one aggregation over one scan."""
    counts = [F.coalesce(F.sum(F.when(_fails(r), 1)), F.lit(0)).cast("bigint").alias(f"r{i}") for i, r in enumerate(rules)]
    row = df.agg(F.count(F.lit(1)).alias("total"), *counts)
    results = []
    for i, r in enumerate(rules):
        ok = (F.col(f"r{i}") <= F.col("total") * r.limit) if r.kind == "null_rate" else F.col(f"r{i}") == 0
        results.append(F.struct(F.lit(r.name).alias("rule"), F.col(f"r{i}").alias("failed"), "total", ok.alias("ok")))
    return row.select(F.explode(F.array(*results)).alias("x")).select("x.*")


def unique_rule(df: DataFrame, columns: Sequence[str], samples: int = 5) -> DataFrame:
    """One row (failed, samples): rows beyond the first of each key, and some of the keys as JSON, the most repeated first."""
    groups = duplicate_groups(df, columns).select("n", F.to_json(F.struct(*columns)).alias("key"))
    total = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("failed"))
    shown = groups.orderBy(F.desc("n"), "key").limit(samples).agg(F.collect_list("key").alias("samples"))  # at most ``samples`` rows
    return total.join(F.broadcast(shown), F.lit(True), "left")


def plan_actions(rules: Sequence[Rule], max_actions: int) -> list[Rule]:
    """The rules that fit the budget: one action for all scalar rules, one for each unique rule. The others are left out; ``run_rules`` with ``max_actions`` refuses instead."""
    scalars, uniques = [r for r in rules if r.kind != "unique"], [r for r in rules if r.kind == "unique"]
    left = max_actions - bool(scalars)
    return [*(scalars if max_actions > 0 else []), *uniques[: max(0, left)]]


def latest_per_key(df: DataFrame, keys: Sequence[str], event_at: str, version: str) -> DataFrame:
    """(keys, max_event, max_version): the state a temporal contract keeps."""
    return df.groupBy(*keys).agg(F.max(event_at).alias("max_event"), F.max(version).alias("max_version"))


def merged_state(state: DataFrame | None, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The state after a batch: never falls."""
    both = batch if state is None else state.unionByName(batch)
    return both.groupBy(*keys).agg(F.max("max_event").alias("max_event"), F.max("max_version").alias("max_version"))


def temporal_findings(df: DataFrame, keys: Sequence[str], event_at: str, version: str, *, now: Column, lateness: str, state: DataFrame | None = None) -> DataFrame:
    """One row (late, disorder, cross_batch): events older than ``now`` - ``lateness``; events older than the one before them in commit order
    (within a commit, in time's order); events older than their key's state. ``version`` is a number; hot keys are cut into pieces (see ``hot``)."""
    split = split_hot(df.withColumn(version, F.coalesce(F.col(version), F.lit(-1)).cast("bigint")), list(keys), version)
    rows = neighbours(split.df, split, [version, event_at], lag={"__prev": event_at})
    if state is not None:
        prior = state.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("max_event").alias("__prior"))
        on = F.lit(True)
        for k in keys:
            on &= rows[k].eqNullSafe(prior[f"__k_{k}"])
        rows = rows.join(prior, on, "left")
    else:
        rows = rows.withColumn("__prior", F.lit(None).cast(df.schema[event_at].dataType))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).cast("bigint")
    at = F.col(event_at)
    return rows.agg(n(at < now - F.expr(f"INTERVAL {lateness}")).alias("late"), n(at < F.col("__prev")).alias("disorder"), n(at < F.col("__prior")).alias("cross_batch"))


def schema_findings(df: DataFrame, expected: dict[str, str], *, required: Sequence[str] = (), mode: str = "additive", cdf: bool = False) -> list[tuple[str, str]]:
    """(code, column) of what differs from a contract: MISSING_COLUMN, TYPE_CHANGED, NULLABLE, UNEXPECTED_COLUMN (unless additive), CDF_METADATA."""
    have = {f.name.lower(): f for f in df.schema}
    found = []
    for name, kind in expected.items():
        f = have.get(name.lower())
        if f is None:
            found.append(("MISSING_COLUMN", name))
        elif f.dataType.simpleString().lower() != kind.lower():
            found.append(("TYPE_CHANGED", name))
        elif name in required and f.nullable and mode == "strict":
            found.append(("NULLABLE", name))
    if mode != "additive":
        found += [("UNEXPECTED_COLUMN", f.name) for k, f in have.items() if k not in {e.lower() for e in expected} and not k.startswith("_")]
    if cdf and not {"_change_type", "_commit_version"} <= set(have):
        found.append(("CDF_METADATA", "_change_type"))
    return found


@dataclass
class Outcome:
    rule: str
    ok: bool
    failed: int | None = None
    severity: str = "error"
    detail: str | None = None


class QualityError(ValueError):
    """An error-level rule failed."""


def report(outcomes: Sequence[Outcome]) -> dict[str, list[str]]:
    """Failed rules by severity; QualityError if one of them is an error."""
    bad = {s: [o.rule for o in outcomes if not o.ok and o.severity == s] for s in ("error", "warn")}
    if bad["error"]:
        raise QualityError(", ".join(bad["error"]))
    return bad


def run_rules(df: DataFrame, rules: Sequence[Rule], max_actions: int | None = None) -> list[Outcome]:
    """The outcome of every rule: one action for all scalar rules, one for each unique rule. ValueError, before any action, if they need more than ``max_actions``."""
    scalars = [r for r in rules if r.kind != "unique"]
    needed = bool(scalars) + len(rules) - len(scalars)
    if max_actions is not None and needed > max_actions:
        raise ValueError(f"the rules need {needed} actions, more than max_actions={max_actions}")
    out = []
    if scalars:
        level = {r.name: r.severity for r in scalars}
        out += [Outcome(r["rule"], r["ok"], r["failed"], level[r["rule"]]) for r in scalar_rules(df, scalars).collect()]
    for r in rules:
        if r.kind == "unique":
            failed = duplicate_groups(df, r.columns).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("f")).first()["f"]
            out.append(Outcome(r.name, failed == 0, int(failed), r.severity))
    return out
