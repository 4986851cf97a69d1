"""Running a table definition: plan sources, load, check contracts, transform, resolve keys, check, merge, commit, keep evidence, move the watermark."""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.keys import surrogate_key
from orrery.operators import dimensions as dim
from orrery.operators import facts as fct
from orrery.operators import feed as fd
from orrery.operators import quality as dq
from orrery.plans.config import Source, TableSpec, seconds
from orrery.plans.contracts import contract_outcomes
from orrery.plans.control import ControlTable, recover
from orrery.plans.evidence import Checkpoints, Evidence, Metrics
from orrery.plans.retry import attempt
from orrery.runtime import cut, scratch
from orrery.sources.scans import empty_like, scan
from orrery.sources.versioned import VersionedTable


@dataclass
class SourcePlan:
    """What a run reads of a source: versions ``start`` to ``end``, or all of it; nothing if it is caught up."""

    alias: str
    name: str
    full: bool
    active: bool
    start: int | None = None
    end: int | None = None


@dataclass
class Result:
    table: str
    status: str
    batch: str = ""
    version: int | None = None
    metrics: dict = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    error: str | None = None


@dataclass
class _Batch:
    """What a run gathers on its way to the commit: rows of other tables, published once the checks are through, and what is kept of it after the commit."""

    id: str
    pending: list[tuple[str, DataFrame]] = field(default_factory=list)
    after: list[Callable[[], None]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metrics: Metrics = field(default_factory=Metrics)


class Warehouse:
    """Where a project's tables live: a folder per table below ``root``, a control table, evidence of quality, unresolved keys and the latest events of temporal contracts.

    ``tries`` and ``wait``: how often a run that meets a passing failure is tried, and the seconds before the second try. ``notify`` gets failed rules.
    """

    def __init__(self, spark: SparkSession, root: str, *, secrets: dict[str, str] | None = None, strategy: str = "xxhash64", tries: int = 3, wait: float = 30.0, evidence_failure: str = "warn", notify: Callable[[list[dict]], None] | None = None):
        self.spark, self.root, self.secrets, self.strategy, self.tries, self.wait = spark, root.rstrip("/"), secrets or {}, strategy, tries, wait
        self.control = ControlTable(spark, f"{self.root}/etl_control")
        self.evidence = Evidence(spark, f"{self.root}/etl_quality_events", on_failure=evidence_failure, notify=notify)

    def path(self, name: str) -> str:
        return name if "/" in name else f"{self.root}/{name}"

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, self.path(name))

    # ------------------------------------------------------------ one run

    def plan(self, spec: TableSpec) -> list[SourcePlan]:
        """A full source is always read; a feed from the version after its watermark to its latest, one version only if all changes are preserved."""
        out = []
        for s in spec.sources:
            if s.cdc_strategy == "full":
                out.append(SourcePlan(s.alias, s.name, True, True, end=self._latest(s)))
                continue
            mark = self.control.watermark(spec.table_name, s.name)
            start = mark + 1 if mark is not None else (s.starting_version or 0)
            latest = self._latest(s)
            latest = -1 if latest is None else latest
            end = min(start, latest) if spec.preserve_all_changes else latest
            out.append(SourcePlan(s.alias, s.name, False, start <= latest, start, end))
        return out

    def _latest(self, source) -> int | None:
        return self.table(source.name).latest() if source.format == "versioned" else None

    def load(self, spec: TableSpec, plan: list[SourcePlan]) -> dict[str, DataFrame]:
        out = {}
        for s, p in zip(spec.sources, plan, strict=True):
            if p.full:
                out[s.alias] = scan(self.spark, self.path(s.name) if s.format == "versioned" else s.name, s.format, s.options)
                continue
            table = self.table(s.name)
            rows = table.changes(p.start, p.end) if p.active else empty_like(self.spark, table.change_schema())
            rows = rows.filter("_change_type <> 'update_preimage'")
            out[s.alias] = fd.append_rows(rows) if s.cdc_strategy == "append" else fd.dedup_delete_wins(rows, s.primary_keys) if p.active else rows
        return out

    def run(self, spec: TableSpec, *, full_reload: bool = False) -> Result:
        """Run a table until it is caught up; with ``full_reload`` from nothing. Failures are recorded and raised; passing ones are tried again.

        Where all changes are preserved each commit of the source is a run of its own, up to the last one there was at the start.
        """
        if full_reload:
            return self._reload(spec)
        recover(self.control, self.table(spec.table_name), spec.table_name)
        result = attempt(lambda: self._run_once(spec), self.tries, self.wait)
        goal = {s.name: self._latest(s) for s in spec.sources}
        while spec.preserve_all_changes and any(p.active and not p.full and p.start <= (goal[p.name] or 0) for p in self.plan(spec)):
            more = attempt(lambda: self._run_once(spec), self.tries, self.wait)
            more.warnings = [*result.warnings, *[w for w in more.warnings if w not in result.warnings]]
            result = more
        return result

    def _reload(self, spec: TableSpec) -> Result:
        """The table is built anew beside the old one and takes its place when it is whole: a failure leaves the old one as it was."""
        name = lambda t: f"{t}__reload"
        beside = spec.model_copy(update={"table_name": name(spec.table_name), "history_table": name(spec.history_table) if spec.history_table else None})
        tables = [t for t in (spec.table_name, spec.history_table) if t]
        for t in tables:
            self.table(name(t)).drop()
        self.control.reset(beside.table_name)
        try:
            result = self.run(beside)
        except Exception as e:
            for t in tables:
                self.table(name(t)).drop()
            self.control.reset(beside.table_name)
            self.control.fail(spec.table_name, [s.name for s in spec.sources], f"reload: {type(e).__name__}: {e}")
            raise
        for t in tables:
            self.table(t).replace_with(self.table(name(t)))
        self.control.rename(beside.table_name, spec.table_name)
        result.table = spec.table_name
        return result

    def _run_once(self, spec: TableSpec) -> Result:
        plan = self.plan(spec)
        stale = self._stale(spec)
        if not any(p.active for p in plan):
            return Result(spec.table_name, "SUCCESS", metrics={"skipped": True}, warnings=stale)
        batch, names = uuid.uuid4().hex, [p.name for p in plan]
        self.control.start(spec.table_name, names, batch)
        try:
            with scratch(self.spark):
                sources = self.load(spec, plan)
                # rows missing from the sources may only be taken for deleted if every source is a full snapshot
                result = self.apply(spec, sources, batch, full_snapshot=all(p.full for p in plan))
                schemas = {p.name: hashlib.sha256(sources[p.alias].schema.json().encode()).hexdigest()[:16] for p in plan}
            self.control.complete(spec.table_name, {p.name: p.end for p in plan}, rows_read=result.metrics.get("read"), rows_written=result.metrics.get("written"), config=spec.fingerprint(), schemas=schemas)
            result.warnings += stale
            return result
        except Exception as e:
            self.control.fail(spec.table_name, names, f"{type(e).__name__}: {e}")
            raise

    def _stale(self, spec: TableSpec) -> list[str]:
        """Sources whose latest commit is older than the definition's ``freshness``."""
        if not spec.freshness:
            return []
        found = []
        for s in spec.sources:
            if s.format == "versioned" and self.table(s.name).exists() and time.time() - self.table(s.name).entry().at > seconds(spec.freshness):
                found.append(f"{s.name} is not fresh: its latest commit is older than {spec.freshness}")
        return found

    # ------------------------------------------------------------ transform

    def apply(self, spec: TableSpec, sources: dict[str, DataFrame], batch: str, *, full_snapshot: bool) -> Result:
        """Everything between loaded sources and the commit. Nothing is written to the target before all checks have passed; evidence of failed ones is kept all the same."""
        run = _Batch(batch)
        try:
            with run.metrics.step("contracts"):
                self._contracts(spec, sources, run)
            df = fd.user_sql(self.spark, sources, spec.transformation_sql)
            if fd.lost_change_type(sources, df):
                found = fd.reattach(sources, df)
                run.warnings.append("the transformation lost _change_type: " + ("deletes are not seen" if found is None else "it was taken from the source again"))
                df = df if found is None else found
            df = fd.mask_columns(df, {m.column: m.model_dump() | {"secret": self.secrets.get(m.secret or "", m.secret or "")} for m in spec.pii})
            self._check_output(spec, df)
            with run.metrics.step("transform"):
                df = cut(df, "staged")  # the rows are used several times: they are computed once, in shared storage
        finally:
            for alias in sources:
                self.spark.catalog.dropTempView(alias)
        for j in spec.junk_dimensions:
            old = self.table(j.name).snapshot() if self.table(j.name).exists() else None
            if old is not None and not dim.junk_collisions(old, df, j.columns, j.key).limit(1).isEmpty():
                raise dq.QualityError(f"{j.name}: one key for two combinations")
            combos, df = dim.junk_dimension(df, j.columns, j.key, self.strategy, old)
            run.pending.append((j.name, combos))
        with run.metrics.step("keys"):
            for f in spec.foreign_keys:
                df = self._resolve(spec, f, df, run)
        with run.metrics.step("checks"):
            df = self._gates(spec, df, run)
            run.warnings += self._test(spec, df, run)
        for name, rows in run.pending:
            self._publish(name, rows, batch)
        with run.metrics.step("merge"):
            result = attempt(lambda: self._merge_once(spec, df, batch, full_snapshot), self.tries, self.wait)
        for keep in run.after:
            keep()
        if spec.compact_files is not None and (target := self.table(spec.table_name)).exists() and len(target.entry().folders()) > max(spec.compact_files, spec.buckets):
            target.compact(spec.compact_files)
        if spec.retain_versions is not None:
            self.vacuum(spec.table_name, spec.retain_versions)
        if spec.validate_target:
            run.warnings += dq.report(self.validate(spec, batch))["warn"]
        result.warnings = run.warnings
        result.metrics["seconds"] = {k: round(v, 3) for k, v in run.metrics.steps.items()}
        return result

    def _contracts(self, spec: TableSpec, sources: dict[str, DataFrame], run: _Batch) -> None:
        """The suppliers' contracts: schema, rules, lateness and order. All findings are kept as evidence; QualityError if one of them is an error. The latest events are remembered once the target is committed."""
        outcomes = []
        for s in (s for s in spec.sources if s.contract):
            rows, label = sources[s.alias], f"contract.{s.alias}"
            outcomes += contract_outcomes(s, rows, label)
            if (t := s.contract.temporal) and {*t.keys, t.event_at, "_commit_version"} <= set(rows.columns):
                table = self.table(f"etl_temporal_state__{spec.table_name}__{s.alias}")
                state = table.snapshot(buckets=table.touched(rows)) if table.exists() else None
                events = rows.select(*t.keys, F.col(t.event_at).cast("timestamp").alias("__event"), "_commit_version").filter("__event IS NOT NULL")
                late = dq.temporal_findings(events, t.keys, "__event", "_commit_version", now=F.current_timestamp(), lateness=f"{seconds(t.lateness)} SECONDS", state=state).first()
                outcomes += [dq.Outcome(f"{label}.{kind}", late[kind] == 0, late[kind], t.severity) for kind in ("late", "disorder", "cross_batch")]
                run.after.append(lambda t=t, events=events, table=table: self._remember(table, dq.latest_per_key(events, t.keys, "__event", "_commit_version"), t.keys, run.id))
            elif t:
                raise dq.QualityError(f"{s.name}: a temporal contract needs {', '.join([*t.keys, t.event_at])} and the feed's metadata")
        self._keep(spec, outcomes, run)

    def _keep(self, spec: TableSpec, outcomes: list[dq.Outcome], run: _Batch) -> list[str]:
        """Evidence of outcomes; QualityError if one of them is a failed error, else the warnings."""
        if outcomes:
            self.evidence.record(spec.table_name, run.id, outcomes)
        bad = dq.report(outcomes)["warn"]
        run.warnings += [w for w in bad if w.startswith("contract.")]
        return bad

    def _remember(self, table: VersionedTable, batch: DataFrame, keys: list[str], tag: str) -> None:
        """Merge the latest events of a batch into a temporal contract's state: only the buckets of its keys are rewritten, and no latest event ever falls."""
        if not table.exists():
            table.create(batch.schema, {"buckets": {"by": keys, "n": 16}, "keys": keys})
        batch = cut(batch, "events")

        def once() -> None:
            version, touched = table.latest(), table.touched(batch)
            table.commit(cut(dq.merged_state(table.snapshot(version, touched), batch, keys), "state"), batch=tag, expected=version, operation="temporal state", replace=touched)

        attempt(once, self.tries, self.wait)

    def _gates(self, spec: TableSpec, df: DataFrame, run: _Batch) -> DataFrame:
        """What must hold before a merge: natural keys and null policy of dimensions, one row per key, foreign keys that lead somewhere."""
        if spec.table_type == "dimension":
            if spec.null_policy == "strict":
                if not fd.null_identities(df, spec.natural_keys).limit(1).isEmpty():
                    raise dq.QualityError(f"{spec.table_name}: a natural key is NULL")
                df = fd.null_policy(df, spec.natural_keys, spec.null_substitutes)
            # rows of a feed, and versions, may lawfully repeat a key: they are put in order by the merge
            grain = spec.natural_keys if spec.scd_type in (1, 4) and "_commit_version" not in df.columns else []
        else:
            grain = [] if spec.append_only else spec.merge_keys
        if grain and spec.grain_check != "skip":
            samples = [r["key"] for r in dq.duplicate_groups(df, grain).select(F.to_json(F.struct(*grain)).alias("key")).limit(5).collect()]  # five samples
            if samples and spec.grain_check == "error":
                raise dq.QualityError(f"{spec.table_name}: several rows for one {', '.join(grain)}, such as {'; '.join(samples)}")
            if samples:
                run.warnings.append("grain")
        for f in (f for f in spec.foreign_keys if not f.lookup):
            lost = dq.orphan_keys(df, f.column, self.table(f.references).snapshot(), f.dimension_key).limit(5).collect()
            if lost:
                raise dq.QualityError(f"{spec.table_name}.{f.column}: keys that {f.references} lacks, such as {', '.join(str(r[0]) for r in lost)}")
        return df

    def _check_output(self, spec: TableSpec, df: DataFrame) -> None:
        wanted = {*spec.keys, *spec.degenerate_dimensions, *(m.name for m in spec.measures), *spec.milestones, *spec.track_history_columns}
        wanted |= {c for f in spec.foreign_keys for c in f.lookup} | {c for j in spec.junk_dimensions for c in j.columns} | {f.event_at for f in spec.foreign_keys if f.event_at}
        wanted |= {spec.effective_at} if spec.effective_at else set()
        if missing := sorted(wanted - set(df.columns)):
            raise dq.QualityError(f"{spec.table_name}: the transformation lacks {', '.join(missing)}")

    def _resolve(self, spec: TableSpec, f, df: DataFrame, run: _Batch) -> DataFrame:
        if not f.lookup:
            return df
        dimension = self.table(f.references).snapshot()
        if f.identity_map and f.event_at:
            ids = self.table(f.identity_map).snapshot()
            if bad := fct.identity_overlaps(ids).limit(5).collect():  # five samples
                raise dq.QualityError(f"{f.identity_map}: " + "; ".join(f"{r['source_identity']}: {r['problem']}" for r in bad))
            for column in f.lookup:
                df = fct.canonical_ids(df, ids, column, f.event_at)
        if f.early_arriving == "skeleton":
            missing = fct.missing_members(df, dimension, f.lookup, f.event_at if "__valid_from" in dimension.columns else None, f.event_at)
            made = cut(fct.skeletons(missing, dimension, list(f.lookup.values()), f.dimension_key, strategy=self.strategy, versioned="__valid_from" in dimension.columns, durable=f.dimension_durable_key), "skeletons")
            run.pending.append((f.references, made))
            dimension = dimension.unionByName(made)
        if f.detect_fanout:
            grain = [*f.lookup, *([f.event_at] if f.event_at else [])]
            if not fct.fanout(df.select(*grain).distinct(), dimension, f.lookup, grain, f.event_at).limit(1).isEmpty():
                raise dq.QualityError(f"{spec.table_name}.{f.column}: a fact matches several rows of {f.references}")
        keys = {f.column: f.dimension_key} | ({f.durable_column: f.dimension_durable_key} if f.durable_column else {})
        df = fct.resolve_keys(df, dimension, f.lookup, keys, event_at=f.event_at, not_applicable=F.expr(f.not_applicable) if f.not_applicable else None)
        fct.enforce(df, f.column, early_arriving=f.early_arriving, invalid_action=f.invalid_action)
        if f.validate_resolution and (n := fct.unmatched_identities(df, list(f.lookup), f.column))["given"] != n["resolved"]:
            raise dq.QualityError(f"{spec.table_name}.{f.column}: {n['given']} identities, of which {n['resolved']} were resolved")
        if f.register_unresolved and f.early_arriving == "default" and spec.merge_keys:
            df = cut(df, "resolved")
            run.after.append(lambda df=df, f=f: self._register(spec, f, df, run.id))
        return df

    def _register(self, spec: TableSpec, f, df: DataFrame, batch: str) -> None:
        """Open evidence of facts without a member, close that of facts that have one now; only the buckets of the batch's facts are rewritten."""
        table, grain = self.table("etl_unresolved_keys"), spec.merge_keys
        build = lambda old: fct.unresolved_registry(old, df, fact=spec.table_name, relationship=f.column, grain=grain, key=f.column, batch=batch)
        if not table.exists():
            table.create(build(None).schema, {"buckets": {"by": ["grain_hash"], "n": 16}, "keys": ["fact", "relationship", "grain_hash"]})

        def once() -> None:
            version = table.latest()
            touched = table.touched(df.select(fct.business_key_hash(grain).alias("grain_hash")))
            after = cut(build(table.snapshot(version, touched)), "registry")
            if not after.limit(1).isEmpty():
                table.commit(after, batch=batch, expected=version, operation="unresolved keys", replace=touched)

        attempt(once, self.tries, self.wait)

    def _test(self, spec: TableSpec, df: DataFrame, run: _Batch) -> list[str]:
        rules = [dq.Rule(r.name, r.kind, r.column, r.columns, r.values, r.sql, r.limit, r.severity) for r in spec.tests if r.kind != "relationships"]
        outcomes = dq.run_rules(df, rules)
        for r in (r for r in spec.tests if r.kind == "relationships"):
            bad = dq.relationships(df, r.column, self.table(r.to).snapshot(), r.field, current_only=False)
            outcomes.append(dq.Outcome(r.name, bad.limit(1).isEmpty(), None, r.severity))
        return self._keep(spec, outcomes, run)

    def validate(self, spec: TableSpec, batch: str = "validate", *, approximate: bool = False) -> list[dq.Outcome]:
        """The checks that follow from a definition, over the whole target: keys without NULL, surrogate and merge keys unique (or, approximately, by a sketch, as warnings), foreign keys that lead to a row. Kept as evidence."""
        rows, outcomes = self.table(spec.table_name).snapshot(), []
        unique = [[spec.surrogate_key]] if spec.table_type == "dimension" else [] if spec.append_only else [spec.merge_keys]
        given = [c for c in [*spec.keys, *(f.column for f in spec.foreign_keys)] if c in rows.columns]
        if given and not (spec.table_type == "dimension" and spec.null_policy == "legacy"):
            outcomes += dq.run_rules(rows, [dq.Rule(f"derived.{c}.not_null", "not_null", c) for c in given])
        for keys in unique:
            name = f"derived.{'+'.join(keys)}.unique"
            if approximate:
                outcomes.append(dq.Outcome(name, bool(dq.approximately_unique(rows, keys).first()["ok"]), None, "warn"))
            else:
                outcomes += dq.run_rules(rows, [dq.Rule(name, "unique", columns=keys)])
        for f in (f for f in spec.foreign_keys if self.table(f.references).exists()):
            lost = dq.orphan_keys(rows, f.column, self.table(f.references).snapshot(), f.dimension_key)
            outcomes.append(dq.Outcome(f"derived.{f.column}.relationships", lost.limit(1).isEmpty()))
        self.evidence.record(spec.table_name, batch, outcomes)
        return outcomes

    def vacuum(self, name: str, keep: int, older: float = 86_400.0) -> list[str]:
        """Delete what only versions before the newest ``keep`` need, but nothing of versions that a reader of the table's feed has still to process (as the control table says)."""
        table = self.table(name)
        behind = [r["last_processed_version"] for (_, source), r in self.control.rows().items() if source == name]
        latest = table.latest()
        return table.vacuum(max(keep, *(latest - (v if v is not None else -1) for v in behind), 1), older)

    def read(self, spec: TableSpec, view: bool = False) -> DataFrame:
        """The table as its readers see it: with the definition's ``read_masks`` applied, as a temporary view of the table's name if asked for."""
        rows = fd.mask_columns(self.table(spec.table_name).snapshot(), {m.column: m.model_dump() | {"secret": self.secrets.get(m.secret or "", m.secret or "")} for m in spec.read_masks})
        if view:
            rows.createOrReplaceTempView(spec.table_name)
        return rows

    def monitor(self, specs: list[TableSpec]) -> dict[str, list[str]]:
        """Schema checks of every contracted source of many definitions, without running any: failed findings by table. All are kept as evidence, failed ones notified."""
        out, batch = {}, f"monitor-{uuid.uuid4().hex}"
        for spec in specs:
            outcomes = []
            for s in (s for s in spec.sources if s.contract):
                outcomes += contract_outcomes(s, self._empty(s), f"contract.{s.alias}", schema_only=True)
            if outcomes:
                self.evidence.record(spec.table_name, batch, outcomes)
                out[spec.table_name] = [f"{o.rule}: {o.detail}" for o in outcomes if not o.ok]
        return out

    def _empty(self, s: Source) -> DataFrame:
        if s.format != "versioned":
            return scan(self.spark, s.name, s.format, s.options).limit(0)
        table = self.table(s.name)
        return empty_like(self.spark, table.schema() if s.cdc_strategy == "full" else table.change_schema())

    def dry_run(self, spec: TableSpec) -> list[str]:
        """Analyse a definition's SQL over empty views of its sources: the columns it gives. ValueError says what is wrong with it; no row is read."""
        try:
            return fd.user_sql(self.spark, {s.alias: self._empty(s) for s in spec.sources}, spec.transformation_sql).columns
        except Exception as e:
            raise ValueError(f"{spec.table_name}: {str(e).splitlines()[0]}") from e
        finally:
            for s in spec.sources:
                self.spark.catalog.dropTempView(s.alias)

    # ------------------------------------------------------------ merge and commit

    def _publish(self, name: str, rows: DataFrame, batch: str) -> None:
        table = self.table(name)
        if not table.exists():
            table.create(rows.schema)
            table.commit(rows, append=True, operation="junk", batch=batch)
            return

        def once() -> None:
            version = table.latest()
            old = table.snapshot(version, table.touched(rows))
            new = rows.join(old.select(*[F.col(c).alias(f"__o_{c}") for c in rows.columns[:1]]), F.col(rows.columns[0]) == F.col(f"__o_{rows.columns[0]}"), "left_anti")
            if not new.limit(1).isEmpty():
                table.commit(new.select(*[f.name for f in table.schema()]), append=True, operation="members", batch=batch, expected=version)

        attempt(once, self.tries, self.wait)

    def _merge_once(self, spec: TableSpec, df: DataFrame, batch: str, full_snapshot: bool) -> Result:
        """One merge and commit. Where the target has buckets only those that hold keys of ``df`` are read and rewritten."""
        table = self.table(spec.table_name)
        tag = {"__etl_batch_id": F.lit(batch), "__etl_processed_at": F.current_timestamp()}
        if spec.append_only:
            rows = fd.append_rows(df).withColumns({"__is_deleted": F.lit(False), **tag})
            self._ensure(spec, table, rows.schema)
            version = table.commit(rows, append=True, operation="append", batch=batch, expected=table.latest())
            return Result(spec.table_name, "SUCCESS", batch, version, {"written": None})
        if spec.table_type == "dimension" and spec.scd_type in (2, 6, 7):
            return self._merge_versions(spec, table, df, batch, full_snapshot)
        keys = spec.keys
        if spec.table_type == "dimension":
            df = df.withColumn(spec.surrogate_key, surrogate_key(keys, None, self.strategy))
        business = [f for f in df.schema if f.name not in fd.META]
        self._ensure(spec, table, T.StructType([*business, T.StructField("__is_deleted", T.BooleanType())]))
        expected = table.latest()
        touched = table.touched(df)
        target = table.snapshot(expected, touched)
        df = fd.prune(df, [f.name for f in target.schema], keys, spec.schema_evolution)
        if spec.fact_type == "accumulating_snapshot":
            merged = fct.accumulate(target, df, keys, [c for c in df.columns if c not in (*keys, *fd.META)]).withColumn("__is_deleted", F.lit(False))
            merged = merged.withColumn("__action", F.lit("update"))
        else:
            merged = dim.overwrite_merge(target, df, keys, deletes=spec.delete_strategy, schema_evolution=spec.schema_evolution)
        merged = cut(merged, "merged")
        counts = {r["__action"]: r["n"] for r in merged.groupBy("__action").agg(F.count(F.lit(1)).alias("n")).collect()}
        changed = {k: counts.get(k, 0) for k in ("insert", "update", "delete")}
        if not any(changed.values()):
            return Result(spec.table_name, "SUCCESS", batch, expected, {"written": 0, **changed})
        kind = F.when(F.col("__action") == "update", "update_postimage").otherwise(F.col("__action"))
        feed = merged.filter("__action <> 'keep'").withColumn("_change_type", kind).drop("__action")
        version = table.commit(dim.applied(merged, spec.delete_strategy), feed, batch=batch, expected=expected, metrics=changed, replace=touched)
        if spec.scd_type == 4:
            self._merge_history(spec, df, batch)
        return Result(spec.table_name, "SUCCESS", batch, version, {"written": sum(changed.values()), **changed})

    def _merge_history(self, spec: TableSpec, df: DataFrame, batch: str) -> None:
        history = self.table(spec.history_table)
        at = spec.effective_at or "__at"
        rows = df if spec.effective_at else df.withColumn("__at", F.current_timestamp())
        if "_change_type" in rows.columns:
            rows = rows.filter("_change_type <> 'delete'")
        fields = [c for c in (spec.track_history_columns or df.columns) if c not in (*spec.natural_keys, spec.surrogate_key, at, *fd.META) and not c.startswith("__")]
        if not history.exists():
            shape = dim.attribute_history(None, rows, spec.surrogate_key, fields, at).schema
            history.create(shape, self._buckets(spec, ["surrogate_key"]) | {"keys": ["surrogate_key", "field", "valid_from"]})
        expected, touched = history.latest(), history.touched(rows.select(F.col(spec.surrogate_key).alias("surrogate_key")))
        out = cut(dim.attribute_history(history.snapshot(expected, touched), rows, spec.surrogate_key, fields, at), "history")
        history.commit(out, batch=batch, expected=expected, replace=touched)

    def _merge_versions(self, spec: TableSpec, table: VersionedTable, df: DataFrame, batch: str, full_snapshot: bool) -> Result:
        keys, at, sk = spec.natural_keys, spec.effective_at, spec.surrogate_key
        df = df.withColumn(at, F.col(at).cast("timestamp")) if not isinstance(df.schema[at].dataType, (T.TimestampType, T.TimestampNTZType)) else df
        attributes = [c for c in df.columns if c not in (*keys, at, sk, *fd.META) and not c.startswith("__") and not c.startswith("current_")]
        empty = dim.empty_versions(df, keys, attributes, at, sk)
        seven, six = spec.scd_type == 7, spec.scd_type == 6

        def finished(rows: DataFrame) -> DataFrame:
            if seven:
                reserved = F.col(sk).isin(-1, -2, -3, -4)
                made = dim.with_dual_keys(rows, keys, self.strategy)
                made = made.withColumn(sk, F.when(reserved | F.col("__is_skeleton"), F.col(sk)).otherwise(F.col("row_key"))).drop("row_key")
                rows = made.withColumnRenamed("durable_key", spec.durable_key) if spec.durable_key != "durable_key" else made
                rows = rows.withColumn(spec.durable_key, F.when(reserved, F.col(sk)).otherwise(F.col(spec.durable_key)))
            if six:
                rows = dim.current_columns(rows, keys, spec.current_value_columns)
            return rows

        if not table.exists():
            members = dim.default_members(self.spark, empty.schema, sk, spec.default_rows)
            start = finished(members)
            self._ensure(spec, table, start.schema)
            table.commit(start, append=True, operation="members", batch=batch)
        expected = table.latest()
        # keys that a full snapshot lacks may lie anywhere
        touched = None if full_snapshot and "_change_type" not in df.columns else table.touched(df)
        old = table.snapshot(expected, touched)
        if spec.schema_evolution:
            old = fd.evolve(old, df)
        base = [c for c in empty.columns if c in old.columns]
        target = old.select(*base)
        reserved = target.filter(F.col(sk).isin(-1, -2, -3, -4))
        kept = [c for c in attributes if c in old.columns]
        merged = dim.versioned_merge(target.filter(~F.col(sk).isin(-1, -2, -3, -4)), df.filter(F.col(at).isNotNull()), keys, at=at, tracked=[c for c in spec.track_history_columns if c in kept], attributes=kept, sk=sk, strategy=self.strategy, full_snapshot=full_snapshot and "_change_type" not in df.columns)
        out = cut(finished(merged.unionByName(reserved)), "merged")
        if seven:
            bad = dim.key_collisions(out.filter(~F.col(sk).isin(-1, -2, -3, -4)), sk, "row_fingerprint")
            if not bad.limit(1).isEmpty():
                raise dq.QualityError(f"{spec.table_name}: one row key for two rows")
        before = old.select(*[c for c in out.columns if c in old.columns])
        feed = fd.changes_from_snapshots(before, out.select(*before.columns), [sk], 0) if "__valid_from" in before.columns else None
        feed = cut(feed, "feed") if feed is not None else None
        counts = {r["_change_type"]: r["n"] for r in feed.groupBy("_change_type").agg(F.count(F.lit(1)).alias("n")).collect()} if feed is not None else {}
        changed = {"insert": counts.get("insert", 0), "update": counts.get("update_postimage", 0), "delete": counts.get("delete", 0)}
        if not any(changed.values()) and out.columns == old.columns:
            return Result(spec.table_name, "SUCCESS", batch, expected, {"written": 0, **changed})
        version = table.commit(out, feed.drop("_commit_version") if feed is not None else None, batch=batch, expected=expected, metrics=changed, replace=touched)
        return Result(spec.table_name, "SUCCESS", batch, version, {"written": sum(changed.values()), **changed})

    def _buckets(self, spec: TableSpec, by: list[str]) -> dict:
        return {"buckets": {"by": by, "n": spec.buckets}} if spec.buckets and by else {}

    def _ensure(self, spec: TableSpec, table: VersionedTable, schema: T.StructType) -> None:
        references = {f.column: [f.references, f.dimension_key] for f in spec.foreign_keys}
        about = {"description": spec.description, "pii": [m.column for m in spec.pii], "primary_key": [spec.surrogate_key] if spec.surrogate_key else spec.merge_keys, "foreign_keys": references}
        if table.exists():
            if spec.buckets and not spec.append_only and (table.bucketing() or (None, 0))[1] != spec.buckets:
                table.rebucket(spec.keys, spec.buckets)
            table.set_properties(**about)  # writes a version only if the definition says something else than the table
            return
        not_null = [*spec.keys, *([spec.surrogate_key] if spec.surrogate_key else []), *(f.column for f in spec.foreign_keys)]
        seeds = spec.table_type == "dimension" and spec.scd_type in (1, 4)
        one_row = [spec.surrogate_key] if spec.table_type == "dimension" and spec.scd_type in (2, 6, 7) else [] if spec.append_only else spec.keys
        table.create(schema, {"not_null": not_null if not spec.append_only else [], "checks": spec.checks, "cluster_by": spec.cluster_by, "keys": one_row, **about, **self._buckets(spec, [] if spec.append_only else spec.keys)})
        if seeds:
            members = dim.default_members(self.spark, schema, spec.surrogate_key, spec.default_rows)
            # natural keys of members are the members' own keys, so that no real row matches them
            table.commit(members.withColumn("__is_deleted", F.lit(False)), append=True, operation="members")

    # ------------------------------------------------------------ a project

    def run_project(self, project, *, stop_on_failure: bool = False, full_reload: bool = False, pipeline: str | None = None) -> list[Result]:
        """Level by level; tables whose dependencies failed are skipped.

        With the name of a ``pipeline`` its finished tables are remembered: run again after a failure it goes on with the others, and starts anew once all are through.
        """
        results, bad = [], set()
        marks = Checkpoints(self.spark, f"{self.root}/etl_checkpoints") if pipeline else None
        done = set(marks.done(pipeline)) if marks else set()
        for level in project.levels:
            for name in level:
                if project.upstream[name] & bad or (stop_on_failure and bad):
                    bad.add(name)
                    results.append(Result(name, "SKIPPED", error="a dependency failed"))
                    continue
                if name in done:
                    results.append(Result(name, "SUCCESS", metrics={"skipped": True}))
                    continue
                try:
                    results.append(self.run(project.tables[name], full_reload=full_reload))
                    if marks:
                        marks.save(pipeline, name, {"version": results[-1].version})
                except Exception as e:  # noqa: BLE001 - other tables go on
                    bad.add(name)
                    results.append(Result(name, "FAILED", error=f"{type(e).__name__}: {e}"))
        if marks and not bad:
            marks.forget(pipeline)
        return results
