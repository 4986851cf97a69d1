"""Change feeds as streams: every micro-batch goes through the batch operators, and the watermark follows the commit."""

from __future__ import annotations

import os
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import feed as fd
from orrery.plans.config import TableSpec
from orrery.plans.pipeline import Result, Warehouse
from orrery.runtime import cut, scratch, shared_folder


@dataclass
class StreamSummary:
    table: str
    batches: int = 0
    versions: list[int] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def checkpoint_path(warehouse: Warehouse, spec: TableSpec, source: str) -> str:
    """Where a query keeps its offsets: in a folder of plain characters below $ORRERY_CHECKPOINTS, by default below the warehouse."""
    plain = re.sub(r"[^A-Za-z0-9_-]+", "_", f"{spec.table_name}__{source}")
    root = os.environ.get("ORRERY_CHECKPOINTS", f"{warehouse.root}/_streams")
    return f"{root.rstrip('/')}/{plain}"


def run_stream(warehouse: Warehouse, spec: TableSpec, *, per_version: bool = False, interval: str | None = None, wait: bool = True) -> StreamSummary:
    """One query per streaming source: everything there is, or with ``interval`` on and on. Sources that don't stream are read as snapshots; a table without a streaming source is run as a batch.

    Offsets are durable, keys are deterministic and merges idempotent, so a batch that is repeated after a crash changes nothing. ``per_version`` applies a
    micro-batch commit by commit, in order. Contracts, key resolution, gates and evidence are those of a batch. Errors and warnings are in the summary.
    """
    summary = StreamSummary(spec.table_name)
    streaming = [s for s in spec.sources if s.streaming]
    if not streaming:
        try:
            warehouse.run(spec)
            summary.batches = 1
        except Exception as e:  # noqa: BLE001 - the summary says what failed
            summary.errors.append(f"{type(e).__name__}: {e}")
        return summary
    shared_folder(warehouse.spark)
    for source in streaming:
        mark = warehouse.control.watermark(spec.table_name, source.name)
        start = mark + 1 if mark is not None else (source.starting_version or 0)
        rows = warehouse.table(source.name).stream(start).filter("_change_type <> 'update_preimage'")

        causes: list[str] = []

        def step(df: DataFrame, _: int, source=source, causes=causes) -> None:
            try:
                with scratch(warehouse.spark):  # a long stream leaves no intermediate tables behind
                    _step(df, source)
            except Exception as e:
                causes.append(f"{type(e).__name__}: {e}")  # the query's own failure buries it in a trace
                raise

        def _step(df: DataFrame, source) -> None:
            rows = cut(df, "microbatch")  # the session of a micro-batch is another one than the warehouse's
            rows = warehouse.spark.read.schema(rows.schema).parquet(rows._orrery_path)  # noqa: SLF001
            versions = sorted(r[0] for r in rows.select("_commit_version").distinct().collect())  # a row per commit
            done = warehouse.control.watermark(spec.table_name, source.name)
            versions = [v for v in versions if done is None or v > done]
            for group in [[v] for v in versions] if per_version else [versions] if versions else []:
                result = apply_batch(warehouse, spec, source, rows.filter(F.col("_commit_version").isin(group)), max(group))
                summary.versions += group
                summary.warnings += [w for w in result.warnings if w not in summary.warnings]
            summary.batches += 1

        writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint_path(warehouse, spec, source.name))
        query = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        if wait:
            try:
                query.awaitTermination()
            except Exception as e:  # noqa: BLE001
                summary.errors.append((causes[-1] if causes else f"{type(e).__name__}: {e}")[:500])
    return summary


def apply_batch(warehouse: Warehouse, spec: TableSpec, source, rows: DataFrame, version: int) -> Result:
    """A micro-batch through the whole pipeline. Rows that aren't in it are never taken for deleted; other sources are there as snapshots."""
    batch = uuid.uuid4().hex
    keep_all = spec.scd_type in (2, 7)
    rows = rows if keep_all or not source.primary_keys else fd.dedup_delete_wins(rows, source.primary_keys)
    sources = {s.alias: warehouse.table(s.name).snapshot() for s in spec.sources if s.alias != source.alias}
    sources[source.alias] = fd.append_rows(rows) if source.cdc_strategy == "append" else rows
    warehouse.control.start(spec.table_name, [source.name], batch)
    try:
        result = warehouse.apply(spec, sources, batch, full_snapshot=False)
    except Exception as e:
        warehouse.control.fail(spec.table_name, [source.name], f"{type(e).__name__}: {e}")
        raise
    warehouse.control.complete(spec.table_name, {source.name: version}, rows_written=result.metrics.get("written"), config=spec.fingerprint())
    return result


def reload_stream(warehouse: Warehouse, spec: TableSpec) -> Result:
    """Forget offsets and watermarks and build the table again from all there is, as a batch."""
    from orrery.runtime import delete

    for s in spec.sources:
        delete(warehouse.spark, checkpoint_path(warehouse, spec, s.name))
    return warehouse.run(spec, full_reload=True)
