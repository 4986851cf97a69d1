"""Control rows: what each target has processed of each source, batch states, recovery."""

from __future__ import annotations

import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from orrery.sources.versioned import ConcurrentCommit, VersionedTable

SCHEMA = T.StructType([
    T.StructField("target_table", T.StringType()), T.StructField("source_table", T.StringType()), T.StructField("last_processed_version", T.LongType()),
    T.StructField("batch_id", T.StringType()), T.StructField("batch_started_at", T.TimestampType()), T.StructField("batch_completed_at", T.TimestampType()),
    T.StructField("batch_status", T.StringType()), T.StructField("rows_read", T.LongType()), T.StructField("rows_written", T.LongType()),
    T.StructField("error_message", T.StringType()), T.StructField("updated_at", T.TimestampType()), T.StructField("config_fingerprint", T.StringType()),
    T.StructField("source_schema_fingerprint", T.StringType()),
])

#: A batch that has been running for longer is taken for dead.
TTL_MINUTES = 60


class ControlTable:
    """One row per target and source in a versioned table: the driver reads and writes it whole, it has a row per pipeline edge."""

    def __init__(self, spark: SparkSession, path: str, retries: int = 5):
        self.spark, self.table, self.retries = spark, VersionedTable(spark, path), retries
        if not self.table.exists():
            self.table.create(SCHEMA)

    def rows(self) -> dict[tuple[str, str], dict]:
        return {(r["target_table"], r["source_table"]): r for r in self.table.rows()}

    def _update(self, change) -> None:
        for n in range(self.retries):
            version = self.table.latest()
            rows = self.rows()
            change(rows)
            try:
                self.table.commit_rows(list(rows.values()), expected=version, operation="control")
                return
            except ConcurrentCommit:
                if n + 1 == self.retries:
                    raise
                time.sleep(0.1 * 2**n)

    def _set(self, target: str, sources: list[str], **values) -> None:
        now = datetime.now(timezone.utc)

        def change(rows):
            for s in sources:
                rows[target, s] = {"target_table": target, "source_table": s} | rows.get((target, s), {}) | values | {"updated_at": now}

        self._update(change)

    def watermark(self, target: str, source: str) -> int | None:
        return self.rows().get((target, source), {}).get("last_processed_version")

    def reset(self, target: str) -> None:
        self._update(lambda rows: [rows.pop(k) for k in list(rows) if k[0] == target])

    def rename(self, old: str, new: str) -> None:
        """The rows of one target become those of another, whose own are dropped; in one commit."""

        def change(rows):
            for k in [k for k in rows if k[0] == new]:
                rows.pop(k)
            for k in [k for k in rows if k[0] == old]:
                rows[new, k[1]] = rows.pop(k) | {"target_table": new}

        self._update(change)

    def start(self, target: str, sources: list[str], batch: str) -> None:
        now = datetime.now(timezone.utc)
        self._set(target, sources, batch_id=batch, batch_status="RUNNING", batch_started_at=now, batch_completed_at=None, error_message=None)

    def complete(self, target: str, versions: dict[str, int | None], *, rows_read: int | None = None, rows_written: int | None = None, config: str | None = None, schemas: dict[str, str] | None = None) -> None:
        """SUCCESS and the new watermarks of all sources, in one commit."""
        now = datetime.now(timezone.utc)

        def change(rows):
            for s, v in versions.items():
                old = rows.get((target, s), {"target_table": target, "source_table": s})
                rows[target, s] = old | {"last_processed_version": v if v is not None else old.get("last_processed_version"), "batch_status": "SUCCESS", "batch_completed_at": now, "rows_read": rows_read, "rows_written": rows_written, "config_fingerprint": config, "source_schema_fingerprint": (schemas or {}).get(s), "updated_at": now}

        self._update(change)

    def fail(self, target: str, sources: list[str], error: str) -> None:
        self._set(target, sources, batch_status="FAILED", batch_completed_at=datetime.now(timezone.utc), error_message=error[:2000])

    def running(self, target: str, ttl_minutes: int = TTL_MINUTES) -> tuple[list[str], list[str]]:
        """(batches that run, batches taken for dead) of a target."""
        alive, dead = [], []
        now = datetime.now(timezone.utc)
        for (t, _), r in self.rows().items():
            if t == target and r["batch_status"] == "RUNNING":
                started = r["batch_started_at"]
                started = started.replace(tzinfo=timezone.utc) if started and started.tzinfo is None else started
                old = started is None or (now - started).total_seconds() > ttl_minutes * 60
                (dead if old else alive).append(r["batch_id"])
        return sorted(set(alive)), sorted(set(dead))


def recover(control: ControlTable, target: VersionedTable, name: str, ttl_minutes: int = TTL_MINUTES) -> list[str]:
    """Batches that died: commits that carry their tag are undone, their control rows become FAILED. Looks through the whole log."""
    _, dead = control.running(name, ttl_minutes)
    for batch in dead:
        tagged = [e.version for e in target.history() if e.batch == batch] if target.exists() else []
        if tagged and min(tagged) > 0:
            target.restore(min(tagged) - 1)
        sources = [s for (t, s), r in control.rows().items() if t == name and r["batch_id"] == batch]
        control.fail(name, sources, f"batch {batch} died and was undone")
    return dead
