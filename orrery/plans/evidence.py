"""Evidence of quality: events with stable ids, appended to a versioned table, and metrics of runs."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.quality import Outcome
from orrery.sources.versioned import VersionedTable

SCHEMA = T.StructType([T.StructField(n, k) for n, k in (
    ("event_id", T.StringType()), ("table_name", T.StringType()), ("batch_id", T.StringType()), ("rule", T.StringType()), ("severity", T.StringType()),
    ("ok", T.BooleanType()), ("failed", T.LongType()), ("detail", T.StringType()), ("at", T.DoubleType()),
)])


def event_id(table: str, batch: str, rule: str) -> str:
    """The same for the same table, batch and rule, so that a retry can be told from a second finding."""
    return hashlib.sha256(f"{table}\0{batch}\0{rule}".encode()).hexdigest()[:32]


class Evidence:
    """Appends outcomes. ``on_failure``: ``warn`` returns False if the sink fails, ``error`` raises. ``notify`` gets the failed ones (a webhook, say)."""

    def __init__(self, spark: SparkSession, path: str, *, on_failure: str = "warn", notify: Callable[[list[dict]], None] | None = None):
        self.spark, self.path, self.on_failure, self.notify = spark, path, on_failure, notify

    def record(self, table: str, batch: str, outcomes: Sequence[Outcome]) -> bool:
        rows = [{"event_id": event_id(table, batch, o.rule), "table_name": table, "batch_id": batch, "rule": o.rule, "severity": o.severity, "ok": o.ok, "failed": o.failed, "detail": o.detail, "at": time.time()} for o in outcomes]
        try:
            sink = VersionedTable(self.spark, self.path)
            if not sink.exists():
                sink.create(SCHEMA)
            if rows:
                # a retry records nothing twice
                there = {r[0] for r in sink.snapshot().filter(F.col("event_id").isin([r["event_id"] for r in rows])).select("event_id").collect()}
                rows = [r for r in rows if r["event_id"] not in there]
            if rows:
                sink.commit_rows(rows, append=True, operation="evidence")
            if self.notify and (bad := [r for r in rows if not r["ok"]]):
                self.notify(bad)
            return True
        except Exception:
            if self.on_failure == "error":
                raise
            return False


@dataclass
class Metrics:
    """Durations and counts of a run's steps."""

    steps: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def step(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.steps[name] = self.steps.get(name, 0.0) + time.perf_counter() - began

    def count(self, name: str, n: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + n

    def json(self) -> str:
        return json.dumps({"steps": self.steps, "counts": self.counts}, sort_keys=True)


class Checkpoints:
    """Steps of a long pipeline that are done, so that a rerun goes on where it stopped; in a versioned table."""

    SCHEMA = T.StructType([T.StructField("pipeline", T.StringType()), T.StructField("step", T.StringType()), T.StructField("state", T.StringType()), T.StructField("at", T.DoubleType())])

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)
        if not self.table.exists():
            self.table.create(self.SCHEMA)

    def save(self, pipeline: str, step: str, state: dict | None = None) -> None:
        self.table.commit_rows([{"pipeline": pipeline, "step": step, "state": json.dumps(state or {}), "at": time.time()}], append=True, operation="checkpoint")

    def done(self, pipeline: str) -> dict[str, dict]:
        rows = sorted((r for r in self.table.rows() if r["pipeline"] == pipeline), key=lambda r: r["at"])  # a row per step of the pipelines under way
        return {r["step"]: json.loads(r["state"]) for r in rows}

    def forget(self, pipeline: str) -> None:
        """Take back what is recorded of a pipeline, once it is through."""
        version = self.table.latest()
        self.table.commit_rows([r for r in self.table.rows(version) if r["pipeline"] != pipeline], operation="checkpoint", expected=version)
