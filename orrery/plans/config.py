"""Table definitions: strict models, YAML with ``{{ name }}`` substitution, fingerprints."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from typing import Any, Literal

import yaml
from pydantic import BaseModel, ConfigDict, Field, model_validator

from orrery.operators.feed import check_sql

_DURATION = re.compile(r"^(\d+)\s*(s|m|h|d|seconds?|minutes?|hours?|days?)$")


class Strict(BaseModel):
    """Unknown keys are errors."""

    model_config = ConfigDict(extra="forbid")


def seconds(duration: str) -> int:
    """Seconds of ``15m``, ``2 hours`` and the like."""
    m = _DURATION.match(duration.strip().lower())
    if not m:
        raise ValueError(f"not a duration: {duration!r}")
    return int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2][0]]


class RuleSpec(Strict):
    name: str
    kind: Literal["unique", "not_null", "null_rate", "accepted_values", "expression", "relationships"]
    column: str = ""
    columns: list[str] = Field(default_factory=list)
    values: list[Any] = Field(default_factory=list)
    sql: str = ""
    limit: float = 0.0
    to: str = ""
    field: str = ""
    severity: Literal["error", "warn"] = "error"


class TemporalSpec(Strict):
    """Lateness and order of a source's events; ``keys`` name the entity whose latest event is remembered from run to run."""

    keys: list[str] = Field(min_length=1)
    event_at: str
    lateness: str = "1 day"
    severity: Literal["error", "warn"] = "warn"

    @model_validator(mode="after")
    def _duration(self):
        seconds(self.lateness)
        return self


class SourceContract(Strict):
    """What a supplier promises: a contract document beside the definition, or columns and rules given here, and how time behaves."""

    document: str | None = None
    object: str | None = None
    columns: dict[str, str] = Field(default_factory=dict)
    required: list[str] = Field(default_factory=list)
    mode: Literal["additive", "strict"] = "additive"
    rules: list[RuleSpec] = Field(default_factory=list)
    max_actions: int | None = None
    #: share of the rows that rules on single rows look at; keys are always checked whole
    sample: float = Field(1.0, gt=0, le=1)
    temporal: TemporalSpec | None = None

    @model_validator(mode="after")
    def _says_something(self):
        if not (self.document or self.columns or self.rules or self.temporal):
            raise ValueError("a contract needs a document, columns, rules or temporal")
        if any(r.kind == "relationships" for r in self.rules):
            raise ValueError("a contract's rules look at the source alone; relationships belong to tests")
        return self


class Source(Strict):
    name: str
    alias: str = ""
    format: str = "versioned"
    options: dict[str, str] = Field(default_factory=dict)
    cdc_strategy: Literal["full", "cdf", "append"] = "full"
    primary_keys: list[str] = Field(default_factory=list)
    starting_version: int | None = None
    streaming: bool = False
    contract: SourceContract | None = None

    @model_validator(mode="after")
    def _names(self):
        if not self.alias:
            self.alias = re.split(r"[./]", self.name.rstrip("/"))[-1]
        if self.contract and self.contract.temporal and self.cdc_strategy == "full":
            raise ValueError(f"source {self.name}: a temporal contract needs a change feed")
        if self.cdc_strategy == "cdf" and not self.primary_keys:
            raise ValueError(f"source {self.name}: a change feed needs primary_keys")
        if self.streaming and self.cdc_strategy == "full":
            raise ValueError(f"source {self.name}: only change feeds can stream")
        return self


class ForeignKey(Strict):
    column: str
    references: str
    #: fact column -> natural key column; empty if the facts carry the dimension's key already
    lookup: dict[str, str] = Field(default_factory=dict)
    dimension_key: str
    durable_column: str | None = None
    dimension_durable_key: str = "durable_key"
    event_at: str | None = None
    not_applicable: str | None = None
    early_arriving: Literal["default", "error", "skeleton"] = "default"
    invalid_action: Literal["default", "error"] = "default"
    identity_map: str | None = None
    detect_fanout: bool = True
    validate_resolution: bool = False
    #: evidence of facts that stay unresolved, by grain
    register_unresolved: bool = True


class JunkDimension(Strict):
    name: str
    columns: list[str] = Field(min_length=1)
    key: str


class Measure(Strict):
    name: str
    aggregation: Literal["sum", "avg", "min", "max", "count", "count_distinct"]
    additivity: Literal["additive", "semi_additive", "non_additive"] = "additive"

    @model_validator(mode="after")
    def _legal(self):
        if self.additivity == "non_additive" and self.aggregation == "sum":
            raise ValueError(f"measure {self.name}: not additive, can't be summed")
        return self


class MaskRule(Strict):
    column: str
    method: Literal["drop", "null", "fast_hash", "hash", "tokenize", "mask"]
    prefix: int = 0
    char: str = "*"
    secret: str | None = None


class TableSpec(Strict):
    table_name: str
    table_type: Literal["dimension", "fact"]
    sources: list[Source] = Field(min_length=1)
    transformation_sql: str | None = None
    scd_type: Literal[1, 2, 4, 6, 7] = 1
    surrogate_key: str | None = None
    durable_key: str = "durable_key"
    natural_keys: list[str] = Field(default_factory=list)
    merge_keys: list[str] = Field(default_factory=list)
    track_history_columns: list[str] = Field(default_factory=list)
    current_value_columns: list[str] = Field(default_factory=list)
    history_table: str | None = None
    effective_at: str | None = None
    delete_strategy: Literal["hard", "soft"] = "soft"
    append_only: bool = False
    schema_evolution: bool = False
    preserve_all_changes: bool = False
    null_policy: Literal["strict", "legacy"] = "legacy"
    null_substitutes: dict[str, Any] = Field(default_factory=dict)
    default_rows: dict[str, Any] = Field(default_factory=dict)
    fact_type: Literal["transaction", "periodic_snapshot", "accumulating_snapshot"] = "transaction"
    period: str | None = None
    milestones: list[str] = Field(default_factory=list)
    foreign_keys: list[ForeignKey] = Field(default_factory=list)
    junk_dimensions: list[JunkDimension] = Field(default_factory=list)
    measures: list[Measure] = Field(default_factory=list)
    degenerate_dimensions: list[str] = Field(default_factory=list)
    pii: list[MaskRule] = Field(default_factory=list)
    tests: list[RuleSpec] = Field(default_factory=list)
    checks: list[str] = Field(default_factory=list)
    cluster_by: list[str] = Field(default_factory=list)
    grain_check: Literal["error", "warn", "skip"] = "error"
    #: sources whose latest commit is older give a warning
    freshness: str | None = None
    #: folders of rows, by a hash of the keys: a merge rewrites those it touches; 0 for none
    buckets: int = Field(16, ge=0, le=65_536)
    #: files to compact into once a run left more folders than so many; None never
    compact_files: int | None = None
    #: versions to keep; older ones go once every reader of the feed is past them. None keeps all
    retain_versions: int | None = Field(None, ge=1)
    #: masks for those who read by ``Warehouse.read``; the table keeps the values
    read_masks: list[MaskRule] = Field(default_factory=list)
    #: derived checks of the whole target after every run
    validate_target: bool = False
    depends_on: list[str] = Field(default_factory=list)
    description: str = ""

    @model_validator(mode="before")
    @classmethod
    def _flatten_keys(cls, data):
        if isinstance(data, dict) and isinstance(data.get("keys"), dict):
            data = data | data["keys"]
            data.pop("keys")
        return data

    @model_validator(mode="after")
    def _rules(self):
        def need(ok: bool, why: str) -> None:
            if not ok:
                raise ValueError(f"{self.table_name}: {why}")

        if self.table_type == "dimension":
            need(bool(self.natural_keys), "a dimension needs natural_keys")
            need(self.surrogate_key is not None, "a dimension needs a surrogate_key")
            need(not self.foreign_keys and not self.measures, "foreign keys and measures belong to facts")
            if self.scd_type in (2, 6, 7):
                need(bool(self.track_history_columns), f"type {self.scd_type} needs track_history_columns")
                need(self.effective_at is not None, f"type {self.scd_type} needs effective_at")
            need(self.scd_type != 4 or self.history_table is not None, "type 4 needs a history_table")
            need(self.scd_type != 6 or bool(self.current_value_columns), "type 6 needs current_value_columns")
        else:
            need(self.append_only or bool(self.merge_keys), "a fact needs merge_keys or append_only")
            need(self.scd_type == 1, "a fact has no history type")
        need(not self.append_only or all(s.cdc_strategy == "append" for s in self.sources), "an append-only table takes append sources only")
        need(self.append_only or all(s.cdc_strategy != "append" for s in self.sources), "append sources need append_only")
        need(self.fact_type != "periodic_snapshot" or self.period is not None, "a periodic snapshot needs a period")
        need(self.fact_type != "accumulating_snapshot" or (len(self.milestones) >= 2 and len(set(self.milestones)) == len(self.milestones)), "an accumulating snapshot needs two milestones or more, each once")
        aliases = [s.alias for s in self.sources]
        need(len(set(aliases)) == len(aliases), "two sources share an alias")
        need(len(aliases) == 1 or self.transformation_sql is not None, "several sources need transformation_sql")
        need(not self.preserve_all_changes or self.scd_type in (2, 7), "preserve_all_changes needs type 2 or 7")
        if self.freshness:
            seconds(self.freshness)
        if self.transformation_sql:
            check_sql(self.transformation_sql, aliases)
        return self

    @property
    def keys(self) -> list[str]:
        return self.natural_keys if self.table_type == "dimension" else self.merge_keys

    def fingerprint(self) -> str:
        """SHA-256 of the definition; descriptions don't count."""
        return hashlib.sha256(json.dumps(self.model_dump(exclude={"description"}), sort_keys=True, default=str).encode()).hexdigest()


#: What may follow a name: ``{{ name | upper }}``.
FILTERS = {"upper": str.upper, "lower": str.lower, "trim": str.strip}


def render(text: str, values: dict[str, Any]) -> str:
    """``{{ a.b }}`` replaced by values; ValueError for a name that has none, so that a typing error never becomes an empty text.

    ``{{ a | default('x') }}`` gives x where a has no value; ``upper``, ``lower`` and ``trim`` may follow, in any number.
    """

    def one(m: re.Match) -> str:
        name, *then = [x.strip() for x in m[1].split("|")]
        if not re.fullmatch(r"[A-Za-z_][\w.]*", name):
            raise ValueError(f"not a name: {name!r}")
        at: Any = values
        for part in name.split("."):
            at = at[part] if isinstance(at, dict) and part in at else None
            if at is None:
                break
        for step in then:
            if given := re.fullmatch(r"default\((?:'([^']*)'|\"([^\"]*)\")\)", step):
                at = (given[1] or given[2] or "") if at is None else at
            elif step not in FILTERS:
                raise ValueError(f"unknown filter {step!r}")
            elif at is not None:
                at = FILTERS[step](str(at))
        if at is None:
            raise ValueError(f"nothing is known as {name!r}")
        return str(at)

    return re.sub(r"\{\{(.*?)\}\}", one, text)


def load_table(path: str | Path, values: dict[str, Any] | None = None) -> TableSpec:
    """A definition from a YAML file; SQL may be in a file beside it (``transformation_sql: file:name.sql``), as are contract documents."""
    path = Path(path)
    data = yaml.safe_load(render(path.read_text(), values or {}))
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no table definition")
    sql = data.get("transformation_sql")
    if isinstance(sql, str) and sql.startswith("file:"):
        data["transformation_sql"] = render((path.parent / sql[5:].strip()).read_text(), values or {})
    spec = TableSpec(**data)
    for s in spec.sources:
        if s.contract and s.contract.document:
            s.contract.document = str((path.parent / s.contract.document).resolve())
            if not Path(s.contract.document).is_file():
                raise ValueError(f"{path}: no contract document {s.contract.document}")
    return spec


#: File of named sets of values beside the definitions: target -> name -> value.
TARGETS = "targets.yml"


def load_targets(folder: str | Path, target: str | None) -> dict[str, Any]:
    """The values of one target; none without a target."""
    if target is None:
        return {}
    path = Path(folder) / TARGETS
    known = yaml.safe_load(path.read_text()) if path.is_file() else {}
    if target not in (known or {}):
        raise ValueError(f"{path} has no target {target!r}")
    return known[target] or {}


def load_project(folder: str | Path, values: dict[str, Any] | None = None, target: str | None = None) -> list[TableSpec]:
    """All definitions of a folder; ``values`` go before those of ``target``. ValueError if there is no such folder."""
    if not Path(folder).is_dir():
        raise ValueError(f"no folder {folder}")
    known = load_targets(folder, target) | (values or {})
    return [load_table(p, known) for p in sorted(Path(folder).glob("*.y*ml")) if p.name != TARGETS]
