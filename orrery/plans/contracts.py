"""Supplier contracts: documents, compatibility of versions, the gate over a folder, a registry."""

from __future__ import annotations

import hashlib
import json
import re
import time
from dataclasses import replace
from pathlib import Path
from typing import Any

import yaml
from pydantic import BaseModel, ConfigDict, Field
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.operators.quality import Outcome, Rule, run_rules, schema_findings
from orrery.sources.versioned import VersionedTable

#: Logical type of a document -> Spark type; a physical type, where given, wins.
TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "date": "date", "timestamp": "timestamp", "time": "string", "array": "array<string>", "object": "struct<>"}


class Property(BaseModel):
    model_config = ConfigDict(extra="ignore", populate_by_name=True)
    name: str
    logical: str = Field("string", alias="logicalType")
    physical: str | None = Field(None, alias="physicalType")
    required: bool = False
    unique: bool = False
    key: bool = Field(False, alias="primaryKey")
    key_position: int = Field(-1, alias="primaryKeyPosition")
    quality: list[dict[str, Any]] = Field(default_factory=list)

    @property
    def type(self) -> str:
        return (self.physical or TYPES.get(self.logical, self.logical)).lower()


class Contract(BaseModel):
    """One schema object of a contract document."""

    id: str
    version: str
    name: str
    properties: list[Property]
    quality: list[dict[str, Any]] = Field(default_factory=list)

    @property
    def primary_key(self) -> list[str]:
        return [p.name for p in sorted((p for p in self.properties if p.key), key=lambda p: (p.key_position if p.key_position > 0 else 10**6))]

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.model_dump(mode="json"), sort_keys=True).encode()).hexdigest()

    def rules(self) -> list[Rule]:
        """Quality metrics as rules: nullValues, duplicateValues, invalidValues; keys and required columns too."""
        out = [Rule(f"{p.name}_required", "not_null", p.name) for p in self.properties if p.required]
        if self.primary_key:
            out.append(Rule("primary_key_unique", "unique", columns=self.primary_key))
        for p in self.properties:
            for q in p.quality:
                metric, severity = q.get("metric") or q.get("rule"), "warn" if q.get("severity") in ("warning", "warn", "info") else "error"
                if metric == "nullValues":
                    at_most = float(q.get("mustBeLessOrEqualTo", q.get("mustBe", 0)))
                    out.append(Rule(f"{p.name}_nullValues", "null_rate", p.name, limit=at_most / 100 if q.get("unit") == "percent" else at_most, severity=severity))
                elif metric == "duplicateValues":
                    out.append(Rule(f"{p.name}_duplicateValues", "unique", columns=list((q.get("arguments") or {}).get("properties", [p.name])), severity=severity))
                elif metric == "invalidValues":
                    out.append(Rule(f"{p.name}_invalidValues", "accepted_values", p.name, values=list((q.get("arguments") or {}).get("validValues", [])), severity=severity))
                else:
                    raise ValueError(f"{self.id}: unknown quality metric {metric!r}")
        return out

    def findings(self, df: DataFrame, mode: str = "additive", cdf: bool = False) -> list[tuple[str, str]]:
        required = [p.name for p in self.properties if p.required]
        return schema_findings(df, {p.name: p.type for p in self.properties}, required=required, mode=mode, cdf=cdf)


def load_contract(text: str, obj: str | None = None) -> Contract:
    """A contract from a YAML document (kind DataContract); ``obj`` names the schema object where there are several."""
    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or doc.get("kind") != "DataContract":
        raise ValueError("not a data contract document")
    for need in ("id", "version", "schema"):
        if need not in doc:
            raise ValueError(f"the contract has no {need}")
    if not re.fullmatch(r"\d+\.\d+\.\d+", str(doc["version"])):
        raise ValueError(f"not a semantic version: {doc['version']}")
    objects = {o["name"]: o for o in doc["schema"]}
    if obj is None and len(objects) != 1:
        raise ValueError("name one of the contract's schema objects: " + ", ".join(sorted(objects)))
    o = objects[obj] if obj is not None else next(iter(objects.values()))
    names = [p["name"] for p in o.get("properties", [])]
    if len(set(names)) != len(names):
        raise ValueError("a property is defined twice")
    return Contract(id=str(doc["id"]), version=str(doc["version"]), name=o["name"], properties=[Property(**p) for p in o.get("properties", [])], quality=o.get("quality", []))


def contract_of(source) -> Contract:
    """The contract that a source's definition refers to or holds itself."""
    c = source.contract
    if c.document:
        found = load_contract(Path(c.document).read_text(), c.object)
    else:
        found = Contract(id=source.name, version="1.0.0", name=source.name, properties=[Property(name=n, physicalType=t, required=n in c.required) for n, t in c.columns.items()])
    return found


def contract_outcomes(source, df: DataFrame, label: str, schema_only: bool = False) -> list[Outcome]:
    """How rows of a source keep its contract: one outcome for the schema and one for each rule; rules are run only where the schema has the columns they name."""
    c = source.contract
    contract = contract_of(source)
    findings = contract.findings(df, c.mode, cdf=source.cdc_strategy != "full" and not schema_only)
    out = [Outcome(f"{label}.schema", not findings, len(findings), detail="; ".join(f"{code} {name}" for code, name in findings) or None)]
    if schema_only:
        return out
    given = [Rule(r.name, r.kind, r.column, r.columns, r.values, r.sql, r.limit, r.severity) for r in c.rules]
    broken = {name for code, name in findings if code == "MISSING_COLUMN"}
    rules = [r for r in [*contract.rules(), *given] if not ({r.column, *r.columns} & broken)]
    if c.sample == 1:
        found = run_rules(df, rules, c.max_actions)
    else:  # the action budget is judged for all rules before the first is run
        needed = sum(r.kind == "unique" for r in rules) + any(r.kind != "unique" for r in rules)
        if c.max_actions is not None and needed > c.max_actions:
            raise ValueError(f"the rules need {needed} actions, more than max_actions={c.max_actions}")
        found = run_rules(df.sample(c.sample, seed=17), [r for r in rules if r.kind != "unique"]) + run_rules(df, [r for r in rules if r.kind == "unique"])
    return out + [replace(o, rule=f"{label}.{o.rule}") for o in found]


def compare(old: Contract, new: Contract) -> list[tuple[str, str, bool]]:
    """(code, property, breaking) of what changed."""
    a, b = {p.name: p for p in old.properties}, {p.name: p for p in new.properties}
    out = [("PROPERTY_REMOVED", n, True) for n in a if n not in b]
    out += [("REQUIRED_PROPERTY_ADDED" if b[n].required else "PROPERTY_ADDED", n, b[n].required) for n in b if n not in a]
    for n in a:
        if n in b:
            if a[n].type != b[n].type:
                out.append(("TYPE_CHANGED", n, True))
            if a[n].required != b[n].required:
                out.append(("NOW_REQUIRED" if b[n].required else "NOW_OPTIONAL", n, not b[n].required))
            if a[n].quality != b[n].quality:
                out.append(("QUALITY_CHANGED", n, False))
    if old.primary_key != new.primary_key:
        out.append(("PRIMARY_KEY_CHANGED", ",".join(new.primary_key), True))
    return out


def version_problem(old: Contract, new: Contract) -> str | None:
    """Why the new version number doesn't fit the changes; None if it does."""
    a, b = (tuple(map(int, c.version.split("."))) for c in (old, new))
    changes = compare(old, new)
    if b <= a and (changes or old.digest() != new.digest()):
        return f"{new.id}: {new.version} is not above {old.version}"
    if any(breaking for _, _, breaking in changes) and b[0] == a[0]:
        return f"{new.id}: a breaking change needs a new major version after {old.version}"
    if changes and b[:2] == a[:2]:
        return f"{new.id}: a change needs a new minor version after {old.version}"
    return None


def gate(old: str | Path, new: str | Path) -> list[str]:
    """Problems between two folders of contract documents: the latest version of each contract there and here; removed contracts; one version with two contents."""
    problems = []

    def read(folder: str | Path) -> dict[str, dict[str, Contract]]:
        out: dict[str, dict[str, Contract]] = {}
        for p in sorted(Path(folder).rglob("*.y*ml")):
            c = load_contract(p.read_text())
            if (same := out.setdefault(c.id, {}).get(c.version)) and same.digest() != c.digest():
                problems.append(f"{c.id}: {c.version} has two contents")
            out[c.id][c.version] = c
        return out

    latest = lambda versions: max(versions.values(), key=lambda c: tuple(map(int, c.version.split("."))))
    before, after = read(old), read(new)
    for name, versions in before.items():
        if name not in after:
            problems.append(f"{name}: removed")
            continue
        problems += [f"{name}: {v} was changed after it was published" for v, c in versions.items() if v in after[name] and after[name][v].digest() != c.digest()]
        if latest(versions).version != latest(after[name]).version and (p := version_problem(latest(versions), latest(after[name]))):
            problems.append(p)
    return problems


_REGISTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("kind", "id", "version", "digest", "document", "at")])


class Registry:
    """Published contracts (never changed), their consumers and project manifests, as rows of one small versioned table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)
        if not self.table.exists():
            self.table.create(_REGISTRY)

    def _add(self, *row: str) -> None:
        values = dict(zip(_REGISTRY.names, (*row, time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())), strict=True))
        self.table.commit_rows([values], append=True, operation="publish", expected=self.table.latest())

    def find(self, kind: str, name: str | None = None) -> list[dict]:
        rows = self.table.snapshot().filter(F.col("kind") == kind)
        return [r.asDict() for r in (rows.filter(F.col("id") == name) if name else rows).collect()]

    def publish(self, contract: Contract) -> bool:
        """True if new; False if this very content is there already; ValueError if the version has another content."""
        for r in self.find("contract", contract.id):
            if r["version"] == contract.version:
                if r["digest"] != contract.digest():
                    raise ValueError(f"{contract.id} {contract.version} is published with other content")
                return False
        self._add("contract", contract.id, contract.version, contract.digest(), json.dumps(contract.model_dump(mode="json", by_alias=True)))
        return True

    def subscribe(self, contract: str, consumer: str) -> None:
        if not any(r["document"] == consumer for r in self.find("consumer", contract)):
            self._add("consumer", contract, "", "", consumer)

    def publish_manifest(self, project: str, manifest: dict) -> bool:
        if any(r["digest"] == manifest["digest"] for r in self.find("manifest", project)):
            return False
        self._add("manifest", project, "", manifest["digest"], json.dumps(manifest))
        return True
