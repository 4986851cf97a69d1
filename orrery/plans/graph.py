"""The dependency graph of a project, its manifest, the impact of changes, and the bus matrix."""

from __future__ import annotations

import hashlib
import json
import shlex
from collections.abc import Sequence
from dataclasses import dataclass, field

from orrery.plans.config import TableSpec


@dataclass
class Issue:
    code: str
    table: str
    detail: str
    severity: str = "error"


@dataclass
class Project:
    """Tables by name, what each depends on, levels that can run one after the other, and what is wrong."""

    tables: dict[str, TableSpec]
    upstream: dict[str, set[str]]
    levels: list[list[str]]
    issues: list[Issue] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not any(i.severity == "error" for i in self.issues)

    def downstream(self, name: str) -> set[str]:
        """Every table that depends on ``name``, directly or not."""
        found: set[str] = set()
        todo = [name]
        while todo:
            at = todo.pop()
            for t, up in self.upstream.items():
                if at in up and t not in found:
                    found.add(t)
                    todo.append(t)
        return found


def compile_project(tables: Sequence[TableSpec]) -> Project:
    """Dependencies from sources, foreign keys, identity maps and ``depends_on``; levels by repeatedly taking the tables whose dependencies are done."""
    issues, by_name = [], {}
    for t in tables:
        if t.table_name in by_name:
            issues.append(Issue("TARGET_WRITER_CONFLICT", t.table_name, "two definitions write this table"))
        by_name[t.table_name] = t
    produced = set(by_name) | {t.history_table for t in tables if t.history_table}
    owner = {t.history_table: t.table_name for t in tables if t.history_table}
    upstream: dict[str, set[str]] = {}
    for name, t in by_name.items():
        reads = {s.name for s in t.sources}
        refers = {f.references for f in t.foreign_keys} | {f.identity_map for f in t.foreign_keys if f.identity_map}
        issues += [Issue("MISSING_UPSTREAM", name, f"refers to {r}, which nothing produces", "warn") for r in sorted(refers - produced)]
        issues += [Issue("MISSING_UPSTREAM", name, f"depends on {r}, which nothing produces") for r in sorted(set(t.depends_on) - produced)]
        found = (reads | refers) & produced
        if t.depends_on:
            issues += [Issue("UNDECLARED_DEPENDENCY", name, f"uses {r} without declaring it", "warn") for r in sorted(found - set(t.depends_on) - {name})]
        upstream[name] = {owner.get(r, r) for r in found | (set(t.depends_on) & produced)} - {name}
    levels, done = [], set()
    while len(done) < len(by_name):
        ready = sorted(n for n in by_name if n not in done and upstream[n] <= done)
        if not ready:
            rest = sorted(set(by_name) - done)
            issues += [Issue("DEPENDENCY_CYCLE", n, "waits for " + ", ".join(sorted(upstream[n] - done))) for n in rest]
            break
        levels.append(ready)
        done |= set(ready)
    return Project(by_name, upstream, levels, issues)


def manifest(project: Project) -> dict:
    """What the project is: tables with fingerprints, dependencies, and a digest of all of it that is the same for the same definitions."""
    tables = {n: {"fingerprint": t.fingerprint(), "definition": t.model_dump(mode="json"), "upstream": sorted(project.upstream[n])} for n, t in sorted(project.tables.items())}
    digest = hashlib.sha256(json.dumps({n: x["fingerprint"] for n, x in tables.items()}, sort_keys=True).encode()).hexdigest()
    return {"tables": tables, "levels": project.levels, "digest": digest}


#: What a change of a field asks for; fields that aren't here need validation.
_BREAKING = {"table_type", "natural_keys", "merge_keys", "surrogate_key", "scd_type", "durable_key", "append_only"}
_BACKFILL = {"transformation_sql", "track_history_columns", "current_value_columns", "effective_at", "sources", "foreign_keys", "junk_dimensions", "pii", "period", "milestones", "null_policy", "null_substitutes"}
_METADATA = {"description", "cluster_by"}
_ORDER = ["metadata_only", "requires_validation", "requires_backfill", "breaking"]


def manifest_diff(old: dict, new: dict) -> dict[str, dict]:
    """Per changed table: ``kind`` (added, removed, changed), the worst ``impact``, the fields, and the tables it reaches."""
    out: dict[str, dict] = {}
    up = {n: set(x["upstream"]) for n, x in new["tables"].items()}

    def reached(name: str) -> list[str]:
        found, todo = set(), [name]
        while todo:
            at = todo.pop()
            more = {t for t, u in up.items() if at in u} - found
            found |= more
            todo += more
        return sorted(found)

    for name in sorted(set(old["tables"]) | set(new["tables"])):
        a, b = old["tables"].get(name), new["tables"].get(name)
        if a is None:
            out[name] = {"kind": "added", "impact": "requires_backfill", "fields": [], "reaches": reached(name)}
        elif b is None:
            out[name] = {"kind": "removed", "impact": "breaking", "fields": [], "reaches": reached(name)}
        else:
            fields = sorted(k for k in b["definition"] if a["definition"].get(k) != b["definition"][k])
            if fields:
                kinds = ["breaking" if f in _BREAKING else "requires_backfill" if f in _BACKFILL else "metadata_only" if f in _METADATA else "requires_validation" for f in fields]
                out[name] = {"kind": "changed", "impact": max(kinds, key=_ORDER.index), "fields": fields, "reaches": reached(name)}
    return out


def bus_matrix(tables: Sequence[TableSpec]) -> str:
    """Facts by dimensions as Markdown: ``X``, with the roles where a dimension plays several, ``H`` where the lookup is at event time, ``+I`` through an identity map."""
    facts = [t for t in tables if t.table_type == "fact"]
    names = sorted({t.table_name for t in tables if t.table_type == "dimension"} | {f.references for t in facts for f in t.foreign_keys})
    rows = ["| fact | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    for t in sorted(facts, key=lambda t: t.table_name):
        cells = []
        for n in names:
            keys = [f for f in t.foreign_keys if f.references == n]
            marks = [("H" + "+C" * bool(f.durable_column) if f.event_at else "X") + "+I" * bool(f.identity_map) for f in keys]
            cells.append("; ".join(f"{m} ({f.column})" for m, f in zip(marks, keys, strict=True)) if len(keys) > 1 else "".join(marks))
        rows.append(f"| {t.table_name} | " + " | ".join(cells) + " |")
    return "\n".join(rows)


def conformance_warnings(tables: Sequence[TableSpec]) -> list[str]:
    """Dimensions that facts look up by different natural keys, or that no definition produces."""
    known = {t.table_name: t for t in tables if t.table_type == "dimension"}
    used: dict[str, set[tuple[str, ...]]] = {}
    for t in tables:
        for f in t.foreign_keys:
            used.setdefault(f.references, set()).add(tuple(sorted(f.lookup.values())))
    out = [f"{d} is looked up by different keys" for d, keys in sorted(used.items()) if len(keys) > 1]
    out += [f"{d} is not defined in this project" for d in sorted(set(used) - set(known))]
    return out + [f"{d} is looked up by something else than its natural keys" for d, keys in sorted(used.items()) if d in known and any(set(k) != set(known[d].natural_keys) for k in keys)]


def job(project: Project, name: str, command: str = "python -m orrery run", folder: str | None = None, warehouse: str | None = None) -> dict:
    """The project as a generic job: a task per table, run after those it depends on, one run at a time.

    With ``folder`` and ``warehouse`` each command runs as it stands; else it is ``command`` and the table, for a caller's own runner.
    """
    line = lambda t: f"{command} {shlex.quote(folder)} --warehouse {shlex.quote(warehouse)} --table {shlex.quote(t)}" if folder and warehouse else f"{command} {t}"
    tasks = [{"task_key": t, "command": line(t), "depends_on": sorted(project.upstream[t])} for level in project.levels for t in level]
    return {"name": name, "max_concurrent_runs": 1, "tasks": tasks}
