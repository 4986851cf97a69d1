"""``python -m orrery``: validate, compile, plan, matrix, job and contract commands need no Spark; run, stream, check, monitor, dry-run and publish commands do."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path


def _values(pairs: list[str]) -> dict:
    return dict(p.split("=", 1) for p in pairs)


#: Commands over a folder of definitions that need a warehouse.
_AT_WAREHOUSE = ("run", "stream", "check", "monitor", "dry-run", "job", "publish-manifest")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="orrery", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "compile", "plan", "matrix", *_AT_WAREHOUSE):
        p = sub.add_parser(name)
        p.add_argument("folder", help="folder of table definitions")
        p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
        p.add_argument("--target", help="set of values in the folder's targets.yml")
        p.add_argument("--warehouse", required=name in _AT_WAREHOUSE, help="where the tables live")
        p.add_argument("--table", action="append", help="only these")
        p.add_argument("--name", default="orrery", help="job, publish-manifest, run: the project's name")
        p.add_argument("--against", help="plan: manifest to compare with")
        p.add_argument("--full-reload", action="store_true")
        p.add_argument("--resume", action="store_true", help="run: go on where the last run of this name stopped")
    p = sub.add_parser("gate", help="compare two folders of contract documents")
    p.add_argument("old")
    p.add_argument("new")
    p = sub.add_parser("contract", help="validate or publish contract documents")
    p.add_argument("action", choices=("validate", "publish"))
    p.add_argument("documents", nargs="+")
    p.add_argument("--object")
    p.add_argument("--warehouse", help="publish: where the registry lives")
    args = parser.parse_args(argv)
    try:
        if args.command == "gate":
            return _gate(args)
        if args.command == "contract":
            return _contract(args, parser)
        return _project(args)
    except (ValueError, OSError) as e:
        print(f"invalid: {e}", file=sys.stderr)
        return 1


def _gate(args) -> int:
    from orrery.plans.contracts import gate

    problems = gate(args.old, args.new)
    print("\n".join(problems) or "compatible")
    return bool(problems)


def _contract(args, parser) -> int:
    from orrery.plans.contracts import Registry, load_contract

    found = [load_contract(Path(d).read_text(), args.object) for d in args.documents]
    for c in found:
        c.rules()  # unknown metrics are errors
    if args.action == "publish":
        if not args.warehouse:
            parser.error("contract publish needs --warehouse")
        from orrery.session import session

        registry = Registry(session(), f"{args.warehouse.rstrip('/')}/etl_registry")
        for c in found:
            print(f"{c.id} {c.version}: {'published' if registry.publish(c) else 'already there'}")
        return 0
    for c in found:
        print(f"{c.id} {c.version}: {len(c.properties)} properties, {len(c.rules())} rules")
    return 0


def _project(args) -> int:
    from orrery.plans.config import load_project
    from orrery.plans.graph import bus_matrix, compile_project, conformance_warnings, job, manifest, manifest_diff

    tables = load_project(args.folder, _values(args.set), args.target)
    project = compile_project(tables)
    for i in project.issues:
        print(f"{i.severity}: {i.code} {i.table}: {i.detail}", file=sys.stderr)
    if args.command == "validate":
        print(f"{len(tables)} tables")
    elif args.command == "compile":
        print(json.dumps(manifest(project), indent=1, default=str))
    elif args.command == "plan":
        now = manifest(project)
        print(json.dumps(manifest_diff(json.loads(Path(args.against).read_text()), now) if args.against else {"levels": project.levels}, indent=1))
    elif args.command == "matrix":
        print(bus_matrix(tables))
        print("\n".join(conformance_warnings(tables)), file=sys.stderr)
    elif args.command == "job":
        print(json.dumps(job(project, args.name, folder=args.folder, warehouse=args.warehouse), indent=1))
    elif project.ok:
        return _at_warehouse(args, project)
    return not project.ok


def _at_warehouse(args, project) -> int:
    from orrery.plans.contracts import Registry
    from orrery.plans.graph import manifest
    from orrery.plans.pipeline import Warehouse
    from orrery.session import session
    from orrery.streaming.feeds import run_stream

    warehouse = Warehouse(session(), args.warehouse)
    if args.table:
        if unknown := set(args.table) - set(project.tables):
            raise ValueError(f"no table {', '.join(sorted(unknown))}")
        project.levels = [[t for t in level if t in args.table] for level in project.levels]
    specs = [project.tables[t] for level in project.levels for t in level]
    if args.command == "publish-manifest":
        new = Registry(warehouse.spark, f"{warehouse.root}/etl_registry").publish_manifest(args.name, manifest(project))
        print("published" if new else "already there")
        return 0
    if args.command == "monitor":
        found = warehouse.monitor(specs)
        print("\n".join(f"{t}: {x}" for t, xs in found.items() for x in xs) or "all contracts hold")
        return any(found.values())
    if args.command == "check":
        failed = [f"{s.table_name}: {o.rule}" for s in specs for o in warehouse.validate(s) if not o.ok]
        print("\n".join(failed) or "all checks hold")
        return bool(failed)
    if args.command == "dry-run":
        for s in specs:
            print(f"{s.table_name}: {', '.join(warehouse.dry_run(s))}")
        return 0
    if args.command == "stream":
        results = [run_stream(warehouse, s) for s in specs]
        failed = any(r.errors for r in results)
    else:
        results = warehouse.run_project(project, full_reload=args.full_reload, pipeline=args.name if args.resume else None)
        failed = any(r.status == "FAILED" for r in results)
    for r in results:
        print(r)
    return failed


if __name__ == "__main__":
    sys.exit(main())
