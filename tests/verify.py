"""python tests/verify.py FOLDER [NAME...]: runs queries against their SQL and prints what differs. $VERIFY_ZONE: the session's time zone."""

from __future__ import annotations

import hashlib
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}/*.parquet')" if p.is_dir() else f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None:
        return "\\N"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (float, Decimal)):
        return f"{float(v):.6g}"
    return str(v)


def bag(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in at], sorted(tuple(plain(r[i]) for i in at) for r in rows)


def digest(rows: list[tuple]) -> str:
    return hashlib.md5(repr(rows).encode()).hexdigest()[:12]


def compare(spark, con, folder: str, name: str, queries, oracles) -> str:
    began = time.time()
    df = queries[name](spark, folder)
    columns, ours = bag(df.columns, df.collect())
    took = time.time() - began
    if name not in oracles:
        return f"rows-only {name}: {len(ours)} rows, {took:.1f} s"
    began = time.time()
    cur = con.execute(oracles[name])
    names, theirs = bag([d[0] for d in cur.description], cur.fetchall())
    sql = time.time() - began
    if columns != names:
        return f"FAIL {name}: columns {columns} {names}"
    if ours != theirs:
        a, b = set(ours), set(theirs)
        return f"FAIL {name}: {len(ours)} rows, SQL {len(theirs)}; only ours {sorted(a - b)[:4]}, only SQL {sorted(b - a)[:4]}"
    return f"ok {name}: {len(ours)} rows, {took:.1f} s, SQL {sql:.1f} s"


if __name__ == "__main__":
    import __spark_entry__ as entry

    from orrery.session import session

    folder, names = sys.argv[1], sys.argv[2:]
    spark = session("local[8]", **({"spark.sql.session.timeZone": zone} if (zone := os.environ.get("VERIFY_ZONE")) else {}))
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles, con = entry.queries(), entry.oracle_sql(), views(folder)
    bad = 0
    for name in names or queries:
        try:
            said = compare(spark, con, folder, name, queries, oracles)
        except Exception as e:  # noqa: BLE001 - report and go on
            said = f"FAIL {name}: {type(e).__name__} {str(e)[:600]}"
        bad += said.startswith("FAIL")
        print(said, flush=True)
    sys.exit(bool(bad))
