"""Run registered queries next to their SQL checks: python tools/compare.py [folder] [name-prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from relearn import catalog  # noqa: E402
from relearn.catalog.bindings import BASE  # noqa: E402
from relearn.session import local_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9))
    if isinstance(value, decimal.Decimal):
        return f"D{value.as_tuple().exponent}:{value}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return f"{type(value).__name__}:{value}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def compare(name, df, con, sql):
    """None when equal, else what differs."""
    columns, rows = canonical(df.columns, df.collect())
    if sql is None:
        return None if rows else "no rows"
    got = con.execute(sql)
    want_columns, want = canonical([d[0] for d in got.description], got.fetchall())
    if columns != want_columns:
        return f"columns {columns} != {want_columns}"
    if len(rows) != len(want):
        return f"{len(rows)} rows != {len(want)}"
    if rows != want:
        bad = [(a, b) for a, b in zip(rows, want) if a != b]
        return f"{len(bad)} rows differ, first {bad[0]}"
    return None if rows else "no rows"


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    queries, checks = catalog.queries(), catalog.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.perf_counter()
        try:
            problem = compare(name, query(spark, folder), con, checks.get(name))
        except Exception as exc:  # report and go on with the next query
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} {time.perf_counter() - start:.2f}s {'' if name in checks else '(rows only) '}{problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)
