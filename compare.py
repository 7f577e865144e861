"""Run registered queries beside their SQL and compare names, types and values.

    python compare.py [--sf 0.01] [--module fleet] [query ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

from checks import all_checks
from voltlake.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, list):
        return tuple(_cell(v) for v in value)
    return value


def _kind(value) -> str:
    return type(value).__name__


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t))


def differences(frame, con, sql: str) -> list[str]:
    columns, mine = rows_of(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = con.execute(sql)
    other_columns, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if columns != other_columns:
        return [f"columns {sorted(set(columns) ^ set(other_columns))}"]
    if len(mine) != len(theirs):
        return [f"rows {len(mine)} != {len(theirs)}"]
    out = []
    for i, name in enumerate(columns):
        bad = [(a, b) for a, b in zip((t[i] for t in mine), (t[i] for t in theirs)) if a != b]
        kinds = {(_kind(a), _kind(b)) for a, b in zip((t[i] for t in mine), (t[i] for t in theirs)) if _kind(a) != _kind(b)}
        if bad:
            out.append(f"{name}: {len(bad)} differ, first {bad[:2]}")
        elif kinds:
            out.append(f"{name}: types {kinds}")
    return out


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--module", action="append", default=[])
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con, failed = local_session(8), connect(sf_dir), 0
    for name, item in all_checks(*args.module).items():
        if args.names and name not in args.names:
            continue
        begin = time.time()
        try:
            frame = item.run(spark, sf_dir)
            if item.sql is None:
                print(f"rows {name}: {len(frame.collect())} ({time.time() - begin:.1f}s)", flush=True)
                continue
            found = differences(frame, con, item.sql)
        except Exception as error:  # report and go on with the next query
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        failed += bool(found)
        print(f"{'FAIL' if found else 'ok'} {name} ({time.time() - begin:.1f}s)", *found, sep="\n   " if found else " ", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
