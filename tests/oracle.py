"""Compare registered queries with their oracle SQL in DuckDB.

    python tests/oracle.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DEFAULT_SF = "/root/testdata/sf0.01"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    """One spelling per value, so both engines' rows can be sorted and compared."""
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(number + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    return type(value).__name__


def compare(frame, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    columns = sorted(frame.columns)
    got = [tuple(r[c] for c in columns) for r in frame.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} vs {sorted(names)}"
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for i, c in enumerate(columns):
        a = {kind(r[i]) for r in got if r[i] is not None}
        b = {kind(r[i]) for r in want if r[i] is not None}
        if a != b:
            return f"type of {c}: {a} vs {b}"
    left = sorted(tuple(plain(v) for v in r) for r in got)
    right = sorted(tuple(plain(v) for v in r) for r in want)
    for a, b in zip(left, right):
        if a != b:
            return f"row {str(a)[:300]} vs {str(b)[:300]}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default=DEFAULT_SF)
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, sqls = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args.names or any(n.startswith(p) for p in args.names)]
    bad = 0
    con = connect(args.sf)
    for name in chosen:
        start = time.time()
        try:
            frame = queries[name](spark, args.sf)
            if name in sqls:
                problem = compare(frame, con, sqls[name])
            else:
                rows = frame.count()
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001 - the report is the point
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        took = time.time() - start
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {took:.2f}s {'' if name in sqls else '(rows only)'} {problem or ''}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
