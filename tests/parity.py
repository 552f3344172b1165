"""Runs registered queries next to their DuckDB SQL and compares the values.

``python tests/parity.py [sf] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, (int, float)):
        return repr(float(value)) if isinstance(value, float) else str(value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return repr(value)


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty text when equal, else what differs."""
    frame = query(spark, sf_dir)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} vs {sorted(names)}"
    theirs = rows_of(names, cursor.fetchall())
    if ours == theirs:
        return "" if ours else "no rows"
    missing = [r for r in theirs if r not in set(ours)][:2]
    extra = [r for r in ours if r not in set(theirs)][:2]
    return f"{len(ours)} vs {len(theirs)} rows; only Spark {extra}; only DuckDB {missing}"


def main() -> int:
    from snapcat.registry import all_oracles, all_queries
    from snapcat.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("parity", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, bad = all_oracles(), 0
    wanted = sys.argv[2:]
    for name, query in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, query, oracles[name])
            else:
                problem = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        kind = "sql " if name in oracles else "rows"
        print(f"{name:28s} {kind} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return bool(bad)


if __name__ == "__main__":
    sys.exit(main())
