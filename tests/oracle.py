"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows.

``python -m tests.oracle [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import sys
import time
import traceback
from pathlib import Path

import duckdb

from rankweave.plans.registry import REGISTRY
from rankweave.session import build_session


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float):
        return value + 0.0
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return float(value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda t: tuple((v is None, f"{v:.4f}" if isinstance(v, float) else str(v)) for v in t))


def compare(spark, con, sf_dir: str, name: str) -> tuple[str, float, float]:
    """'ok', 'close' (floats differ in the last digits) or a description of the difference; seconds of both."""
    query = REGISTRY[name]
    start = time.time()
    df = query.plan(spark, sf_dir)
    got = df.collect()
    spark_sec = time.time() - start
    if query.sql is None:
        return f"rows={len(got)} (no SQL)", spark_sec, 0.0
    start = time.time()
    cursor = con.execute(query.sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    sql_sec = time.time() - start
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", spark_sec, sql_sec
    left, right = rows_of(df.columns, got), rows_of(names, want)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}", spark_sec, sql_sec
    if not left:
        return "empty", spark_sec, sql_sec
    if left == right:
        return "ok", spark_sec, sql_sec
    close = True
    for a, b in zip(left, right):
        for x, y in zip(a, b):
            if x == y:
                continue
            if isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-9 * max(1, abs(x), abs(y)):
                continue
            close = False
            return f"value {str(x)[:80]!r} != {str(y)[:80]!r} in {str(a)[:200]} / {str(b)[:200]}", spark_sec, sql_sec
    return ("close" if close else "differs"), spark_sec, sql_sec


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(REGISTRY)
    spark = build_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name in names:
        try:
            status, a, b = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            status, a, b = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0.0
            if len(names) < 4:
                traceback.print_exc()
        print(f"{name:28s} spark {a:6.2f}s duckdb {b:6.2f}s  {status}", flush=True)


if __name__ == "__main__":
    main()
