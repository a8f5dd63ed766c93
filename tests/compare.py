"""Run registered queries next to their SQL and compare the rows.

``python -m tests.compare [sf] [name ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)
    return value


def normal(columns, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark_rows, sql_rows) -> str | None:
    """None when equal, otherwise what differs."""
    (c1, r1), (c2, r2) = normal(*spark_rows), normal(*sql_rows)
    if c1 != c2:
        return f"columns {c1} != {c2}"
    if len(r1) != len(r2):
        return f"rows {len(r1)} != {len(r2)}; e.g. {set(r1) ^ set(r2) and list(set(r1) ^ set(r2))[:4]}"
    bad = [(a, b) for a, b in zip(r1, r2) if [type(x) for x in a] != [type(x) for x in b] or a != b]
    return f"{len(bad)} rows differ: {bad[:3]}" if bad else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from basketlens.session import build_session

    sf = argv[0] if argv else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
            "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, plans, sqls = connect(sf_dir), queries(), oracle_sql()
    failed = 0
    for name in argv[1:] or plans:
        started = time.time()
        try:
            df = plans[name](spark, sf_dir)
            got = df.columns, [tuple(r) for r in df.collect()]
        except Exception as exc:  # noqa: BLE001
            print(f"ERROR {name}: {str(exc)[:600]}")
            failed += 1
            continue
        took = time.time() - started
        if name not in sqls:
            print(f"rows  {name} {len(got[1])} {took:.1f}s")
            continue
        try:
            rel = con.execute(sqls[name])
            want = [d[0] for d in rel.description], rel.fetchall()
            problem = compare(got, want)
        except Exception as exc:  # noqa: BLE001
            problem = f"sql: {str(exc)[:600]}"
        if problem is None and not got[1]:
            problem = "no rows"
        print(f"{'ok   ' if problem is None else 'DIFF '} {name} {len(got[1])} {took:.1f}s {problem or ''}")
        failed += problem is not None
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sys.exit(1 if main(sys.argv[1:]) else 0)
