"""Compare the named queries with their SQL in DuckDB.

Run as a script: python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def _sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df, sql: str, connection) -> str | None:
    """What differs between a DataFrame and a SQL result, or None."""
    relation = connection.sql(sql)
    spark_rows = _sorted_rows([tuple(r) for r in df.collect()], df.columns)
    duck_rows = _sorted_rows(relation.fetchall(), relation.columns)
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} against {sorted(relation.columns)}"
    if len(spark_rows) != len(duck_rows):
        return f"{len(spark_rows)} rows against {len(duck_rows)}"
    for a, b in zip(spark_rows, duck_rows):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"row {a}\n    against {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from tests.conftest import build_test_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:]
    spark = build_test_session()
    connection = connect(folder)
    failed = 0
    for name, run in contract.queries().items():
        if chosen and name not in chosen:
            continue
        if name not in contract.oracle_sql():
            continue
        started = time.time()
        try:
            df = run(spark, folder)
            problem = difference(df, contract.oracle_sql()[name], connection)
            rows = len(connection.sql(contract.oracle_sql()[name]).fetchall())
        except Exception as error:  # the report goes on to the next query
            problem, rows = f"{type(error).__name__}: {str(error)[:1500]}", "?"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {rows} rows {time.time() - started:.2f}s"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print("failed:", failed)
