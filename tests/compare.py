"""Compares every registered query with its SQL, run by DuckDB on the same files.

    python tests/compare.py [folder] [query ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    """Rows with columns in name order, sorted: an order-insensitive form."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda row: tuple((v is None, str(v)) for v in row))


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    return sorted(columns), rows_of(columns, result.fetchall())


def difference(query, sql, spark, folder, connection) -> str | None:
    """What differs, or None."""
    columns, rows = spark_rows(query(spark, folder))
    other_columns, other_rows = sql_rows(connection, sql)
    if columns != other_columns:
        return f"columns {columns} / {other_columns}"
    if len(rows) != len(other_rows):
        return f"{len(rows)} rows / {len(other_rows)}"
    unequal = [(a, b) for a, b in zip(rows, other_rows) if a != b]
    if unequal:
        return f"{len(unequal)} of {len(rows)} rows differ, first {unequal[0]}"
    return None if rows else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from retally.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql, bad = duck(folder), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            found = difference(query, sql[name], spark, folder, connection)
        except Exception as error:  # noqa: BLE001 - reported, and counted as a difference
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.2f}s", found or "")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
