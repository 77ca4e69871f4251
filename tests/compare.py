"""Compares registered queries with their SQL run by DuckDB, and prints one line per query.

Usage: python -m tests.compare [--sf 0.01 | --folder PATH] [query ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, decimal.Decimal):
        return "decimal"
    return type(value).__name__


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0  # -0.0 and 0.0 are the same result
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def compare(spark, connection, name: str, build, sql: str, folder: str) -> str | None:
    """None when both sides agree in columns, value types and values, else what differs."""
    result = build(spark, folder)
    ours = _table(result.columns, [tuple(r) for r in result.collect()])
    cursor = connection.execute(sql)
    theirs = _table([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} / {len(theirs[1])}"
    kinds = [
        {c: {_kind(r[i]) for r in rows if r[i] is not None} for i, c in enumerate(side[0])}
        for side, rows in ((ours, ours[1]), (theirs, theirs[1]))
    ]
    if kinds[0] != kinds[1]:
        return "types " + str({c: (kinds[0][c], kinds[1][c]) for c in kinds[0] if kinds[0][c] != kinds[1][c]})
    wrong = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours[1])} rows differ, first {wrong[0]}"
    return None


def main() -> None:
    from basketlens.plans import catalog
    from basketlens.session import build_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--folder", help="a table folder instead of a scale factor")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    folder = options.folder or f"/root/testdata/sf{options.sf}"
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(folder)
    builders, sqls = catalog.queries(), catalog.oracle_sql()
    bad = 0
    for name in options.names or sqls:
        start = time.time()
        try:
            problem = compare(spark, connection, name, builders[name], sqls[name], folder)
        except Exception as error:  # a report tool: show the failure and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'BAD '} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print(f"{bad} of {len(options.names or sqls)} differ")
    spark.stop()


if __name__ == "__main__":
    main()
