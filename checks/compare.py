"""Run queries in Spark and their statements in DuckDB and report differences.

    python -m checks.compare SF_DIR [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame, SparkSession

from checks.sql_oracles import oracles
from urbanweave.plans.catalogue import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    """A value both engines print alike: numbers as rounded text, times without zone."""
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, (int, float, Decimal)):
        return "nan" if math.isnan(value) else f"{float(value):.10g}"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value]


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(row[i]) for i in order]) for row in rows)


def open_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def difference(found: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between a Spark result and a DuckDB statement, None when they are equal."""
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} against {sorted(names)}"
    expected = rows_of(names, answer.fetchall())
    actual = rows_of(found.columns, [tuple(row) for row in found.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows against {len(expected)}"
    for got, wanted in zip(actual, expected):
        if got != wanted:
            return f"{got} against {wanted}"
    return None


def main(sf_dir: str, *chosen: str) -> int:
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    connection, statements, failures = open_tables(sf_dir), oracles(), 0
    for name in chosen or QUERIES:
        started = time.monotonic()
        try:
            found = QUERIES[name](spark, sf_dir)
            if name in statements:
                result = difference(found, connection, statements[name])
            else:
                result = None if found.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            result = f"{type(error).__name__}: {str(error)[:300]}"
        failures += result is not None
        print(f"{'ok  ' if result is None else 'DIFF'} {name} {time.monotonic() - started:.1f}s {result or ''}"[:700], flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
