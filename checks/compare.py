"""Run queries in Spark and their SQL in DuckDB, and compare the results.

    python -m checks.compare [sample folder] [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.jobs_oracle import JOB_ORACLE
from checks.oracle import ORACLE, statement
from checks.queries import QUERIES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "string": "VARCHAR",
    "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def plain(value: object) -> object:
    if isinstance(value, decimal.Decimal):
        return f"{value:f}"
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return "<null>" if value is None else str(value)


def rows(records: list[tuple], names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def database(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    return connection


def kind_of(spark_type: str) -> str:
    return spark_type.upper().replace(" ", "") if spark_type.startswith("decimal") else KINDS.get(spark_type, spark_type)


def compare(spark: SparkSession, connection: duckdb.DuckDBPyConnection, folder: str, name: str) -> tuple[bool, str]:
    started = time.time()
    frame = QUERIES[name](spark, folder)
    mine = [tuple(r) for r in frame.collect()]
    spent = time.time() - started
    sql = {**ORACLE, **JOB_ORACLE}.get(name)
    if sql is None:
        return True, f"rows only: {len(mine)} ({spent:.2f}s)"
    relation = connection.sql(statement(sql))
    theirs = relation.fetchall()
    names = relation.columns
    if sorted(names) != sorted(frame.columns):
        return False, f"columns: only Spark {set(frame.columns) - set(names)}, only SQL {set(names) - set(frame.columns)}"
    if len(mine) != len(theirs):
        return False, f"rows: Spark {len(mine)}, SQL {len(theirs)}"
    left, right = rows(mine, frame.columns), rows(theirs, names)
    if left != right:
        bad = next((a, b) for a, b in zip(left, right) if a != b)
        wrong = [(n, x, y) for n, x, y in zip(sorted(names), *bad) if x != y]
        return False, f"values, first difference (column, Spark, SQL): {wrong[:6]}"
    kinds = {n: str(k).replace(" ", "") for n, k in zip(relation.columns, relation.types)}
    types = [(n, kind_of(k), kinds[n]) for n, k in frame.dtypes if kind_of(k) != kinds[n]]
    return True, f"{len(mine)} rows ({spent:.2f}s)" + (f" types differ: {types}" if types else "")


def main() -> int:
    from wardline.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, connection = local_session(), database(folder)
    failed = 0
    for name in names:
        try:
            ok, text = compare(spark, connection, folder, name)
        except Exception as error:  # report and go on with the next query
            ok, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print(("ok   " if ok else "FAIL ") + f"{name}: {text}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
