"""Writing results: append, rewrite of touched months, JSON."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from wardline.functions import as_day, as_moment
from wardline.sources.model import MONTH, TABLES

NO_MONTH = "none"


def with_month(df: DataFrame, table: str) -> DataFrame:
    """Add the storage partition of a fact: the month of its date, ``none`` where unknown."""
    column = TABLES[table].month_of
    if column is None:
        return df
    return df.withColumn(MONTH, F.coalesce(F.date_format(column, "yyyy-MM"), F.lit(NO_MONTH)))


def by_month(df: DataFrame, table: str) -> DataFrameWriter:
    """A writer of a table's rows that lays a fact out by month."""
    if TABLES[table].month_of is None:
        return df.write
    # REBALANCE keeps files of one month together, merges small ones and splits a
    # month that holds much of the data over several tasks.
    return with_month(df, table).hint("rebalance", MONTH).write.partitionBy(MONTH)


def _write(df: DataFrame, table: str, path: str, mode: str) -> None:
    by_month(df, table).mode(mode).option("partitionOverwriteMode", "dynamic").parquet(path)


def append(df: DataFrame, table: str, path: str) -> None:
    """Add rows to a stored table."""
    _write(df, table, path, "append")


def write_table(df: DataFrame, table: str, path: str) -> None:
    """Store a whole table, or write the months the rows belong to again."""
    _write(df, table, path, "overwrite")


def save_bucketed(df: DataFrame, table: str, database: str, path: str, buckets: int) -> None:
    """Store a table in the catalog, hash-bucketed where it is joined one to one.

    Appointments and consultations, and admissions and discharges, then join without a
    shuffle, given the same number of buckets. Only keys that are unique in the table
    are used, so no bucket can be larger than the others; visits, forms and medicines
    are stored plainly, because one stay may hold very many of them.
    """
    key = TABLES[table].together_by
    writer = df.write.mode("overwrite").option("path", path)
    if key is not None:
        # One task per bucket, or each task would write a file into every bucket.
        writer = df.repartition(buckets, key).write.mode("overwrite").option("path", path)
        writer = writer.bucketBy(buckets, key).sortBy(key)
    writer.saveAsTable(f"{database}.{table}")


def touched_months(changed: DataFrame, table: str) -> list[str] | None:
    """The storage months that hold changed rows; None for a table without months."""
    if TABLES[table].month_of is None:
        return None
    return sorted(r[0] for r in with_month(changed, table).select(MONTH).distinct().collect())


def in_months(table: str, months: list[str]) -> Column:
    """Condition on the stored date, as ranges that let a scan skip all other files."""
    declared = TABLES[table]
    column = F.col(declared.month_of)
    literal = as_day if declared.by_name[declared.month_of].type == "date" else as_moment
    spans: list[list[dt.date]] = []
    for month in (m for m in months if m != NO_MONTH):
        start = dt.date.fromisoformat(f"{month}-01")
        end = (start + dt.timedelta(days=31)).replace(day=1)
        if spans and spans[-1][1] == start:
            spans[-1][1] = end
        else:
            spans.append([start, end])
    conditions = [(column >= literal(start)) & (column < literal(end)) for start, end in spans]
    if NO_MONTH in months:
        conditions.append(column.isNull())
    return reduce(or_, conditions, F.lit(False))


def rows_to_rewrite(state: DataFrame, table: str, months: list[str] | None) -> DataFrame:
    """The part of a table's state that lies in the touched months.

    Update in place for a fact: only these months are read and written again. The old
    and the new row of an update lie in one month, because no job moves the date a
    table is stored by.
    """
    return state if months is None else state.filter(in_months(table, months))


def write_months(rows: DataFrame, table: str, path: str, months: list[str] | None) -> None:
    """Replace the touched months; a month that has no rows left is removed.

    ``rows`` must not be computed from the files of ``path``: stage them first.
    """
    if months == []:
        return
    write_table(rows, table, path)
    if months is not None:
        left = set(touched_months(rows, table))
        _remove_months(rows.sparkSession, table, path, [m for m in months if m not in left])


def _remove_months(spark: SparkSession, table: str, path: str, months: list[str]) -> None:
    """Overwrite months with no rows."""
    for month in months:
        spark.createDataFrame([], TABLES[table].schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MONTH}={month}")


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as one JSON text, NULL fields included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))
