"""Aggregates of one entity or of every entity, and row counts of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summarise(df: DataFrame, key: str, value: int | None, *measures: Column) -> DataFrame:
    """``measures`` per ``key``; for a given ``value`` always exactly one row.

    The one-row form yields zero counts and NULL sums where nothing matches.
    """
    if value is None:
        return df.groupBy(key).agg(*measures)
    one = df.filter(F.col(key) == value).agg(*measures)
    return one.select(F.lit(value).cast(df.schema[key].dataType).alias(key), "*")


def total(df: DataFrame) -> DataFrame:
    """The row count a list report carries next to its rows."""
    return df.agg(F.count(F.lit(1)).alias("total"))
