"""Latest rows, ties and top-n, per group or overall.

Top-n per group is a rank filter. Spark evaluates it with a group limit before the
shuffle, so a group that holds much of the table is cut to a few rows in every map
task. Latest values are aggregates, partial before the shuffle. No group travels
whole to one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_RANK = "__rank"


def top_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows of every group in the given order; all of them for None."""
    if n is None:
        return df
    ranked = df.withColumn(_RANK, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(_RANK) <= n).drop(_RANK)


def latest_value(moment: str, key: str, value: str) -> Column:
    """Aggregate: the value at the greatest (moment, key) of the group."""
    return F.max(F.struct(F.col(moment), F.col(key), F.col(value)))[value]


def latest_with_ties(df: DataFrame, keys: Sequence[str], moment: str) -> DataFrame:
    """All rows that carry the greatest ``moment`` of their group.

    The greatest moments come from a partial aggregate and are joined back on key and
    moment: very many rows of one group, even with one and the same moment, never have
    to meet in one task. Cut ``df`` to the wanted keys first.
    """
    latest = df.groupBy(*keys).agg(F.max(moment).alias(moment))
    return df.join(latest, [*keys, moment])


def top(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """The first ``n`` rows overall; all of them for None."""
    return df if n is None else df.orderBy(*order).limit(n)


def referring(df: DataFrame, *parents: DataFrame) -> DataFrame:
    """Rows whose mandatory references exist: each parent frame holds one key column.

    A limit that comes after this and before the joins with the parents keeps as many
    rows as one after the joins.
    """
    for parent in parents:
        df = df.join(parent, parent.columns[0], "left_semi")
    return df
