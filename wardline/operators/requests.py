"""Deciding batches of requests.

A request frame has ``request_id`` (unique) and ``requested_at``; the order of a
batch is (requested_at, request_id). A job marks each request with the reason it
is rejected for, or NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.sources.model import TABLES
from wardline.sources.tables import Tables

ID, AT = "request_id", "requested_at"


def turn() -> Column:
    """The position of a request in its batch, as one comparable value."""
    return F.struct(F.col(AT), F.col(ID))


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The first reason whose condition is TRUE, else NULL."""
    (condition, reason), *rest = cases
    chain = F.when(condition, F.lit(reason))
    for condition, reason in rest:
        chain = chain.when(condition, F.lit(reason))
    return chain


def with_known(requests: DataFrame, parents: DataFrame, column: str, mark: str, key: str | None = None) -> DataFrame:
    """Add ``mark``: TRUE where ``column`` is a key of ``parents``, else NULL."""
    keys = parents.select(F.col(key or column).alias(column), F.lit(True).alias(mark))
    return requests.join(keys, column, "left")


def with_references(requests: DataFrame, t: Tables, table: str, columns: Sequence[str], flag: str) -> DataFrame:
    """Add ``flag``: TRUE where every given reference of the row exists (NULL ones count as kept)."""
    parents = {r.column: r.table for r in TABLES[table].references}
    kept = F.lit(True)
    marks = []
    for column in columns:
        parent = parents[column]
        marks.append(f"__known_{column}")
        keys = t[parent].select(F.col(TABLES[parent].key).alias(column), F.lit(True).alias(marks[-1]))
        requests = requests.join(keys, column, "left")
        kept = kept & (F.col(marks[-1]).isNotNull() | F.col(column).isNull())
    return requests.select("*", kept.alias(flag)).drop(*marks)


def winners(requests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first request of every key: the keys, ``winner_id`` and ``winner_turn``.

    An aggregate rather than a window: it is partial before any shuffle, however many
    requests compete for one key.
    """
    first = requests.groupBy(*keys).agg(F.min(turn()).alias("winner_turn"))
    return first.withColumn("winner_id", F.col("winner_turn")[ID])


def newest_value(requests: DataFrame, key: str, value: str) -> DataFrame:
    """The value in the last request of every key."""
    last = requests.groupBy(key).agg(F.max(F.struct(AT, ID, value)).alias("last"))
    return last.select(key, F.col("last")[value].alias(value))


def with_new_key(rows: DataFrame, requests: DataFrame, t: Tables, table: str, step_from: str = ID) -> DataFrame:
    """Give new rows their surrogate key.

    Keys continue after the largest stored one in steps of the table, by request id.
    Like an identity column that also counts failed inserts, a rejected request
    leaves a gap; in return no global numbering pass is needed.
    """
    declared = TABLES[table]
    key, step = declared.key, declared.key_step
    last = t[table].agg(F.coalesce(F.max(key), F.lit(declared.first_key - step)).cast("bigint")).scalar()
    first = requests.agg(F.min(step_from)).scalar()
    rows = rows.withColumn(key, last + F.lit(step) * (F.col(step_from) - first + F.lit(1)))
    if declared.login is not None:
        column, prefix = declared.login
        rows = rows.withColumn(column, F.concat(F.lit(prefix), F.col(key).cast("string")))
    return rows


def as_table(rows: DataFrame, table: str) -> DataFrame:
    """Rows in the declared columns and types of a table, absent columns NULL."""
    present = set(rows.columns)
    return rows.select(
        *[
            (F.col(c.name) if c.name in present else F.lit(None)).cast(c.type).alias(c.name)
            for c in TABLES[table].columns
        ]
    )
