"""What a job returns, and storing it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import stage
from wardline.sources import sinks
from wardline.sources.commits import Change, Manifest, Store
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables

# Applied to the decisions before outputs are derived from them. ``session.stage``
# evaluates them once and cuts the lineage; the default leaves the plan lazy.
Keep = Callable[[DataFrame], DataFrame]


def lazily(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Update:
    """An updated table: its complete new state, the rows that differ, and the state before.

    With ``gone`` the rows that differ are rows of the old state that the new one lacks.
    """

    state: DataFrame
    changed: DataFrame
    old: DataFrame
    gone: bool = False


def without(old: DataFrame, keys: DataFrame, key: str) -> Update:
    """A table that loses the rows with the given keys."""
    return Update(old.join(keys, key, "left_anti"), old.join(keys, key, "left_semi"), old, gone=True)


@dataclass(frozen=True)
class JobResult:
    decisions: DataFrame
    appended: dict[str, DataFrame] = field(default_factory=dict)
    updated: dict[str, Update] = field(default_factory=dict)

    @property
    def accepted(self) -> DataFrame:
        return self.decisions.filter("reason is null").drop("reason")

    @property
    def rejected(self) -> DataFrame:
        return self.decisions.filter("reason is not null")


def update(t: Tables, table: str, changes: DataFrame, values: dict[str, Column]) -> Update:
    """Change rows of a table by key.

    ``changes`` holds the key once per changed row; ``values`` are expressions over
    the old columns and ``new.*``. All other rows and columns stay.
    """
    declared = TABLES[table]
    key = declared.key
    old = t[table]
    marked = changes.select(key, F.struct(F.lit(True).alias("__hit"), *changes.columns).alias("new"))
    hit = F.col("new").isNotNull()

    def apply(frame: DataFrame) -> DataFrame:
        return frame.select(
            *[
                F.when(hit, values[c].cast(old.schema[c].dataType)).otherwise(F.col(c)).alias(c)
                if c in values
                else F.col(c)
                for c in old.columns
            ]
        )

    return Update(apply(old.join(marked, key, "left")), apply(old.join(marked, key)), old)


def commit(result: JobResult, tables: Store, onto: Manifest | None = None) -> Manifest:
    """Write a result to versioned tables: all of its tables change at once, or none.

    Build the job on ``tables.tables()`` with ``keep=session.stage``, so that its outputs
    share one evaluation of the decisions; ``onto`` is the state it was built on.
    """
    changes = {table: Change(new.changed, new.gone) for table, new in result.updated.items()}
    return tables.commit(result.appended, changes, onto)


def store(result: JobResult, root: str) -> None:
    """Write a result into tables stored as plain ``root/<table>`` folders.

    Appended rows are added; of updated tables only the months that hold changed
    rows are written again. All outputs are materialised before the first file is
    replaced, because each of them may read any of the tables. Build the job with
    ``keep=session.stage`` so that they share one evaluation of the decisions.

    The tables change one after the other. Use ``commit`` where they must change at once.
    """
    added = {table: stage(rows) for table, rows in result.appended.items()}
    changed = {table: stage(new.changed) for table, new in result.updated.items()}
    months = {table: sinks.touched_months(rows, table) for table, rows in changed.items()}
    written = {table: stage(_rewritten(new, changed[table], table, months[table])) for table, new in result.updated.items()}
    for table, rows in added.items():
        sinks.append(rows, table, f"{root}/{table}")
    for table, rows in written.items():
        sinks.write_months(rows, table, f"{root}/{table}", months[table])


def _rewritten(new: Update, changed: DataFrame, table: str, months: list[str] | None) -> DataFrame:
    """The new rows of the touched months: what was there, with the changed rows put in or left out."""
    key = TABLES[table].key
    kept = sinks.rows_to_rewrite(new.old, table, months).join(changed.select(key), key, "left_anti")
    return kept if new.gone else kept.unionByName(changed)
