"""Deleting rows under foreign keys: cascade, set to NULL, and refuse, in batch order.

``fallen`` holds, per table, which rows go with which deleted row (the owner): the closure of the
cascading references, level by level down the graph of tables. References that refuse hold
an owner back as long as a row outside its own closure still refers into it. Such a row may
go with another owner that is deleted earlier in the batch; who can be deleted is then the least
fixpoint of rounds over the owners still held, which equals the rule request by request.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.session import stage
from wardline.sources.model import TABLES, Table
from wardline.sources.tables import Tables

OWNER = "__owner"
Step = Callable[[DataFrame], DataFrame]


def children(table: str, action: str, t: Tables) -> Iterator[tuple[Table, str]]:
    """The (child table, column) pairs whose references to ``table`` take this action."""
    for child in TABLES.values():
        for reference in child.references:
            if reference.table == table and reference.on_delete == action and child.name in t:
                yield child, reference.column


def _referring(t: Tables, child: str, column: str, fallen: DataFrame, parent: str) -> DataFrame:
    """Rows of a child that refer to fallen rows: its key and the owner."""
    gone = fallen.select(F.col(TABLES[parent].key).alias(column), OWNER)
    return t[child].select(TABLES[child].key, column).join(gone, column).select(TABLES[child].key, OWNER)


def fallen_rows(t: Tables, table: str, keys: DataFrame, keep: Step = stage) -> dict[str, DataFrame]:
    """Per table the keys of rows that fall with rows of ``table``, each with its owner.

    A row may fall with several owners, and along several paths; it is listed once for each owner.
    """
    fallen = {table: keep(keys.select(TABLES[table].key, F.col(TABLES[table].key).alias(OWNER)))}
    reached = [table]
    for name in reached:
        reached += [child.name for child, _ in children(name, "cascade", t) if child.name not in reached]
    order = _parents_first(list(dict.fromkeys(reached)), t)
    for name in order:
        if name == table:
            continue
        parts = [
            _referring(t, name, column, fallen[parent], parent)
            for parent in order
            if parent in fallen
            for child, column in children(parent, "cascade", t)
            if child.name == name
        ]
        fallen[name] = keep(reduce(DataFrame.unionAll, parts).distinct())
    return fallen


def _parents_first(names: list[str], t: Tables) -> list[str]:
    """Tables in an order in which every parent comes before its children."""
    order: list[str] = []
    while len(order) < len(names):
        placed = [
            n for n in names
            if n not in order and all(p in order for p in names if p != n and any(c.name == n for c, _ in children(p, "cascade", t)))
        ]
        order += placed
    return order


def _holders(t: Tables, fallen: dict[str, DataFrame]) -> DataFrame | None:
    """Rows that would be left behind: ``holder`` (the table and key), its owner, and one other owner it falls with.

    ``other`` is NULL where the row falls with none. None if no reference of the model refuses.
    """
    parts = []
    for parent, rows in fallen.items():
        for child, column in children(parent, "reject", t):
            held = _referring(t, child.name, column, rows, parent).distinct()
            holder = F.concat(F.lit(f"{child.name}:"), F.col(child.key).cast("string")).alias("holder")
            if child.name not in fallen:
                parts.append(held.select(holder, OWNER, F.lit(None).cast("bigint").alias("other")))
                continue
            held = held.join(fallen[child.name], [child.key, OWNER], "left_anti")
            others = fallen[child.name].select(child.key, F.col(OWNER).alias("other"))
            parts.append(held.join(others, child.key, "left").select(holder, OWNER, F.col("other").cast("bigint")))
    return reduce(DataFrame.unionAll, parts) if parts else None


def deletable(t: Tables, fallen: dict[str, DataFrame], turns: DataFrame, keep: Step = stage) -> DataFrame:
    """Owners that can be deleted, in the order of ``turns`` (``__owner, turn``): ``__owner``.

    Each round adds the owners whose holders have all gone with owners added before and
    asked for earlier. Most owners have no holder and are decided at once.
    """
    holders = _holders(t, fallen)
    if holders is None:
        return turns.select(OWNER)
    holders = holders.join(turns, OWNER).withColumnRenamed("turn", "own_turn")
    before = turns.select(F.col(OWNER).alias("other"), "turn")
    # Only an owner asked for earlier can take a holder away.
    holders = keep(
        holders.join(before, "other", "left")
        .withColumn("other", F.when(F.col("turn") < F.col("own_turn"), F.col("other")))
        .select("holder", OWNER, "other")
        .distinct()
    )
    done = keep(turns.select(OWNER).join(holders, OWNER, "left_anti"))
    while True:
        gone = done.select(F.col(OWNER).alias("other"), F.lit(True).alias("gone"))
        left = holders.join(done, OWNER, "left_anti").join(gone, "other", "left")
        free = left.groupBy(OWNER, "holder").agg(F.bool_or(F.coalesce("gone", F.lit(False))).alias("gone"))
        new = keep(free.groupBy(OWNER).agg(F.bool_and("gone").alias("free")).filter("free").select(OWNER))
        if new.isEmpty():
            return done
        done = keep(done.unionAll(new))
