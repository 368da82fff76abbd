"""Parents with all of their children: joined without an outer join on the many side, or nested in pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.segments import in_ranges, running_sum
from wardline.session import stage

#: Children in one list, at most.
PAGE_ROWS = 100


def with_children(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """A left outer join whose right side may hold very many rows of one key.

    A left outer join can only split its left side, so one parent with a large share
    of all children would be one task. Here the pairs come from an inner join, which
    splits either side or broadcasts the parents, and the childless parents from an
    anti join with the distinct keys.
    """
    pairs = parents.join(children, key)
    alone = parents.join(children.select(key).distinct(), key, "left_anti")
    return pairs.unionByName(alone, allowMissingColumns=True)


def pages(
    rows: DataFrame,
    parents: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    size: int = PAGE_ROWS,
    keep: Callable[[DataFrame], DataFrame] = stage,
) -> DataFrame:
    """Children nested in their parent, as numbered lists of at most ``size``.

    Returns the ``parents`` columns, ``page`` from 0 on, ``children`` (a list of the ``columns``
    in ``order``) and ``in_page``. A parent with more children has more pages, so no list grows with the
    data. Children are numbered in ranges of the whole order, so one parent's rows are never sorted in
    one task; ``order`` tells the rows of a parent apart.
    """
    parent = F.struct(*parents)
    placed = in_ranges(rows.withColumn("__parent", parent), [*parents, *order], keep=keep)
    placed = running_sum(placed.withColumn("__one", F.lit(1)), "__parent", [*parents, *order], "__one", "__place")
    page = F.floor((F.col("__place") - 1) / size).cast("int").alias("page")
    child = F.struct("__place", F.struct(*columns).alias("child"))
    lists = placed.groupBy("__parent", page).agg(F.sort_array(F.collect_list(child)).alias("list"))
    return lists.select(
        "__parent.*", "page", F.col("list.child").alias("children"), F.size("list").alias("in_page")
    )
