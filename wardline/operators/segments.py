"""Running values of a group that may hold a large share of all rows.

A window partitioned by the group alone sorts and sums a hot group in one task. Here all rows
are cut into ranges of their common order first, so that no (group, range) holds more rows
than a range does. Each of these is reduced to one row; a prefix over those rows, at most
one per range and group, gives what a range starts from; and the window runs inside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import stage

RANGE = "__range"


def in_ranges(rows: DataFrame, order: Sequence[str], ranges: int | None = None, keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """``rows`` with the number of their range in ``order``; earlier rows have no larger number.

    The borders are drawn from the data, so ranges hold about equally many rows, however the
    moments cluster, given that ``order`` tells rows apart. The numbers are those of
    shuffle partitions and are written once by ``keep``, as a second evaluation could draw others.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(rows.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()))


def _before(group: str) -> Window:
    return Window.partitionBy(group).orderBy(RANGE)


def previous(rows: DataFrame, group: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the value in the row before of the same group, NULL in its first row.

    ``rows`` comes from ``in_ranges``; ``value`` is never NULL.
    """
    inside = Window.partitionBy(group, RANGE).orderBy(*order)
    last = rows.groupBy(group, RANGE).agg(F.max_by(value, F.struct(*order)).alias("__last"))
    start = last.select(group, RANGE, F.lag("__last").over(_before(group)).alias("__start"))
    joined = rows.join(start, [group, RANGE])
    return joined.withColumn(name, F.coalesce(F.lag(value).over(inside), "__start")).drop("__start")


def running_sum(rows: DataFrame, group: str, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of the group up to this one.

    ``rows`` comes from ``in_ranges``; ``value`` is never NULL.
    """
    inside = Window.partitionBy(group, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = _before(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(group, RANGE).agg(F.sum(value).alias("__sum"))
    bases = sums.select(group, RANGE, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__base"))
    joined = rows.join(bases, [group, RANGE])
    return joined.withColumn(name, F.col("__base") + F.sum(value).over(inside)).drop("__base")
