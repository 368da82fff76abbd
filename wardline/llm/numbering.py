"""Global positions in a sort order without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import staged


def numbered(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """``df`` with its 0-based position in ``order``, which must tell all rows apart.

    Ranges of the order are numbered on their own and shifted by the prefix sum of the
    range sizes, a table with one row per partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.withColumn("_inside", inside)
        .join(staged(bases, "bases"), "_range")
        .withColumn(name, F.col("_base") + F.col("_inside") - 1)
        .drop("_range", "_inside", "_base")
    )
