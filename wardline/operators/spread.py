"""Joins whose left side may hold very many rows of one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WAYS = 8
_SALT = "__salt"


def spread_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str, by: str) -> DataFrame:
    """Join rows with a frame that has one row per key, in ``WAYS`` parts per key.

    Where the right side is an aggregate over the same keys, it is not shuffled for the
    join, and then AQE cannot split a hot key of the left side. So the rows of a key are
    spread by the unique column ``by``, and the few rows of the right side are copied.
    """
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(WAYS - 1))))
    rows = left.withColumn(_SALT, F.pmod(F.xxhash64(by), F.lit(WAYS)).cast("int"))
    return rows.join(copies, [*keys, _SALT], how).drop(_SALT)
