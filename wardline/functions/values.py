"""Numeric helpers: money, rates and zero-as-missing defaults."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Name = Column | str


def _col(value: Name) -> Column:
    return F.col(value) if isinstance(value, str) else value


def money(value: Name) -> Column:
    """A money total in one fixed type."""
    return _col(value).cast("decimal(18,2)")


EXACT = "decimal(18,4)"


def exact_sum(value: Name) -> Column:
    """A sum in exact arithmetic, so that it does not depend on the order of rows."""
    return F.sum(_col(value).cast(EXACT))


def mean(value: Name) -> Column:
    """The average of the given values as a double, from an exact sum; NULL if there are none."""
    return F.try_divide(exact_sum(value).cast("double"), F.count(_col(value)))


def rate(value: Name) -> Column:
    """A rate as a double rounded to four places."""
    return F.round(_col(value).cast("double"), 4)


def falsy(value: Name, kind: T.DataType | None = None) -> Column:
    """True where a request field counts as not given: NULL, zero or empty text."""
    c = _col(value)
    if isinstance(kind, T.StringType):
        return c.isNull() | (c == "")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return c.isNull()
    if isinstance(kind, T.BooleanType):
        return c.isNull() | ~c
    return c.isNull() | (c == F.lit(0))


def truthy(value: Name, kind: T.DataType | None = None) -> Column:
    return ~falsy(value, kind)


def or_default(value: Name, default: Any) -> Column:
    """The value, or ``default`` where it is NULL or zero."""
    c = _col(value)
    return F.when(c.isNull() | (c == F.lit(0)), default if isinstance(default, Column) else F.lit(default)).otherwise(c)
