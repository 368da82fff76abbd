"""Text helpers: NULL-tolerant and NULL-propagating joins, caseless comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = Column | str


def _col(value: Name) -> Column:
    return F.col(value) if isinstance(value, str) else value


def joined(*parts: Name) -> Column:
    """Concatenate, reading NULL as the empty string."""
    return F.concat(*[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])


def full_name(first: Name = "first_name", last: Name = "last_name", title: str = "") -> Column:
    """First and last name with a space; a missing part is simply empty."""
    parts = [first, F.lit(" "), last]
    return joined(F.lit(title), *parts) if title else joined(*parts)


def spaced_name(first: Name = "first_name", last: Name = "last_name") -> Column:
    """First and last name with a space; NULL as soon as one part is NULL."""
    return F.concat(_col(first), F.lit(" "), _col(last))


def same_text(column: Name, value: Name) -> Column:
    """Caseless equality. A plain string ``value`` is a literal."""
    other = F.lit(value.lower()) if isinstance(value, str) else F.lower(value)
    return F.lower(_col(column)) == other


def contains_text(column: Name, text: str) -> Column:
    """Caseless substring match; ``%`` and ``_`` in ``text`` act as wildcards."""
    return _col(column).ilike(f"%{text}%")


def first_given(column: Name, default: str) -> Column:
    """The text itself, or ``default`` where it is NULL or empty."""
    c = _col(column)
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)
