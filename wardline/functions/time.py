"""Date and time helpers. "Now" is always an explicit argument."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = str | dt.date | dt.datetime
Name = Column | str
DAY_MILLIS = 86_400_000


def _col(value: Name) -> Column:
    return F.col(value) if isinstance(value, str) else value


def to_datetime(value: Moment) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    return dt.datetime.fromisoformat(value)


def as_moment(value: Moment) -> Column:
    """A zone-free timestamp literal, so comparisons stay on the stored type."""
    return F.lit(to_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def as_day(value: Moment) -> Column:
    return F.lit(to_datetime(value).date().isoformat()).cast("date")


def _days_after(value: Moment, days: int) -> dt.datetime:
    midnight = dt.datetime.combine(to_datetime(value).date(), dt.time())
    return midnight + dt.timedelta(days=days)


def on_day(moment: Name, day: Moment) -> Column:
    """True within that calendar day; a half-open range, so it reaches the scan."""
    return between_days(moment, day, day)


def between_days(moment: Name, first: Moment, last: Moment) -> Column:
    """True from the start of ``first`` to the end of ``last``."""
    c = _col(moment)
    return (c >= as_moment(_days_after(first, 0))) & (c < as_moment(_days_after(last, 1)))


def to_last_second(moment: Name, first: Moment, last: Moment) -> Column:
    """True from the start of ``first`` to 23:59:59 of ``last``, both included."""
    end = _days_after(last, 1) - dt.timedelta(seconds=1)
    return _col(moment).between(as_moment(_days_after(first, 0)), as_moment(end))


def months_before(value: Moment, months: int) -> Column:
    """``value`` moved back by whole months; the day is clipped to the month's end."""
    return F.expr(
        f"timestamp_ntz '{to_datetime(value).isoformat(sep=' ')}' - interval '{months}' month"
    )


def days_between(earlier: Name, later: Name) -> Column:
    """Midnights crossed from ``earlier`` to ``later``."""
    return F.datediff(_col(later), _col(earlier))


def started_days(earlier: Name, later: Name) -> Column:
    """Length of the stay in started 24-hour periods."""
    span = F.unix_millis(_col(later).cast("timestamp")) - F.unix_millis(_col(earlier).cast("timestamp"))
    return F.ceil(span / F.lit(DAY_MILLIS)).cast("int")


def weekday(day: Name) -> Column:
    """Day of the week with Sunday = 0."""
    return F.dayofweek(_col(day)) - F.lit(1)


def clock(minutes: Name) -> Column:
    """Minutes after midnight as HH:mm:ss text."""
    m = _col(minutes).cast("int")
    return F.format_string("%02d:%02d:00", F.floor(m / 60), m % 60)
