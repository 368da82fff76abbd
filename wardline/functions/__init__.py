"""Column helpers with the semantics every dataset shares."""

from wardline.functions.text import contains_text, first_given, full_name, joined, same_text, spaced_name
from wardline.functions.time import (
    as_day,
    as_moment,
    between_days,
    clock,
    days_between,
    months_before,
    on_day,
    started_days,
    to_last_second,
    weekday,
)
from wardline.functions.values import exact_sum, falsy, mean, money, or_default, rate, truthy

__all__ = [
    "as_day",
    "as_moment",
    "between_days",
    "clock",
    "contains_text",
    "days_between",
    "exact_sum",
    "falsy",
    "first_given",
    "full_name",
    "joined",
    "mean",
    "money",
    "months_before",
    "on_day",
    "or_default",
    "rate",
    "same_text",
    "spaced_name",
    "started_days",
    "to_last_second",
    "truthy",
    "weekday",
]
