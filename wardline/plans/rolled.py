"""Datasets computed from stored daily totals instead of the facts.

They equal the datasets of the same names in ``reports``, ``visits`` and ``billing`` on the same state.
Totals read a row per day and key; the patient reports use the index of patients per month.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_day, money
from wardline.functions.time import Moment, to_datetime
from wardline.operators.activity import BY_DAY, BY_SECOND, Within, touched_patients
from wardline.plans import reports
from wardline.plans.billing import period_start
from wardline.sources.rollups import Rollups
from wardline.sources.tables import Tables

_KINDS = ("new_patients", "appointments", "consultations", "admissions")


def _counts(rollups: Rollups, first: Moment, last: Moment) -> DataFrame:
    """New patients, appointments, consultations and admissions in one row."""
    parts = [rollups.days(kind, first, last).select(F.lit(kind).alias("kind"), "n") for kind in _KINDS]
    n = [F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(kind) for kind in _KINDS]
    return reduce(DataFrame.unionAll, parts).agg(*n)


def daily_summary(rollups: Rollups, date: Moment) -> DataFrame:
    return _counts(rollups, date, date).select(as_day(date).alias("date"), "*")


def range_summary(rollups: Rollups, as_of: Moment, start_date: Moment | None = None, end_date: Moment | None = None) -> DataFrame:
    """Counts of a date range; by default the last 30 days up to today."""
    first = start_date or (to_datetime(as_of) - dt.timedelta(days=V.RANGE_SUMMARY_DAYS))
    last = end_date or as_of
    return _counts(rollups, first, last).select(as_day(first).alias("start_date"), as_day(last).alias("end_date"), "*")


def _mean(total: str, n: str) -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(n))


def doctor_visits_summary(rollups: Rollups, as_of: Moment, days: int = V.VISIT_SUMMARY_DAYS) -> DataFrame:
    """Visit counts and average vitals per doctor over the last days."""
    found = rollups.since("doctor_visits", to_datetime(as_of) - dt.timedelta(days=days))
    return found.select(
        "doctor_id",
        F.col("visits").alias("total_visits"),
        *(F.col(name.lower()).alias(f"{name.lower()}_count") for name in V.CONDITIONS),
        F.col("ready").alias("ready_for_discharge_count"),
        *(_mean(f"sum_{name}", f"n_{name}").alias(f"avg_{name}") for name in ("temperature", "oxygen_saturation", "pulse_rate")),
    )


def doctor_discharge_stats(rollups: Rollups, as_of: Moment, period: str = "month") -> DataFrame:
    """Discharge counts, revenue, stay and payments per doctor over a period."""
    start = rollups.spark.range(1).select(period_start(as_of, period).alias("at")).first()["at"]
    found = rollups.since("doctor_discharges", start)
    return found.select(
        "doctor_id",
        F.col("discharges").alias("total_discharges"),
        F.col("follow_up").alias("follow_up_required"),
        money(F.col("billed")).alias("total_revenue"),
        _mean("billed", "n_billed").alias("average_bill"),
        _mean("days", "n_days").alias("avg_hospital_stay"),
        *(F.col(state).alias(f"{state}_count") for state in ("paid", "unpaid", "partial")),
        money(F.col("received")).alias("total_paid"),
        money(F.col("pending")).alias("total_pending"),
    )


def doctor_patients(rollups: Rollups, first: Moment, last: Moment) -> DataFrame:
    """Distinct patients with an appointment in the range, per doctor."""
    return rollups.range("doctor_patients", first, last).select("doctor_id", F.col("n").alias("patients"))


def _of_touched(rollups: Rollups, first: Moment, last: Moment, within: Within) -> Tables:
    """The tables of the newest state, with the appointments and admissions of those months only
    in which a patient touched in the range has any. Rows of other patients do not matter to the reports."""
    store = rollups.store
    t = store.tables()
    touched = touched_patients(t, first, last, within)
    frames = {
        table: store._rows(table, rollups.folders_with(index, touched))
        for table, index in (("appointments", "appointment_patients"), ("admissions", "admission_patients"))
    }
    return t.replacing(**frames)


def patients_range(rollups: Rollups, start_date: Moment, end_date: Moment) -> DataFrame:
    """``reports.patients_range``, reading only the months that hold a touched patient."""
    return reports.patients_range(_of_touched(rollups, start_date, end_date, BY_SECOND), start_date, end_date)


def daily_patients(rollups: Rollups, date: Moment) -> DataFrame:
    """``reports.daily_patients``, reading only the months that hold a touched patient."""
    return reports.daily_patients(_of_touched(rollups, date, date, BY_DAY), date)
