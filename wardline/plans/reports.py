"""Daily and date-range activity reports.

Each report is a detail frame and a one-row summary computed from it. A summary takes
the ``detail`` frame where the caller has it already, for instance staged.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_day, as_moment, between_days, mean, money, rate, spaced_name
from wardline.functions.time import Moment, to_datetime
from wardline.operators.activity import (
    BY_DAY,
    BY_SECOND,
    at_least_one,
    doctor_activity,
    patient_activity,
    zero,
)
from wardline.operators.people import doctor_names, patient_names
from wardline.operators.ranking import top
from wardline.sources.tables import Tables

_PATIENT = ("age", "gender", "blood_group", "phone_no")


def _total(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")


def _total_money(column: str) -> Column:
    return money(F.coalesce(F.sum(column), F.lit(0)))


def _rows() -> Column:
    return F.count(F.lit(1))


def daily_patients(t: Tables, date: Moment) -> DataFrame:
    """Patients who registered, had an appointment or were admitted on the day.

    ``admissions_today`` counts admissions on or after the day, as reported;
    ``admissions_on_day`` counts those of the day itself.
    """
    return patient_activity(t, date, date, BY_DAY, billing=False).select(
        "patient_id",
        "patient_login_id",
        spaced_name().alias("patient_name"),
        *_PATIENT,
        F.col("created_at").alias("registration_date"),
        F.col("appointments").alias("total_appointments"),
        F.col("appointments_in").alias("appointments_today"),
        F.col("admissions").alias("total_admissions"),
        F.col("admissions_since").alias("admissions_today"),
        F.col("admissions_in").alias("admissions_on_day"),
    )


def daily_patients_summary(t: Tables, date: Moment, detail: DataFrame | None = None) -> DataFrame:
    on_day = between_days("registration_date", date, date)
    detail = daily_patients(t, date) if detail is None else detail
    return detail.agg(
        _rows().alias("total_patients"),
        F.count_if(on_day).alias("new_patients"),
        _total("appointments_today").alias("appointments_today"),
        _total("admissions_today").alias("admissions_today"),
    ).withColumn("date", as_day(date))


def daily_doctors(t: Tables, date: Moment) -> DataFrame:
    """All doctors with their appointments, consultations, visits and revenue of the day."""
    counts = doctor_activity(
        t, date, date, BY_DAY, skip_cancelled=True, consulted_in_range=True, admissions=False
    )
    exact = F.col("consultation_fee") * zero("completed")
    return counts.select(
        "doctor_id",
        "doctor_login_id",
        spaced_name().alias("doctor_name"),
        "specialization_name",
        "consultation_fee",
        "phone_no",
        "experience_years",
        zero("appointments").alias("total_appointments_today"),
        zero("consultations").alias("consultations_today"),
        zero("visits").alias("patient_visits_today"),
        money(exact * at_least_one("visits")).alias("revenue_today"),
        money(exact).alias("revenue_today_exact"),
    )


def daily_doctors_summary(t: Tables, date: Moment, detail: DataFrame | None = None) -> DataFrame:
    detail = daily_doctors(t, date) if detail is None else detail
    return detail.agg(
        _rows().alias("total_doctors"),
        _total("total_appointments_today").alias("total_appointments"),
        _total_money("revenue_today").alias("total_revenue"),
    ).withColumn("date", as_day(date))


def patients_range(t: Tables, start_date: Moment, end_date: Moment) -> DataFrame:
    """Patients who registered, had an appointment or were admitted in the range."""
    return patient_activity(t, start_date, end_date, BY_SECOND).select(
        "patient_id",
        "patient_login_id",
        spaced_name().alias("patient_name"),
        *_PATIENT,
        F.col("created_at").alias("registration_date"),
        F.col("appointments").alias("total_appointments"),
        F.col("consultations").alias("total_consultations"),
        F.col("admissions").alias("total_admissions"),
        F.col("discharges").alias("total_discharges"),
        "first_appointment_date",
        "last_appointment_date",
        F.col("spent").alias("total_spent"),
        F.col("spent_exact").alias("total_spent_exact"),
    )


def _period(start_date: Moment, end_date: Moment) -> Column:
    first, last = to_datetime(start_date).date(), to_datetime(end_date).date()
    return F.lit(f"{first} to {last}")


def patients_range_summary(
    t: Tables, start_date: Moment, end_date: Moment, detail: DataFrame | None = None
) -> DataFrame:
    """Totals of the range. New registrations end at midnight at the start of the last day."""
    registered = F.col("registration_date").between(as_moment(start_date), as_moment(end_date))
    detail = patients_range(t, start_date, end_date) if detail is None else detail
    return detail.agg(
        _rows().alias("total_patients"),
        F.count_if(registered).alias("new_registrations"),
        _total("total_appointments").alias("total_appointments"),
        _total("total_admissions").alias("total_admissions"),
        _total_money("total_spent").alias("total_revenue"),
    ).withColumn("period", _period(start_date, end_date))


def doctors_range(t: Tables, start_date: Moment, end_date: Moment) -> DataFrame:
    """All doctors with their activity, revenue and completion rate in the range."""
    counts = doctor_activity(t, start_date, end_date, BY_SECOND)
    exact = F.col("consultation_fee") * zero("completed")
    return counts.select(
        "doctor_id",
        "doctor_login_id",
        spaced_name().alias("doctor_name"),
        "specialization_name",
        "consultation_fee",
        "experience_years",
        "registration_number",
        zero("appointments").alias("total_appointments"),
        zero("completed").alias("completed_appointments"),
        zero("scheduled").alias("scheduled_appointments"),
        zero("cancelled").alias("cancelled_appointments"),
        zero("consultations").alias("total_consultations"),
        zero("visits").alias("patient_visits"),
        zero("admissions").alias("admissions_recommended"),
        money(exact * at_least_one("visits") * at_least_one("admissions")).alias("total_revenue"),
        money(exact).alias("total_revenue_exact"),
        rate(zero("completed").cast("double") / at_least_one("appointments") * F.lit(100.0)).alias("completion_rate"),
    )


def busiest_doctors(t: Tables, start_date: Moment, end_date: Moment, limit: int | None = 10) -> DataFrame:
    """The doctors with the most appointments in the range, the longest serving first among equals."""
    rows = doctors_range(t, start_date, end_date).select(
        "doctor_id", "doctor_name", "experience_years", "total_appointments", "total_revenue"
    )
    return top(rows, [F.desc("total_appointments"), F.desc_nulls_last("experience_years"), F.asc("doctor_id")], limit)


def doctors_range_summary(
    t: Tables, start_date: Moment, end_date: Moment, detail: DataFrame | None = None
) -> DataFrame:
    detail = doctors_range(t, start_date, end_date) if detail is None else detail
    return detail.agg(
        _rows().alias("total_doctors"),
        _total("total_appointments").alias("total_appointments"),
        _total_money("total_revenue").alias("total_revenue"),
        F.coalesce(mean("completion_rate"), F.lit(0.0)).alias("average_completion_rate"),
    ).withColumn("period", _period(start_date, end_date))


def _four_counts(t: Tables, first: Moment, last: Moment) -> DataFrame:
    """New patients, appointments, consultations and admissions in one row.

    Every table is filtered and tagged, and one aggregate counts the tags, so the
    tables are scanned side by side and only partial counts are shuffled.
    """
    booked, seen, stays = (t.of_months(n, first, last) for n in ("appointments", "consultations", "admissions"))
    parts = {
        "new_patients": t.patients.filter(between_days("created_at", first, last)),
        "appointments": booked.filter(F.col("appointment_date").between(as_day(first), as_day(last))),
        "consultations": seen.filter(between_days("consultation_date", first, last)),
        "admissions": stays.filter(between_days("admission_date", first, last)),
    }
    tagged = [df.select(F.lit(name).alias("kind")) for name, df in parts.items()]
    return reduce(DataFrame.unionAll, tagged).agg(
        *[F.count_if(F.col("kind") == name).alias(name) for name in parts]
    )


def daily_summary(t: Tables, date: Moment) -> DataFrame:
    return _four_counts(t, date, date).select(as_day(date).alias("date"), "*")


def range_summary(t: Tables, as_of: Moment, start_date: Moment | None = None, end_date: Moment | None = None) -> DataFrame:
    """Counts of a date range; by default the last 30 days up to today."""
    first = start_date or (to_datetime(as_of) - dt.timedelta(days=V.RANGE_SUMMARY_DAYS))
    last = end_date or as_of
    return _four_counts(t, first, last).select(as_day(first).alias("start_date"), as_day(last).alias("end_date"), "*")


def today_appointments(t: Tables, as_of: Moment) -> DataFrame:
    """Appointments of the day in any status."""
    rows = t.of_months("appointments", as_of, as_of).filter(F.col("appointment_date") == as_day(as_of))
    return (
        rows.join(patient_names(t, "patient_login_id"), "patient_id")
        .join(doctor_names(t, title=V.DOCTOR_TITLE), "doctor_id")
        .join(t.appointment_statuses, "status_id")
        .select("appointment_id", "patient_login_id", "patient_name", "doctor_name", "status_name")
    )
