"""Weekly schedules and slot availability."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_day, weekday
from wardline.functions.time import Moment, to_datetime
from wardline.operators.people import doctor_names, doctor_profiles, slot_times
from wardline.operators.spread import spread_join
from wardline.sources.tables import Tables


def schedules(t: Tables, doctor_id: int | None = None, day_of_week: int | None = None) -> DataFrame:
    rows = t.doctor_schedules
    if doctor_id is not None:
        rows = rows.filter(F.col("doctor_id") == doctor_id)
    if day_of_week is not None:
        rows = rows.filter(F.col("day_of_week") == day_of_week)
    return (
        rows.join(slot_times(t), "slot_id")
        .join(doctor_names(t, "doctor_login_id", "room_no"), "doctor_id")
        .select(
            *t.doctor_schedules.columns, "slot_number", "start_time", "end_time",
            "doctor_name", "doctor_login_id", "room_no",
        )
    )


def booking_window(as_of: Moment) -> tuple[dt.date, dt.date]:
    """First and last bookable day; both count, so the window has eight days."""
    first = to_datetime(as_of).date()
    return first, first + dt.timedelta(days=V.BOOKING_HORIZON_DAYS)


def taken_slots(t: Tables, first: dt.date, last: dt.date) -> DataFrame:
    """Distinct (doctor, date, slot) of appointments that are not cancelled."""
    open_rows = t.of_months("appointments", first, last).filter(
        F.col("appointment_date").between(as_day(first), as_day(last))
        & (F.col("status_id") != V.CANCELLED)
        & F.col("slot_id").isNotNull()
    )
    return open_rows.select("doctor_id", "appointment_date", "slot_id").distinct()


def _active_slots(t: Tables, doctor_id: int | None) -> DataFrame:
    rows = t.doctor_schedules.filter("is_active")
    if doctor_id is not None:
        rows = rows.filter(F.col("doctor_id") == doctor_id)
    return rows.select("schedule_id", "doctor_id", "slot_id", "day_of_week").join(
        slot_times(t).drop("slot_number"), "slot_id"
    )


def _status(taken: Column) -> Column:
    return F.when(taken, F.lit(V.SLOT_BOOKED)).otherwise(F.lit(V.SLOT_AVAILABLE))


def available_schedule(t: Tables, date: Moment, as_of: Moment, doctor_id: int | None = None) -> DataFrame:
    """Active slots of one day with their availability (1/0)."""
    day = to_datetime(date).date()
    first, last = booking_window(as_of)
    if day < first:
        raise ValueError(V.SLOT_PAST)
    if day > last:
        raise ValueError(V.SLOT_TOO_FAR)
    sunday_based = day.isoweekday() % 7
    slots = _active_slots(t, doctor_id).filter(F.col("day_of_week") == sunday_based)
    taken = taken_slots(t, day, day).select("doctor_id", "slot_id", F.lit(True).alias("taken"))
    return slots.join(taken, ["doctor_id", "slot_id"], "left").select(
        "schedule_id",
        "doctor_id",
        "slot_id",
        "day_of_week",
        "start_time",
        "end_time",
        F.when(F.col("taken"), F.lit(0)).otherwise(F.lit(1)).alias("is_available"),
        _status(F.col("taken")).alias("slot_status"),
    )


def available_schedule_summary(t: Tables, date: Moment, as_of: Moment, doctor_id: int | None = None) -> DataFrame:
    """Doctors with the number of free and of all slots on that day."""
    counts = (
        available_schedule(t, date, as_of, doctor_id)
        .groupBy("doctor_id")
        .agg(F.sum("is_available").alias("available_count"), F.count(F.lit(1)).alias("total_slots"))
    )
    doctors = doctor_profiles(t, "consultation_fee")
    if doctor_id is not None:
        doctors = doctors.filter(F.col("doctor_id") == doctor_id)
    return doctors.join(counts, "doctor_id", "left").select(
        "doctor_id",
        "doctor_name",
        "specialization_name",
        "consultation_fee",
        as_day(date).alias("date"),
        F.coalesce("available_count", F.lit(0)).alias("available_count"),
        F.coalesce("total_slots", F.lit(0)).alias("total_slots"),
    )


def weekly_availability(t: Tables, as_of: Moment, doctor_id: int | None = None) -> DataFrame:
    """Every active slot of the next seven days with its availability.

    Seven consecutive days hold each weekday once, so the date of a weekly slot
    follows from its weekday and no calendar has to be joined.
    """
    first = to_datetime(as_of).date()
    last = first + dt.timedelta(days=V.CALENDAR_DAYS - 1)
    offset = F.pmod(F.col("day_of_week").cast("int") - F.lit(first.isoweekday() % 7), F.lit(7))
    dated = _active_slots(t, doctor_id).withColumn("appointment_date", F.date_add(as_day(first), offset))
    taken = taken_slots(t, first, last).withColumn("taken", F.lit(True))
    return dated.join(taken, ["doctor_id", "appointment_date", "slot_id"], "left").select(
        "schedule_id",
        "doctor_id",
        "slot_id",
        "day_of_week",
        F.col("appointment_date").alias("date"),
        F.date_format("appointment_date", "EEEE").alias("day_name"),
        "start_time",
        "end_time",
        F.col("taken").isNull().alias("is_available"),
        _status(F.col("taken")).alias("slot_status"),
    )


def weekly_availability_days(t: Tables, as_of: Moment, doctor_id: int | None = None) -> DataFrame:
    """Days with slots per doctor: names and counts. Days without slots are absent."""
    return (
        weekly_availability(t, as_of, doctor_id)
        .groupBy("doctor_id", "date", "day_of_week", "day_name")
        .agg(F.count_if("is_available").alias("available_slots"), F.count(F.lit(1)).alias("total_slots"))
        .join(doctor_profiles(t, "consultation_fee"), "doctor_id")
        .select(
            "doctor_id", "doctor_name", "specialization_name", "consultation_fee", "date", "day_of_week",
            "day_name", "available_slots", "total_slots",
        )
    )


def weekly_availability_nested(t: Tables, as_of: Moment, doctor_id: int | None = None) -> DataFrame:
    """The days with their slots as a list, by start time.

    A list holds one doctor's slots of one weekday, which the unique key (doctor,
    day, slot) bounds by the number of time slots.
    """
    slot = F.struct("start_time", "end_time", "slot_id", "schedule_id", "is_available", "slot_status")
    return (
        weekly_availability(t, as_of, doctor_id)
        .groupBy("doctor_id", "date", "day_of_week", "day_name")
        .agg(
            F.sort_array(F.collect_list(slot)).alias("slots"),
            F.count_if("is_available").alias("available_slots"),
            F.count(F.lit(1)).alias("total_slots"),
        )
    )


def slot_check(t: Tables, requests: DataFrame, as_of: Moment) -> DataFrame:
    """Whether each requested (doctor, slot, date) can be booked, and why not."""
    first, last = booking_window(as_of)
    asked = requests.select("request_id", "doctor_id", "slot_id", "appointment_date").withColumn(
        "day_of_week", weekday("appointment_date")
    )
    weekly = (
        t.doctor_schedules.select("doctor_id", "slot_id", "day_of_week", "is_active")
        .join(slot_times(t).drop("slot_number"), "slot_id")
    )
    taken = taken_slots(t, first, last).withColumn("taken", F.lit(True))
    found = asked.join(weekly, ["doctor_id", "slot_id", "day_of_week"], "left")
    found = spread_join(found, taken, ["doctor_id", "appointment_date", "slot_id"], "left", "request_id")
    day = F.col("appointment_date")
    in_window = day.between(as_day(first), as_day(last))
    reason = (
        F.when(day < as_day(first), V.SLOT_PAST)
        .when(day > as_day(last), V.SLOT_TOO_FAR)
        .when(F.col("is_active").isNull(), V.SLOT_NOT_SCHEDULED)
        .when(~F.col("is_active"), V.SLOT_INACTIVE)
        .when(F.col("taken"), V.SLOT_TAKEN)
        .otherwise(F.lit(V.SLOT_AVAILABLE))
    )
    return found.withColumn("reason", reason).select(
        "request_id",
        "doctor_id",
        "slot_id",
        "appointment_date",
        (F.col("reason") == V.SLOT_AVAILABLE).alias("is_available"),
        "reason",
        F.when(in_window, F.col("start_time")).alias("start_time"),
        F.when(in_window, F.col("end_time")).alias("end_time"),
    )
