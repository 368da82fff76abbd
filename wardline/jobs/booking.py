"""Booking appointment slots and moving appointments on."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_day, as_moment, falsy, full_name, weekday
from wardline.functions.time import Moment
from wardline.jobs.result import JobResult, Keep, update
from wardline.operators.matching import match_first_come
from wardline.operators.people import doctor_profiles, slot_times
from wardline.operators.requests import AT, ID, as_table, first_reason, turn, with_known, with_new_key
from wardline.operators.spread import spread_join
from wardline.plans.scheduling import booking_window
from wardline.session import stage
from wardline.sources.tables import Tables

_FIELDS = ("patient_id", "doctor_id", "appointment_date", "slot_id")


def _slot_facts(t: Tables, open_rows: DataFrame, days: Sequence[dt.date]) -> DataFrame:
    """Per (doctor_id, appointment_date, slot_id) of the booking window: ``scheduled``, ``slot_held``."""
    # A weekday comes up at most twice in the window, so this is about one row per schedule row.
    calendar = F.explode(F.array(*(F.struct(as_day(d).alias("appointment_date")) for d in days)))
    weekly = (
        t.doctor_schedules.filter("is_active")
        .select("doctor_id", F.col("day_of_week").cast("int").alias("day_of_week"), "slot_id", calendar.alias("day"))
        .select("doctor_id", "day_of_week", "slot_id", "day.appointment_date")
        .filter(weekday("appointment_date") == F.col("day_of_week"))
        .join(t.time_slots.select("slot_id"), "slot_id", "left_semi")
    )
    keys = ("doctor_id", "appointment_date", "slot_id")
    both = weekly.select(*keys, F.lit(True).alias("scheduled"), F.lit(False).alias("slot_held")).unionByName(
        open_rows.filter("slot_id is not null").select(*keys, F.lit(False).alias("scheduled"), F.lit(True).alias("slot_held"))
    )
    return both.groupBy(*keys).agg(F.bool_or("scheduled").alias("scheduled"), F.bool_or("slot_held").alias("slot_held"))


def book_slots(t: Tables, requests: DataFrame, as_of: Moment, keep: Keep = stage) -> JobResult:
    """Book requested slots in batch order.

    A request needs a date within the next seven days, a known patient and doctor,
    no other open appointment of the patient with that doctor on that day, an active
    slot of the doctor's weekday schedule, and a slot nobody else holds. Every row
    is checked. The decisions hold ``reason`` or, if accepted, ``appointment_id`` and
    ``status_id``. The checks and the rounds of the matching are written by ``keep``.
    """
    first, last = booking_window(as_of)
    day = F.col("appointment_date")
    open_rows = t.of_months("appointments", first, last).filter(
        day.between(as_day(first), as_day(last)) & (F.col("status_id") != V.CANCELLED)
    ).select("patient_id", "doctor_id", "appointment_date", "slot_id")
    days = [first + dt.timedelta(days=n) for n in range((last - first).days + 1)]
    by_slot, by_patient = ["doctor_id", "appointment_date", "slot_id"], ["doctor_id", "appointment_date", "patient_id"]
    held_pairs = open_rows.groupBy(*by_patient).agg(F.lit(True).alias("pair_held"))

    checked = requests.select(ID, AT, *_FIELDS)
    checked = with_known(checked, t.doctors, "doctor_id", "doctor_known")
    checked = with_known(checked, t.patients, "patient_id", "patient_known")
    checked = spread_join(checked, _slot_facts(t, open_rows, days), by_slot, "left", ID)
    checked = spread_join(checked, held_pairs, by_patient, "left", ID)
    incomplete = falsy("patient_id") | falsy("doctor_id") | day.isNull() | falsy("slot_id")
    scheduled, slot_held, pair_held = (F.coalesce(c, F.lit(False)) for c in ("scheduled", "slot_held", "pair_held"))
    before = (
        (incomplete, V.BOOK_REQUIRED),
        (day < as_day(first), V.SLOT_PAST),
        (day > as_day(last), V.SLOT_TOO_FAR),
        (F.col("patient_known").isNull(), V.BOOK_NO_PATIENT),
        (F.col("doctor_known").isNull(), V.BOOK_NO_DOCTOR),
    )
    own = first_reason(*before, (pair_held, V.BOOK_DUPLICATE), (~scheduled, V.BOOK_NOT_SCHEDULED), (slot_held, V.BOOK_TAKEN))
    checked = keep(checked.withColumn("own_reason", own))

    matched = match_first_come(checked.filter("own_reason is null"), keep=keep)
    slots = matched.select(*by_slot, F.col("turn").alias("slot_turn"))
    people = matched.select(*by_patient, F.col("turn").alias("patient_turn"))

    def earlier(taken: str) -> Column:
        """An earlier request of the batch holds the same patient or slot on that day."""
        return F.coalesce(F.col(taken) < turn(), F.lit(False))

    # What was accepted earlier in the batch counts like a stored appointment.
    reason = first_reason(
        *before,
        (pair_held | earlier("patient_turn"), V.BOOK_DUPLICATE),
        (~scheduled, V.BOOK_NOT_SCHEDULED),
        (slot_held | earlier("slot_turn"), V.BOOK_TAKEN),
    )
    decided = checked.join(slots, by_slot, "left").join(people, by_patient, "left").withColumn("reason", reason)
    decisions = with_new_key(decided.select(ID, AT, *_FIELDS, "reason"), requests, t, "appointments")
    booked = F.col("reason").isNull()
    decisions = decisions.withColumns(
        {
            "appointment_id": F.when(booked, F.col("appointment_id")),
            "status_id": F.when(booked, F.lit(V.SCHEDULED)),
        }
    )
    rows = decisions.filter(booked).withColumn("created_at", as_moment(as_of))
    return JobResult(decisions, {"appointments": as_table(rows, "appointments")})


def booking_confirmations(t: Tables, appointments: DataFrame) -> DataFrame:
    """New appointments with the names and times a confirmation shows."""
    people = t.patients.select(
        "patient_id", full_name().alias("patient_name"), F.col("phone_no").alias("patient_phone")
    )
    return (
        appointments.join(people, "patient_id")
        .join(doctor_profiles(t, "consultation_fee"), "doctor_id")
        .join(slot_times(t).drop("slot_number"), "slot_id")
        .join(t.appointment_statuses, "status_id")
        .select(
            "appointment_id", "patient_id", "patient_name", "patient_phone", "doctor_id", "doctor_name",
            "specialization_name", "appointment_date", "slot_id", "start_time", "end_time", "status_name",
            "consultation_fee", "created_at",
        )
    )


def advance_status(t: Tables, requests: DataFrame | None = None) -> JobResult:
    """Mark appointments that have a consultation as completed.

    Others keep their status; a missing status becomes Scheduled. ``requests``
    (``appointment_id``) narrows the job to some appointments.
    """
    done = t.consultations.select("appointment_id", F.lit(True).alias("consultation_exists"))
    rows = t.appointments.select("appointment_id", "status_id")
    if requests is None:
        asked = rows.withColumn("found", F.lit(True))
    else:
        asked = (
            requests.select("appointment_id")
            .distinct()
            .join(rows.withColumn("found", F.lit(True)), "appointment_id", "left")
        )
    names = t.appointment_statuses.select(F.col("status_id").alias("new_status"), "status_name")
    completed = F.coalesce("consultation_exists", F.lit(False))
    decisions = (
        asked.join(done, "appointment_id", "left")
        .select(
            "appointment_id",
            completed.alias("consultation_exists"),
            F.col("status_id").alias("previous_status"),
            F.when(completed, F.lit(V.COMPLETED)).otherwise(F.coalesce("status_id", F.lit(V.SCHEDULED))).alias("new_status"),
            F.when(F.col("found").isNull(), F.lit(V.NOT_FOUND)).alias("reason"),
        )
        .join(names, "new_status", "left")
        .withColumn("status_name", F.coalesce("status_name", F.lit(V.NO_NAME)))
    )
    moved = decisions.filter("reason is null and not (previous_status <=> new_status)").select(
        "appointment_id", "new_status"
    )
    changed = update(t, "appointments", moved, {"status_id": F.col("new.new_status")})
    return JobResult(decisions, updated={"appointments": changed})
