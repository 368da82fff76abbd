"""Discharges and their payments."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, contains_text, days_between, full_name, mean, money, months_before, same_text
from wardline.functions.time import Moment, to_datetime
from wardline.operators.people import doctor_names, doctor_profiles, patient_names, receptionist_names
from wardline.operators.ranking import referring, top, top_per
from wardline.operators.summary import summarise
from wardline.sources.tables import Tables


def _newest() -> list[Column]:
    return [F.desc("discharge_date"), F.desc("discharge_id")]


def _keep(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def discharge_list(
    t: Tables,
    patient_id: int | None = None,
    payment_status: str | None = None,
    admission_id: int | None = None,
) -> DataFrame:
    """Discharges with the names of patient, doctor and receptionist."""
    rows = _keep(_keep(t.discharges, "patient_id", patient_id), "admission_id", admission_id)
    if payment_status is not None:
        rows = rows.filter(same_text("payment_status", payment_status))
    return (
        rows.join(patient_names(t), "patient_id")
        .join(doctor_names(t), "doctor_id")
        .join(receptionist_names(t, "processed_by_receptionist_id"), "processed_by_receptionist_id")
        .select(*t.discharges.columns, "patient_name", "doctor_name", "receptionist_name")
    )


def doctor_discharged_patients(
    t: Tables,
    doctor_id: int | None = None,
    start_date: Moment | None = None,
    end_date: Moment | None = None,
    limit: int | None = V.DISCHARGED_PATIENTS,
) -> DataFrame:
    """The newest discharges of one doctor, or of every doctor; all for a limit of None.

    ``end_date`` is a moment: a plain date stops at its first instant. Discharges with
    a broken reference are left out before the limit.
    """
    rows = t.of_months("discharges", start_date, end_date).select(
        "discharge_id", "admission_id", "patient_id", "doctor_id", "discharge_date", "total_days", "total_amount",
        "payment_status", "amount_paid", "final_diagnosis", "discharge_summary", "follow_up_required",
        "follow_up_date",
    )
    if start_date is not None:
        rows = rows.filter(F.col("discharge_date") >= as_moment(start_date))
    if end_date is not None:
        rows = rows.filter(F.col("discharge_date") <= as_moment(end_date))
    parents = (t.patients.select("patient_id"), doctor_profiles(t).select("doctor_id"), t.admissions.select("admission_id"))
    rows = referring(rows, *parents)
    if doctor_id is None:
        newest = top_per(rows, ["doctor_id"], _newest(), limit)
    else:
        newest = top(rows.filter(F.col("doctor_id") == doctor_id), _newest(), limit)
    stays = t.admissions.select("admission_id", "admission_date", "initial_room_id")
    rooms = t.rooms.select(F.col("room_id").alias("initial_room_id"), "room_number")
    return (
        newest.join(patient_names(t, "age", "gender", "blood_group", "phone_no"), "patient_id")
        .join(doctor_profiles(t), "doctor_id")
        .join(stays, "admission_id")
        .join(rooms, "initial_room_id", "left")
        .select(
            *rows.columns, "patient_name", "age", "gender", "blood_group", "phone_no", "room_number", "doctor_name",
            "specialization_id", "specialization_name",
            days_between("admission_date", "discharge_date").alias("hospital_days"),
            F.date_format("discharge_date", V.ISO_DAY).alias("formatted_discharge_date"),
            F.date_format("admission_date", V.ISO_DAY).alias("formatted_admission_date"),
        )
    )


def discharge_bundle(t: Tables, discharge_id: int | None = None) -> DataFrame:
    """Discharge and admission of a stay, one row per discharge.

    The visits of the stay are the rows of ``discharge_bundle_visits`` with the
    same ``discharge_id``.
    """
    kinds = t.room_types.select("room_type_id", F.col("type_name").alias("room_type"), "per_day_charges")
    rooms = (
        t.rooms.select(F.col("room_id").alias("initial_room_id"), "room_number", "room_type_id")
        .join(kinds, "room_type_id", "left")
        .drop("room_type_id")
    )
    stays = (
        t.admissions.select(
            "admission_id", "admission_date", "admission_notes", "initial_room_id", "bed_id", "consultation_id",
            "action_id", "is_active", "assigned_by_receptionist_id",
            F.col("discharge_date").alias("admission_discharge_date"),
        )
        .join(rooms, "initial_room_id", "left")
        .join(t.beds.select("bed_id", "bed_number", "bed_code"), "bed_id", "left")
    )
    people = patient_names(t, "age", "gender", "blood_group", "phone_no")
    return (
        _keep(t.discharges, "discharge_id", discharge_id)
        .join(people, "patient_id")
        .join(doctor_profiles(t).drop("specialization_id"), "doctor_id")
        .join(receptionist_names(t, "processed_by_receptionist_id"), "processed_by_receptionist_id")
        .join(stays, "admission_id", "left")
        .select(
            *t.discharges.columns, "patient_name", "age", "gender", "blood_group", "phone_no", "doctor_name",
            "specialization_name", "receptionist_name",
            F.date_format("discharge_date", V.LONG_MINUTE).alias("formatted_discharge_date"),
            "admission_date", "admission_discharge_date", "admission_notes", "initial_room_id", "bed_id", "consultation_id", "action_id",
            "is_active", "assigned_by_receptionist_id", "room_number", "bed_number", "bed_code", "room_type",
            "per_day_charges", F.date_format("admission_date", V.LONG_MINUTE).alias("formatted_admission_date"),
        )
    )


def discharge_bundle_visits(t: Tables, discharge_id: int | None = None) -> DataFrame:
    """The visit history behind each discharge."""
    stays = _keep(t.discharges, "discharge_id", discharge_id).select("discharge_id", "admission_id")
    return t.admitted_patient_visits.join(stays, "admission_id").select(
        "discharge_id",
        *t.admitted_patient_visits.columns,
        F.date_format("visit_datetime", V.LONG_MINUTE).alias("formatted_visit_date"),
        F.date_format("discharge_recommended_date", V.LONG_DAY).alias("formatted_recommended_discharge_date"),
    )


def period_start(as_of: Moment, period: str) -> Column:
    """Start of the statistics period; an unknown period is a month."""
    now = to_datetime(as_of)
    if period == "day":
        return as_moment(now - dt.timedelta(days=1))
    if period == "week":
        return as_moment(now - dt.timedelta(weeks=1))
    return months_before(now, 12 if period == "year" else 1)


def doctor_discharge_stats(
    t: Tables, as_of: Moment, period: str = "month", doctor_id: int | None = None
) -> DataFrame:
    """Discharge counts, revenue, stay and payments per doctor over a period."""
    # A month that is not later than the start of the period.
    months = 12 if period == "year" else 1
    earliest = (to_datetime(as_of).replace(day=1) - dt.timedelta(days=31 * months)).replace(day=1)
    recent = _keep(t.of_months("discharges", earliest), "doctor_id", doctor_id).filter(
        F.col("discharge_date") >= period_start(as_of, period)
    )
    return summarise(
        recent,
        "doctor_id",
        doctor_id,
        F.count(F.lit(1)).alias("total_discharges"),
        F.count_if("follow_up_required").alias("follow_up_required"),
        money(F.sum("total_amount")).alias("total_revenue"),
        mean("total_amount").alias("average_bill"),
        mean("total_days").alias("avg_hospital_stay"),
        *[
            F.count_if(same_text("payment_status", state)).alias(f"{state.lower()}_count")
            for state in ("Paid", "Unpaid", "Partial")
        ],
        money(F.sum("amount_paid")).alias("total_paid"),
        money(F.sum(F.col("total_amount") - F.col("amount_paid"))).alias("total_pending"),
    )


def discharge_search(t: Tables, query: str, doctor_id: int | None = None) -> DataFrame:
    """Discharges whose patient, doctor or specialization contains the text."""
    text = (query or "").strip()
    if len(text) < V.SEARCH_MIN_CHARS:
        raise ValueError(f"Search query must be at least {V.SEARCH_MIN_CHARS} characters")

    def hit(*columns: str) -> Column:
        return F.coalesce(reduce(or_, [F.coalesce(contains_text(c, text), F.lit(False)) for c in columns]), F.lit(False))

    people = t.patients.select(
        "patient_id",
        full_name().alias("patient_name"),
        "phone_no",
        hit("first_name", "last_name", "phone_no", "patient_login_id").alias("patient_hit"),
    )
    doctors = (
        t.doctors.join(t.specializations.select("specialization_id", "specialization_name"), "specialization_id")
        .select(
            "doctor_id",
            full_name().alias("doctor_name"),
            "specialization_name",
            hit("first_name", "last_name", "specialization_name").alias("doctor_hit"),
        )
    )
    # The text is matched once per person, not once per discharge.
    return (
        _keep(t.discharges, "doctor_id", doctor_id)
        .join(people, "patient_id")
        .join(doctors, "doctor_id")
        .filter("patient_hit or doctor_hit")
        .select(
            "discharge_id", "admission_id", "patient_id", "doctor_id", "discharge_date", "total_amount",
            "payment_status", "patient_name", "phone_no", "doctor_name", "specialization_name",
        )
    )


def recent_discharges(t: Tables, limit: int | None = V.RECENT_DISCHARGES) -> DataFrame:
    """The newest discharges with their charges and the balance due; all for a limit of None.

    Discharges with a broken reference are left out before the limit.
    """
    parents = (
        t.patients.select("patient_id"),
        doctor_profiles(t).select("doctor_id"),
        t.admissions.select("admission_id"),
        t.receptionists.select(F.col("receptionist_id").alias("processed_by_receptionist_id")),
    )
    rows = top(referring(t.discharges, *parents), _newest(), limit)
    stays = t.admissions.select("admission_id", "admission_date")
    desk = t.receptionists.select(
        F.col("receptionist_id").alias("processed_by_receptionist_id"),
        F.col("receptionist_login_id").alias("processed_by"),
    )
    return (
        rows.join(patient_names(t, "patient_login_id"), "patient_id")
        .join(stays, "admission_id")
        .join(doctor_profiles(t, title=V.DOCTOR_TITLE), "doctor_id")
        .join(desk, "processed_by_receptionist_id")
        .select(
            "discharge_id", "patient_login_id", "patient_name",
            F.date_format("discharge_date", V.ISO_DAY).alias("discharge_date"),
            "total_days", "total_amount", "payment_status", "amount_paid", "room_charges", "medical_charges",
            "doctor_visit_charges", "lab_charges", "other_charges", "doctor_name", "specialization_name",
            F.date_format("admission_date", V.ISO_DAY).alias("admission_date"), "processed_by", "final_diagnosis",
            "follow_up_required", F.date_format("follow_up_date", V.ISO_DAY).alias("follow_up_date"),
            money(F.col("total_amount") - F.col("amount_paid")).alias("balance_due"),
        )
    )
