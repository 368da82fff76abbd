"""Directories, reference lists and "most recent" lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import full_name
from wardline.operators.people import doctor_profiles, slot_times, specialization_names
from wardline.operators.ranking import top
from wardline.sources.tables import Tables


def specializations(t: Tables, specialization_id: int | None = None) -> DataFrame:
    df = t.specializations
    return df if specialization_id is None else df.filter(F.col("specialization_id") == specialization_id)


def doctor_directory(t: Tables, doctor_id: int | None = None) -> DataFrame:
    """Doctors with their specialization."""
    doctors = t.doctors if doctor_id is None else t.doctors.filter(F.col("doctor_id") == doctor_id)
    return doctors.join(specialization_names(t), "specialization_id").select(
        *t.doctors.columns, "specialization_name"
    )


def doctors_list(t: Tables) -> DataFrame:
    return doctor_profiles(t, "doctor_login_id", "consultation_fee").select(
        "doctor_id", "doctor_login_id", "doctor_name", "specialization_name", "consultation_fee"
    )


def doctor_fees(t: Tables) -> DataFrame:
    return t.doctors.select("doctor_id", "consultation_fee")


def removed_doctors(t: Tables) -> DataFrame:
    """Archived removals with the admin and specialization, where known."""
    admins = t.admin.select(
        F.col("admin_id").alias("removed_by_admin_id"), F.col("username").alias("removed_by_admin")
    )
    return (
        t.removed_doctors.join(admins, "removed_by_admin_id", "left")
        .join(specialization_names(t), "specialization_id", "left")
        .select(*t.removed_doctors.columns, "removed_by_admin", "specialization_name")
    )


def time_slots(t: Tables) -> DataFrame:
    return slot_times(t)


def action_types(t: Tables) -> DataFrame:
    return t.action_types


def receptionists(t: Tables) -> DataFrame:
    return t.receptionists


def reference_dims(t: Tables) -> DataFrame:
    """Slots, action types and receptionists as one pick list: dimension, id, label."""

    def picks(dimension: str, rows: DataFrame, key: str, label: Column) -> DataFrame:
        return rows.select(
            F.lit(dimension).alias("dimension"), F.col(key).cast("bigint").alias("id"), label.alias("label")
        )

    parts = (
        picks("time_slots", slot_times(t), "slot_id", F.concat("start_time", F.lit("-"), "end_time")),
        picks("action_types", t.action_types, "action_type_id", F.col("action_name")),
        picks("receptionists", t.receptionists, "receptionist_id", full_name()),
    )
    return reduce(DataFrame.unionAll, parts)


def recent_signins(t: Tables, limit: int = V.RECENT_SIGNINS) -> DataFrame:
    rows = top(t.signin_logs, [F.desc("signin_datetime"), F.desc("log_id")], limit)
    return rows.select("user_id", "user_type", F.date_format("signin_datetime", V.ISO_MINUTE).alias("signin_time"))


def recent_patients(t: Tables, limit: int = V.RECENT_PATIENTS) -> DataFrame:
    rows = top(t.patients, [F.desc("created_at"), F.desc("patient_id")], limit)
    return rows.select(
        "patient_id",
        "patient_login_id",
        full_name().alias("patient_name"),
        "age",
        "gender",
        F.date_format("created_at", V.ISO_DAY).alias("registered_date"),
    )
