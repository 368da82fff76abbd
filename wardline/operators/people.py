"""Name columns of patients, doctors and receptionists for joining to facts.

No join here is forced to broadcast: doctors and patients grow with the data,
so Spark decides from the measured size, and splits hot keys where it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import clock, full_name
from wardline.sources.tables import Tables

Extra = str | Column


def patient_names(t: Tables, *extra: Extra) -> DataFrame:
    return t.patients.select("patient_id", full_name().alias("patient_name"), *extra)


def doctor_names(t: Tables, *extra: Extra, title: str = "") -> DataFrame:
    return t.doctors.select("doctor_id", full_name(title=title).alias("doctor_name"), *extra)


def doctor_profiles(t: Tables, *extra: Extra, title: str = "") -> DataFrame:
    """Doctor names with the specialization (an inner join, as everywhere)."""
    return doctor_names(t, "specialization_id", *extra, title=title).join(specialization_names(t), "specialization_id")


def specialization_names(t: Tables) -> DataFrame:
    return t.specializations.select("specialization_id", "specialization_name")


def receptionist_names(t: Tables, key: str) -> DataFrame:
    return t.receptionists.select(
        F.col("receptionist_id").alias(key), full_name().alias("receptionist_name")
    )


def slot_times(t: Tables) -> DataFrame:
    """Slots with start and end as clock text."""
    return t.time_slots.select(
        "slot_id", "slot_number", clock("start_min").alias("start_time"), clock("end_min").alias("end_time")
    )


def room_details(t: Tables) -> DataFrame:
    """Rooms with their type, under the names the admission datasets use."""
    kinds = t.room_types.select("room_type_id", F.col("type_name").alias("room_type"), "per_day_charges")
    return t.rooms.select(F.col("room_id").alias("initial_room_id"), "room_number", "room_type_id").join(
        kinds, "room_type_id"
    )


def bed_numbers(t: Tables) -> DataFrame:
    return t.beds.select("bed_id", "bed_number", "bed_code")
