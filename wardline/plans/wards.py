"""Rooms, beds and admissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, contains_text, days_between, same_text, spaced_name
from wardline.functions.time import Moment
from wardline.operators.children import with_children
from wardline.operators.people import (
    bed_numbers,
    doctor_names,
    patient_names,
    receptionist_names,
    room_details,
    specialization_names,
)
from wardline.operators.spread import spread_join
from wardline.sources.tables import Tables

ADMIT = "Admit"
PENDING = "Pending"


def active(t: Tables) -> DataFrame:
    return t.admissions.filter("is_active")


def department(type_name: str = "type_name") -> Column:
    """Department from the ward code inside the type name; the first match wins."""
    arms = [(contains_text(type_name, code), name) for code, name in V.WARD_DEPARTMENTS]
    first, *rest = arms
    chain = reduce(lambda c, arm: c.when(arm[0], arm[1]), rest, F.when(first[0], first[1]))
    return chain.otherwise(F.lit(V.OTHER_DEPARTMENT))


def ward_gender(type_name: str = "type_name") -> Column:
    """Gender from the suffix of the type name."""
    (male, first), (female, second) = V.WARD_GENDERS
    c = F.col(type_name)
    return (
        F.when(c.ilike(f"%{male}"), first).when(c.ilike(f"%{female}"), second).otherwise(F.lit(V.OTHER_WARD_GENDER))
    )


def room_types(t: Tables) -> DataFrame:
    return t.room_types.withColumn("gender_category", ward_gender())


def room_charges(t: Tables) -> DataFrame:
    return t.room_types.select("room_type_id", F.col("per_day_charges").alias("daily_charge"))


def _typed_rooms(t: Tables, *type_columns: str) -> DataFrame:
    return t.rooms.join(t.room_types.select("room_type_id", *type_columns), "room_type_id")


def rooms_occupancy(t: Tables) -> DataFrame:
    """Rooms with all and occupied beds; a room without beds counts zero."""
    counts = t.beds.groupBy("room_id").agg(
        F.count("bed_id").alias("total_beds"), F.count_if("is_occupied").alias("occupied_beds")
    )
    return (
        _typed_rooms(t, "type_name", "description", "per_day_charges")
        .join(counts, "room_id", "left")
        .select(
            "room_id", "room_number", "room_type_id", "type_name", "description", "per_day_charges", "floor_number",
            "is_occupied", F.coalesce("total_beds", F.lit(0)).alias("total_beds"),
            F.coalesce("occupied_beds", F.lit(0)).alias("occupied_beds"),
        )
    )


def rooms_department(t: Tables) -> DataFrame:
    return _typed_rooms(t, "type_name", "description", "per_day_charges").select(
        "room_id", "room_number", "room_type_id", "type_name", "description", "per_day_charges", "floor_number",
        "is_occupied", department().alias("department_name"),
    )


def _available_columns(df: DataFrame, t: Tables, room_type_id: int | None) -> DataFrame:
    if room_type_id is not None:
        df = df.filter(F.col("room_type_id") == room_type_id)
    return df.select(*t.rooms.columns, "type_name", "per_day_charges")


def rooms_available_by_bed(t: Tables, room_type_id: int | None = None) -> DataFrame:
    """Rooms not marked occupied that have a free bed."""
    free = t.beds.filter("not is_occupied").select("room_id")
    rooms = _typed_rooms(t, "type_name", "per_day_charges").filter("not is_occupied")
    return _available_columns(rooms.join(free, "room_id", "left_semi"), t, room_type_id)


def rooms_available_by_admission(t: Tables, room_type_id: int | None = None) -> DataFrame:
    """Rooms no active admission was assigned to."""
    used = active(t).select(F.col("initial_room_id").alias("room_id")).distinct()
    rooms = _typed_rooms(t, "type_name", "per_day_charges")
    return _available_columns(rooms.join(used, "room_id", "left_anti"), t, room_type_id)


def _placed_beds(t: Tables) -> DataFrame:
    rooms = _typed_rooms(t, "type_name", "per_day_charges").select(
        "room_id", "room_number", "type_name", "per_day_charges", "floor_number"
    )
    return t.beds.join(rooms, "room_id")


_BED = (
    "bed_id", "bed_code", "room_id", "bed_number", "is_occupied", "room_number", "type_name", "per_day_charges",
    "floor_number",
)


def beds(t: Tables) -> DataFrame:
    """Beds with their room and occupant; several active admissions repeat a bed."""
    people = t.patients.select(
        "patient_id",
        F.col("first_name").alias("patient_first_name"),
        F.col("last_name").alias("patient_last_name"),
        F.col("gender").alias("patient_gender"),
    )
    occupants = active(t).select("bed_id", "patient_id").join(people, "patient_id", "left").drop("patient_id")
    return with_children(_placed_beds(t), occupants, "bed_id").select(
        *_BED, "patient_first_name", "patient_last_name", "patient_gender"
    )


def beds_available_filtered(
    t: Tables, patient_gender: str | None = None, specialization_name: str | None = None, match: str = "prefix"
) -> DataFrame:
    """Free beds that suit a gender and a specialization.

    ``match="prefix"`` looks for the first four letters of the specialization in
    the type name (so Pediatrics finds no ward whose code is PED, and private
    rooms match none); ``match="department"`` compares the department instead.
    """
    free = _placed_beds(t).filter("not is_occupied")
    kind = F.col("type_name")
    suffixes = {name.lower(): suffix for suffix, name in V.WARD_GENDERS}
    if patient_gender is not None and patient_gender.lower() in suffixes:
        own = suffixes[patient_gender.lower()]
        neutral = reduce(lambda a, b: a & b, [~kind.ilike(f"%{s}%") for s in suffixes.values()])
        free = free.filter(kind.ilike(f"%{own}%") | neutral)
    if specialization_name:
        if match == "department":
            free = free.filter(same_text(department(), specialization_name))
        else:
            prefix = specialization_name[:4].upper()
            free = free.filter(contains_text(kind, prefix) | contains_text(kind, "GENERAL"))
    return free.select(*_BED)


def _with_people(t: Tables, admissions: DataFrame, with_phone: bool = True) -> DataFrame:
    about = ["age", "gender", "blood_group"] + (["phone_no"] if with_phone else [])
    return (
        admissions.join(patient_names(t, *about), "patient_id")
        .join(room_details(t).drop("room_type_id"), "initial_room_id")
        .join(receptionist_names(t, "assigned_by_receptionist_id"), "assigned_by_receptionist_id")
    )


def _days_admitted(as_of: Moment) -> Column:
    return days_between("admission_date", as_moment(as_of)).alias("days_admitted")


def active_admissions(t: Tables, as_of: Moment) -> DataFrame:
    """Active admissions with patient, doctor, room, bed and receptionist."""
    return (
        _with_people(t, active(t))
        .join(doctor_names(t, "specialization_id"), "doctor_id")
        .join(bed_numbers(t), "bed_id")
        .select(
            *t.admissions.columns, "patient_name", "age", "gender", "blood_group", "phone_no", "doctor_name",
            "specialization_id", "room_number", "room_type", "per_day_charges", "bed_number", "bed_code",
            "receptionist_name", _days_admitted(as_of),
        )
    )


def active_admissions_any_bed(t: Tables, as_of: Moment) -> DataFrame:
    """The same without the bed join, so an admission whose bed is unknown stays."""
    return (
        _with_people(t, active(t), with_phone=False)
        .join(doctor_names(t), "doctor_id")
        .select(
            *t.admissions.columns, "patient_name", "age", "gender", "blood_group", "doctor_name", "room_number",
            "room_type", "receptionist_name", _days_admitted(as_of),
        )
    )


def active_admissions_detailed(t: Tables, as_of: Moment) -> DataFrame:
    """Active admissions with the doctor's specialization too."""
    return active_admissions(t, as_of).join(specialization_names(t), "specialization_id").select(
        *active_admissions(t, as_of).columns, "specialization_name"
    )


def active_admissions_report(t: Tables) -> DataFrame:
    people = patient_names(t, "patient_login_id")
    return (
        active(t)
        .join(people, "patient_id")
        .join(doctor_names(t, title=V.DOCTOR_TITLE), "doctor_id")
        .select(
            "admission_id",
            "patient_login_id",
            "patient_name",
            "doctor_name",
            F.date_format("admission_date", V.ISO_DAY).alias("admission_date"),
        )
    )


def admission_detail(t: Tables, as_of: Moment, admission_id: int | None = None) -> DataFrame:
    """Admissions with the days to discharge, or to now while it is open."""
    rows = t.admissions if admission_id is None else t.admissions.filter(F.col("admission_id") == admission_id)
    end = F.coalesce("discharge_date", as_moment(as_of))
    return (
        _with_people(t, rows)
        .join(doctor_names(t), "doctor_id")
        .select(
            *t.admissions.columns, "patient_name", "age", "gender", "blood_group", "phone_no", "doctor_name",
            "room_number", "room_type", "per_day_charges", "receptionist_name",
            days_between("admission_date", end).alias("total_days"),
        )
    )


def admission_recommended(t: Tables) -> DataFrame:
    """Pending admission actions whose consultation has no active admission."""
    admit = t.action_types.filter(same_text("action_name", ADMIT))
    pending = t.consultation_actions.filter(same_text("status", PENDING)).select(
        "action_id", "consultation_id", "action_type_id", "notes", "created_at", "status"
    )
    people = t.patients.select(
        "patient_id",
        F.col("first_name").alias("patient_first_name"),
        F.col("last_name").alias("patient_last_name"),
        "patient_login_id",
        F.col("gender").alias("patient_gender"),
        F.col("age").alias("patient_age"),
        "blood_group",
    )
    doctors = t.doctors.join(specialization_names(t), "specialization_id").select(
        "doctor_id",
        F.col("first_name").alias("doctor_first_name"),
        F.col("last_name").alias("doctor_last_name"),
        "doctor_login_id",
        F.col("specialization_id").alias("doctor_specialization_id"),
        F.col("specialization_name").alias("doctor_specialization_name"),
        "consultation_fee",
    )
    seen = t.consultations.select(
        "consultation_id", "patient_id", "doctor_id", "appointment_id", "diagnosis", "consultation_date"
    )
    admitted = active(t).select("consultation_id").distinct()
    return (
        spread_join(pending.join(admit, "action_type_id"), admitted, ["consultation_id"], "left_anti", "action_id")
        .join(seen, "consultation_id")
        .join(people, "patient_id")
        .join(doctors, "doctor_id")
        .select(
            "action_id", "consultation_id", "notes", "created_at", "status", "action_name", "patient_id",
            "patient_first_name", "patient_last_name", "patient_login_id", "patient_gender", "patient_age",
            "blood_group", "doctor_id", "doctor_first_name", "doctor_last_name", "doctor_login_id",
            "doctor_specialization_id", "doctor_specialization_name", "consultation_fee", "appointment_id",
            "diagnosis", F.date_format("consultation_date", V.ISO_SECOND).alias("consultation_date"),
        )
    )


def bed_availability(t: Tables) -> DataFrame:
    """Number of free beds."""
    return t.beds.agg(F.count_if(~F.col("is_occupied")).alias("available_beds"))


def action_admission_status(t: Tables, action_id: int | None = None) -> DataFrame:
    """Actions with names, and whether the consultation already has an active admission."""
    actions = t.consultation_actions.select("action_id", "status", "consultation_id")
    if action_id is not None:
        actions = actions.filter(F.col("action_id") == action_id)
    admitted = active(t).groupBy("consultation_id").agg(F.count(F.lit(1)).alias("existing_admission"))
    people = t.patients.select("patient_id", spaced_name().alias("patient_name"))
    doctors = t.doctors.select("doctor_id", "specialization_id", spaced_name().alias("doctor_name"))
    existing = F.coalesce("existing_admission", F.lit(0))
    return (
        spread_join(actions, admitted, ["consultation_id"], "left", "action_id")
        .join(t.consultations.select("consultation_id", "patient_id", "doctor_id"), "consultation_id")
        .join(people, "patient_id")
        .join(doctors.join(specialization_names(t), "specialization_id"), "doctor_id")
        .select(
            "action_id", "status", "consultation_id", "patient_id", "doctor_id", "patient_name", "doctor_name",
            "specialization_name", existing.alias("existing_admission"), (existing > 0).alias("is_admitted"),
        )
    )
