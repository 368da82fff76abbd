"""Ward visits of admitted patients."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, days_between, exact_sum, mean, same_text
from wardline.functions.time import Moment, to_datetime
from wardline.operators.children import PAGE_ROWS, pages
from wardline.operators.people import bed_numbers, doctor_names, doctor_profiles, patient_names, specialization_names
from wardline.operators.ranking import latest_value, latest_with_ties, referring, top, top_per
from wardline.operators.spread import spread_join
from wardline.operators.summary import summarise
from wardline.sources.tables import Tables


def _newest() -> list[Column]:
    return [F.desc("visit_datetime"), F.desc("visit_id")]


def _keep(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def _room_numbers(t: Tables) -> DataFrame:
    return t.rooms.select(F.col("room_id").alias("initial_room_id"), "room_number")


def doctor_admitted_patients(t: Tables, as_of: Moment, doctor_id: int | None = None) -> DataFrame:
    """Open admissions with the condition seen at the last visit."""
    rows = _keep(t.admissions, "doctor_id", doctor_id).filter("is_active and discharge_date is null")
    # only visits of open stays are aggregated; those of a long stay are spread
    seen = t.admitted_patient_visits.select("admission_id", "visit_datetime", "visit_id", "condition_status")
    last = spread_join(seen, rows.select("admission_id"), ["admission_id"], "left_semi", "visit_id").groupBy("admission_id").agg(
        latest_value("visit_datetime", "visit_id", "condition_status").alias("last_condition_status")
    )
    people = t.patients.select(
        "patient_id", "first_name", "last_name", "age", "gender", "blood_group", "phone_no", "patient_login_id"
    )
    return (
        rows.join(people, "patient_id")
        .join(doctor_names(t), "doctor_id")
        .join(t.consultations.select("consultation_id", "consultation_date"), "consultation_id", "left")
        .join(_room_numbers(t), "initial_room_id", "left")
        .join(bed_numbers(t), "bed_id", "left")
        .join(last, "admission_id", "left")
        .select(
            "admission_id", "patient_id", "doctor_id", "admission_date", "admission_notes", "is_active",
            "first_name", "last_name", "age", "gender", "blood_group", "phone_no", "patient_login_id", "room_number",
            "bed_number", "bed_code", "consultation_date", "doctor_name",
            days_between("admission_date", as_moment(as_of)).alias("days_admitted"), "last_condition_status",
        )
    )


def admission_visits(t: Tables, admission_id: int | None = None) -> DataFrame:
    people = t.patients.select(
        "patient_id", F.col("first_name").alias("patient_first_name"), F.col("last_name").alias("patient_last_name")
    )
    return (
        _keep(t.admitted_patient_visits, "admission_id", admission_id)
        .join(people, "patient_id")
        .join(doctor_names(t), "doctor_id")
        .select(
            *t.admitted_patient_visits.columns,
            "patient_first_name",
            "patient_last_name",
            "doctor_name",
            F.date_format("visit_datetime", V.ISO_MINUTE).alias("formatted_visit_date"),
            F.date_format("discharge_recommended_date", V.ISO_DAY).alias("formatted_discharge_date"),
        )
    )


def doctor_recent_visits(t: Tables, doctor_id: int | None = None, limit: int | None = V.RECENT_VISITS) -> DataFrame:
    """The newest visits of one doctor, or of every doctor; all for a limit of None.

    Visits without their patient or admission are left out before the limit, so it
    keeps as many rows as one after the joins, and only the kept rows are looked up.
    """
    visits = t.admitted_patient_visits.select(
        "visit_id", "admission_id", "patient_id", "doctor_id", "blood_pressure", "temperature", "oxygen_saturation",
        "pulse_rate", "condition_status", "ready_for_discharge", "visit_datetime",
    )
    visits = referring(visits, t.patients.select("patient_id"), t.admissions.select("admission_id"))
    if doctor_id is None:
        newest = top_per(visits, ["doctor_id"], _newest(), limit)
    else:
        newest = top(visits.filter(F.col("doctor_id") == doctor_id), _newest(), limit)
    return (
        newest.join(patient_names(t, "gender", "age"), "patient_id")
        .join(t.admissions.select("admission_id", "initial_room_id", "bed_id"), "admission_id")
        .join(_room_numbers(t), "initial_room_id", "left")
        .join(bed_numbers(t).drop("bed_code"), "bed_id", "left")
        .select(
            *visits.columns, "patient_name", "gender", "age", "room_number", "bed_number",
            F.date_format("visit_datetime", V.US_MINUTE).alias("formatted_date"),
        )
    )


def _condition_counts(suffix: str) -> list[Column]:
    return [
        F.count_if(same_text("condition_status", name)).alias(f"{name.lower()}_{suffix}") for name in V.CONDITIONS
    ]


def _since(t: Tables, as_of: Moment, days: int, doctor_id: int | None) -> DataFrame:
    start = to_datetime(as_of) - dt.timedelta(days=days)
    visits = _keep(t.of_months("admitted_patient_visits", start), "doctor_id", doctor_id)
    return visits.filter(F.col("visit_datetime") >= as_moment(start))


def doctor_visits_summary(
    t: Tables, as_of: Moment, days: int = V.VISIT_SUMMARY_DAYS, doctor_id: int | None = None
) -> DataFrame:
    """Visit counts and average vitals per doctor over the last days."""
    return summarise(
        _since(t, as_of, days, doctor_id),
        "doctor_id",
        doctor_id,
        F.count(F.lit(1)).alias("total_visits"),
        *_condition_counts("count"),
        F.count_if("ready_for_discharge").alias("ready_for_discharge_count"),
        mean("temperature").alias("avg_temperature"),
        mean("oxygen_saturation").alias("avg_oxygen_saturation"),
        mean("pulse_rate").alias("avg_pulse_rate"),
    )


def doctor_visits_trend(
    t: Tables, as_of: Moment, days: int = V.VISIT_SUMMARY_DAYS, doctor_id: int | None = None
) -> DataFrame:
    """Visits per doctor and day over the last days."""
    return (
        _since(t, as_of, days, doctor_id)
        .groupBy("doctor_id", F.to_date("visit_datetime").alias("visit_date"))
        .agg(F.count(F.lit(1)).alias("visit_count"))
    )


def patient_admitted_visits(
    t: Tables, patient_id: int | None = None, admission_id: int | None = None
) -> DataFrame:
    """Visits with their context; ``visit_date_only`` is the key they group by for display."""
    visits = _keep(_keep(t.admitted_patient_visits, "patient_id", patient_id), "admission_id", admission_id)
    stays = t.admissions.select("admission_id", "admission_date", "initial_room_id", "bed_id")
    moment, recommended = "visit_datetime", "discharge_recommended_date"
    return (
        visits.join(stays, "admission_id")
        .join(patient_names(t, "age", "gender"), "patient_id")
        .join(doctor_profiles(t), "doctor_id")
        .join(_room_numbers(t), "initial_room_id", "left")
        .join(bed_numbers(t).drop("bed_code"), "bed_id", "left")
        .select(
            *t.admitted_patient_visits.columns, "patient_name", "age", "gender", "doctor_name", "specialization_id",
            "specialization_name", "admission_date", "room_number", "bed_number",
            F.date_format(moment, V.LONG_CLOCK).alias("formatted_visit_date"),
            F.date_format(moment, V.ISO_DAY).alias("visit_date_only"),
            F.date_format(moment, V.TIME_MINUTE).alias("visit_time_only"),
            F.date_format(recommended, V.LONG_DAY).alias("formatted_discharge_recommended_date"),
            days_between("admission_date", moment).alias("days_since_admission"),
        )
    )


def patient_visits_by_date(t: Tables, patient_id: int | None = None, admission_id: int | None = None) -> DataFrame:
    """The date groups of a patient's visits, one row each.

    The rows of a group are those of ``patient_admitted_visits`` with the same
    patient and ``visit_date_only``; they are not packed into a list, because
    nothing bounds how many visits a group can hold.
    """
    visits = _keep(_keep(t.admitted_patient_visits, "patient_id", patient_id), "admission_id", admission_id)
    return visits.groupBy("patient_id", F.date_format("visit_datetime", V.ISO_DAY).alias("visit_date_only")).agg(
        F.count(F.lit(1)).alias("visits"),
        F.min("visit_datetime").alias("first_visit"),
        F.max("visit_datetime").alias("last_visit"),
    )


def patient_visits_nested(t: Tables, patient_id: int | None = None, size: int = PAGE_ROWS) -> DataFrame:
    """The visits of each patient and date as lists, latest first, in pages of at most ``size`` visits.

    Holds the groups of ``patient_visits_by_date`` with their rows nested; a group with more
    visits than a page has several pages, numbered from 0.
    """
    visits = _keep(t.admitted_patient_visits, "patient_id", patient_id)
    rows = visits.withColumns(
        {
            "visit_date_only": F.date_format("visit_datetime", V.ISO_DAY),
            "visit_time_only": F.date_format("visit_datetime", V.TIME_MINUTE),
            # ascending in both, so that the latest visit comes first
            "__moment": -F.unix_micros(F.col("visit_datetime").cast("timestamp")),
            "__id": -F.col("visit_id"),
        }
    )
    shown = ["visit_id", "admission_id", "doctor_id", "visit_datetime", "visit_time_only", "condition_status", "ready_for_discharge"]
    return pages(rows, ["patient_id", "visit_date_only"], ["__moment", "__id"], shown, size).withColumnRenamed("children", "visits")


def patient_visits_summary(t: Tables, patient_id: int | None = None) -> DataFrame:
    """Visit counts, averages, first and last visit and number of doctors per patient.

    Distinct doctors come from a per-(patient, doctor) roll-up, so a patient with
    very many visits is reduced before rows of one patient meet.
    """

    def parts(column: str) -> list[Column]:
        return [exact_sum(column).alias(f"sum_{column}"), F.count(column).alias(f"n_{column}")]

    vitals = ("temperature", "oxygen_saturation", "pulse_rate")
    by_doctor = (
        _keep(t.admitted_patient_visits, "patient_id", patient_id)
        .groupBy("patient_id", "doctor_id")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            *_condition_counts("visits"),
            F.count_if("ready_for_discharge").alias("ready"),
            *[part for column in vitals for part in parts(column)],
            F.min("visit_datetime").alias("first_visit"),
            F.max("visit_datetime").alias("last_visit"),
        )
    )

    def average(column: str) -> Column:
        return F.try_divide(F.sum(f"sum_{column}").cast("double"), F.sum(f"n_{column}"))

    return summarise(
        by_doctor,
        "patient_id",
        patient_id,
        F.coalesce(F.sum("visits"), F.lit(0)).alias("total_visits"),
        *[F.sum(f"{name.lower()}_visits").alias(f"{name.lower()}_visits") for name in V.CONDITIONS],
        F.sum("ready").alias("ready_for_discharge_count"),
        average("temperature").alias("avg_temperature"),
        average("oxygen_saturation").alias("avg_oxygen"),
        average("pulse_rate").alias("avg_pulse"),
        F.min("first_visit").alias("first_visit_date"),
        F.max("last_visit").alias("last_visit_date"),
        F.count("doctor_id").alias("unique_doctors_count"),
    )


def patient_visit_doctors(t: Tables, patient_id: int | None = None) -> DataFrame:
    """Doctors who visited each patient, with their number of visits."""
    counts = (
        _keep(t.admitted_patient_visits, "patient_id", patient_id)
        .groupBy("patient_id", "doctor_id")
        .agg(F.count("visit_id").alias("visits_by_doctor"))
    )
    return counts.join(doctor_profiles(t), "doctor_id").select(
        "patient_id", "doctor_id", "doctor_name", "specialization_name", "visits_by_doctor"
    )


def ready_for_discharge(t: Tables, as_of: Moment) -> DataFrame:
    """Active, undischarged admissions with their newest discharge recommendation.

    Only visits that recommend discharge compete, so a later visit without a
    recommendation does not cancel it; recommendations at the same moment all stay.
    """
    open_rows = (
        t.admissions.filter("is_active")
        .join(t.discharges.select("admission_id"), "admission_id", "left_anti")
        .select(
            "admission_id", "patient_id", "doctor_id", "bed_id", "initial_room_id", "admission_date",
            "admission_notes",
        )
    )
    recommended = t.admitted_patient_visits.filter("ready_for_discharge").select(
        "visit_id", "admission_id", "ready_for_discharge", "discharge_recommended_date", "condition_status",
        "visit_datetime", "treatment_given", "notes",
    )
    # visits of closed stays, nearly all, are dropped before they are aggregated
    recommended = spread_join(recommended, open_rows.select("admission_id"), ["admission_id"], "left_semi", "visit_id")
    newest = latest_with_ties(recommended, ["admission_id"], "visit_datetime")
    people = t.patients.select(
        "patient_id",
        F.col("first_name").alias("patient_first_name"),
        F.col("last_name").alias("patient_last_name"),
        "patient_login_id", "age", "gender", "blood_group", "phone_no",
    )
    doctors = t.doctors.select(
        "doctor_id",
        F.col("first_name").alias("doctor_first_name"),
        F.col("last_name").alias("doctor_last_name"),
        "doctor_login_id", "specialization_id",
    ).join(specialization_names(t), "specialization_id")
    kinds = t.room_types.select("room_type_id", F.col("type_name").alias("room_type"), "per_day_charges")
    rooms = t.rooms.select(F.col("room_id").alias("initial_room_id"), "room_number", "room_type_id")
    return (
        open_rows.join(newest, "admission_id")
        .join(people, "patient_id")
        .join(doctors, "doctor_id")
        .join(rooms.join(kinds, "room_type_id"), "initial_room_id")
        .join(bed_numbers(t), "bed_id")
        .select(
            *open_rows.columns, "patient_first_name", "patient_last_name", "patient_login_id", "age", "gender",
            "blood_group", "phone_no", "doctor_first_name", "doctor_last_name", "doctor_login_id",
            "specialization_id", "specialization_name", "room_number", "room_type_id", "room_type",
            "per_day_charges", "bed_number", "bed_code", "visit_id", "ready_for_discharge",
            "discharge_recommended_date", "condition_status", F.col("visit_datetime").alias("last_visit_date"),
            "treatment_given", F.col("notes").alias("doctor_notes"),
            days_between("admission_date", as_moment(as_of)).alias("days_admitted"),
        )
    )
