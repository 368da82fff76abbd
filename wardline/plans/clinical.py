"""Appointments, forms, consultations, prescriptions and follow-up actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_day, first_given, full_name, joined, or_default, same_text
from wardline.functions.time import Moment
from wardline.operators.people import doctor_names, doctor_profiles, patient_names, slot_times
from wardline.operators.ranking import latest_value
from wardline.sources.tables import Tables


def _keep(df: DataFrame, column: str, value: int | None) -> DataFrame:
    return df if value is None else df.filter(F.col(column) == value)


def _appointment_dates(t: Tables) -> DataFrame:
    return t.appointments.select("appointment_id", "appointment_date")


def appointment_form_detail(t: Tables, appointment_id: int | None = None) -> DataFrame:
    """Forms with the names of the patient and of the appointment's doctor."""
    doctors = t.appointments.select("appointment_id", "doctor_id").join(doctor_profiles(t), "doctor_id")
    forms = _keep(t.appointment_forms, "appointment_id", appointment_id)
    return (
        forms.join(patient_names(t), "patient_id")
        .join(doctors.select("appointment_id", "doctor_name"), "appointment_id")
        .select(*t.appointment_forms.columns, "patient_name", "doctor_name")
    )


def patient_forms(t: Tables, patient_id: int | None = None) -> DataFrame:
    visits = t.appointments.select("appointment_id", "appointment_date", "doctor_id")
    visits = visits.join(doctor_profiles(t), "doctor_id").select(
        "appointment_id", "appointment_date", "doctor_name", "specialization_name"
    )
    return (
        _keep(t.appointment_forms, "patient_id", patient_id)
        .join(visits, "appointment_id")
        .select(*t.appointment_forms.columns, "appointment_date", "doctor_name", "specialization_name")
    )


def consultation_detail(t: Tables, consultation_id: int | None = None) -> DataFrame:
    return (
        _keep(t.consultations, "consultation_id", consultation_id)
        .join(patient_names(t), "patient_id")
        .join(doctor_names(t), "doctor_id")
        .join(_appointment_dates(t), "appointment_id")
        .select(*t.consultations.columns, "patient_name", "doctor_name", "appointment_date")
    )


def consultation_exists(t: Tables, appointment_id: int | None = None) -> DataFrame:
    """Appointments with the consultation they led to, if any."""
    done = t.consultations.select("appointment_id", "consultation_id", "diagnosis", "consultation_date")
    asked = _keep(t.appointments, "appointment_id", appointment_id).select("appointment_id")
    return asked.join(done, "appointment_id", "left").select(
        "appointment_id",
        F.col("consultation_id").isNotNull().alias("exists"),
        "consultation_id",
        "diagnosis",
        "consultation_date",
    )


def patient_consultations(t: Tables, patient_id: int | None = None) -> DataFrame:
    """Consultations with doctor, slot times and display dates."""
    slots = slot_times(t).drop("slot_number")
    booked = t.appointments.select("appointment_id", "appointment_date", "slot_id")
    return (
        _keep(t.consultations, "patient_id", patient_id)
        .join(booked, "appointment_id")
        .join(doctor_profiles(t), "doctor_id")
        .join(slots, "slot_id", "left")
        .select(
            "consultation_id", "appointment_id", "patient_id", "doctor_id", "blood_pressure", "temperature",
            "oxygen_saturation", "diagnosis",
            F.date_format("consultation_date", V.ISO_SECOND).alias("consultation_date"),
            F.date_format("appointment_date", V.ISO_DAY).alias("appointment_date"),
            "start_time", "end_time", "doctor_name", "specialization_name",
        )
    )


def doctor_consultations(t: Tables, doctor_id: int | None = None) -> DataFrame:
    return (
        _keep(t.consultations, "doctor_id", doctor_id)
        .join(patient_names(t, "age", "gender", "blood_group"), "patient_id")
        .join(_appointment_dates(t), "appointment_id")
        .select(*t.consultations.columns, "patient_name", "age", "gender", "blood_group", "appointment_date")
    )


def consultation_medicines(t: Tables, consultation_id: int | None = None) -> DataFrame:
    return _keep(t.prescribed_medicines, "consultation_id", consultation_id)


def patient_prescriptions(t: Tables, patient_id: int | None = None) -> DataFrame:
    given = (
        _keep(t.consultations, "patient_id", patient_id)
        .select("consultation_id", "patient_id", "doctor_id", "consultation_date")
        .join(doctor_names(t), "doctor_id")
    )
    return t.prescribed_medicines.join(given, "consultation_id").select(
        "medicine_id",
        "consultation_id",
        "patient_id",
        "medicine_name",
        "dosage",
        "frequency",
        "duration",
        F.date_format("consultation_date", V.ISO_DAY).alias("consultation_date"),
        "doctor_name",
    )


def consultation_actions(t: Tables, consultation_id: int | None = None) -> DataFrame:
    return (
        _keep(t.consultation_actions, "consultation_id", consultation_id)
        .join(t.action_types, "action_type_id")
        .select(*t.consultation_actions.columns, "action_name")
    )


def appointment_patient_card(t: Tables, appointment_id: int | None = None) -> DataFrame:
    """Patient and complaint of an appointment with display defaults."""
    people = patient_names(t, "age", "gender")
    forms = t.appointment_forms.select("appointment_id", "symptoms", "medical_history")
    return (
        _keep(t.appointments, "appointment_id", appointment_id)
        .select("appointment_id", "patient_id")
        .join(people, "patient_id")
        .join(forms, "appointment_id", "left")
        .select(
            "appointment_id",
            first_given("patient_name", V.NO_NAME).alias("name"),
            # Age 0 reads as not given, so the column is text.
            F.coalesce(or_default("age", F.lit(None)).cast("string"), F.lit(V.NOT_AVAILABLE)).alias("age"),
            first_given("gender", V.NO_GENDER).alias("gender"),
            first_given("symptoms", V.NO_SYMPTOMS).alias("symptoms"),
            first_given("medical_history", V.NO_HISTORY).alias("allergies"),
        )
    )


def doctor_scheduled_appointments(
    t: Tables, doctor_id: int | None = None, start_date: Moment | None = None, end_date: Moment | None = None
) -> DataFrame:
    """Appointments still in status Scheduled, optionally of a date range."""
    rows = _keep(t.of_months("appointments", start_date, end_date), "doctor_id", doctor_id)
    rows = rows.filter(F.col("status_id") == V.SCHEDULED)
    if start_date is not None:
        rows = rows.filter(F.col("appointment_date") >= as_day(start_date))
    if end_date is not None:
        rows = rows.filter(F.col("appointment_date") <= as_day(end_date))
    people = t.patients.select(
        "patient_id",
        F.col("first_name").alias("patient_first_name"),
        F.col("last_name").alias("patient_last_name"),
        "phone_no",
        "patient_login_id",
    )
    return (
        rows.join(people, "patient_id")
        .join(slot_times(t).drop("slot_number"), "slot_id", "left")
        .join(t.appointment_statuses, "status_id", "left")
        .select(
            "appointment_id", "doctor_id", "appointment_date", "slot_id", "status_id", "created_at", "start_time",
            "end_time", "patient_id", "patient_first_name", "patient_last_name", "phone_no", "patient_login_id",
            "status_name",
        )
    )


def patient_upcoming_appointments(t: Tables, as_of: Moment, patient_id: int | None = None) -> DataFrame:
    """Appointments from today on that are not cancelled."""
    rows = _keep(t.of_months("appointments", as_of), "patient_id", patient_id).filter(
        (F.col("appointment_date") >= as_day(as_of)) & (F.col("status_id") != V.CANCELLED)
    )
    doctors = doctor_names(t, "specialization_id", "consultation_fee").join(
        t.specializations.select("specialization_id", "specialization_name"), "specialization_id", "left"
    )
    return (
        rows.join(doctors, "doctor_id", "left")
        .join(slot_times(t).drop("slot_number"), "slot_id", "left")
        .join(t.appointment_statuses, "status_id", "left")
        .select(
            "appointment_id", "appointment_date", "patient_id", "doctor_id", "slot_id", "start_time", "end_time",
            # A missing doctor still yields the separating space.
            F.coalesce("doctor_name", F.lit(" ")).alias("doctor_name"),
            "specialization_name", "consultation_fee", "status_name",
        )
    )


def doctor_patients_summary(t: Tables, doctor_id: int | None = None, gender: str | None = None) -> DataFrame:
    """Patients of each doctor with consultation count, last date and diagnosis.

    ``latest_diagnosis`` is the alphabetically greatest one, as reported;
    ``latest_diagnosis_exact`` is the diagnosis of the last consultation.
    """
    pair = ["doctor_id", "patient_id"]
    seen = _keep(t.consultations, "doctor_id", doctor_id)
    counts = seen.groupBy(*pair).agg(
        F.count("consultation_id").alias("total_consultations"),
        F.max("consultation_date").alias("last_consultation_date"),
        F.max("diagnosis").alias("latest_diagnosis"),
        latest_value("consultation_date", "consultation_id", "diagnosis").alias("latest_diagnosis_exact"),
    )
    people = t.patients.select(
        "patient_id", "patient_login_id", "first_name", "last_name", "gender", "age", "blood_group", "phone_no"
    )
    if gender is not None and gender.lower() in ("male", "female"):
        people = people.filter(same_text("gender", gender))
    return (
        counts.join(people, "patient_id")
        .select(
            "doctor_id", *people.columns, "total_consultations", "last_consultation_date", "latest_diagnosis",
            "latest_diagnosis_exact",
        )
    )


def medical_report(t: Tables) -> DataFrame:
    """Consultations of completed appointments as display text."""
    done = t.appointments.filter(F.col("status_id") == V.COMPLETED).select("appointment_id", "appointment_date")
    people = t.patients.select("patient_id", "patient_login_id", full_name().alias("patient_name"))

    def shown(column: str, unit: str) -> Column:
        text = joined(column, F.lit(unit)) if unit else F.col(column)
        return F.when(F.col(column).isNotNull(), text).otherwise(F.lit(V.NOT_AVAILABLE)).alias(column)

    return (
        t.consultations.join(done, "appointment_id")
        .join(people, "patient_id")
        .join(doctor_profiles(t, title=V.DOCTOR_TITLE), "doctor_id")
        .select(
            "consultation_id", "appointment_id", "patient_login_id", "patient_name", "doctor_name",
            "specialization_name",
            F.date_format("appointment_date", V.SLASH_DAY).alias("appointment_date"),
            F.date_format("consultation_date", V.SLASH_MINUTE).alias("consultation_date"),
            F.coalesce("diagnosis", F.lit(V.NO_DIAGNOSIS)).alias("diagnosis"),
            shown("blood_pressure", ""), shown("temperature", "°F"), shown("oxygen_saturation", "%"),
        )
    )
