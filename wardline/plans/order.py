"""Display order of the datasets.

Datasets are unordered frames: a global sort is a shuffle of the whole result and
belongs at the output. ``in_display_order`` adds the order a reader expects, with
the key as the last criterion. NULL sorts first ascending and last descending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dataset -> sort columns; a leading minus is descending.
ORDER: dict[str, tuple[str, ...]] = {
    "specializations": ("specialization_name", "specialization_id"),
    "doctor_directory": ("-doctor_id",),
    "doctors_list": ("doctor_name", "doctor_id"),
    "doctor_fees": ("doctor_id",),
    "removed_doctors": ("-removal_date", "-removed_doctor_id"),
    "time_slots": ("slot_number",),
    "action_types": ("action_name", "action_type_id"),
    "receptionists": ("receptionist_id",),
    "recent_patients": ("-registered_date", "-patient_id"),
    "schedules": ("day_of_week", "slot_number", "schedule_id"),
    "available_schedule": ("doctor_id", "start_time"),
    "weekly_availability": ("doctor_id", "date", "start_time"),
    "weekly_availability_days": ("doctor_id", "date"),
    "patient_forms": ("-created_at", "-form_id"),
    "patient_consultations": ("-consultation_date", "-consultation_id"),
    "doctor_consultations": ("-consultation_date", "-consultation_id"),
    "consultation_medicines": ("created_at", "medicine_id"),
    "patient_prescriptions": ("-consultation_date", "medicine_id"),
    "consultation_actions": ("-created_at", "-action_id"),
    "doctor_scheduled_appointments": ("appointment_date", "start_time", "appointment_id"),
    "patient_upcoming_appointments": ("appointment_date", "start_time", "appointment_id"),
    "doctor_patients_summary": ("-last_consultation_date", "first_name", "last_name", "patient_id"),
    "discharge_list": ("-discharge_date", "-discharge_id"),
    "doctor_discharged_patients": ("-discharge_date", "-discharge_id"),
    "discharge_bundle_visits": ("visit_datetime", "visit_id"),
    "discharge_search": ("-discharge_date", "-discharge_id"),
    "recent_discharges": ("-discharge_date", "-discharge_id"),
    "daily_patients": ("-registration_date", "patient_id"),
    "daily_doctors": ("-revenue_today", "doctor_id"),
    "patients_range": ("-registration_date", "patient_id"),
    "doctors_range": ("-total_revenue", "doctor_id"),
    "today_appointments": ("appointment_id",),
    "admission_recommended": ("-created_at", "-action_id"),
    "beds": ("room_number", "bed_number"),
    "beds_available_filtered": ("floor_number", "room_id", "bed_number"),
    "rooms_occupancy": ("floor_number", "room_number"),
    "rooms_department": ("floor_number", "room_number"),
    "rooms_available_by_bed": ("floor_number", "room_number"),
    "rooms_available_by_admission": ("floor_number", "room_number"),
    "room_types": ("type_name", "room_type_id"),
    "room_charges": ("room_type_id",),
    "active_admissions": ("-admission_date", "-admission_id"),
    "active_admissions_any_bed": ("-admission_date", "-admission_id"),
    "active_admissions_detailed": ("-admission_date", "-admission_id"),
    "active_admissions_report": ("-admission_date", "-admission_id"),
    "doctor_admitted_patients": ("-admission_date", "-admission_id"),
    "admission_visits": ("-visit_datetime", "-visit_id"),
    "doctor_recent_visits": ("-visit_datetime", "-visit_id"),
    "doctor_visits_trend": ("doctor_id", "visit_date"),
    "patient_admitted_visits": ("-visit_datetime", "-visit_id"),
    "ready_for_discharge": ("discharge_recommended_date", "-admission_date", "admission_id", "visit_id"),
}


def sort_columns(name: str) -> list[Column]:
    return [
        F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_first()
        for c in ORDER.get(name, ())
    ]


def in_display_order(name: str, df: DataFrame) -> DataFrame:
    """Sort a dataset for output."""
    columns = sort_columns(name)
    return df.orderBy(*columns) if columns else df
