"""All datasets by name, and the tables and the report view for SQL users."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from wardline.plans import billing, clinical, lists, reports, scheduling, visits, wards
from wardline.plans.order import in_display_order
from wardline.sources.tables import Tables

_MODULES = {
    lists: "specializations doctor_directory doctors_list doctor_fees removed_doctors reference_dims time_slots"
    " action_types receptionists recent_signins recent_patients",
    scheduling: "schedules available_schedule available_schedule_summary weekly_availability"
    " weekly_availability_days weekly_availability_nested slot_check",
    clinical: "appointment_form_detail patient_forms consultation_detail consultation_exists patient_consultations"
    " doctor_consultations consultation_medicines patient_prescriptions consultation_actions"
    " appointment_patient_card doctor_scheduled_appointments patient_upcoming_appointments"
    " doctor_patients_summary medical_report",
    wards: "admission_recommended beds beds_available_filtered rooms_occupancy rooms_department room_types"
    " room_charges rooms_available_by_bed rooms_available_by_admission active_admissions active_admissions_any_bed"
    " active_admissions_detailed active_admissions_report admission_detail action_admission_status bed_availability",
    visits: "doctor_admitted_patients admission_visits doctor_recent_visits doctor_visits_summary"
    " doctor_visits_trend patient_admitted_visits patient_visits_by_date patient_visits_summary"
    " patient_visit_doctors ready_for_discharge",
    billing: "discharge_list doctor_discharged_patients discharge_bundle discharge_bundle_visits"
    " doctor_discharge_stats discharge_search recent_discharges",
    reports: "daily_patients daily_patients_summary daily_doctors daily_doctors_summary patients_range"
    " patients_range_summary doctors_range doctors_range_summary daily_summary range_summary today_appointments",
}
DATASETS: dict[str, Callable[..., DataFrame]] = {
    name: getattr(module, name) for module, names in _MODULES.items() for name in names.split()
}


def dataset(name: str, t: Tables, *arguments: object, ordered: bool = False, **options: object) -> DataFrame:
    """A dataset by name; ``ordered`` sorts it for display."""
    frame = DATASETS[name](t, *arguments, **options)
    return in_display_order(name, frame) if ordered else frame


def register_views(t: Tables) -> None:
    """Make the tables and the medical report available to ``spark.sql``."""
    for name in t:
        t[name].createOrReplaceTempView(name)
    clinical.medical_report(t).createOrReplaceTempView("medical_report")
