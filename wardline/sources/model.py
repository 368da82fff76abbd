"""The hospital model: 24 tables with their types, rules, keys and references.

One declaration per table serves the readers (schema), the quality rules, the
ingest job (required fields, defaults, keys) and the cascade of removals.
Surrogate keys are 64-bit: the visit and log tables outgrow 32 bits first.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from wardline import fixed_values as V

NOW = object()  # default "time of the run"
MONTH = "month"  # storage partition of the facts: yyyy-MM of their date


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    required: bool = False
    default: Any = None
    low: float | None = None
    high: float | None = None
    one_of: tuple[str, ...] | None = None
    max_len: int | None = None


@dataclass(frozen=True)
class Reference:
    """A foreign key and what a removed parent does to its children."""

    column: str
    table: str
    on_delete: str = "reject"  # "reject" | "cascade" | "clear"


@dataclass(frozen=True)
class Table:
    name: str
    key: str
    columns: tuple[Column, ...]
    references: tuple[Reference, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    first_key: int = 1
    key_step: int = 1
    login: tuple[str, str] | None = None  # derived login id: (column, prefix)
    month_of: str | None = None  # facts are stored by the month of this column
    together_by: str | None = None  # a key, unique here, that it shares with the table it is joined to one to one
    by_name: dict[str, Column] = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        self.by_name.update({c.name: c for c in self.columns})

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, T.DataType.fromDDL(c.type)) for c in self.columns])


def _ref(name: str, required: bool = True) -> Column:
    return Column(name, "bigint", required=required)


def _text(name: str, size: int, required: bool = False, **rules: Any) -> Column:
    return Column(name, "string", required=required, max_len=size, **rules)


def _count(name: str, low: float | None = None, high: float | None = None, **rules: Any) -> Column:
    return Column(name, "int", low=low, high=high, **rules)


def _amount(name: str, required: bool = False, default: Any = None) -> Column:
    return Column(name, "decimal(10,2)", required=required, default=default, low=0)


def _flag(name: str, default: bool) -> Column:
    return Column(name, "boolean", default=default)


def _moment(name: str, default: Any = None) -> Column:
    return Column(name, "timestamp_ntz", default=default)


def _person(login: str) -> tuple[Column, ...]:
    return (_text(login, 11), _text("first_name", 50, True), _text("last_name", 50, True))


# decimal(5,2): the allowed range of 90-110 does not fit two integer digits.
_TEMPERATURE = "decimal(5,2)"

TABLES: dict[str, Table] = {
    table.name: table
    for table in (
        Table(
            "admin", "admin_id",
            (_ref("admin_id"), _text("admin_login_id", 11), _text("username", 50, True), _moment("created_at", NOW)),
            unique=(("username",),), login=("admin_login_id", "A"),
        ),
        Table(
            "specializations", "specialization_id",
            (_ref("specialization_id"), _text("specialization_login_id", 11),
             _text("specialization_name", 100, True), _text("description", 255)),
            unique=(("specialization_name",),), login=("specialization_login_id", "S"),
        ),
        Table(
            "doctors", "doctor_id",
            (_ref("doctor_id"), *_person("doctor_login_id"), _count("age", 18, 100, required=True),
             _ref("specialization_id"), _amount("consultation_fee", True, 0), _text("phone_no", 20),
             _count("experience_years", 0, required=True), _text("registration_number", 50), _count("room_no")),
            references=(Reference("specialization_id", "specializations"),),
            unique=(("registration_number",),), first_key=10, key_step=10, login=("doctor_login_id", "D"),
        ),
        Table(
            "patients", "patient_id",
            (_ref("patient_id"), *_person("patient_login_id"), _count("age", 0, 150, required=True),
             _text("gender", 10, one_of=V.GENDERS), _text("blood_group", 5, one_of=V.BLOOD_GROUPS),
             _text("phone_no", 20), _moment("created_at", NOW)),
            first_key=1000, login=("patient_login_id", "P"), together_by="patient_id",
        ),
        Table(
            "receptionists", "receptionist_id",
            (_ref("receptionist_id"), *_person("receptionist_login_id"), _text("contact_no", 20),
             _moment("created_at", NOW)),
            first_key=5, login=("receptionist_login_id", "R"),
        ),
        Table(
            "signin_logs", "log_id",
            (_ref("log_id"), _text("user_id", 50, True), _text("user_type", 20, True),
             _moment("signin_datetime", NOW)),
            month_of="signin_datetime",
        ),
        Table(
            "signup_logs", "signup_log_id",
            (_ref("signup_log_id"), _ref("patient_id"), _text("first_name", 50, True),
             _text("last_name", 50, True), _moment("signup_datetime", NOW)),
            references=(Reference("patient_id", "patients", "cascade"),), month_of="signup_datetime",
        ),
        Table(
            "time_slots", "slot_id",
            (_ref("slot_id"), _count("slot_number", required=True), _count("start_min", required=True),
             _count("end_min", required=True)),
            unique=(("slot_number",),),
        ),
        Table(
            "doctor_schedules", "schedule_id",
            (_ref("schedule_id"), _ref("doctor_id"), _count("day_of_week", 0, 6, required=True), _ref("slot_id"),
             _flag("is_active", True), _moment("created_at", NOW), _moment("updated_at", NOW)),
            references=(Reference("doctor_id", "doctors", "cascade"), Reference("slot_id", "time_slots", "cascade")),
            unique=(("doctor_id", "day_of_week", "slot_id"),),
        ),
        Table(
            "removed_doctors", "removed_doctor_id",
            (_ref("removed_doctor_id"), _ref("doctor_id"), _text("doctor_name", 100, True),
             _ref("specialization_id"), _text("registration_number", 50), _text("removal_reason", 500, True),
             _ref("removed_by_admin_id"), _moment("removal_date", NOW)),
            references=(Reference("specialization_id", "specializations"), Reference("removed_by_admin_id", "admin")),
        ),
        Table(
            "room_types", "room_type_id",
            (_ref("room_type_id"), _text("type_name", 50, True), _text("description", 255),
             _amount("per_day_charges", True, 0)),
            unique=(("type_name",),),
        ),
        Table(
            "rooms", "room_id",
            (_ref("room_id"), _text("room_number", 20, True), _ref("room_type_id"),
             _count("floor_number", 0, default=1), _flag("is_occupied", False)),
            references=(Reference("room_type_id", "room_types", "cascade"),), unique=(("room_number",),),
        ),
        Table(
            "beds", "bed_id",
            (_ref("bed_id"), _text("bed_code", 30, True), _ref("room_id"), _count("bed_number", 1, required=True),
             _flag("is_occupied", False)),
            references=(Reference("room_id", "rooms", "cascade"),), unique=(("bed_code",), ("room_id", "bed_number")),
        ),
        Table(
            "appointment_statuses", "status_id", (_ref("status_id"), _text("status_name", 50, True)),
            unique=(("status_name",),),
        ),
        Table(
            "appointments", "appointment_id",
            (_ref("appointment_id"), _ref("patient_id"), _ref("doctor_id"),
             Column("appointment_date", "date", required=True), _ref("slot_id", False),
             Column("status_id", "bigint", required=True, default=V.SCHEDULED), _moment("appointment_datetime"),
             _moment("created_at", NOW)),
            references=(Reference("patient_id", "patients", "cascade"), Reference("doctor_id", "doctors", "cascade"),
                        Reference("slot_id", "time_slots", "clear"), Reference("status_id", "appointment_statuses")),
            month_of="appointment_date", together_by="appointment_id",
        ),
        Table(
            "appointment_cancellations", "cancellation_id",
            (_ref("cancellation_id"), _ref("appointment_id"), _ref("patient_id"), _text("cancellation_reason", 500),
             _moment("cancelled_at", NOW)),
            references=(Reference("appointment_id", "appointments", "cascade"),
                        Reference("patient_id", "patients", "cascade")),
            month_of="cancelled_at",
        ),
        Table(
            "appointment_forms", "form_id",
            (_ref("form_id"), _ref("appointment_id"), _ref("patient_id"), _text("symptoms", 1000, True),
             _text("medical_history", 1000), _moment("created_at", NOW)),
            references=(Reference("appointment_id", "appointments", "cascade"), Reference("patient_id", "patients")),
            month_of="created_at",
        ),
        Table(
            "consultations", "consultation_id",
            (_ref("consultation_id"), _ref("appointment_id"), _ref("doctor_id"), _ref("patient_id"),
             _text("blood_pressure", 20), Column("temperature", _TEMPERATURE), _count("oxygen_saturation"),
             _text("diagnosis", 500), _moment("consultation_date", NOW)),
            references=(Reference("appointment_id", "appointments", "cascade"), Reference("doctor_id", "doctors"),
                        Reference("patient_id", "patients")),
            unique=(("appointment_id",),), month_of="consultation_date", together_by="appointment_id",
        ),
        Table(
            "prescribed_medicines", "medicine_id",
            (_ref("medicine_id"), _ref("consultation_id"), _text("medicine_name", 100, True),
             _text("dosage", 50, True), _text("frequency", 50, True), _text("duration", 50, True),
             _moment("created_at", NOW)),
            references=(Reference("consultation_id", "consultations", "cascade"),), month_of="created_at",
        ),
        Table(
            "action_types", "action_type_id", (_ref("action_type_id"), _text("action_name", 50, True)),
            unique=(("action_name",),),
        ),
        Table(
            "consultation_actions", "action_id",
            (_ref("action_id"), _ref("consultation_id"), _ref("action_type_id"),
             _text("status", 20, default="Pending", one_of=V.ACTION_STATES), _text("notes", 500),
             _moment("created_at", NOW), _moment("completed_at")),
            references=(Reference("consultation_id", "consultations", "cascade"),
                        Reference("action_type_id", "action_types")),
            month_of="created_at",
        ),
        Table(
            "admissions", "admission_id",
            (_ref("admission_id"), _ref("patient_id"), _ref("doctor_id"), _ref("consultation_id"), _ref("action_id"),
             _ref("initial_room_id"), _ref("bed_id"), _moment("admission_date", NOW), _moment("discharge_date"),
             _flag("is_active", True), _text("admission_notes", 500), _ref("assigned_by_receptionist_id")),
            references=(Reference("patient_id", "patients", "cascade"), Reference("doctor_id", "doctors"),
                        Reference("consultation_id", "consultations"), Reference("action_id", "consultation_actions"),
                        Reference("initial_room_id", "rooms"), Reference("bed_id", "beds"),
                        Reference("assigned_by_receptionist_id", "receptionists")),
            month_of="admission_date", together_by="admission_id",
        ),
        Table(
            "admitted_patient_visits", "visit_id",
            (_ref("visit_id"), _ref("admission_id"), _ref("patient_id"), _ref("doctor_id"),
             _moment("visit_datetime", NOW), _text("blood_pressure", 20),
             Column("temperature", _TEMPERATURE, low=V.TEMPERATURE_RANGE[0], high=V.TEMPERATURE_RANGE[1]),
             _count("oxygen_saturation", *V.OXYGEN_RANGE), _count("pulse_rate", *V.PULSE_RANGE),
             _text("condition_status", 50, one_of=V.CONDITIONS), _text("notes", 1000), _text("treatment_given", 500),
             _flag("ready_for_discharge", False), _moment("discharge_recommended_date"), _moment("created_at", NOW)),
            references=(Reference("admission_id", "admissions", "cascade"), Reference("patient_id", "patients"),
                        Reference("doctor_id", "doctors")),
            month_of="visit_datetime",
        ),
        Table(
            "discharges", "discharge_id",
            (_ref("discharge_id"), _ref("admission_id"), _ref("patient_id"), _ref("doctor_id"),
             _moment("discharge_date", NOW), _count("total_days", 0, required=True), _amount("room_charges", True, 0),
             _amount("medical_charges", default=0), _amount("doctor_visit_charges", default=0),
             _amount("lab_charges", default=0), _amount("other_charges", default=0), _amount("total_amount", True),
             _text("payment_status", 20, default="Unpaid", one_of=V.PAYMENT_STATES),
             _amount("amount_paid", default=0), _moment("payment_date"), _text("final_diagnosis", 1000),
             _text("discharge_summary", 2000), _text("discharge_instructions", 2000),
             _flag("follow_up_required", False), Column("follow_up_date", "date"),
             _ref("processed_by_receptionist_id"), _ref("discharge_approved_by_visit_id", False)),
            references=(Reference("admission_id", "admissions", "cascade"), Reference("patient_id", "patients"),
                        Reference("doctor_id", "doctors"),
                        Reference("processed_by_receptionist_id", "receptionists"),
                        Reference("discharge_approved_by_visit_id", "admitted_patient_visits")),
            unique=(("admission_id",),), month_of="discharge_date", together_by="admission_id",
        ),
    )
}
