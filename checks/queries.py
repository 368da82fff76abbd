"""Every dataset and job as a query over a sample folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import quality
from wardline.jobs import admission, booking, discharge, ingest, occupancy, patches, removal
from wardline.jobs import visits as visit_jobs
from wardline.jobs.result import JobResult, commit, store
from wardline.operators.beds import expand_beds
from wardline.operators.summary import total
from wardline.plans import billing, clinical, lists, reports, rolled, scheduling, visits, wards
from wardline.plans.order import sort_columns
from wardline.session import checkpoint_folder, configure, stage
from wardline.sources import seeds, sinks
from wardline.sources.commits import Change, Store
from wardline.sources.rollups import ROLLUPS, Rollups
from wardline.sources.sample import AS_OF, REPORT_DAY, REPORT_RANGE, Sample, hospital_tables, long_lists
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
DATASETS: dict[str, Callable[[Tables, Sample], DataFrame]] = {
    "specializations": lambda t, s: lists.specializations(long_lists(t, s)),
    "doctor_directory": lambda t, s: lists.doctor_directory(t),
    "doctors_list": lambda t, s: lists.doctors_list(t),
    "doctor_fees": lambda t, s: lists.doctor_fees(t),
    "removed_doctors": lambda t, s: lists.removed_doctors(t),
    "time_slots": lambda t, s: lists.time_slots(long_lists(t, s)),
    "action_types": lambda t, s: lists.action_types(long_lists(t, s)),
    "receptionists": lambda t, s: lists.receptionists(long_lists(t, s)),
    "reference_dims": lambda t, s: lists.reference_dims(long_lists(t, s)),
    "recent_signins": lambda t, s: lists.recent_signins(t),
    "recent_patients": lambda t, s: lists.recent_patients(t),
    "schedules": lambda t, s: scheduling.schedules(t),
    "available_schedule": lambda t, s: scheduling.available_schedule(t, AS_OF, AS_OF),
    "available_schedule_summary": lambda t, s: scheduling.available_schedule_summary(t, AS_OF, AS_OF),
    "weekly_availability": lambda t, s: scheduling.weekly_availability(t, AS_OF),
    "weekly_availability_days": lambda t, s: scheduling.weekly_availability_days(t, AS_OF),
    "slot_check": lambda t, s: scheduling.slot_check(t, s.booking_requests(), AS_OF),
    "appointment_form_detail": lambda t, s: clinical.appointment_form_detail(t),
    "patient_forms": lambda t, s: clinical.patient_forms(t),
    "consultation_detail": lambda t, s: clinical.consultation_detail(t),
    "consultation_exists": lambda t, s: clinical.consultation_exists(t),
    "patient_consultations": lambda t, s: clinical.patient_consultations(t),
    "doctor_consultations": lambda t, s: clinical.doctor_consultations(t),
    "consultation_medicines": lambda t, s: clinical.consultation_medicines(t),
    "patient_prescriptions": lambda t, s: clinical.patient_prescriptions(t),
    "consultation_actions": lambda t, s: clinical.consultation_actions(t),
    "appointment_patient_card": lambda t, s: clinical.appointment_patient_card(t),
    "doctor_scheduled_appointments": lambda t, s: clinical.doctor_scheduled_appointments(t),
    "patient_upcoming_appointments": lambda t, s: clinical.patient_upcoming_appointments(t, "2001-06-01"),
    "doctor_patients_summary": lambda t, s: clinical.doctor_patients_summary(t),
    "doctor_patients_summary_female": lambda t, s: clinical.doctor_patients_summary(t, gender="female"),
    "medical_report": lambda t, s: clinical.medical_report(t),
    "admission_recommended": lambda t, s: wards.admission_recommended(t),
    "beds": lambda t, s: wards.beds(t),
    "beds_available_filtered": lambda t, s: wards.beds_available_filtered(t, "Female", "Cardiology"),
    "beds_available_male": lambda t, s: wards.beds_available_filtered(t, "male"),
    "beds_available_department": lambda t, s: wards.beds_available_filtered(
        t, "Other", "Pediatrics", match="department"
    ),
    "rooms_occupancy": lambda t, s: wards.rooms_occupancy(t),
    "rooms_department": lambda t, s: wards.rooms_department(t),
    "room_types": lambda t, s: wards.room_types(long_lists(t, s)),
    "room_charges": lambda t, s: wards.room_charges(long_lists(t, s)),
    "rooms_available_by_bed": lambda t, s: wards.rooms_available_by_bed(t),
    "rooms_available_by_admission": lambda t, s: wards.rooms_available_by_admission(t),
    "active_admissions": lambda t, s: wards.active_admissions(t, AS_OF),
    "active_admissions_any_bed": lambda t, s: wards.active_admissions_any_bed(t, AS_OF),
    "active_admissions_detailed": lambda t, s: wards.active_admissions_detailed(t, AS_OF),
    "active_admissions_report": lambda t, s: wards.active_admissions_report(t),
    "active_admissions_total": lambda t, s: total(wards.active_admissions_report(t)),
    "admission_detail": lambda t, s: wards.admission_detail(t, AS_OF),
    "action_admission_status": lambda t, s: wards.action_admission_status(t),
    "bed_availability": lambda t, s: wards.bed_availability(t),
    "doctor_admitted_patients": lambda t, s: visits.doctor_admitted_patients(t, AS_OF),
    "admission_visits": lambda t, s: visits.admission_visits(t),
    "doctor_recent_visits": lambda t, s: visits.doctor_recent_visits(t),
    "doctor_visits_summary": lambda t, s: visits.doctor_visits_summary(t, AS_OF),
    "doctor_visits_trend": lambda t, s: visits.doctor_visits_trend(t, AS_OF),
    "patient_admitted_visits": lambda t, s: visits.patient_admitted_visits(t),
    "patient_visits_by_date": lambda t, s: visits.patient_visits_by_date(t),
    "patient_visits_summary": lambda t, s: visits.patient_visits_summary(t),
    "patient_visit_doctors": lambda t, s: visits.patient_visit_doctors(t),
    "ready_for_discharge": lambda t, s: visits.ready_for_discharge(t, AS_OF),
    "discharge_list": lambda t, s: billing.discharge_list(t),
    "discharge_list_unpaid": lambda t, s: billing.discharge_list(t, payment_status="unpaid"),
    "doctor_discharged_patients": lambda t, s: billing.doctor_discharged_patients(
        t, start_date="1997-01-01", end_date="2000-12-31"
    ),
    "discharge_bundle": lambda t, s: billing.discharge_bundle(t),
    "discharge_bundle_visits": lambda t, s: billing.discharge_bundle_visits(t),
    "doctor_discharge_stats": lambda t, s: billing.doctor_discharge_stats(t, AS_OF, "year"),
    "doctor_discharge_stats_month": lambda t, s: billing.doctor_discharge_stats(t, AS_OF, "any"),
    "discharge_search": lambda t, s: billing.discharge_search(t, " ro "),
    "recent_discharges": lambda t, s: billing.recent_discharges(t),
    "daily_patients": lambda t, s: reports.daily_patients(t, REPORT_DAY),
    "daily_patients_summary": lambda t, s: reports.daily_patients_summary(t, REPORT_DAY),
    "daily_doctors": lambda t, s: reports.daily_doctors(t, REPORT_DAY),
    "daily_doctors_summary": lambda t, s: reports.daily_doctors_summary(t, REPORT_DAY),
    "patients_range": lambda t, s: reports.patients_range(t, *REPORT_RANGE),
    "patients_range_summary": lambda t, s: reports.patients_range_summary(t, *REPORT_RANGE),
    "doctors_range": lambda t, s: reports.doctors_range(t, *REPORT_RANGE),
    "doctors_range_summary": lambda t, s: reports.doctors_range_summary(t, *REPORT_RANGE),
    "daily_summary": lambda t, s: reports.daily_summary(t, REPORT_DAY),
    "range_summary": lambda t, s: reports.range_summary(t, AS_OF),
    "today_appointments": lambda t, s: reports.today_appointments(t, REPORT_DAY),
    "today_appointments_total": lambda t, s: total(reports.today_appointments(t, REPORT_DAY)),
}


#: Datasets with the filters they are usually called with.
DATASETS.update(
    {
        "schedules_of_doctor_day": lambda t, s: scheduling.schedules(t, 3, 2),
        "weekly_availability_of_doctor": lambda t, s: scheduling.weekly_availability(t, AS_OF, 3),
        "patient_forms_of_patient": lambda t, s: clinical.patient_forms(t, 7),
        "patient_consultations_of_patient": lambda t, s: clinical.patient_consultations(t, 7),
        "doctor_consultations_of_doctor": lambda t, s: clinical.doctor_consultations(t, 3),
        "doctor_scheduled_appointments_of_doctor": lambda t, s: clinical.doctor_scheduled_appointments(t, 3),
        "doctor_patients_summary_of_doctor": lambda t, s: clinical.doctor_patients_summary(t, 3),
        "doctor_admitted_patients_of_doctor": lambda t, s: visits.doctor_admitted_patients(t, AS_OF, 0),
        "doctor_recent_visits_of_doctor": lambda t, s: visits.doctor_recent_visits(t, 4),
        "patient_admitted_visits_of_patient": lambda t, s: visits.patient_admitted_visits(t, 4),
        "admission_visits_of_admission": lambda t, s: visits.admission_visits(t, 4),
        "discharge_list_of_patient": lambda t, s: billing.discharge_list(t, patient_id=4),
        "doctor_discharged_patients_of_doctor": lambda t, s: billing.doctor_discharged_patients(t, 4, start_date="1997-01-01", end_date="2000-12-31"),
    }
)


def _in_order(name: str, rows: DataFrame) -> DataFrame:
    """The limited list of every doctor with its place in display order."""
    place = F.row_number().over(Window.partitionBy("doctor_id").orderBy(*sort_columns(name)))
    return rows.withColumn("place", place)


def _seeded_slots(t: Tables) -> DataFrame:
    """Appointments in each of the seeded slots, by the slot's own times."""
    booked = t.appointments.groupBy("slot_id").agg(F.count(F.lit(1)).alias("appointments"))
    slots = seeds.time_slots(t.appointments.sparkSession).select("slot_id", "start_min", "end_min")
    return slots.join(booked, "slot_id", "left").withColumn("appointments", F.coalesce("appointments", F.lit(0)))


def _nested(t: Tables) -> DataFrame:
    """Pages of at most two visits, their lists spelt out."""
    spelt = F.transform("visits", lambda v: F.concat(v["visit_id"].cast("string"), F.lit("@"), v["visit_time_only"]))
    return visits.patient_visits_nested(t, size=2).select(
        "patient_id", "visit_date_only", "page", "in_page", F.array_join(spelt, ", ").alias("visits")
    )


DATASETS["patient_visits_nested"] = lambda t, s: _nested(t)
DATASETS["beds_of_rooms"] = lambda t, s: expand_beds(t.rooms, t.room_types)
DATASETS["seeded_slots_in_use"] = lambda t, s: _seeded_slots(t)
DATASETS["busiest_doctors"] = lambda t, s: reports.busiest_doctors(t, *REPORT_RANGE)
DATASETS["doctor_recent_visits_in_order"] = lambda t, s: _in_order("doctor_recent_visits", visits.doctor_recent_visits(t))
DATASETS["doctor_discharged_patients_in_order"] = lambda t, s: _in_order(
    "doctor_discharged_patients",
    billing.doctor_discharged_patients(t, start_date="1997-01-01", end_date="2000-12-31"),
)


def _folder(t: Tables) -> tuple[SparkSession, str]:
    spark = t.patients.sparkSession
    return spark, f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"


def _stored_append(t: Tables, s: Sample) -> DataFrame:
    """Sign-ins appended in two parts and read back."""
    spark, root = _folder(t)
    late = F.col("user_type") == "patient"
    for part in (t.signin_logs.filter(~late), t.signin_logs.filter(late)):
        sinks.append(part, "signin_logs", f"{root}/signin_logs")
    return Tables.parquet(spark, root).signin_logs.select(*t.signin_logs.columns)


def _stored_update(t: Tables, s: Sample) -> DataFrame:
    """Discharges stored by month, patched in place and read back."""
    spark, root = _folder(t)
    declared = [F.col(f.name).cast(f.dataType) for f in TABLES["discharges"].schema]
    sinks.write_table(t.discharges.select(*declared), "discharges", f"{root}/discharges")
    stored = Tables.parquet(spark, root)
    kept = t.replacing(discharges=lambda: stored.discharges)
    store(patches.apply_patches(kept, "discharges", s.follow_up_patches(), AS_OF, keep=stage), root)
    as_before = [F.col(f.name).cast(f.dataType) for f in t.discharges.schema]
    return Tables.parquet(spark, root).discharges.select(*as_before)


def _stored_commit(t: Tables, s: Sample) -> DataFrame:
    """Admissions that change four tables in one commit, read back from the newest state."""
    spark, root = _folder(t)
    versioned, names = Store(spark, root), ("admissions", "beds", "rooms", "consultation_actions")
    versioned.commit({name: t[name] for name in names})
    before = versioned.tables()
    kept = t.replacing(**{name: before[name] for name in names})
    commit(admission.admit(kept, s.admit_requests(), AS_OF, keep=stage), versioned)
    now = versioned.tables()
    states = {"admissions": "is_active", "beds": "is_occupied", "rooms": "is_occupied", "consultation_actions": "status"}
    parts = [
        now[name].select(F.lit(name).alias("table_name"), F.col(TABLES[name].key).alias("id"), F.col(state).cast("string").alias("state"))
        for name, state in states.items()
    ]
    return reduce(DataFrame.unionAll, parts)


def _stored_json(t: Tables, s: Sample) -> DataFrame:
    """A dataset written as JSON lines and read back."""
    spark, root = _folder(t)
    rows = lists.doctor_directory(t)
    sinks.write_json(rows, root)
    return spark.read.schema(rows.schema).json(root)


def _kept_up(t: Tables, *names: str) -> Rollups:
    """Totals that have seen their tables grow, change and lose rows until these are those of ``t``.

    A third of the rows comes late, a seventh is wrong at first, and as many are removed again.
    """
    spark, root = _folder(t)
    versioned = Store(spark, root)
    rollups = Rollups(versioned)
    begun, late, changed, gone = {}, {}, {}, {}
    for table in sorted({ROLLUPS[name].table for name in names}):
        rows, name = t[table], TABLES[table].key
        key = F.col(name)
        wrong, extra = (key % 7 == 1) & (key % 3 != 0), F.col("__copy")
        # One pass: a row that is there at first, its copy that leaves again, both or neither.
        copies = F.array_compact(F.array(F.when(key % 3 != 0, F.lit(False)), F.when(key % 7 == 2, F.lit(True))))
        first = rows.select("*", F.explode(copies).alias("__copy"))
        if "doctor_id" in rows.columns:
            first = first.withColumn("doctor_id", F.when(~extra & wrong, F.lit(None)).otherwise(F.col("doctor_id")).cast("bigint"))
        begun[table] = first.withColumn(name, F.when(extra, -key - 1).otherwise(key)).drop("__copy")
        late[table], changed[table] = rows.filter(key % 3 == 0), Change(rows.filter(wrong))
        gone[table] = Change(rows.filter(key % 7 == 2).withColumn(name, -key - 1), gone=True)
    versioned.commit(begun)
    rollups.refresh(*names)
    versioned.commit(late, changed)
    versioned.commit(changes=gone)
    rollups.refresh(*names)
    return rollups


def _indexed(t: Tables) -> Rollups:
    """All tables that the patient report reads, with the index of patients per month."""
    spark, root = _folder(t)
    versioned = Store(spark, root)
    versioned.commit({name: t[name] for name in ("patients", "appointments", "admissions", "consultations", "discharges", "doctors")})
    rollups = Rollups(versioned)
    rollups.refresh("appointment_patients", "admission_patients")
    return rollups


STORED = {
    "range_summary_from_days": lambda t, s: rolled.range_summary(
        _kept_up(t, "new_patients", "appointments", "consultations", "admissions"), AS_OF
    ),
    "doctor_visits_summary_from_days": lambda t, s: rolled.doctor_visits_summary(_kept_up(t, "doctor_visits"), AS_OF),
    "doctor_discharge_stats_from_days": lambda t, s: rolled.doctor_discharge_stats(_kept_up(t, "doctor_discharges"), AS_OF, "year"),
    "patients_range_indexed": lambda t, s: rolled.patients_range(_indexed(t), *REPORT_RANGE).withColumn(
        "registration_date", F.col("registration_date").cast(t.patients.schema["created_at"].dataType)
    ),
    "doctor_patients_from_days": lambda t, s: rolled.doctor_patients(_kept_up(t, "doctor_patients"), *REPORT_RANGE),
    "stored_append": _stored_append, "stored_update": _stored_update, "stored_commit": _stored_commit, "stored_json": _stored_json,
}


def _state(result: JobResult, table: str) -> DataFrame:
    return result.updated[table].state


def _booking(t: Tables, s: Sample) -> JobResult:
    return booking.book_slots(t, s.booking_requests(), AS_OF)


def _visits(t: Tables, s: Sample) -> JobResult:
    return visit_jobs.record_visits(t, s.visit_requests(), AS_OF)


def _admit(t: Tables, s: Sample) -> JobResult:
    return admission.admit(t, s.admit_requests(), AS_OF)


def _total_bill(t: Tables, s: Sample) -> JobResult:
    return discharge.discharge_total_bill(t, s.discharge_requests(), AS_OF)


def _itemised(t: Tables, s: Sample) -> JobResult:
    return discharge.discharge_itemised(t, s.discharge_requests(), AS_OF)


def _final(t: Tables, s: Sample) -> JobResult:
    return discharge.discharge_final_amount(t, s.discharge_requests(), AS_OF)


def _removal(t: Tables, s: Sample) -> JobResult:
    return removal.remove_doctors(t, s.removal_requests(), AS_OF)


def _slots(t: Tables, s: Sample) -> JobResult:
    return removal.delete_rows(t, "time_slots", s.slot_deletions())


def _new_rows(table: str, rows: Callable[[Sample], DataFrame]) -> Callable[[Tables, Sample], DataFrame]:
    return lambda t, s: ingest.ingest(t, table, rows(s), AS_OF).appended[table]


JOBS: dict[str, Callable[[Tables, Sample], DataFrame]] = {
    "book_slots": lambda t, s: _booking(t, s).decisions,
    "book_slots_confirmations": lambda t, s: booking.booking_confirmations(t, _booking(t, s).appended["appointments"]),
    "advance_status": lambda t, s: booking.advance_status(t).decisions.drop("reason"),
    "record_visits": lambda t, s: _visits(t, s).decisions.select("request_id", "admission_id", "visit_id", "reason"),
    "record_visits_rows": lambda t, s: _visits(t, s).appended["admitted_patient_visits"],
    "record_visits_admissions": lambda t, s: _state(_visits(t, s), "admissions"),
    "admit": lambda t, s: _admit(t, s).decisions.select("request_id", "bed_id", "admission_id", "reason"),
    "admit_rows": lambda t, s: _admit(t, s).appended["admissions"],
    "admit_actions": lambda t, s: _state(_admit(t, s), "consultation_actions"),
    "admit_confirmations": lambda t, s: admission.admission_confirmations(t, _admit(t, s).appended["admissions"]),
    "admit_beds": lambda t, s: _state(_admit(t, s), "beds"),
    "admit_rooms": lambda t, s: _state(_admit(t, s), "rooms"),
    "discharge_total_bill": lambda t, s: _total_bill(t, s).decisions,
    "discharge_total_bill_rows": lambda t, s: _total_bill(t, s).appended["discharges"],
    "discharge_total_bill_admissions": lambda t, s: _state(_total_bill(t, s), "admissions"),
    "discharge_total_bill_beds": lambda t, s: _state(_total_bill(t, s), "beds"),
    "discharge_total_bill_rooms": lambda t, s: _state(_total_bill(t, s), "rooms"),
    "discharge_itemised": lambda t, s: _itemised(t, s).decisions,
    "discharge_itemised_rows": lambda t, s: _itemised(t, s).appended["discharges"],
    "discharge_itemised_admissions": lambda t, s: _state(_itemised(t, s), "admissions"),
    "discharge_final_amount_rows": lambda t, s: _final(t, s).appended["discharges"],
    "discharge_final_amount_beds": lambda t, s: _state(_final(t, s), "beds"),
    "discharge_final_amount_rooms": lambda t, s: _state(_final(t, s), "rooms"),
    "discharge_final_amount": lambda t, s: _final(t, s).decisions,
    "discharge_final_amount_admissions": lambda t, s: _state(_final(t, s), "admissions"),
    "room_occupancy": lambda t, s: occupancy.recompute_room_occupancy(t),
    "set_bed_flags_rooms": lambda t, s: _state(occupancy.set_bed_flags(t, s.bed_requests()), "rooms"),
    "set_bed_flags_one_way_rooms": lambda t, s: _state(
        occupancy.set_bed_flags(t, s.bed_requests(), release=False), "rooms"
    ),
    "set_room_flags_rooms": lambda t, s: _state(occupancy.set_room_flags(t, s.room_requests()), "rooms"),
    "patch_schedules": lambda t, s: _state(
        patches.apply_patches(t, "doctor_schedules", s.schedule_patches(), AS_OF), "doctor_schedules"
    ),
    "patch_schedules_decisions": lambda t, s: patches.apply_patches(
        t, "doctor_schedules", s.schedule_patches(), AS_OF
    ).decisions.drop("changes", "requested_at"),
    "patch_actions": lambda t, s: _state(
        patches.apply_patches(t, "consultation_actions", s.action_patches(), AS_OF), "consultation_actions"
    ),
    "patch_visits": lambda t, s: _state(
        patches.apply_patches(t, "admitted_patient_visits", s.visit_patches(), AS_OF), "admitted_patient_visits"
    ),
    "patch_follow_up": lambda t, s: _state(
        patches.apply_patches(t, "discharges", s.follow_up_patches(), AS_OF), "discharges"
    ),
    "remove_doctors": lambda t, s: _removal(t, s).decisions,
    "remove_doctors_appointments": lambda t, s: _state(_removal(t, s), "appointments"),
    "remove_doctors_medicines": lambda t, s: _state(_removal(t, s), "prescribed_medicines"),
    "remove_doctors_rows": lambda t, s: _removal(t, s).appended["removed_doctors"],
    "remove_doctors_doctors": lambda t, s: _state(_removal(t, s), "doctors"),
    "remove_doctors_schedules": lambda t, s: _state(_removal(t, s), "doctor_schedules"),
    "remove_doctors_forms": lambda t, s: _state(_removal(t, s), "appointment_forms"),
    "remove_doctors_cancellations": lambda t, s: _state(_removal(t, s), "appointment_cancellations"),
    "remove_doctors_consultations": lambda t, s: _state(_removal(t, s), "consultations"),
    "remove_doctors_actions": lambda t, s: _state(_removal(t, s), "consultation_actions"),
    "delete_schedules": lambda t, s: removal.delete_schedules(t, s.schedule_deletions()).decisions,
    "delete_schedules_state": lambda t, s: _state(
        removal.delete_schedules(t, s.schedule_deletions()), "doctor_schedules"
    ),
    "delete_time_slots": lambda t, s: _slots(t, s).decisions,
    "delete_time_slots_schedules": lambda t, s: _state(_slots(t, s), "doctor_schedules"),
    "delete_time_slots_appointments": lambda t, s: _state(_slots(t, s), "appointments"),
    "ingest_patients": lambda t, s: ingest.ingest(t, "patients", s.new_patients(), AS_OF).decisions,
    "ingest_patients_signups": lambda t, s: ingest.ingest(t, "patients", s.new_patients(), AS_OF).appended["signup_logs"],
    "ingest_doctors": lambda t, s: ingest.ingest(t, "doctors", s.new_doctors(), AS_OF).decisions,
    "ingest_doctors_rows": lambda t, s: ingest.ingest(t, "doctors", s.new_doctors(), AS_OF).appended["doctors"],
    "ingest_forms": lambda t, s: ingest.ingest(t, "appointment_forms", s.new_forms(), AS_OF).decisions,
    "ingest_consultations": lambda t, s: ingest.ingest(t, "consultations", s.new_consultations(), AS_OF).decisions,
    "ingest_schedules": lambda t, s: ingest.ingest(t, "doctor_schedules", s.new_schedules(), AS_OF).appended[
        "doctor_schedules"
    ],
    "ingest_medicines": lambda t, s: ingest.ingest(t, "prescribed_medicines", s.new_medicines(), AS_OF).decisions,
    "ingest_receptionists": lambda t, s: ingest.ingest(t, "receptionists", s.new_receptionists(), AS_OF).appended[
        "receptionists"
    ],
    "ingest_actions": lambda t, s: ingest.ingest(t, "consultation_actions", s.new_actions(), AS_OF).decisions,
    "ingest_signins": lambda t, s: ingest.ingest(t, "signin_logs", s.new_signins(), AS_OF).appended["signin_logs"],
    "ingest_patients_rows": _new_rows("patients", Sample.new_patients),
    "ingest_forms_rows": _new_rows("appointment_forms", Sample.new_forms),
    "ingest_consultations_rows": _new_rows("consultations", Sample.new_consultations),
    "ingest_medicines_rows": _new_rows("prescribed_medicines", Sample.new_medicines),
    "ingest_actions_rows": _new_rows("consultation_actions", Sample.new_actions),
    "quality_visits": lambda t, s: quality.summary(
        quality.violations(t.replacing(admitted_patient_visits=s.raw_visits), "admitted_patient_visits")
    ),
    "quality_all": lambda t, s: quality.summary(quality.audit(t)),
    "quality_core": lambda t, s: quality.violations(
        t, "appointments", "consultations", "admissions", "discharges", "doctors", "patients"
    ),
}


def as_query(build: Callable[[Tables, Sample], DataFrame]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        configure(spark)
        return build(hospital_tables(spark, folder), Sample(spark, folder))

    return run


JOBS.update(STORED)
QUERIES: dict[str, Query] = {name: as_query(build) for name, build in {**DATASETS, **JOBS}.items()}
