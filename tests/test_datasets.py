"""Edge rows of single datasets."""

from __future__ import annotations

import pytest
from conftest import DIMENSIONS, at, dicts, on
from pyspark.sql import functions as F

from wardline.plans import billing, clinical, lists, scheduling, visits, wards
from wardline.plans.catalog import DATASETS, dataset, register_views
from wardline.plans.order import ORDER, in_display_order
from wardline.sources import seeds
from wardline.sources.tables import Tables

AS_OF = "2024-03-03 09:00:00"
SCHEDULE = [
    {"schedule_id": 1, "doctor_id": 10, "day_of_week": 0, "slot_id": 1, "is_active": True},
    {"schedule_id": 2, "doctor_id": 10, "day_of_week": 0, "slot_id": 2, "is_active": True},
    {"schedule_id": 3, "doctor_id": 10, "day_of_week": 0, "slot_id": 3, "is_active": False},
    {"schedule_id": 4, "doctor_id": 10, "day_of_week": 1, "slot_id": 1, "is_active": True},
]


def booked(i, slot, day, status=1, patient=1000, doctor=10):
    return {"appointment_id": i, "patient_id": patient, "doctor_id": doctor, "appointment_date": on(day),
            "slot_id": slot, "status_id": status}


def test_available_schedule_window_and_status(hospital):
    t = hospital(
        **DIMENSIONS,
        doctor_schedules=SCHEDULE,
        appointments=[booked(1, 1, "2024-03-10"), booked(2, 2, "2024-03-10", status=3), booked(3, 2, "2024-03-03")],
    )
    rows = dicts(scheduling.available_schedule(t, "2024-03-10", AS_OF), "slot_id")
    assert [(r["slot_id"], r["is_available"], r["slot_status"]) for r in rows] == [(1, 0, "Booked"), (2, 1, "Available")]
    assert rows[0]["start_time"] == "06:00:00"
    with pytest.raises(ValueError):
        scheduling.available_schedule(t, "2024-03-11", AS_OF)
    with pytest.raises(ValueError):
        scheduling.available_schedule(t, "2024-03-02", AS_OF)
    counts = dicts(scheduling.available_schedule_summary(t, "2024-03-10", AS_OF), "doctor_id")
    assert [(r["available_count"], r["total_slots"]) for r in counts] == [(1, 2), (0, 0)]


def test_weekly_availability_has_each_weekday_once(hospital):
    t = hospital(**DIMENSIONS, doctor_schedules=SCHEDULE, appointments=[booked(1, 1, "2024-03-04")])
    days = dicts(scheduling.weekly_availability_days(t, AS_OF), "date")
    assert [(str(r["date"]), r["day_name"], r["available_slots"], r["total_slots"]) for r in days] == [
        ("2024-03-03", "Sunday", 2, 2), ("2024-03-04", "Monday", 0, 1),
    ]
    late = dicts(scheduling.weekly_availability_days(t, "2024-03-05"), "date")
    assert [str(r["date"]) for r in late] == ["2024-03-10", "2024-03-11"]
    nested = dicts(scheduling.weekly_availability_nested(t, AS_OF), "date")
    assert [s["start_time"] for s in nested[0]["slots"]] == ["06:00:00", "06:30:00"]


def test_slot_check_reasons(hospital, requests):
    t = hospital(**DIMENSIONS, doctor_schedules=SCHEDULE, appointments=[booked(1, 1, "2024-03-03")])
    asked = requests(
        "doctor_id bigint, slot_id bigint, appointment_date date",
        [(10, 1, on("2024-03-02")), (10, 1, on("2024-03-11")), (10, 4, on("2024-03-03")), (10, 3, on("2024-03-03")),
         (10, 1, on("2024-03-03")), (10, 2, on("2024-03-03")), (10, 1, on("2024-03-10"))],
    )
    got = [r["reason"] for r in dicts(scheduling.slot_check(t, asked, AS_OF), "request_id")]
    assert [g.split()[0] for g in got] == ["Cannot", "Appointments", "Slot", "Schedule", "Already", "Available", "Available"]


def test_latest_diagnosis_is_alphabetical_and_exact(hospital):
    rows = [
        {"consultation_id": i, "appointment_id": i, "doctor_id": 10, "patient_id": 1000, "diagnosis": d,
         "consultation_date": at(f"2024-01-0{i}")}
        for i, d in enumerate(("Z", "A", None), start=1)
    ]
    t = hospital(**DIMENSIONS, consultations=rows[:2])
    row = clinical.doctor_patients_summary(t).first()
    assert (row["latest_diagnosis"], row["latest_diagnosis_exact"], row["total_consultations"]) == ("Z", "A", 2)
    row = clinical.doctor_patients_summary(hospital(**DIMENSIONS, consultations=rows)).first()
    assert (row["latest_diagnosis"], row["latest_diagnosis_exact"]) == ("Z", None)
    assert clinical.doctor_patients_summary(t, gender="Female").count() == 0
    assert clinical.doctor_patients_summary(t, gender="Other").count() == 1


def test_patient_card_defaults(hospital):
    people = [{**DIMENSIONS["patients"][0], "age": 0, "gender": None}]
    t = hospital(**{**DIMENSIONS, "patients": people}, appointments=[booked(1, 1, "2024-03-03")])
    assert clinical.appointment_patient_card(t).first().asDict() == {
        "appointment_id": 1, "name": "F0 X", "age": "N/A", "gender": "Not specified",
        "symptoms": "No symptoms recorded", "allergies": "No medical history recorded",
    }


def test_upcoming_excludes_cancelled_and_past(hospital):
    t = hospital(**DIMENSIONS, appointments=[
        booked(1, 1, "2024-03-02"), booked(2, 1, "2024-03-03"), booked(3, 1, "2024-03-04", status=3),
        booked(4, None, "2024-03-05", doctor=99),
    ])
    rows = dicts(clinical.patient_upcoming_appointments(t, AS_OF), "appointment_id")
    assert [(r["appointment_id"], r["doctor_name"], r["start_time"]) for r in rows] == [
        (2, "Ann Lee", "06:00:00"), (4, " ", None),
    ]


def stay(i, patient=1000, bed=1, room=1, active=True, start="2024-03-01 20:00:00", end=None):
    return {"admission_id": i, "patient_id": patient, "doctor_id": 10, "consultation_id": i, "action_id": i,
            "initial_room_id": room, "bed_id": bed, "admission_date": at(start), "is_active": active,
            "discharge_date": at(end) if end else None, "assigned_by_receptionist_id": 5}


def visit(i, admission, when, ready=False, condition="Stable", recommended=None):
    return {"visit_id": i, "admission_id": admission, "patient_id": 1000, "doctor_id": 10, "visit_datetime": at(when),
            "ready_for_discharge": ready, "condition_status": condition, "temperature": 98.6,
            "discharge_recommended_date": at(recommended) if recommended else None}


ROOMS = {
    "room_types": [{"room_type_id": 1, "type_name": "GWARD-CARD-M", "per_day_charges": 1500}],
    "rooms": [{"room_id": i, "room_number": f"R{i}", "room_type_id": 1, "floor_number": 1, "is_occupied": i == 1}
              for i in (1, 2, 3, 4)],
    "beds": [{"bed_id": (r - 1) * 8 + b, "bed_code": f"R{r}-B{b}", "room_id": r, "bed_number": b,
              "is_occupied": b <= taken} for r, taken in ((1, 8), (2, 7), (3, 0)) for b in range(1, 9)],
}


def test_ready_for_discharge_keeps_ties_and_ignores_later_visits(hospital):
    t = hospital(
        **DIMENSIONS, **ROOMS,
        admissions=[stay(1), stay(2), stay(3), stay(4, active=False)],
        admitted_patient_visits=[
            visit(1, 1, "2024-03-02 08:00:00", ready=True), visit(2, 1, "2024-03-02 09:00:00", ready=True),
            visit(3, 1, "2024-03-02 09:00:00", ready=True), visit(4, 1, "2024-03-02 10:00:00"),
            visit(5, 2, "2024-03-02 09:00:00"), visit(6, 3, "2024-03-02 09:00:00", ready=True),
            visit(7, 4, "2024-03-02 09:00:00", ready=True),
        ],
        discharges=[{"discharge_id": 1, "admission_id": 3}],
    )
    rows = dicts(visits.ready_for_discharge(t, AS_OF), "visit_id")
    assert [(r["admission_id"], r["visit_id"], r["days_admitted"]) for r in rows] == [(1, 2, 2), (1, 3, 2)]


def test_last_condition_of_open_admissions(hospital):
    t = hospital(
        **DIMENSIONS, **ROOMS, admissions=[stay(1), stay(2, bed=99), stay(3, end="2024-03-02 08:00:00")],
        admitted_patient_visits=[visit(1, 1, "2024-03-02 08:00:00"), visit(2, 1, "2024-03-02 08:00:00", condition="Critical")],
    )
    rows = dicts(visits.doctor_admitted_patients(t, AS_OF), "admission_id")
    assert [(r["admission_id"], r["last_condition_status"], r["bed_code"]) for r in rows] == [
        (1, "Critical", "R1-B1"), (2, None, None),
    ]
    assert wards.active_admissions(t, AS_OF).count() == 2
    assert wards.active_admissions_any_bed(t, AS_OF).count() == 3


def test_room_occupancy_counts(hospital):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1, room=2)])
    rows = dicts(wards.rooms_occupancy(t), "room_id")
    assert [(r["total_beds"], r["occupied_beds"]) for r in rows] == [(8, 8), (8, 7), (8, 0), (0, 0)]
    assert [r["room_id"] for r in dicts(wards.rooms_available_by_bed(t), "room_id")] == [2, 3]
    assert [r["room_id"] for r in dicts(wards.rooms_available_by_admission(t), "room_id")] == [1, 3, 4]


def test_bed_filter_by_gender_and_specialization(spark, hospital):
    t = Tables(seeds.seed_tables(spark))

    def kinds(*args, **more):
        return sorted({r["type_name"] for r in wards.beds_available_filtered(t, *args, **more).collect()})

    male = kinds("Male")
    assert "PRIVATE ROOM" in male and "GWARD-CARD-M" in male and "GWARD-CARD-F" not in male
    assert kinds("Female", "Cardiology") == ["GWARD-CARD-F"]
    assert kinds(None, "Pediatrics") == []
    assert kinds(None, "Pediatrics", match="department") == ["GWARD-PED-F", "GWARD-PED-M"]
    assert len(kinds("Other")) == 11


def test_seeds(spark):
    frames = seeds.seed_tables(spark)
    assert {n: f.count() for n, f in frames.items()} == {
        "specializations": 5, "appointment_statuses": 3, "action_types": 4, "time_slots": 24, "room_types": 11,
        "rooms": 11, "beds": 81,
    }
    last = frames["time_slots"].orderBy(F.desc("slot_id")).first()
    assert (last["start_min"], last["end_min"]) == (17 * 60 + 30, 18 * 60)
    assert frames["beds"].select("bed_id").distinct().count() == 81
    types = {r["type_name"]: r["gender_category"] for r in wards.room_types(Tables(frames)).collect()}
    assert (types["GWARD-PED-F"], types["PRIVATE ROOM"]) == ("Female", "Mixed")
    departments = {r["room_number"]: r["department_name"] for r in wards.rooms_department(Tables(frames)).collect()}
    assert (departments["GW-DERMA-M-4-01"], departments["PR-6-01"]) == ("Dermatology", "General")


def bill(i, when, patient=1000, doctor=10, paid=0, status="Unpaid"):
    return {"discharge_id": i, "admission_id": i, "patient_id": patient, "doctor_id": doctor, "discharge_date": at(when),
            "total_days": 3, "total_amount": 1000, "amount_paid": paid, "payment_status": status,
            "processed_by_receptionist_id": 5, "follow_up_required": False}


def test_discharges_on_the_end_date(hospital):
    t = hospital(
        **DIMENSIONS, **ROOMS, admissions=[stay(1), stay(2)],
        discharges=[bill(1, "2024-03-05 00:00:00"), bill(2, "2024-03-05 10:00:00")],
    )
    rows = dicts(billing.doctor_discharged_patients(t, end_date="2024-03-05"))
    assert [r["discharge_id"] for r in rows] == [1]
    assert billing.doctor_discharged_patients(t, doctor_id=10, limit=1).first()["discharge_id"] == 2


def test_discharge_stats_periods_and_empty_doctor(hospital):
    t = hospital(**DIMENSIONS, discharges=[
        bill(1, "2024-02-29 08:00:00", paid=400, status="Partial"), bill(2, "2024-03-31 08:00:00"),
    ])
    now = "2024-03-31 08:00:00"
    month = billing.doctor_discharge_stats(t, now, "month").first()
    assert (month["total_discharges"], int(month["total_pending"]), month["partial_count"]) == (2, 1600, 1)
    assert billing.doctor_discharge_stats(t, now, "week").first()["total_discharges"] == 1
    none = billing.doctor_discharge_stats(t, now, "day", doctor_id=20).first()
    assert (none["doctor_id"], none["total_discharges"], none["total_revenue"], none["average_bill"]) == (20, 0, None, None)


def test_search_rules(hospital):
    t = hospital(**DIMENSIONS, discharges=[bill(1, "2024-03-01")])
    assert billing.discharge_search(t, " CARDIO ").count() == 1
    assert billing.discharge_search(t, "f_").count() == 1
    assert billing.discharge_search(t, "zz").count() == 0
    assert billing.discharge_search(t, "ann", doctor_id=20).count() == 0
    with pytest.raises(ValueError):
        billing.discharge_search(t, " a ")


def test_visit_summaries(hospital):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1)], admitted_patient_visits=[
        visit(1, 1, "2024-03-02 08:00:00", ready=True), visit(2, 1, "2024-03-02 14:07:00", condition="critical"),
        visit(3, 1, "2024-01-01 08:00:00"),
    ])
    row = visits.doctor_visits_summary(t, AS_OF).first()
    assert (row["total_visits"], row["critical_count"], row["avg_temperature"]) == (2, 1, 98.6)
    assert [r["visit_count"] for r in visits.doctor_visits_trend(t, AS_OF).collect()] == [2]
    whole = visits.patient_visits_summary(t).first()
    assert (whole["total_visits"], whole["unique_doctors_count"], whole["avg_pulse"]) == (3, 1, None)
    nobody = visits.patient_visits_summary(t, patient_id=1005).first()
    assert (nobody["total_visits"], nobody["first_visit_date"]) == (0, None)
    shown = dicts(visits.patient_admitted_visits(t), "visit_id")[1]
    assert (shown["formatted_visit_date"], shown["days_since_admission"]) == ("02 Mar 2024, 02:07 PM", 1)
    assert dicts(visits.patient_visits_by_date(t), "visit_date_only")[1]["visits"] == 2


def test_recent_lists_are_bounded_and_tied_by_id(hospital):
    logs = [{"log_id": i, "user_id": "1", "user_type": "admin", "signin_datetime": at("2024-03-01 08:05:00")} for i in range(30)]
    t = hospital(signin_logs=logs)
    assert lists.recent_signins(t).count() == 20
    assert lists.recent_signins(t, 1).first()["signin_time"] == "2024-03-01 08:05"


def test_display_order_names_real_columns(hospital):
    t = hospital(**DIMENSIONS)
    ordered = in_display_order("doctor_directory", lists.doctor_directory(t))
    assert [r["doctor_id"] for r in ordered.collect()] == [20, 10]
    assert in_display_order("bed_availability", wards.bed_availability(t)).count() == 1
    assert all(ORDER.values())


def test_catalog_and_views(spark, hospital):
    t = hospital(**DIMENSIONS, appointments=[booked(1, 1, "2024-03-03", status=2)],
                 consultations=[{"consultation_id": 1, "appointment_id": 1, "patient_id": 1000, "doctor_id": 10}])
    assert set(ORDER) <= set(DATASETS)
    assert dataset("doctor_fees", t, ordered=True).first()["doctor_id"] == 10
    register_views(t)
    row = spark.sql("select doctor_name, diagnosis, temperature from medical_report").first()
    assert tuple(row) == ("Dr. Ann Lee", "Diagnosis pending", "N/A")
    assert spark.sql("select count(*) n from doctors").first()["n"] == 2
    for name in DATASETS:
        spark.catalog.dropTempView(name)


def test_a_bed_with_many_occupants_repeats(hospital):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1), stay(2, patient=1001), stay(3, patient=9999), stay(4, bed=2, active=False)])
    rows = [r for r in dicts(wards.beds(t), "bed_id") if r["bed_id"] <= 2]
    assert sorted(((r["bed_id"], r["patient_first_name"]) for r in rows), key=str) == [
        (1, "F0"), (1, "F1"), (1, None), (2, None),
    ]
    assert wards.beds(t).count() == 24 + 2


def test_limits_count_rows_with_their_references(hospital):
    """The newest visits of an unknown patient do not use up the limit."""
    from wardline.plans.visits import doctor_recent_visits

    people = [{"patient_id": 1, "first_name": "A", "last_name": "B"}]
    stays = [{"admission_id": 5, "patient_id": 1, "doctor_id": 9}]
    seen = [
        {"visit_id": i, "admission_id": 5, "doctor_id": 9, "patient_id": 1 if i <= 5 else 99, "visit_datetime": at(f"2024-01-{i:02d}")}
        for i in range(1, 16)
    ]
    t = hospital(patients=people, admissions=stays, admitted_patient_visits=seen)
    assert sorted(r.visit_id for r in doctor_recent_visits(t, limit=3).collect()) == [3, 4, 5]
    assert doctor_recent_visits(t, 9, limit=None).count() == 5
