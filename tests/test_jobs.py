"""Visits, admission, discharge, occupancy, patches, removal and ingest."""

from __future__ import annotations

from decimal import Decimal

from conftest import DIMENSIONS, at, dicts, on
from test_datasets import ROOMS, stay

from wardline import fixed_values as V
from wardline.jobs import admission, discharge, ingest, occupancy, patches, removal, visits
from wardline.session import stage

AS_OF = "2024-03-03 09:00:00"
VISIT = (
    "admission_id bigint, patient_id bigint, doctor_id bigint, temperature string, oxygen_saturation string,"
    " pulse_rate string, condition_status string, ready_for_discharge boolean, discharge_recommended_date timestamp_ntz"
)


def test_visit_rules(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1), stay(2, active=False)])
    ok = (1, 1000, 10)
    rows = [
        (*ok, "99.99", "0", "0", "Stable", False, None), (*ok, "100.00", "100", "300", "", False, None),
        (*ok, "110.00", None, None, None, None, None), (*ok, "110.01", None, None, None, None, None),
        (*ok, "89.99", None, None, None, None, None), (*ok, "hot", None, None, None, None, None),
        (*ok, None, "101", None, None, None, None), (*ok, None, "97.8", "301", None, None, None),
        (*ok, None, None, None, "stable", None, None), (2, 1000, 10, None, None, None, None, None, None),
        (1, 1001, 10, None, None, None, None, None, None), (None, 1000, 10, None, None, None, None, None, None),
    ]
    result = visits.record_visits(t, requests(VISIT, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        None, None, None, V.VISIT_TEMPERATURE, V.VISIT_TEMPERATURE, V.VISIT_TEMPERATURE, V.VISIT_OXYGEN, V.VISIT_PULSE,
        V.VISIT_CONDITION, V.VISIT_NO_ADMISSION, V.VISIT_NO_ADMISSION, V.FIELDS_REQUIRED,
    ]
    stored = dicts(result.appended["admitted_patient_visits"], "visit_id")
    assert [(r["temperature"], r["oxygen_saturation"], r["pulse_rate"], r["condition_status"]) for r in stored] == [
        (Decimal("99.99"), None, None, "Stable"), (Decimal("100.00"), 100, 300, None), (Decimal("110.00"), None, None, None),
    ]
    assert {r["visit_datetime"] for r in stored} == {at(AS_OF)}


def test_ready_visit_dates_the_discharge(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1), stay(2), stay(3)])
    none = (None, None, None, None)
    rows = [
        (1, 1000, 10, *none, True, at("2024-03-05")), (1, 1000, 10, *none, True, None),
        (1, 1000, 10, *none, True, at("2024-01-01")), (2, 1000, 10, *none, True, at("2024-03-07")),
        (3, 1000, 10, *none, False, at("2024-03-07")),
    ]
    state = visits.record_visits(t, requests(VISIT, rows), AS_OF).updated["admissions"].state
    assert [r["discharge_date"] for r in dicts(state, "admission_id")] == [at(AS_OF), at("2024-03-07"), None]


ADMIT = (
    "patient_id bigint, doctor_id bigint, consultation_id bigint, action_id bigint, initial_room_id bigint,"
    " bed_id bigint, assigned_by_receptionist_id bigint"
)


def admit_tables(hospital):
    return hospital(
        **DIMENSIONS, **ROOMS,
        consultations=[{"consultation_id": i, "appointment_id": i} for i in (1, 2, 3)],
        consultation_actions=[{"action_id": i, "consultation_id": i, "action_type_id": 1, "status": "Pending"} for i in (1, 2, 3)],
    )


def test_first_valid_request_gets_the_bed(hospital, requests):
    t = admit_tables(hospital)
    rows = [
        (9999, 10, 1, 1, 2, 16, 5), (1000, 10, 1, 1, 2, 16, 5), (1001, 10, 2, 2, 2, 16, 5), (1001, 10, 2, 2, 1, 1, 5),
        (1001, 10, 2, 2, 1, 777, 5), (1002, 10, 3, 3, 3, 17, 5), (1002, 10, 3, 3, 3, None, 5), (9999, 10, 1, 1, 2, 16, 5),
    ]
    result = admission.admit(t, requests(ADMIT, rows), AS_OF, keep=stage)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.INVALID_REFERENCE, None, V.BED_OCCUPIED, V.BED_OCCUPIED, V.BED_NOT_FOUND, None, V.FIELDS_REQUIRED,
        V.BED_OCCUPIED,
    ]
    new = dicts(result.appended["admissions"], "admission_id")
    assert [(r["patient_id"], r["bed_id"], r["is_active"], r["admission_date"]) for r in new] == [
        (1000, 16, True, at(AS_OF)), (1002, 17, True, at(AS_OF)),
    ]
    assert [r["is_occupied"] for r in dicts(result.updated["rooms"].state, "room_id")] == [True, True, False, False]
    assert [r["bed_id"] for r in dicts(result.updated["beds"].changed, "bed_id")] == [16, 17]
    actions = dicts(result.updated["consultation_actions"].state, "action_id")
    assert [(a["status"], a["completed_at"]) for a in actions] == [
        ("Completed", at(AS_OF)), ("Pending", None), ("Completed", at(AS_OF)),
    ]
    after = t.replacing(beds=result.updated["beds"].state, admissions=result.appended["admissions"])
    shown = dicts(admission.admission_confirmations(after, result.appended["admissions"]), "admission_id")
    assert [r["bed_code"] for r in shown] == ["R2-B8", "R3-B1"]


TOTAL = (
    "admission_id bigint, bed_id bigint, total_bill decimal(12,2), discharge_date timestamp_ntz,"
    " discharged_by_receptionist_id bigint"
)


def test_total_bill_splits_and_frees(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[
        stay(1, bed=9, room=2, start="2024-03-01 09:00:00"), stay(2, bed=10, room=2, start=AS_OF),
        stay(3, bed=1, room=1, active=False), stay(4, bed=1, room=1),
    ])
    d = Decimal
    rows = [
        (1, 9, d(2999), None, 5), (1, 9, d(5000), None, 77), (1, 9, d(5000), None, 5), (1, 9, d(9000), None, 5),
        (2, 10, d(1500), None, 5), (3, 1, d(5000), None, 5), (4, 1, d(0), None, 5),
        (4, 1, d(9000), at("2024-03-04 20:00:01"), 5),
    ]
    result = discharge.discharge_total_bill(t, requests(TOTAL, rows), AS_OF)
    got = dicts(result.decisions, "request_id")
    assert [r["reason"] for r in got] == [
        V.BILL_TOO_SMALL, V.INVALID_REFERENCE, None, V.ADMISSION_NOT_ACTIVE, None, V.ADMISSION_NOT_ACTIVE,
        V.FIELDS_REQUIRED, None,
    ]
    new = dicts(result.appended["discharges"], "admission_id")
    assert [(r["total_days"], int(r["room_charges"]), int(r["medical_charges"]), r["payment_status"]) for r in new] == [
        (2, 3000, 2000, "Paid"), (1, 1500, 0, "Paid"), (4, 6000, 3000, "Paid"),
    ]
    assert all(r["room_charges"] + r["medical_charges"] == r["total_amount"] == r["amount_paid"] for r in new)
    assert [r["is_active"] for r in dicts(result.updated["admissions"].state, "admission_id")] == [False] * 4
    assert {r["bed_id"] for r in result.updated["beds"].changed.collect()} == {1, 9, 10}
    assert [r["is_occupied"] for r in dicts(result.updated["rooms"].state, "room_id")] == [True, True, False, False]


def test_one_unstorable_amount_does_not_fail_the_batch(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1), stay(2, bed=2)])
    schema = TOTAL.replace("total_bill decimal(12,2)", "total_bill decimal(20,2)")
    rows = [(1, 1, Decimal(10) ** 8, None, 5), (2, 2, Decimal(10) ** 15, None, 5), (2, 2, Decimal("99999999.99"), None, 5)]
    result = discharge.discharge_total_bill(t, requests(schema, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [V.INVALID_VALUE, V.INVALID_VALUE, None]
    assert str(result.appended["discharges"].first()["total_amount"]) == "99999999.99"


def test_daily_charge_defaults_when_zero(hospital, requests):
    kinds = [{**ROOMS["room_types"][0], "per_day_charges": 0}]
    t = hospital(**{**DIMENSIONS, **ROOMS, "room_types": kinds}, admissions=[stay(1)])
    row = discharge.discharge_total_bill(t, requests(TOTAL, [(1, 1, Decimal(5000), None, 5)]), AS_OF).decisions.first()
    assert (row["total_days"], int(row["room_charges"]), int(row["medical_charges"])) == (2, 2000, 3000)


def test_itemised_bill_keeps_the_bed(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1, start=AS_OF), stay(2, active=False), stay(3)],
                 discharges=[{"discharge_id": 4, "admission_id": 3}])
    schema = (
        "admission_id bigint, patient_id bigint, doctor_id bigint, processed_by_receptionist_id bigint,"
        " room_charges decimal(12,2), lab_charges decimal(12,2)"
    )
    d = Decimal
    rows = [(1, 1000, 10, 5, d(-1), None), (1, 1000, 10, 5, d(10), None), (1, 1000, 10, 5, d(20), d(1)),
            (2, 1000, 10, 5, None, None), (3, 1000, 10, 5, None, None), (9, 1000, 10, 5, None, None),
            (1, 1000, None, 5, None, None)]
    result = discharge.discharge_itemised(t, requests(schema, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.INVALID_VALUE, None, V.ADMISSION_CLOSED, V.ADMISSION_CLOSED, V.DUPLICATE_KEY, V.ADMISSION_NOT_FOUND,
        V.FIELDS_REQUIRED,
    ]
    row = result.appended["discharges"].first()
    assert (row["total_days"], int(row["total_amount"]), row["payment_status"], row["discharge_id"]) == (0, 10, "Unpaid", 6)
    assert set(result.updated) == {"admissions"}


def test_final_amount_frees_bed_and_room(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS, admissions=[stay(1)])
    schema = "admission_id bigint, final_bill_amount decimal(12,2), discharged_by_receptionist_id bigint"
    rows = [(1, Decimal(0), 5), (1, Decimal(70), 5), (1, Decimal(80), 5)]
    result = discharge.discharge_final_amount(t, requests(schema, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.FIELDS_REQUIRED, None, V.ADMISSION_NOT_ACTIVE,
    ]
    row = result.appended["discharges"].first()
    assert (int(row["room_charges"]), int(row["medical_charges"]), int(row["total_amount"])) == (0, 70, 70)
    assert [r["is_occupied"] for r in dicts(result.updated["rooms"].state, "room_id")] == [False] * 4


def test_occupancy(hospital, requests):
    t = hospital(**DIMENSIONS, **ROOMS)
    rows = dicts(occupancy.recompute_room_occupancy(t), "room_id")
    assert [(r["room_full"], r["room_in_use"]) for r in rows] == [(True, True), (False, True), (False, False), (False, False)]
    asked = requests("bed_id bigint, is_occupied boolean", [(1, False), (16, False), (16, True), (99, True)])
    both = occupancy.set_bed_flags(t, asked)
    assert [r["is_occupied"] for r in dicts(both.updated["rooms"].state, "room_id")] == [False, True, False, False]
    assert both.rejected.first()["reason"] == V.BED_NOT_FOUND
    fill = occupancy.set_bed_flags(t, asked, release=False)
    assert [r["is_occupied"] for r in dicts(fill.updated["rooms"].state, "room_id")] == [True, True, False, False]
    turns = requests("bed_id bigint, is_occupied boolean", [(16, True), (16, False), (1, False), (16, False)])
    kept = occupancy.set_bed_flags(t, turns, release=False)  # room 2 was full after the first request
    assert [r["is_occupied"] for r in dicts(kept.updated["rooms"].state, "room_id")] == [True, True, False, False]
    freed = occupancy.set_bed_flags(t, turns)
    assert [r["is_occupied"] for r in dicts(freed.updated["rooms"].state, "room_id")] == [False] * 4
    flags = occupancy.set_room_flags(t, requests("room_id bigint, is_occupied boolean", [(3, True), (1, None), (9, True)]))
    assert [r["is_occupied"] for r in dicts(flags.updated["rooms"].state, "room_id")] == [False, False, True, False]


def test_patches_tell_absent_from_null(hospital, requests):
    actions = [{"action_id": i, "consultation_id": 1, "action_type_id": 1, "status": "Pending", "notes": "n"} for i in (1, 2, 3)]
    t = hospital(**DIMENSIONS, consultation_actions=actions)
    rows = [
        (1, {"notes": None}), (2, {"status": "Completed"}), (2, {"status": "Cancelled", "notes": "x"}), (3, {}),
        (3, {"other": "x"}), (9, {"notes": "x"}), (3, {"status": "Lost", "notes": "y"}),
    ]
    asked = requests("action_id bigint, changes map<string,string>", rows)
    result = patches.apply_patches(t, "consultation_actions", asked, AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        None, None, None, V.NOTHING_TO_UPDATE, V.NOTHING_TO_UPDATE, V.NOT_FOUND, V.INVALID_VALUE,
    ]
    got = dicts(result.updated["consultation_actions"].state, "action_id")
    assert [(r["status"], r["notes"], r["completed_at"]) for r in got] == [
        ("Pending", None, None), ("Cancelled", "x", at(AS_OF)), ("Pending", "n", None),
    ]


def test_patch_types_and_flags(hospital, requests):
    t = hospital(
        **DIMENSIONS,
        discharges=[{"discharge_id": 1, "admission_id": 1, "follow_up_required": True, "follow_up_date": on("2024-03-09")}],
        doctor_schedules=[{"schedule_id": 1, "doctor_id": 10, "day_of_week": 1, "slot_id": 1, "is_active": True}],
    )
    asked = requests("discharge_id bigint, changes map<string,string>",
                     [(1, {"follow_up_required": None, "follow_up_notes": "rest"}), (1, {"follow_up_date": "soon"})])
    row = patches.apply_patches(t, "discharges", asked, AS_OF).updated["discharges"].state.first()
    assert (row["follow_up_required"], row["follow_up_date"], row["discharge_instructions"]) == (False, on("2024-03-09"), "rest")
    asked = requests("schedule_id bigint, changes map<string,string>",
                     [(1, {"day_of_week": "7"}), (1, {"slot_id": "99"}), (1, {"day_of_week": None}), (1, {"is_active": "false"})])
    result = patches.apply_patches(t, "doctor_schedules", asked, AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.INVALID_VALUE, V.INVALID_REFERENCE, V.INVALID_VALUE, None,
    ]
    row = result.updated["doctor_schedules"].state.first()
    assert (row["day_of_week"], row["is_active"], row["updated_at"]) == (1, False, at(AS_OF))


def test_a_row_of_another_removed_doctor_still_blocks(hospital, requests):
    appointment = {"appointment_id": 1, "patient_id": 1000, "doctor_id": 20, "appointment_date": on("2024-03-04"),
                   "slot_id": 1, "status_id": 1}
    t = hospital(
        **DIMENSIONS,
        appointments=[appointment],
        consultations=[{"consultation_id": 1, "appointment_id": 1, "doctor_id": 10}],
    )
    asked = requests("doctor_id bigint, removal_reason string, removed_by_admin_id bigint", [(20, "left", 1), (10, "left", 1)])
    result = removal.remove_doctors(t, asked, AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [None, V.STILL_REFERENCED]
    after = t.replacing(**{name: lambda new=new: new.state for name, new in result.updated.items()})
    again = removal.remove_doctors(after, asked, AS_OF)
    assert [r["reason"] for r in dicts(again.decisions, "request_id")] == [V.BOOK_NO_DOCTOR, None]


def test_removal_cascades_and_blocks(hospital, requests):
    def appointment(i, doctor):
        return {"appointment_id": i, "patient_id": 1000, "doctor_id": doctor, "appointment_date": on("2024-03-04"),
                "slot_id": 1, "status_id": 1}

    t = hospital(
        **DIMENSIONS,
        appointments=[appointment(1, 10), appointment(2, 20)],
        consultations=[{"consultation_id": i, "appointment_id": i, "doctor_id": i * 10} for i in (1, 2)],
        prescribed_medicines=[{"medicine_id": i, "consultation_id": i} for i in (1, 2)],
        doctor_schedules=[{"schedule_id": i, "doctor_id": i * 10, "slot_id": 1} for i in (1, 2)],
        admissions=[{"admission_id": 1, "doctor_id": 20, "consultation_id": 2}],
    )
    rows = [(10, "", 1), (10, "left", 3), (10, "left", 1), (10, "left", 1), (20, "left", 1), (77, "left", 1)]
    asked = requests("doctor_id bigint, removal_reason string, removed_by_admin_id bigint", rows)
    result = removal.remove_doctors(t, asked, AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.FIELDS_REQUIRED, V.INVALID_REFERENCE, None, V.BOOK_NO_DOCTOR, V.STILL_REFERENCED, V.BOOK_NO_DOCTOR,
    ]
    archived = result.appended["removed_doctors"].first()
    assert (archived["doctor_name"], archived["registration_number"], archived["removal_date"]) == ("Ann Lee", "R1", at(AS_OF))
    left = {n: [r[0] for r in u.state.collect()] for n, u in result.updated.items()}
    assert (left["doctors"], left["appointments"], left["consultations"], left["prescribed_medicines"]) == ([20], [2], [2], [2])
    assert [r["schedule_id"] for r in result.updated["doctor_schedules"].changed.collect()] == [1]
    gone = removal.delete_schedules(t, requests("schedule_id bigint", [(2,), (2,), (9,)]))
    assert [r["reason"] for r in dicts(gone.decisions, "request_id")] == [None, V.NOT_FOUND, V.NOT_FOUND]


def test_ingest_people(hospital, requests):
    t = hospital(**DIMENSIONS)
    schema = "first_name string, last_name string, age int, gender string, phone_no string"
    rows = [("A", "B", 30, "female", ""), ("", "B", 30, "Male", None), ("A", "B", 0, "Male", None),
            ("A", "B", 151, "Male", None), ("A" * 51, "B", 30, "Male", None), ("C", "D", 5, "Other", "1")]
    result = ingest.ingest(t, "patients", requests(schema, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        None, V.FIELDS_REQUIRED, V.FIELDS_REQUIRED, V.INVALID_VALUE, V.INVALID_VALUE, None,
    ]
    new = dicts(result.appended["patients"], "patient_id")
    assert [(r["patient_id"], r["patient_login_id"], r["phone_no"], r["created_at"]) for r in new] == [
        (1006, "P1006", None, at(AS_OF)), (1011, "P1011", "1", at(AS_OF)),
    ]
    log = dicts(result.appended["signup_logs"], "signup_log_id")
    assert [(r["signup_log_id"], r["patient_id"]) for r in log] == [(1, 1006), (6, 1011)]


def test_ingest_doctors_numbers_and_unique_null(hospital, requests):
    t = hospital(**DIMENSIONS)
    schema = (
        "first_name string, last_name string, age int, specialization_id bigint, experience_years int,"
        " registration_number string, consultation_fee decimal(10,2)"
    )
    rows = [("A", "B", 30, 1, 3, "R1", None), ("A", "B", 30, 1, 3, "R9", Decimal(7)), ("A", "B", 30, 1, 3, "R9", None),
            ("A", "B", 30, 9, 3, "R8", None), ("A", "B", 30, 1, 3, None, None), ("A", "B", 30, 1, 3, "", None)]
    result = ingest.ingest(t, "doctors", requests(schema, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.DUPLICATE_KEY, None, V.DUPLICATE_KEY, V.INVALID_REFERENCE, None, V.DUPLICATE_KEY,
    ]
    new = dicts(result.appended["doctors"], "doctor_id")
    assert [(r["doctor_id"], r["doctor_login_id"], r["room_no"], int(r["consultation_fee"])) for r in new] == [
        (40, "D40", 4, 7), (70, "D70", 7, 0),
    ]


def test_ingest_clinical_rows(hospital, requests):
    t = hospital(
        **DIMENSIONS,
        appointments=[{"appointment_id": i, "patient_id": 1000, "doctor_id": 10} for i in (1, 2, 3)],
        appointment_forms=[{"form_id": 1, "appointment_id": 1}],
        consultations=[{"consultation_id": 1, "appointment_id": 1}],
    )
    forms = requests("appointment_id bigint, patient_id bigint, symptoms string",
                     [(1, 1000, "x"), (2, 1001, "x"), (2, 1000, "x"), (2, 1000, "y"), (3, 1000, "")])
    assert [r["reason"] for r in dicts(ingest.ingest(t, "appointment_forms", forms, AS_OF).decisions, "request_id")] == [
        V.FORM_EXISTS, V.FORM_NOT_OWNED, None, V.FORM_EXISTS, V.FIELDS_REQUIRED,
    ]
    seen = requests("appointment_id bigint, doctor_id bigint, patient_id bigint, temperature double, diagnosis string",
                    [(2, 10, 1000, 0.0, ""), (1, 10, 1000, 99.5, "flu"), (9, 10, 1000, None, None)])
    result = ingest.ingest(t, "consultations", seen, AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [None, V.DUPLICATE_KEY, V.INVALID_REFERENCE]
    row = result.appended["consultations"].first()
    assert (row["temperature"], row["diagnosis"], row["consultation_date"]) == (None, None, at(AS_OF))
    schedules = requests("doctor_id bigint, day_of_week int, slot_id bigint", [(10, 0, 1), (10, 0, 1), (10, 7, 1), (10, None, 1)])
    result = ingest.ingest(t, "doctor_schedules", schedules, AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        None, V.DUPLICATE_KEY, V.INVALID_VALUE, V.FIELDS_REQUIRED,
    ]
    assert result.appended["doctor_schedules"].first()["is_active"] is True
    actions = requests("consultation_id bigint, action_type_id bigint", [(1, 1), (1, 9)])
    result = ingest.ingest(t, "consultation_actions", actions, AS_OF)
    assert result.appended["consultation_actions"].first()["status"] == "Pending"
    texts = requests("consultation_id string, action_type_id string", [("1", "1"), ("one", "1"), ("1", "")])
    decided = ingest.ingest(t, "consultation_actions", texts, AS_OF).decisions
    assert [r["reason"] for r in dicts(decided, "request_id")] == [None, V.INVALID_VALUE, V.INVALID_VALUE]
    logs = requests("user_id string, user_type string", [("1000", "patient")])
    assert ingest.ingest(t, "signin_logs", logs, AS_OF).appended["signin_logs"].first()["signin_datetime"] == at(AS_OF)


def test_keys_of_a_table_are_not_broadcast(hospital, requests):
    """Their estimate may be far too low, as that of the schedules, which are unfolded from few rows."""
    stored = {
        "consultation_actions": [{"action_id": 1, "consultation_id": 1, "action_type_id": 1, "status": "Open"}],
        "doctor_schedules": [{"schedule_id": 1, "doctor_id": 10, "day_of_week": 2, "slot_id": 1, "is_active": True}],
    }
    t = hospital(**{**DIMENSIONS, **stored})
    asked = requests("action_id bigint, changes map<string,string>", [(1, {"status": "Open"})])
    patched = patches.apply_patches(t, "consultation_actions", asked, "2024-02-01").decisions
    new = requests("doctor_id bigint, day_of_week int, slot_id int, is_active boolean", [(10, 1, 1, True)])
    added = ingest.ingest(t, "doctor_schedules", new, "2024-02-01").decisions
    for frame, key in ((patched, "action_id"), (added, "coalesce(doctor_id")):
        plan = frame._jdf.queryExecution().sparkPlan().toString()
        assert f"SortMergeJoin [{key}" in plan and f"BroadcastHashJoin [{key}" not in plan
