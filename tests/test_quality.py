"""Data-quality rules on rows that break them."""

from __future__ import annotations

import random

import pytest
from conftest import DIMENSIONS, at, dicts, on

from wardline import quality
from wardline.session import stage
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables


def found(df) -> set[tuple]:
    return {(r["table"], r["rule"], r["key"], r["detail"]) for r in df.collect()}


def test_clean_dimensions_have_no_violations(hospital):
    assert found(quality.violations(hospital(**DIMENSIONS))) == set()


def test_every_kind_of_rule(hospital):
    visit = {"patient_id": 1000, "doctor_id": 10, "admission_id": 1}
    t = hospital(
        **DIMENSIONS,
        appointments=[
            {"appointment_id": 1, "patient_id": 1000, "doctor_id": 10, "appointment_date": on("2024-03-02"),
             "status_id": 1, "created_at": at("2024-03-03 10:00:00")},
            {"appointment_id": 2, "patient_id": 1000, "doctor_id": 77, "appointment_date": on("2024-03-04"),
             "slot_id": 1, "status_id": 1, "created_at": at("2024-03-04 10:00:00")},
        ],
        admitted_patient_visits=[
            {"visit_id": 1, "temperature": 110.0, "oxygen_saturation": 0, "condition_status": "stable", **visit},
            {"visit_id": 2, "temperature": 110.01, "oxygen_saturation": 101, "condition_status": "Fair", **visit},
            {"visit_id": 0, **visit},
        ],
        admissions=[{"admission_id": 1, "patient_id": 1000, "doctor_id": 10, "consultation_id": 1, "action_id": 1,
                     "initial_room_id": 1, "bed_id": 1, "assigned_by_receptionist_id": 5,
                     "admission_date": at("2024-03-02"), "discharge_date": at("2024-03-01")}],
        beds=[{"bed_id": i, "bed_code": f"B{i}", "room_id": 1, "bed_number": 1} for i in (1, 2)],
        rooms=[{"room_id": 1, "room_number": "R" * 21, "room_type_id": 1}],
        room_types=[{"room_type_id": 1, "type_name": None, "per_day_charges": -1}],
    )
    got = found(quality.violations(t, "appointments", "admitted_patient_visits", "admissions", "beds", "rooms", "room_types"))
    assert got == {
        ("appointments", "slot_or_datetime:slot_id", "1", "null"),
        ("appointments", "not_past:appointment_date", "1", "2024-03-02"),
        ("appointments", "reference:doctor_id", "2", "77"),
        ("admitted_patient_visits", "range:temperature", "2", "110.01"),
        ("admitted_patient_visits", "range:oxygen_saturation", "2", "101"),
        ("admitted_patient_visits", "list:condition_status", "2", "Fair"),
        ("admitted_patient_visits", "positive_id:visit_id", "0", "0"),
        ("admissions", "discharge_after_admission:discharge_date", "1", "2024-03-01 00:00:00"),
        ("admissions", "reference:consultation_id", "1", "1"),
        ("admissions", "reference:action_id", "1", "1"),
        ("beds", "unique:room_id,bed_number", "1", "2 rows"),
        ("rooms", "length:room_number", "1", "R" * 21),
        ("room_types", "not_null:type_name", "1", "null"),
        ("room_types", "range:per_day_charges", "1", "-1.00"),
    }
    counts = {r["rule"]: r["violations"] for r in quality.summary(quality.violations(t, "beds")).collect()}
    assert counts == {"unique:room_id,bed_number": 1}


def test_id_fields_parse_as_positive_integers(spark):
    df = spark.createDataFrame([("12",), ("0",), ("-3",), ("x",), (None,)], "id string")
    assert [r[0] for r in df.select(quality.positive_id("id")).collect()] == [True, False, False, False, False]


def test_not_null_rules_follow_the_source_columns(spark, hospital):
    from wardline.sources.tables import Tables

    few = Tables({"doctors": spark.createDataFrame([(10, "Ann")], "doctor_id bigint, first_name string")})
    assert found(quality.violations(few, "doctors")) == set()
    assert dicts(few.doctors)[0]["last_name"] is None


def spoilt(size: int) -> dict[str, list[dict]]:
    """Rows that break many rules; a third of the appointments repeat one key and name one lost doctor."""
    rng = random.Random(size)
    return {
        **DIMENSIONS,
        "doctors": [*DIMENSIONS["doctors"], {**DIMENSIONS["doctors"][0], "doctor_id": -5, "age": 7, "registration_number": None},
                    {**DIMENSIONS["doctors"][0], "doctor_id": 31, "registration_number": None}],
        "appointments": [
            {"appointment_id": 1 if i % 3 == 0 else i, "patient_id": rng.choice([1000, 1001, 77]), "doctor_id": 404 if i % 3 == 0 else 10,
             "appointment_date": on("2024-01-01") if i % 7 else None, "status_id": rng.choice([1, 2, 9]), "slot_id": rng.choice([1, None, 55])}
            for i in range(1, size)
        ],
        "beds": [{"bed_id": i, "room_id": 1, "bed_number": i % 4, "bed_code": rng.choice(["x", "y", None, "z" * 40])} for i in range(1, 20)],
        "consultations": [{"consultation_id": i, "appointment_id": i % 5, "doctor_id": 10} for i in range(1, 12)],
    }


@pytest.mark.parametrize("few", [100_000, 0])
def test_audit_gives_the_violations(hospital, monkeypatch, few):
    monkeypatch.setattr(quality, "FEW", few)
    t = hospital(**spoilt(200))
    got = sorted(map(tuple, quality.audit(t).collect()))
    want = sorted(map(tuple, quality.violations(t).collect()))
    assert got == want
    assert {r[1].split(":")[0] for r in got} >= {"unique", "reference", "range", "not_null", "positive_id", "length", "slot_or_datetime"}
    some = sorted(map(tuple, quality.audit(t, "beds", "appointments").collect()))
    assert some == [r for r in want if r[0] in ("beds", "appointments")]


def test_audit_of_clean_and_empty_tables(hospital):
    assert quality.audit(hospital()).count() == 0
    assert quality.audit(hospital(**DIMENSIONS)).count() == quality.violations(hospital(**DIMENSIONS)).count()


def test_equal_hashes_are_no_repeated_key(hospital, monkeypatch):
    monkeypatch.setattr(quality.F, "xxhash64", lambda *columns: quality.F.lit(1).cast("bigint"))
    t = hospital(**spoilt(40))
    assert sorted(map(tuple, quality.audit(t).collect())) == sorted(map(tuple, quality.violations(t).collect()))


def test_audit_reads_each_table_at_most_twice(spark, hospital, tmp_path):
    t, plans = hospital(**spoilt(30)), []
    for name in t:
        t[name].write.parquet(f"{tmp_path}/{name}")
    stored = Tables({name: spark.read.parquet(f"{tmp_path}/{name}") for name in TABLES})

    def keep(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        frame = stage(df)
        return frame

    quality.audit(stored, keep=keep)
    reads = [line for plan in plans for line in plan.splitlines() if "Relation [" in line]
    assert len(plans) == 2 and len(reads) == 2 * len(TABLES)
    assert not any("Window" in plan or "collect_" in plan for plan in plans)


def test_second_read_looks_only_for_constraints_with_a_suspicious_key(hospital):
    """Doctor 99 is unknown, all other keys and references are clean."""
    rows = {**DIMENSIONS, "doctor_schedules": [
        {"schedule_id": i, "doctor_id": d, "day_of_week": 1, "slot_id": 1} for i, d in ((1, 10), (2, 20), (3, 99))
    ]}
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        return stage(df)

    t = hospital(**rows)
    got = {tuple(r) for r in quality.audit(t, "doctor_schedules", keep=keep).collect()}
    assert got == {tuple(r) for r in quality.violations(t, "doctor_schedules").collect()}
    assert ("doctor_schedules", "reference:doctor_id", "3", "99") in got
    assert "reference:doctor_id" in plans[1] and "unique:schedule_id" not in plans[1] and "reference:slot_id" not in plans[1]
