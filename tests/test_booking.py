"""Booking against a plain sequential loop, and under a hot slot."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import DIMENSIONS, at, dicts, on
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.jobs import booking
from wardline.operators.matching import match_first_come
from wardline.session import stage

AS_OF = "2024-03-03 09:00:00"
EVERY_SLOT = [
    {"schedule_id": 100 * doctor + 10 * day + slot, "doctor_id": doctor, "day_of_week": day, "slot_id": slot,
     "is_active": (doctor + day + slot) % 5 != 0}
    for doctor in (10, 20) for day in range(7) for slot in range(1, 5)
]


def sequential(rows: list[tuple], held: list[dict], schedule: list[dict], people: set[int]) -> list[str | None]:
    """The rules request by request."""
    first = dt.date(2024, 3, 3)
    last = first + dt.timedelta(days=7)
    open_rows = [(h["patient_id"], h["doctor_id"], h["appointment_date"], h["slot_id"]) for h in held if h["status_id"] != 3]
    active = {(s["doctor_id"], s["day_of_week"], s["slot_id"]) for s in schedule if s["is_active"]}
    reasons: list[str | None] = []
    for patient, doctor, day, slot in rows:
        if not patient or not doctor or day is None or not slot:
            reasons.append(V.BOOK_REQUIRED)
        elif day < first:
            reasons.append(V.SLOT_PAST)
        elif day > last:
            reasons.append(V.SLOT_TOO_FAR)
        elif patient not in people:
            reasons.append(V.BOOK_NO_PATIENT)
        elif doctor not in (10, 20):
            reasons.append(V.BOOK_NO_DOCTOR)
        elif any((p, d, a) == (patient, doctor, day) for p, d, a, _ in open_rows):
            reasons.append(V.BOOK_DUPLICATE)
        elif (doctor, day.isoweekday() % 7, slot) not in active:
            reasons.append(V.BOOK_NOT_SCHEDULED)
        elif any((d, a, s) == (doctor, day, slot) for _, d, a, s in open_rows):
            reasons.append(V.BOOK_TAKEN)
        else:
            open_rows.append((patient, doctor, day, slot))
            reasons.append(None)
    return reasons


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_sequential_rules(hospital, requests, seed):
    rng = random.Random(seed)
    people = [p["patient_id"] for p in DIMENSIONS["patients"]]

    def day(spread: int) -> dt.date:
        return dt.date(2024, 3, 3) + dt.timedelta(days=rng.randrange(-1, spread))

    held = [
        {"appointment_id": i, "patient_id": rng.choice(people), "doctor_id": rng.choice([10, 20]),
         "appointment_date": day(9), "slot_id": rng.choice([1, 2, 3, 4, None]), "status_id": rng.choice([1, 2, 3])}
        for i in range(1, 8)
    ]
    rows = [
        (rng.choice([*people, 7, None, 0]), rng.choice([10, 10, 20, 30]), rng.choice([day(3), day(10), None]),
         rng.choice([1, 2, 3, 4, 4, 9, None]))
        for _ in range(150)
    ]
    t = hospital(**DIMENSIONS, doctor_schedules=EVERY_SLOT, appointments=held)
    asked = requests("patient_id bigint, doctor_id bigint, appointment_date date, slot_id bigint", rows)
    result = booking.book_slots(t, asked, AS_OF)
    got = dicts(result.decisions, "request_id")
    assert [r["reason"] for r in got] == sequential(rows, held, EVERY_SLOT, set(people))
    new = dicts(result.appended["appointments"], "appointment_id")
    assert len({(r["doctor_id"], r["appointment_date"], r["slot_id"]) for r in new}) == len(new)
    assert len({(r["doctor_id"], r["appointment_date"], r["patient_id"]) for r in new}) == len(new)
    assert [r["appointment_id"] for r in new] == [7 + r["request_id"] for r in got if r["reason"] is None]
    assert result.accepted.count() + result.rejected.count() == len(rows)


def test_two_requests_for_one_slot_and_a_rejected_first_try(hospital, requests):
    day = on("2024-03-04")
    t = hospital(**DIMENSIONS, doctor_schedules=EVERY_SLOT)
    rows = [(1000, 10, day, 1), (1001, 10, day, 1), (1001, 10, day, 2), (1000, 10, day, 2), (1002, 10, day, 2)]
    asked = requests("patient_id bigint, doctor_id bigint, appointment_date date, slot_id bigint", rows)
    result = booking.book_slots(t, asked, AS_OF, keep=stage)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        None, V.BOOK_TAKEN, None, V.BOOK_DUPLICATE, V.BOOK_TAKEN,
    ]
    shown = dicts(booking.booking_confirmations(t, result.appended["appointments"]), "slot_id")
    assert [(r["patient_name"], r["start_time"], r["status_name"]) for r in shown] == [
        ("F0 X", "06:00:00", "Scheduled"), ("F1 X", "06:30:00", "Scheduled"),
    ]


def first_come(rows: list[tuple]) -> set[tuple]:
    """The rule request by request; rows are (turn, doctor, slot, patient)."""
    taken: set[tuple] = set()
    out = set()
    for turn, doctor, slot, patient in sorted(rows):
        if not taken & {(doctor, "slot", slot), (doctor, "patient", patient)}:
            taken |= {(doctor, "slot", slot), (doctor, "patient", patient)}
            out.add((turn, doctor, slot, patient))
    return out


def asked_for(spark, rows: list[tuple]):
    frame = spark.createDataFrame(rows, "request_id bigint, doctor_id bigint, slot_id bigint, patient_id bigint")
    return frame.selectExpr("*", "timestamp_ntz'2024-03-01 08:00:00' requested_at", "date'2024-03-04' appointment_date")


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_rule(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), rng.randrange(9), rng.randrange(12)) for i in range(300)]
    matched = match_first_come(asked_for(spark, rows)).collect()
    assert {(r["turn"]["request_id"], r["doctor_id"], r["slot_id"], r["patient_id"]) for r in matched} == first_come(rows)


def test_a_chain_takes_a_round_for_each_slot(spark):
    """Every request waits for the one before: patient n asks for slot n after n - 1 asked for it too."""
    rows = [(2 * n + k, 1, n + k, n) for n in range(7) for k in (0, 1)]
    staged = []

    def keep(df):
        staged.append(stage(df))
        return staged[-1]

    matched = match_first_come(asked_for(spark, rows), keep=keep).collect()
    assert {(r["turn"]["request_id"], 1, r["slot_id"], r["patient_id"]) for r in matched} == first_come(rows)
    slots = len({slot for _, _, slot, _ in rows})
    assert 5 <= (len(staged) - 1) / 2 <= slots


def test_no_requests(spark):
    assert match_first_come(asked_for(spark, [])).count() == 0


def test_a_hot_slot_is_exact(spark):
    """A third of all requests wants one slot of one day; the result is that of the rule."""
    size = 30_000
    asked = spark.range(size).select(
        F.col("id").alias("request_id"),
        F.timestamp_seconds(F.col("id") % 997).cast("timestamp_ntz").alias("requested_at"),
        (F.col("id") % 50).alias("doctor_id"),
        F.lit(on("2024-03-04")).alias("appointment_date"),
        (F.pmod(F.xxhash64("id"), F.lit(4)) + 1).cast("bigint").alias("slot_id"),
        (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(500))).cast("bigint").alias("patient_id"),
    ).withColumns({c: F.when(F.col("request_id") % 3 == 0, F.lit(1)).otherwise(F.col(c)).alias(c) for c in ("doctor_id", "slot_id")})
    rows = [((r["requested_at"], r["request_id"]), r["doctor_id"], r["slot_id"], r["patient_id"]) for r in asked.collect()]
    matched = match_first_come(asked).collect()
    assert {(tuple(r["turn"]), r["doctor_id"], r["slot_id"], r["patient_id"]) for r in matched} == first_come(rows)


def test_decisions_take_twelve_hash_shuffles(spark, hospital, requests):
    """Over all written steps together, without any broadcast; the rounds of the matching come on top."""
    t = hospital(**DIMENSIONS, doctor_schedules=EVERY_SLOT)
    asked = requests("patient_id bigint, doctor_id bigint, appointment_date date, slot_id bigint", [(1000, 10, on("2024-03-04"), 1)])
    plans: list[str] = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        result = booking.book_slots(t, asked, AS_OF, keep=keep)
        last = result.decisions._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    shuffles = [text.count("hashpartitioning") for text in (plans[0], last)]
    assert sum(shuffles) <= 12 and shuffles[1] <= 4, shuffles
    assert "Window" not in "".join(plans) and "collect_list" not in "".join(plans)


def test_status_moves_only_with_a_consultation(hospital, requests):
    rows = [
        {"appointment_id": i, "patient_id": 1000, "doctor_id": 10, "appointment_date": on("2024-03-04"), "slot_id": i,
         "status_id": s, "created_at": at("2024-03-01")}
        for i, s in ((1, 1), (2, 1), (3, 3), (4, None))
    ]
    t = hospital(**DIMENSIONS, appointments=rows, consultations=[{"consultation_id": 1, "appointment_id": i} for i in (2, 3)])
    result = booking.advance_status(t)
    got = dicts(result.decisions, "appointment_id")
    assert [(r["new_status"], r["status_name"]) for r in got] == [
        (1, "Scheduled"), (2, "Completed"), (2, "Completed"), (1, "Scheduled"),
    ]
    update = result.updated["appointments"]
    assert [r["status_id"] for r in dicts(update.state, "appointment_id")] == [1, 2, 2, 1]
    assert sorted(r["appointment_id"] for r in update.changed.collect()) == [2, 3, 4]
    some = booking.advance_status(t, requests("appointment_id bigint", [(2,), (9,)]))
    assert [(r["appointment_id"], r["reason"]) for r in dicts(some.decisions, "appointment_id")] == [(2, None), (9, V.NOT_FOUND)]
