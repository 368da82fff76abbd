"""Deletions under foreign keys against a plain loop over the requests."""

from __future__ import annotations

import random

import pytest
from conftest import DIMENSIONS, dicts, on

from wardline import fixed_values as V
from wardline.jobs import removal
from wardline.sources.model import TABLES


def plain_delete(state: dict[str, list[dict]], table: str, keys: list[int]) -> list[str | None]:
    """Request by request, on dictionaries that change."""
    reasons: list[str | None] = []
    refused: set[int] = set()
    for key in keys:
        if all(r[TABLES[table].key] != key for r in state[table]):
            reasons.append(V.NOT_FOUND)
            continue
        if key in refused:  # only the first request for a row counts
            reasons.append(V.STILL_REFERENCED)
            continue
        gone = {table: {key}}
        grown = True
        while grown:
            grown = False
            for child in TABLES.values():
                for ref in child.references:
                    if ref.on_delete == "cascade" and ref.table in gone:
                        more = {r[child.key] for r in state[child.name] if r.get(ref.column) in gone[ref.table]} - gone.get(child.name, set())
                        if more:
                            gone[child.name] = gone.get(child.name, set()) | more
                            grown = True
        held = any(
            r.get(ref.column) in gone[ref.table] and r[child.key] not in gone.get(child.name, set())
            for child in TABLES.values()
            for ref in child.references
            if ref.on_delete == "reject" and ref.table in gone
            for r in state[child.name]
        )
        reasons.append(V.STILL_REFERENCED if held else None)
        if held:
            refused.add(key)
            continue
        for child in TABLES.values():
            for ref in child.references:
                if ref.on_delete == "clear" and ref.table in gone:
                    for r in state[child.name]:
                        if r.get(ref.column) in gone[ref.table]:
                            r[ref.column] = None
        for name, rows in gone.items():
            state[name] = [r for r in state[name] if r[TABLES[name].key] not in rows]
    return reasons


def clinic(seed: int) -> dict[str, list[dict]]:
    """Forms and consultations that belong to one patient's appointment and name another patient."""
    rng = random.Random(seed)
    people = [{"patient_id": i, "first_name": "a", "last_name": "b", "age": 3} for i in range(1, 13)]

    def near(i: int) -> int:
        return min(12, max(1, i + rng.choice([0, 0, 0, 1, -1])))

    appointments = [{"appointment_id": 100 + i, "patient_id": 1 + i % 12, "doctor_id": 10, "appointment_date": on("2024-01-01"), "slot_id": 1 + i % 4, "status_id": 1} for i in range(30)]
    return {name: [] for name in TABLES} | {
        **{k: [dict(r) for r in v] for k, v in DIMENSIONS.items()},
        "patients": people,
        "appointments": appointments,
        "appointment_forms": [
            {"form_id": i, "appointment_id": a["appointment_id"], "patient_id": near(a["patient_id"]), "symptoms": "x"} for i, a in enumerate(appointments) if i % 2
        ],
        "consultations": [
            {"consultation_id": i, "appointment_id": a["appointment_id"], "doctor_id": 10, "patient_id": near(a["patient_id"])} for i, a in enumerate(appointments) if i % 3 == 0
        ],
        "doctor_schedules": [{"schedule_id": i, "doctor_id": 10, "day_of_week": i % 7, "slot_id": 1 + i % 4} for i in range(28)],
    }


def check(hospital, requests, seed: int, table: str, keys: list[int]) -> list[str | None]:
    state = clinic(seed)
    t = hospital(**{k: [dict(r) for r in v] for k, v in state.items()})
    result = removal.delete_rows(t, table, requests(f"{TABLES[table].key} bigint", [(k,) for k in keys]))
    want = plain_delete(state, table, keys)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == want
    for name, new in result.updated.items():
        key = TABLES[name].key
        got = [{c: r[c] for c in rows} for r, rows in zip(dicts(new.state, key), sorted(state[name], key=lambda r: r[key]), strict=True)]
        assert got == sorted(state[name], key=lambda r: r[key]), name
    return want


@pytest.mark.parametrize("seed", range(4))
def test_patients_equal_a_loop(hospital, requests, seed):
    rng = random.Random(seed)
    keys = [rng.randrange(1, 15) for _ in range(18)]
    want = check(hospital, requests, seed, "patients", keys)
    assert {None, V.STILL_REFERENCED} <= set(want)


def test_a_row_that_fell_earlier_holds_nobody_back(hospital, requests):
    t = hospital(
        patients=[{"patient_id": i, "age": 3} for i in (1, 2, 3)],
        appointments=[{"appointment_id": i, "patient_id": i} for i in (1, 2, 3)],
        appointment_forms=[{"form_id": 1, "appointment_id": 1, "patient_id": 2}, {"form_id": 2, "appointment_id": 2, "patient_id": 3}],
    )
    forward = removal.delete_rows(t, "patients", requests("patient_id bigint", [(1,), (2,), (3,), (1,)]))
    assert [r["reason"] for r in dicts(forward.decisions, "request_id")] == [None, None, None, V.NOT_FOUND]
    assert forward.updated["patients"].state.count() == 0
    back = removal.delete_rows(t, "patients", requests("patient_id bigint", [(3,), (2,), (1,)]))
    assert [r["reason"] for r in dicts(back.decisions, "request_id")] == [V.STILL_REFERENCED, V.STILL_REFERENCED, None]


def test_a_slot_clears_appointments_and_takes_schedules(hospital, requests):
    check(hospital, requests, 1, "time_slots", [2, 9, 2, 3])
    t = hospital(**{k: v for k, v in clinic(1).items()})
    result = removal.delete_rows(t, "time_slots", requests("slot_id bigint", [(2,)]))
    assert set(result.updated) == {"time_slots", "doctor_schedules", "appointments"}
    assert {r["slot_id"] for r in dicts(result.updated["appointments"].changed)} == {None}
    assert result.updated["doctor_schedules"].gone and not result.updated["appointments"].gone


def test_nothing_to_delete(hospital, requests):
    result = removal.delete_rows(hospital(**DIMENSIONS), "patients", requests("patient_id bigint", []))
    assert result.decisions.count() == 0 and result.updated["patients"].state.count() == 6
