"""Commits of several tables: all or nothing, at every point where a step can fail."""

from __future__ import annotations

import os

import pytest
from conftest import DIMENSIONS, at, dicts, on, table_frame
from test_datasets import ROOMS, stay

from wardline.jobs import admission, discharge, removal
from wardline.jobs.result import commit
from wardline.session import stage
from wardline.sources import commits
from wardline.sources.commits import Change, Conflict, Store
from wardline.sources.model import TABLES

ASKED = (
    "patient_id bigint, doctor_id bigint, consultation_id bigint, action_id bigint, initial_room_id bigint,"
    " bed_id bigint, assigned_by_receptionist_id bigint"
)


def bill(i, when, amount=100):
    return {"discharge_id": i, "admission_id": i, "discharge_date": at(when), "total_amount": amount}


def bills(spark, *rows):
    return table_frame(spark, "discharges", list(rows))


def amounts(tables) -> list[tuple]:
    return [(r["discharge_id"], int(r["total_amount"])) for r in dicts(tables.discharges, "discharge_id")]


@pytest.fixture()
def ward(hospital):
    return hospital(
        **DIMENSIONS, **ROOMS, admissions=[stay(1, bed=1, start="2024-01-05 10:00:00")],
        consultations=[{"consultation_id": 2, "appointment_id": 2, "consultation_date": at("2024-03-01")}],
        consultation_actions=[{"action_id": 2, "consultation_id": 2, "action_type_id": 1, "status": "Pending",
                               "created_at": at("2024-03-01")}],
        appointments=[{"appointment_id": 2, "patient_id": 1000, "doctor_id": 10, "appointment_date": on("2024-03-01")}],
    )


def test_appends_and_changes_by_month(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert amounts(store.tables()) == []
    store.commit({"discharges": bills(spark, bill(1, "2024-01-31 10:00:00"), bill(2, "2024-02-01 10:00:00"), {"discharge_id": 3, "total_amount": 5})})
    store.commit({"discharges": bills(spark, bill(4, "2024-02-07 10:00:00"))})
    store.commit(changes={"discharges": Change(bills(spark, bill(2, "2024-02-01 10:00:00", 7)))})
    assert amounts(store.tables()) == [(1, 100), (2, 7), (3, 5), (4, 100)]
    assert store.tables().discharges.schema == TABLES["discharges"].schema
    state = store.manifest()
    first, second = store.manifest(1), store.manifest(2)
    # the untouched months still lie where the first commit put them, the changed one is one folder
    assert {f for f in state.folders if f.month != "2024-02"} == {f for f in first.folders if f.month != "2024-02"}
    assert [f.month for f in second.folders].count("2024-02") == 2
    assert [f.month for f in state.folders].count("2024-02") == 1
    store.commit(changes={"discharges": Change(bills(spark, bill(2, "2024-02-01 10:00:00"), bill(4, "2024-02-07 10:00:00")), gone=True)})
    assert amounts(store.tables()) == [(1, 100), (3, 5)]


def test_older_states_stay_readable_and_can_be_removed(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"discharges": bills(spark, bill(1, "2024-01-31 10:00:00"))})
    before = store.tables()
    store.commit(changes={"discharges": Change(bills(spark, bill(1, "2024-01-31 10:00:00", 9)))})
    assert amounts(before) == amounts(store.tables(1)) == [(1, 100)]
    assert amounts(store.tables()) == [(1, 9)]
    assert len(store.remove_old()) == 1
    assert amounts(store.tables()) == [(1, 9)]
    assert amounts(store.tables(1)) == []
    with pytest.raises(KeyError):
        store.tables(77)


def test_a_range_reads_the_folders_of_its_months(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [bill(i, f"2024-0{i}-11 10:00:00") for i in range(1, 6)]
    store.commit({"discharges": bills(spark, *rows, {"discharge_id": 9, "total_amount": 5})})
    part = store.tables().of_months("discharges", "2024-02-20", "2024-04-01")
    assert sorted(r.discharge_id for r in part.collect()) == [2, 3, 4]
    assert {f.split("month=")[1][:7] for f in part.inputFiles()} == {"2024-02", "2024-03", "2024-04"}
    assert store.tables().of_months("discharges").count() == 6
    assert store.tables().of_months("discharges", "2030-01-01").count() == 0


def test_admission_and_discharge_change_four_tables_at_once(spark, ward, requests, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({name: ward[name] for name in ward})
    asked = requests(ASKED, [(1000, 10, 2, 2, 2, 16, 5), (1001, 10, 2, 2, 2, 16, 5)])
    commit(admission.admit(store.tables(), asked, "2024-03-01 12:00:00", keep=stage), store)
    t = store.tables()
    assert [r["admission_id"] for r in dicts(t.admissions, "admission_id")] == [1, 2]
    assert [r["is_occupied"] for r in dicts(t.rooms, "room_id")] == [True, True, False, False]
    assert t.consultation_actions.first()["status"] == "Completed"
    asked = requests("admission_id bigint, bed_id bigint, total_bill decimal(12,2), discharged_by_receptionist_id bigint", [(2, 16, None, 5)])
    asked = asked.selectExpr("* except (total_bill)", "cast(9000 as decimal(12,2)) total_bill")
    commit(discharge.discharge_total_bill(t, asked, "2024-03-03 12:00:00", keep=stage), store)
    t = store.tables()
    assert [(r["admission_id"], r["is_active"]) for r in dicts(t.admissions, "admission_id")] == [(1, True), (2, False)]
    assert t.beds.filter("bed_id = 16").first()["is_occupied"] is False
    assert t.discharges.count() == 1


def test_removed_rows_leave_all_their_tables(spark, ward, requests, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({name: ward[name] for name in ward})
    asked = requests("doctor_id bigint, removal_reason string, removed_by_admin_id bigint", [(20, "left", 1)])
    commit(removal.remove_doctors(store.tables(), asked, "2024-03-01 12:00:00", keep=stage), store)
    t = store.tables()
    assert [r["doctor_id"] for r in dicts(t.doctors, "doctor_id")] == [10]
    assert t.removed_doctors.count() == 1


class Lost(RuntimeError):
    pass


def steps_of(store: Store, monkeypatch, fail_at: int | None) -> list[str]:
    """Count the steps of commits; the one numbered ``fail_at`` is done and then everything stops."""
    seen: list[str] = []

    def counted(name: str, step):
        def run(*args, **kwargs):
            out = step(*args, **kwargs)
            seen.append(name)
            if len(seen) - 1 == fail_at:
                raise Lost(name)
            return out

        return run

    monkeypatch.setattr(commits, "stage", counted("stage", stage))
    monkeypatch.setattr(store, "_write", counted("write", store._write))
    append = store._append
    monkeypatch.setattr(store, "_append", lambda log, *rest: counted(f"log {log}", append)(log, *rest))
    return seen


def test_a_failure_between_any_two_steps_leaves_the_old_state(spark, ward, requests, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.commit({name: ward[name] for name in ("admissions", "beds", "rooms", "consultation_actions")})
    asked = requests(ASKED, [(1000, 10, 2, 2, 2, 16, 5)])
    result = admission.admit(ward, asked, "2024-03-01 12:00:00", keep=stage)

    def state() -> list:
        t = Store(spark, str(tmp_path)).tables()
        return [sorted(map(str, t[n].collect())) for n in ("admissions", "beds", "rooms", "consultation_actions")]

    before, at_step, seen = state(), 0, []
    while True:
        with monkeypatch.context() as patch:
            seen = steps_of(store, patch, at_step)
            try:
                commit(result, store)
            except Lost as lost:
                if str(lost) == "log commits":
                    break  # the last step was done, so the commit holds
                assert state() == before
                at_step += 1
                continue
        pytest.fail("a step after the manifest")
    assert seen[0] == "log begun" and seen[-1] == "log commits"
    assert at_step == len(seen) - 1 >= 9
    after = state()
    assert all(a != b for a, b in zip(before, after, strict=True))
    emptied = store.remove_old()
    assert len([p for p in emptied if "month" not in p]) >= at_step * 4  # what the failed ones wrote
    assert state() == after
    kept = sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(tmp_path / "data") for f in files if f.endswith(".parquet"))
    assert kept < 60_000 + 3_000 * len(emptied)


def test_changed_rows_are_evaluated_once(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.commit({"beds": table_frame(spark, "beds", [{"bed_id": i, "room_id": 1, "bed_number": i} for i in range(1, 5)])})
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    beds = store.tables().beds
    changed = beds.where("bed_id < 4").mapInArrow(count, beds.schema).selectExpr("* except (is_occupied)", "true is_occupied")
    store.commit(changes={"beds": Change(changed)})
    assert seen.value == 3
    assert [r["is_occupied"] for r in dicts(store.tables().beds, "bed_id")] == [True, True, True, None]


def test_a_commit_onto_an_older_state_is_refused(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    old = store.commit({"admin": table_frame(spark, "admin", [{"admin_id": 1, "username": "a"}])})
    store.commit({"admin": table_frame(spark, "admin", [{"admin_id": 2, "username": "b"}])})
    with pytest.raises(Conflict):
        store.commit({"admin": table_frame(spark, "admin", [{"admin_id": 3, "username": "c"}])}, onto=old)
    assert [r["admin_id"] for r in dicts(store.tables().admin, "admin_id")] == [1, 2]


def test_many_appends_are_compacted(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for i in range(1, 5):
        store.commit({"discharges": bills(spark, bill(i, "2024-02-01 10:00:00"), bill(10 + i, f"2024-0{2 + i}-01 10:00:00"))})
    before = amounts(store.tables())
    state = store.compact(most=3)
    assert [f.month for f in state.folders].count("2024-02") == 1
    assert amounts(store.tables()) == before
    assert store.compact(most=3) == state
