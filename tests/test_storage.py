"""Reading and writing tables, and storing job results."""

from __future__ import annotations

import json
import os

from conftest import DIMENSIONS, at, dicts, on, table_frame
from test_datasets import ROOMS, stay

from wardline.jobs import admission, discharge
from wardline.jobs.result import store
from wardline.plans import lists, wards
from wardline.session import stage
from wardline.sources import sinks
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables, split_options


def bill(i, when, amount=100):
    return {"discharge_id": i, "admission_id": i, "discharge_date": at(when), "total_amount": amount}


def test_round_trip_and_append_by_month(spark, tmp_path):
    path = str(tmp_path / "discharges")
    sinks.write_table(table_frame(spark, "discharges", [bill(1, "2024-01-31 10:00:00")]), "discharges", path)
    sinks.append(table_frame(spark, "discharges", [bill(2, "2024-02-01 10:00:00")]), "discharges", path)
    assert sorted(d for d in os.listdir(path) if d.startswith("month")) == ["month=2024-01", "month=2024-02"]
    back = Tables.parquet(spark, str(tmp_path)).discharges
    assert back.schema == TABLES["discharges"].schema
    assert [r["discharge_id"] for r in dicts(back, "discharge_id")] == [1, 2]


def test_rewrite_touches_only_the_changed_months(spark, tmp_path):
    path = str(tmp_path / "discharges")
    rows = [bill(1, "2024-01-31 10:00:00"), bill(2, "2024-02-01 10:00:00"), bill(3, "2024-02-02 10:00:00")]
    sinks.write_table(table_frame(spark, "discharges", rows), "discharges", path)
    before = set(os.listdir(f"{path}/month=2024-01"))
    stored = Tables.parquet(spark, str(tmp_path)).discharges
    state = stored.selectExpr("* except (total_amount)", "if(discharge_id = 2, 7.00bd, total_amount) total_amount")
    months = sinks.touched_months(stored.filter("discharge_id = 2"), "discharges")
    part = sinks.rows_to_rewrite(state, "discharges", months)
    assert "PushedFilters: [IsNotNull(discharge_date), GreaterThanOrEqual(discharge_date,2024-02-01T00:00)" in (
        part._jdf.queryExecution().executedPlan().toString()
    )
    sinks.write_months(stage(part), "discharges", path, months)
    again = Tables.parquet(spark, str(tmp_path)).discharges
    assert [(r["discharge_id"], int(r["total_amount"])) for r in dicts(again, "discharge_id")] == [(1, 100), (2, 7), (3, 100)]
    assert set(os.listdir(f"{path}/month=2024-01")) == before


def test_a_month_without_rows_goes(spark, tmp_path):
    path = str(tmp_path / "discharges")
    rows = [bill(1, "2024-01-31 10:00:00"), bill(2, "2024-02-01 10:00:00"), {"discharge_id": 3}]
    sinks.write_table(table_frame(spark, "discharges", rows), "discharges", path)
    stored = Tables.parquet(spark, str(tmp_path)).discharges
    months = sinks.touched_months(stored.filter("discharge_id <> 1"), "discharges")
    assert months == ["2024-02", "none"]
    kept = stage(sinks.rows_to_rewrite(stored.filter("discharge_id <> 2"), "discharges", months))
    sinks.write_months(kept, "discharges", path, months)
    again = Tables.parquet(spark, str(tmp_path)).discharges
    assert [r["discharge_id"] for r in dicts(again, "discharge_id")] == [1, 3]


def test_neighbouring_months_are_one_range(spark):
    text = str(sinks.in_months("appointments", ["2023-12", "2024-01", "2024-03"]))
    assert text.count(">=") == 2


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert json.loads(sinks.as_json(df).first()["json"]) == {"a": 1, "b": None}
    sinks.write_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_passwords_never_pass(spark):
    df = spark.createDataFrame([(5, "Desk", "One", "secret")], "receptionist_id int, first_name string, last_name string, password string")
    assert "password" not in lists.receptionists(Tables({"receptionists": df})).columns


def test_key_ranges_of_a_database_read():
    assert split_options("beds", "bed_id", None, None, 8) == {"dbtable": "beds"}
    assert split_options("beds", "bed_id", 1, 5, 8) == {"dbtable": "beds"}
    assert split_options("visits", "visit_id", 1, 900, 8)["numPartitions"] == "8"


def test_bucketed_families_join_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sql("create database wardline_test")
    try:
        rows = {"admissions": [stay(i) for i in range(1, 9)], "discharges": [bill(1, "2024-01-31 10:00:00")]}
        for name in ("admissions", "discharges"):
            frame = table_frame(spark, name, rows[name])
            sinks.save_bucketed(frame, name, "wardline_test", str(tmp_path / name), 4)
        t = Tables.catalog(spark, "wardline_test")
        joined = t.admissions.select("admission_id").join(t.discharges.select("admission_id"), "admission_id", "left_anti")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop database wardline_test cascade")


def test_a_stay_from_admission_to_discharge_in_storage(spark, hospital, requests, tmp_path):
    root = str(tmp_path)
    given = hospital(
        **DIMENSIONS, **ROOMS, admissions=[stay(1, bed=1, start="2024-01-05 10:00:00")],
        consultations=[{"consultation_id": 2, "appointment_id": 2, "consultation_date": at("2024-03-01")}],
        consultation_actions=[{"action_id": 2, "consultation_id": 2, "action_type_id": 1, "status": "Pending",
                               "created_at": at("2024-03-01")}],
        appointments=[{"appointment_id": 2, "patient_id": 1000, "doctor_id": 10, "appointment_date": on("2024-03-01")}],
    )
    for name in given:
        sinks.write_table(given[name], name, f"{root}/{name}")
    asked = requests(
        "patient_id bigint, doctor_id bigint, consultation_id bigint, action_id bigint, initial_room_id bigint,"
        " bed_id bigint, assigned_by_receptionist_id bigint",
        [(1000, 10, 2, 2, 2, 16, 5)],
    )
    store(admission.admit(Tables.parquet(spark, root), asked, "2024-03-01 12:00:00", keep=stage), root)
    t = Tables.parquet(spark, root)
    open_stays = dicts(wards.active_admissions(t, "2024-03-03"), "admission_id")
    assert [(r["admission_id"], r["bed_code"], r["days_admitted"]) for r in open_stays] == [(1, "R1-B1", 58), (2, "R2-B8", 2)]
    assert [r["is_occupied"] for r in dicts(t.rooms, "room_id")] == [True, True, False, False]
    assert t.consultation_actions.first()["status"] == "Completed"

    bills = requests(
        "admission_id bigint, bed_id bigint, total_bill decimal(12,2), discharged_by_receptionist_id bigint",
        [(2, 16, None, 5)],
    ).selectExpr("* except (total_bill)", "cast(9000 as decimal(12,2)) total_bill")
    store(discharge.discharge_total_bill(t, bills, "2024-03-03 12:00:00", keep=stage), root)
    t = Tables.parquet(spark, root)
    assert [(r["admission_id"], r["is_active"]) for r in dicts(t.admissions, "admission_id")] == [(1, True), (2, False)]
    assert [(int(r["room_charges"]), r["total_days"]) for r in dicts(t.discharges)] == [(3000, 2)]
    assert [r["is_occupied"] for r in dicts(t.rooms, "room_id")] == [True, True, False, False]
    assert t.beds.filter("bed_id = 16").first()["is_occupied"] is False
