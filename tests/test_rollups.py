"""Totals kept up folder by folder against direct queries."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from checks import queries
from conftest import DIMENSIONS, at, dicts, on, table_frame

from wardline.plans import billing, reports, rolled, visits
from wardline.sources.commits import Change, Store
from wardline.sources.rollups import ROLLUPS, Rollups

AS_OF = "2024-03-20 15:30:00"
BIG = 1 << 40


def moment(rng: random.Random) -> dt.datetime:
    return at("2024-01-01 00:00:00") + dt.timedelta(minutes=rng.randrange(100 * 24 * 60))


def facts(seed: int, size: int = 160) -> dict[str, list[dict]]:
    """A third of everything belongs to one doctor; some dates are missing, some ids are large or negative."""
    rng = random.Random(seed)

    def doctor(i: int) -> int:
        return 10 if i % 3 == 0 else rng.choice([10, 20, 30])

    def patient() -> int:
        return rng.choice([1, 2, 40_000, BIG, BIG + 1, BIG + 40_000, -3, 1 << 31, (1 << 62) + 5])

    return {
        "patients": [{"patient_id": i, "age": 30, "created_at": moment(rng)} for i in range(1, 40)],
        "appointments": [
            {"appointment_id": i, "patient_id": patient(), "doctor_id": doctor(i), "appointment_date": moment(rng).date() if i % 19 else None, "status_id": 1}
            for i in range(1, size)
        ],
        "consultations": [{"consultation_id": i, "appointment_id": i, "consultation_date": moment(rng)} for i in range(1, size)],
        "admissions": [{"admission_id": i, "patient_id": patient(), "admission_date": moment(rng)} for i in range(1, size)],
        "admitted_patient_visits": [
            {"visit_id": i, "doctor_id": doctor(i), "patient_id": patient(), "visit_datetime": moment(rng), "condition_status": rng.choice(["Stable", "critical", None]),
             "ready_for_discharge": rng.choice([True, False, None]), "temperature": rng.choice([98, 99.5, None]), "pulse_rate": rng.choice([70, None])}
            for i in range(1, size)
        ],
        "discharges": [
            {"discharge_id": i, "doctor_id": doctor(i), "discharge_date": moment(rng), "total_days": i % 5, "total_amount": rng.choice([100, 250.5]),
             "amount_paid": rng.choice([0, 50, None]), "payment_status": rng.choice(["Paid", "unpaid", "Partial"]), "follow_up_required": i % 2 == 0}
            for i in range(1, size)
        ],
    }


def same(left, right) -> None:
    assert left.columns == right.columns
    key = left.columns[0]
    assert sorted(map(str, left.collect())) == sorted(map(str, right.collect())), key


def compare(store: Store, rollups: Rollups) -> None:
    t = store.tables()
    same(rolled.daily_summary(rollups, "2024-02-02"), reports.daily_summary(t, "2024-02-02"))
    same(rolled.range_summary(rollups, AS_OF), reports.range_summary(t, AS_OF))
    same(rolled.range_summary(rollups, AS_OF, "2024-01-20", "2024-03-03"), reports.range_summary(t, AS_OF, "2024-01-20", "2024-03-03"))
    same(rolled.doctor_visits_summary(rollups, AS_OF), visits.doctor_visits_summary(t, AS_OF))
    same(rolled.doctor_discharge_stats(rollups, AS_OF), billing.doctor_discharge_stats(t, AS_OF))
    inside = t.appointments.filter("appointment_date between '2024-01-20' and '2024-03-03'")
    direct = {r["doctor_id"]: r["n"] for r in inside.groupBy("doctor_id").agg({"patient_id": "count"}).withColumnRenamed("count(patient_id)", "n").collect()}
    distinct = {r["doctor_id"]: r["n"] for r in inside.select("doctor_id", "patient_id").distinct().groupBy("doctor_id").count().toDF("doctor_id", "n").collect()}
    got = {r["doctor_id"]: r["patients"] for r in rolled.doctor_patients(rollups, "2024-01-20", "2024-03-03").collect()}
    assert got == distinct and direct.keys() == got.keys()


def test_totals_follow_appends_updates_and_removals(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rollups, rows = Rollups(store), facts(1)
    frames = {name: table_frame(spark, name, part) for name, part in rows.items()}
    store.commit({name: frames[name] for name in frames})
    first = rollups.refresh()
    assert all(first.values())
    compare(store, rollups)
    later = table_frame(spark, "appointments", [{"appointment_id": 900, "patient_id": BIG, "doctor_id": 20, "appointment_date": on("2024-02-02"), "status_id": 1}])
    store.commit({"appointments": later})
    compare(store, rollups)  # the folder that is not totalled yet is read as it is
    assert {name: [f.month for f in found] for name, found in rollups.refresh().items() if found} == {
        "appointments": ["2024-02"], "doctor_patients": ["2024-02"], "appointment_patients": ["2024-02"],
    }
    changed = table_frame(spark, "discharges", [{**r, "doctor_id": 20, "total_amount": 7} for r in rows["discharges"] if r["discharge_date"].month == 3][:9])
    gone = table_frame(spark, "admitted_patient_visits", rows["admitted_patient_visits"][::4])
    store.commit(changes={"discharges": Change(changed), "admitted_patient_visits": Change(gone, gone=True)})
    compare(store, rollups)
    found = rollups.refresh()
    assert {f.month for f in found["doctor_discharges"]} == {"2024-03"} and not found["appointments"]
    compare(store, rollups)
    assert not any(rollups.refresh().values())


def test_unchanged_months_are_not_read(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rollups = Rollups(store)
    store.commit({"discharges": table_frame(spark, "discharges", facts(2)["discharges"])})
    rollups.refresh("doctor_discharges")
    read = rolled.doctor_discharge_stats(rollups, AS_OF).inputFiles()
    # of the facts only the month in which the period begins, for the part of its first day
    assert {f.split("month=")[1][:7] for f in read if "/data/" in f} == {"2024-02"}
    assert any("/rollups/doctor_discharges/" in f for f in read)
    whole = rollups.range("doctor_discharges", "2024-02-01", "2024-02-29").inputFiles()
    assert whole and all("/rollups/" in f for f in whole)


def test_no_facts(spark, tmp_path):
    rollups = Rollups(Store(spark, str(tmp_path)))
    assert not any(rollups.refresh().values())
    assert dicts(rolled.daily_summary(rollups, "2024-02-02"))[0]["appointments"] == 0
    assert rolled.doctor_patients(rollups, "2024-01-01", "2024-02-01").count() == 0
    assert rolled.doctor_visits_summary(rollups, AS_OF).count() == 0


@pytest.mark.parametrize("name", ["doctor_patients", "patients_visited"])
def test_bitmaps_count_like_distinct(spark, tmp_path, name):
    store = Store(spark, str(tmp_path))
    rollup = ROLLUPS[name]
    store.commit({rollup.table: table_frame(spark, rollup.table, facts(5, 400)[rollup.table])})
    rollups = Rollups(store)
    rollups.refresh(name)
    rows = store.tables()[rollup.table].filter(f"{rollup.moment} is not null").select(*rollup.keys, rollup.distinct).distinct()
    want = sorted(tuple(r) for r in rows.groupBy(*rollup.keys).count().collect())
    assert sorted(tuple(r) for r in rollups.range(name, "2024-01-01", "2025-01-01").collect()) == want
    assert DIMENSIONS


def test_a_bitmap_is_no_larger_than_its_ids_need(spark, tmp_path):
    """A doctor sees few patients a day; their totals are a few numbers, not a page of 4 KB."""
    store = Store(spark, str(tmp_path))
    store.commit({"appointments": table_frame(spark, "appointments", facts(5, 400)["appointments"])})
    rollups = Rollups(store)
    rollups.refresh("doctor_patients")
    days = rollups.days("doctor_patients")
    assert days.schema["ids"].dataType.simpleString() == "bigint"
    assert 0 < days.count() <= 400


def test_patient_reports_read_the_months_of_touched_patients(spark, tmp_path):
    """Every patient comes in two neighbouring months of a year, but for one who comes in all."""
    rng = random.Random(3)
    people = [{"patient_id": i, "first_name": "a", "last_name": "b", "age": 3, "created_at": at("2023-01-01")} for i in [*range(1, 61), BIG]]

    def day(i: int) -> dt.date:
        return dt.date(2023, 1 + (i % 6) * 2 + rng.randrange(2), 1 + rng.randrange(28))

    booked = [{"appointment_id": 10 * i + k, "patient_id": i, "doctor_id": 10, "appointment_date": day(i), "status_id": 1 + k % 3} for i in range(1, 61) for k in range(3)]
    booked += [{"appointment_id": 5000 + m, "patient_id": BIG, "doctor_id": 10, "appointment_date": dt.date(2023, m, 15), "status_id": 2} for m in range(1, 13) if m > 6]
    stays = [{"admission_id": i, "patient_id": i, "admission_date": dt.datetime.combine(day(i), dt.time(5))} for i in range(1, 61)]
    frames = {"patients": people, "appointments": booked, "admissions": stays, "doctors": DIMENSIONS["doctors"]}
    store = Store(spark, str(tmp_path))
    store.commit({name: table_frame(spark, name, rows) for name, rows in frames.items()})
    rollups = Rollups(store)
    rollups.refresh("appointment_patients", "admission_patients")
    t = store.tables()
    for first, last in (("2023-01-05", "2023-02-20"), ("2023-09-02", "2023-09-04"), ("2022-01-01", "2022-02-01")):
        same(rolled.patients_range(rollups, first, last), reports.patients_range(t, first, last))
        same(rolled.daily_patients(rollups, last), reports.daily_patients(t, last))

    def months(df) -> set[str]:
        return {f.split("month=")[1][:7] for f in df.inputFiles() if "/appointments/" in f}

    assert months(rolled.patients_range(rollups, "2023-01-05", "2023-02-20")) == {"2023-01", "2023-02"}
    assert len(months(reports.patients_range(t, "2023-01-05", "2023-02-20"))) == 12
    # who came in all months from July on is read in all of these
    assert months(rolled.patients_range(rollups, "2023-09-15", "2023-09-15")) >= {f"2023-{m:02d}" for m in range(7, 13)}
    assert not months(rolled.patients_range(rollups, "2022-01-01", "2022-02-01"))


def test_first_state_of_the_kept_up_totals_is_one_pass(hospital, monkeypatch):
    """Rows that come late are missing, a seventh lacks its doctor, another seventh has a copy under a negative key."""
    begun = {}

    class Stop(Exception):
        pass

    def commit(self, appended):
        begun.update(appended)
        raise Stop

    monkeypatch.setattr(Store, "commit", commit)
    ids = range(1, 60)
    visits_of = [{"visit_id": i, "admission_id": 1, "doctor_id": 10 + i % 3, "visit_datetime": at("2024-01-01")} for i in ids]
    with pytest.raises(Stop):
        queries._kept_up(hospital(admitted_patient_visits=visits_of), "doctor_visits")
    rows = begun["admitted_patient_visits"]
    first = [(i, None if i % 7 == 1 else 10 + i % 3) for i in ids if i % 3] + [(-i - 1, 10 + i % 3) for i in ids if i % 7 == 2]
    assert sorted((r.visit_id, r.doctor_id) for r in rows.collect()) == sorted(first, key=lambda r: r[0])
    assert rows._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
