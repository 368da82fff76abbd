"""The activity reports against the plain join product, on random and edge data."""

from __future__ import annotations

import datetime as dt
import random

import duckdb
import pytest
from conftest import DIMENSIONS, at, dicts, on

from wardline.plans import reports

FIRST, LAST = "2024-03-01", "2024-03-03"
END = "timestamp '2024-03-03 23:59:59'"

NAIVE_PATIENTS = f"""
select p.patient_id, count(distinct a.appointment_id) total_appointments,
  count(distinct c.consultation_id) total_consultations, count(distinct s.admission_id) total_admissions,
  count(distinct x.discharge_id) total_discharges, min(a.appointment_date) first_appointment_date,
  max(a.appointment_date) last_appointment_date,
  cast(sum(case when a.status_id = 2 then d.consultation_fee else 0 end) as decimal(18,2)) total_spent
from patients p left join appointments a on a.patient_id = p.patient_id
left join consultations c on c.appointment_id = a.appointment_id
left join admissions s on s.patient_id = p.patient_id left join discharges x on x.admission_id = s.admission_id
left join doctors d on d.doctor_id = a.doctor_id
where p.created_at between date '{FIRST}' and {END} or a.appointment_date between date '{FIRST}' and {END}
  or s.admission_date between date '{FIRST}' and {END} group by p.patient_id"""
NAIVE_DOCTORS = f"""
select d.doctor_id, count(distinct a.appointment_id) total_appointments, count(distinct v.visit_id) patient_visits,
  count(distinct h.admission_id) admissions_recommended,
  cast(sum(case when a.status_id = 2 then d.consultation_fee else 0 end) as decimal(18,2)) total_revenue,
  round(avg(case when a.status_id = 2 then 1.0 else 0.0 end) * 100, 4) completion_rate
from doctors d left join appointments a on a.doctor_id = d.doctor_id
  and a.appointment_date between date '{FIRST}' and {END}
left join admitted_patient_visits v on v.doctor_id = d.doctor_id and v.visit_datetime between date '{FIRST}' and {END}
left join admissions h on h.doctor_id = d.doctor_id and h.admission_date between date '{FIRST}' and {END}
group by d.doctor_id"""


def random_hospital(seed: int) -> dict:
    rng = random.Random(seed)

    def moment() -> dt.datetime:
        return at("2024-02-28") + dt.timedelta(minutes=rng.randrange(7 * 24 * 60))

    patients = [{**p, "created_at": moment()} for p in DIMENSIONS["patients"]]
    people = [p["patient_id"] for p in patients]
    appointments = [
        {"appointment_id": i, "patient_id": rng.choice(people), "doctor_id": rng.choice([10, 20]),
         "appointment_date": moment().date(), "slot_id": 1, "status_id": rng.choice([1, 2, 2, 3])}
        for i in range(1, rng.randrange(2, 25))
    ]
    consultations = [
        {"consultation_id": a["appointment_id"], **{k: a[k] for k in ("appointment_id", "patient_id", "doctor_id")}}
        for a in appointments
        if rng.random() < 0.5
    ]
    admissions = [
        {"admission_id": i, "patient_id": rng.choice(people), "doctor_id": rng.choice([10, 20]),
         "admission_date": moment()}
        for i in range(1, rng.randrange(2, 12))
    ]
    discharges = [
        {"discharge_id": a["admission_id"], "admission_id": a["admission_id"]} for a in admissions if rng.random() < 0.5
    ]
    visits = [
        {"visit_id": i, "admission_id": 1, "doctor_id": rng.choice([10, 20]), "visit_datetime": moment()}
        for i in range(1, rng.randrange(1, 12))
    ]
    return {
        **DIMENSIONS, "patients": patients, "appointments": appointments, "consultations": consultations,
        "admissions": admissions, "discharges": discharges, "admitted_patient_visits": visits,
    }


def duck(t, sql: str) -> list[dict]:
    connection = duckdb.connect()
    for name in t:
        frame = t[name].toArrow()
        connection.register(f"{name}_given", frame)
        connection.execute(f"create table {name} as select * from {name}_given")
    relation = connection.sql(sql)
    return [dict(zip(relation.columns, row)) for row in relation.fetchall()]


@pytest.mark.parametrize("seed", range(4))
def test_closed_forms_equal_the_product(hospital, seed):
    t = hospital(**random_hospital(seed))
    for frame, sql, key in (
        (reports.patients_range(t, FIRST, LAST), NAIVE_PATIENTS, "patient_id"),
        (reports.doctors_range(t, FIRST, LAST), NAIVE_DOCTORS, "doctor_id"),
    ):
        expected = sorted(duck(t, sql), key=lambda r: r[key])
        got = [{k: row[k] for k in expected[0]} for row in dicts(frame, key)] if expected else dicts(frame)
        assert got == expected


@pytest.mark.parametrize("visits,admissions,factor", [(0, 0, 1), (1, 0, 1), (3, 0, 3), (0, 2, 2), (3, 2, 6)])
def test_fees_repeat_with_visits_and_admissions(hospital, visits, admissions, factor):
    rows = {
        **DIMENSIONS,
        "appointments": [
            {"appointment_id": i, "patient_id": 1000, "doctor_id": 10, "appointment_date": on("2024-03-02"), "status_id": 2}
            for i in (1, 2)
        ],
        "admitted_patient_visits": [
            {"visit_id": i, "admission_id": 1, "doctor_id": 10, "visit_datetime": at("2024-03-02 09:00:00")}
            for i in range(visits)
        ],
        "admissions": [
            {"admission_id": i, "patient_id": 1001, "doctor_id": 10, "admission_date": at("2024-03-01 09:00:00")}
            for i in range(admissions)
        ],
    }
    t = hospital(**rows)
    busy, idle = dicts(reports.doctors_range(t, FIRST, LAST), "doctor_id")
    assert (int(busy["total_revenue"]), int(busy["total_revenue_exact"])) == (200 * factor, 200)
    assert (busy["completion_rate"], idle["completion_rate"], int(idle["total_revenue"])) == (100.0, 0.0, 0)
    day = dicts(reports.daily_doctors(t, "2024-03-02"), "doctor_id")[0]
    assert int(day["revenue_today"]) == 200 * max(visits, 1)


def test_summary_ends_registrations_at_midnight(hospital):
    people = [
        {**DIMENSIONS["patients"][i], "created_at": at(when)}
        for i, when in enumerate(("2024-03-01 00:00:00", "2024-03-03 00:00:00", "2024-03-03 10:00:00", "2024-03-04"))
    ]
    t = hospital(**{**DIMENSIONS, "patients": people})
    summary = reports.patients_range_summary(t, FIRST, LAST).first()
    assert (summary["total_patients"], summary["new_registrations"]) == (3, 2)
    assert summary["period"] == "2024-03-01 to 2024-03-03"


def test_summaries_take_a_given_detail(hospital):
    t = hospital(**random_hospital(9))
    detail = reports.patients_range(t, FIRST, LAST)
    given = reports.patients_range_summary(t, FIRST, LAST, detail=detail.limit(0)).first()
    assert (given["total_patients"], int(given["total_revenue"]), given["period"]) == (0, 0, f"{FIRST} to {LAST}")
    assert reports.patients_range_summary(t, FIRST, LAST, detail=detail).first()["total_patients"] == detail.count()


def test_empty_tables_give_zero_rows_and_counts(hospital):
    t = hospital()
    assert reports.doctors_range(t, FIRST, LAST).count() == 0
    assert tuple(reports.daily_summary(t, FIRST).first())[1:] == (0, 0, 0, 0)
    summary = reports.doctors_range_summary(t, FIRST, LAST).first()
    assert (summary["total_doctors"], summary["total_appointments"], summary["average_completion_rate"]) == (0, 0, 0.0)


def test_range_summary_defaults_to_thirty_days(hospital):
    rows = [{**DIMENSIONS["patients"][0], "patient_id": i, "created_at": at(when)}
            for i, when in enumerate(("2024-02-01", "2024-02-02", "2024-03-03 22:00:00", "2024-03-04"))]
    counts = reports.range_summary(hospital(patients=rows), "2024-03-03 12:00:00").first()
    assert (counts["start_date"], counts["end_date"], counts["new_patients"]) == (on("2024-02-02"), on("2024-03-03"), 2)
