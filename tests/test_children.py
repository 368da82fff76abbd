"""Nested children in pages."""

from __future__ import annotations

import random

from conftest import at, dicts

from wardline.operators.children import pages
from wardline.plans import visits


def test_pages_hold_the_children_in_order(spark):
    rng = random.Random(3)
    data = [(1 if i % 3 == 0 else rng.randrange(6), rng.randrange(9), i, f"v{i}") for i in range(500)]
    frame = spark.createDataFrame(data, "p int, o int, i int, v string")
    got = dicts(pages(frame, ["p"], ["o", "i"], ["i", "v"], size=7), "p", "page")
    want = {}
    for p, o, i, v in sorted(data):
        want.setdefault(p, []).append({"i": i, "v": v})
    for p, rows in want.items():
        mine = [r for r in got if r["p"] == p]
        assert [r["page"] for r in mine] == list(range(-(-len(rows) // 7)))
        assert [c for r in mine for c in r["children"]] == rows
        assert all(r["in_page"] == len(r["children"]) <= 7 for r in mine)
    assert len(got) == sum(-(-len(rows) // 7) for rows in want.values())


def test_visits_of_a_long_stay_are_split(hospital):
    rows = [
        {"visit_id": i, "admission_id": 1, "patient_id": 5 if i % 3 else 6, "doctor_id": 10, "visit_datetime": at(f"2024-01-0{1 + i % 2} {i % 24:02d}:00:00")}
        for i in range(1, 61)
    ]
    t = hospital(admitted_patient_visits=rows)
    got = dicts(visits.patient_visits_nested(t, size=8), "patient_id", "visit_date_only", "page")
    groups = {(r["patient_id"], r["visit_date_only"]): r["visits"] for r in dicts(visits.patient_visits_by_date(t))}
    for key, n in groups.items():
        mine = [r for r in got if (r["patient_id"], r["visit_date_only"]) == key]
        assert [r["in_page"] for r in mine] == [8] * (n // 8) + ([n % 8] if n % 8 else [])
        order = [(v["visit_datetime"], v["visit_id"]) for r in mine for v in r["visits"]]
        assert order == sorted(order, reverse=True) and len(order) == n
    assert {r["patient_id"] for r in dicts(visits.patient_visits_nested(t, patient_id=6))} == {6}
    assert visits.patient_visits_nested(hospital()).count() == 0
