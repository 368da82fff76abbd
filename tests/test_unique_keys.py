"""Schedule patches under the unique key of (doctor, day, slot), against a plain loop."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import DIMENSIONS, dicts
from wardline import fixed_values as V
from wardline.jobs import patches
from wardline.operators.unique_keys import _components, _State, refused_moves

AS_OF = "2024-03-03 09:00:00"
COLUMNS = "schedule_id bigint, changes map<string,string>"


def schedule(number: int, doctor: int, day: int, slot: int) -> dict:
    return {"schedule_id": number, "doctor_id": doctor, "day_of_week": day, "slot_id": slot, "is_active": True}


def triples(result) -> list[tuple]:
    rows = dicts(result.updated["doctor_schedules"].state, "schedule_id")
    return [(r["schedule_id"], r["doctor_id"], r["day_of_week"], r["slot_id"]) for r in rows]


def test_a_place_can_be_taken_once_it_is_left(hospital, requests):
    t = hospital(**DIMENSIONS, doctor_schedules=[schedule(1, 10, 1, 1), schedule(2, 10, 1, 2), schedule(3, 20, 1, 1)])
    rows = [
        (2, {"slot_id": "1"}),  # held by 1
        (1, {"slot_id": "3"}),
        (2, {"slot_id": "1"}),  # free by now
        (1, {"slot_id": "1", "is_active": "false"}),  # refused as a whole
        (2, {"slot_id": "1"}),  # its own place
        (3, {"day_of_week": "1"}),  # another doctor
        (1, {"slot_id": "77"}),
    ]
    result = patches.apply_patches(t, "doctor_schedules", requests(COLUMNS, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == [
        V.DUPLICATE_KEY, None, None, V.DUPLICATE_KEY, None, None, V.INVALID_REFERENCE,
    ]
    assert triples(result) == [(1, 10, 1, 3), (2, 10, 1, 1), (3, 20, 1, 1)]
    assert all(r["is_active"] for r in dicts(result.updated["doctor_schedules"].state))


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_loop_over_the_patches(hospital, requests, seed):
    draw = random.Random(seed)
    cells = [(doctor, day, slot) for doctor in (10, 20) for day in range(3) for slot in (1, 2, 3)]
    stored = [schedule(i, *cell) for i, cell in enumerate(draw.sample(cells, 12), start=1)]
    rows = []
    for _ in range(200):
        changes = {"day_of_week": str(draw.randrange(3)), "slot_id": str(draw.randint(1, 3)), "is_active": "true"}
        rows.append((draw.randint(1, 13), {k: v for k, v in changes.items() if draw.random() < 0.6}))

    place = {r["schedule_id"]: (r["doctor_id"], r["day_of_week"], r["slot_id"]) for r in stored}
    expected = []
    for number, changes in rows:
        if not changes or number not in place:
            expected.append(V.NOTHING_TO_UPDATE if not changes else V.NOT_FOUND)
            continue
        doctor, day, slot = place[number]
        new = (doctor, int(changes.get("day_of_week", day)), int(changes.get("slot_id", slot)))
        taken = any(other == new for owner, other in place.items() if owner != number)
        expected.append(V.DUPLICATE_KEY if taken else None)
        if not taken:
            place[number] = new

    t = hospital(**DIMENSIONS, doctor_schedules=stored)
    result = patches.apply_patches(t, "doctor_schedules", requests(COLUMNS, rows), AS_OF)
    assert [r["reason"] for r in dicts(result.decisions, "request_id")] == expected
    assert triples(result) == [(number, *place[number]) for number in sorted(place)]
    assert V.DUPLICATE_KEY in expected


def test_no_patches(hospital, requests):
    t = hospital(**DIMENSIONS, doctor_schedules=[schedule(1, 10, 1, 1)])
    result = patches.apply_patches(t, "doctor_schedules", requests(COLUMNS, []), AS_OF)
    assert result.decisions.count() == 0 and triples(result) == [(1, 10, 1, 1)]


def plain_refused(stored: list[tuple], moves: list[tuple]) -> list[int]:
    """Move by move; rows are (group, key, a, b), moves (id, group, key, a or None, b or None)."""
    place = {key: (group, a, b) for group, key, a, b in stored}
    out = []
    for i, group, key, a, b in moves:
        _, old_a, old_b = place[key]
        new = (group, old_a if a is None else a, old_b if b is None else b)
        if any(other == new for owner, other in place.items() if owner != key) and new != place[key]:
            out.append(i)
        else:
            place[key] = new
    return out


def moves_frame(spark, moves: list[tuple]):
    frame = spark.createDataFrame(moves, "request_id bigint, g bigint, k bigint, a int, b bigint")
    return frame.selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' requested_at")


@pytest.mark.parametrize("seed", range(4))
def test_refused_moves_equal_a_loop_with_a_hot_group(spark, seed):
    draw = random.Random(seed)
    cells = [(g, a, b) for g in range(4) for a in range(7) for b in range(6)]
    # half of the places are held, and two rows share one already
    stored = [(g, i, a, b) for i, (g, a, b) in enumerate(draw.sample(cells, 80))]
    stored.append((*stored[0][:1], 500, *stored[0][2:]))
    group = {key: g for g, key, *_ in stored}
    hot = [key for key, g in group.items() if g == 0]
    moves = []
    for i in range(600):
        key = draw.choice(hot) if i % 3 == 0 else draw.choice(list(group))
        a, b = draw.choice([None, draw.randrange(7)]), draw.choice([None, draw.randrange(3) + 3 * (key % 2)])
        if a is not None or b is not None:
            moves.append((i, group[key], key, a, b))
    frame = spark.createDataFrame(stored, "g bigint, k bigint, a int, b bigint")
    got = refused_moves(frame, moves_frame(spark, moves), "g", "k", ("a", "b"))
    want = plain_refused(stored, moves)
    assert sorted(r["request_id"] for r in got.collect()) == want
    assert len(want) > 50


def test_rows_without_a_shared_place_are_not_looked_at(spark):
    stored = [(1, i, i % 7, i) for i in range(40)]
    moves = [(n, 1, n % 40, draw, None) for n, draw in enumerate([3, 5, 2] * 40)]
    frame = spark.createDataFrame(stored, "g bigint, k bigint, a int, b bigint")
    got = refused_moves(frame, moves_frame(spark, moves), "g", "k", ("a", "b"))
    assert got.count() == 0 == len(plain_refused(stored, moves))


def test_one_group_with_a_third_of_all_moves_runs_in_many_tasks(spark):
    """The pairs (2n, 2n + 1) of the hot group want each other's place; no pair meets another one."""
    stored = [(1, k, 0, k // 2 * 10 + k % 2) for k in range(64)] + [(2 + k // 2, 100 + k, 0, k % 2) for k in range(64)]
    moves = []
    for n in range(900):
        key = n % 64 if n % 3 == 0 else 100 + n % 64
        own = next(b for _, k, _, b in stored if k == key)
        moves.append((n, next(g for g, k, *_ in stored if k == key), key, None, own - own % 10 + n % 3))
    frame = spark.createDataFrame(stored, "g bigint, k bigint, a int, b bigint")
    asked = moves_frame(spark, moves)
    got = refused_moves(frame, asked, "g", "k", ("a", "b"))
    assert sorted(r["request_id"] for r in got.collect()) == plain_refused(stored, moves)
    options = frame.selectExpr("*", "array(a) a_options", "array(b, b div 10 * 10, b div 10 * 10 + 1, b div 10 * 10 + 2) b_options")
    options = options.selectExpr("g", "k", "a", "b", "a_options", "array_distinct(b_options) b_options").where("g = 1")
    parts = _components(options, "g", "k", ("a", "b")).groupBy("component").count().collect()
    assert sorted(r["count"] for r in parts) == [2] * 32


def test_arrays_of_several_components():
    rows = pa.table(
        {"row": [7, 3, 9], "component": [3, 3, 9], "a": [0, 1, 0], "b": [1, 1, 0], "a_size": [2, 2, 1], "b_size": [2, 2, 4]}
    )
    state = _State(rows, ("a", "b"))
    assert state.held.sum() == 3 and len(state.held) == 8
    assert state.refused(np.array([7, 9]), np.array([[1, -1], [-1, 3]])).tolist() == [True, False]
    assert state.refused(np.array([3]), np.array([[0, 0]])).tolist() == [False]
    assert state.refused(np.array([7, 9]), np.array([[1, -1], [0, 3]])).tolist() == [False, False]
    assert state.at.tolist() == [[0, 0], [1, 1], [0, 3]]
