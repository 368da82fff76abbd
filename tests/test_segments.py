"""Running values inside ranges, against plain loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from conftest import dicts

from wardline.jobs import occupancy
from wardline.operators.segments import RANGE, in_ranges, previous, running_sum

ORDER = ("at", "id")


def some_rows(seed: int, size: int = 400) -> list[tuple]:
    """A third of the rows in one group, many of them at the same moment."""
    rng = random.Random(seed)
    return [(rng.choice([rng.randrange(50), 7]), i, "hot" if i % 3 == 0 else f"g{rng.randrange(5)}", rng.randrange(-3, 4)) for i in range(size)]


@pytest.mark.parametrize(("seed", "ranges"), [(1, 9), (2, 1), (3, 40)])
def test_running_values_equal_a_loop(spark, seed, ranges):
    data = some_rows(seed)
    frame = in_ranges(spark.createDataFrame(data, "at int, id long, g string, v int"), ORDER, ranges)
    got = dicts(running_sum(previous(frame, "g", ORDER, "v", "before"), "g", ORDER, "v", "total"), "at", "id")
    last, total, want = {}, defaultdict(int), []
    for at, i, g, v in sorted(data):
        total[g] += v
        want.append((at, i, last.get(g), total[g]))
        last[g] = v
    assert [(r["at"], r["id"], r["before"], r["total"]) for r in got] == want


def test_a_hot_group_lies_in_many_ranges(spark):
    frame = in_ranges(spark.createDataFrame(some_rows(4, 2000), "at int, id long, g string, v int"), ORDER, 16)
    sizes = {(r["g"], r[RANGE]): r["count"] for r in frame.groupBy("g", RANGE).count().collect()}
    hot = [n for (g, _), n in sizes.items() if g == "hot"]
    assert len(hot) >= 12 and max(hot) <= sum(hot) / 6
    borders = frame.groupBy(RANGE).agg({"at": "max"}).orderBy(RANGE).collect()
    assert [r[1] for r in borders] == sorted(r[1] for r in borders)


def test_no_rows(spark):
    frame = in_ranges(spark.createDataFrame([], "at int, id long, g string, v int"), ORDER, 4)
    assert running_sum(previous(frame, "g", ORDER, "v", "before"), "g", ORDER, "v", "total").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_one_way_rooms_equal_a_loop_with_a_hot_room(spark, hospital, requests, seed):
    rng = random.Random(seed)
    beds = [{"bed_id": 10 * room + k, "room_id": room, "bed_number": k, "is_occupied": rng.random() < 0.4} for room in range(1, 6) for k in range(1, 4)]
    rooms = [{"room_id": room, "room_number": str(room), "is_occupied": room == 5} for room in range(1, 6)]
    rows = [(11 + rng.randrange(3) if i % 3 == 0 else rng.choice([b["bed_id"] for b in beds] + [999]), rng.choice([True, False, None])) for i in range(90)]
    t = hospital(beds=beds, rooms=rooms)
    result = occupancy.set_bed_flags(t, requests("bed_id bigint, is_occupied boolean", rows), release=False)
    flags = {b["bed_id"]: b["is_occupied"] for b in beds}
    state = {r["room_id"]: r["is_occupied"] for r in rooms}
    for bed, flag in rows:
        if bed not in flags:
            continue
        flags[bed] = bool(flag)
        room = bed // 10
        if flag and all(flags[b["bed_id"]] for b in beds if b["room_id"] == room):
            state[room] = True
    assert {r["room_id"]: r["is_occupied"] for r in dicts(result.updated["rooms"].state)} == state


def test_no_window_by_room_over_the_requests(spark, hospital, requests):
    t = hospital(beds=[{"bed_id": 1, "room_id": 1, "bed_number": 1}], rooms=[{"room_id": 1, "room_number": "1"}])
    asked = requests("bed_id bigint, is_occupied boolean", [(1, True)])
    plan = occupancy.set_bed_flags(t, asked, release=False).updated["rooms"].state._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition" in line]
    over_rows = [w for w in windows if "requested_at" in w or "request_id" in w]
    assert over_rows and all(RANGE in w for w in over_rows)
