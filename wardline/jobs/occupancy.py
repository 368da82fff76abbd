"""Bed flags and the room occupancy that follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.jobs.result import JobResult, Keep, update
from wardline.operators.requests import AT, ID, newest_value
from wardline.operators.segments import in_ranges, previous, running_sum
from wardline.session import stage
from wardline.sources.tables import Tables


def room_occupancy(beds: DataFrame) -> DataFrame:
    """Per room: whether all beds are occupied, and whether any is."""
    return beds.groupBy("room_id").agg(
        F.bool_and(F.coalesce("is_occupied", F.lit(False))).alias("room_full"),
        F.bool_or(F.coalesce("is_occupied", F.lit(False))).alias("room_in_use"),
    )


def recompute_room_occupancy(t: Tables) -> DataFrame:
    """Every room with both occupancy measures; a room without beds is neither."""
    return t.rooms.join(room_occupancy(t.beds), "room_id", "left").select(
        *t.rooms.columns,
        F.coalesce("room_full", F.lit(False)).alias("room_full"),
        F.coalesce("room_in_use", F.lit(False)).alias("room_in_use"),
    )


def filled_rooms(beds: DataFrame, accepted: DataFrame, keep: Keep = stage) -> DataFrame:
    """Rooms all of whose beds were occupied right after some request that occupied one.

    A request changes the number of occupied beds of its room by its flag less the one
    before it on that bed; running sums of these changes give the number at any turn. It
    never exceeds the beds, so the largest one tells. A room or a bed may hold a large
    share of the requests: both steps work inside ranges of the batch.
    """
    flag = F.coalesce("is_occupied", F.lit(False)).cast("int")
    stored = beds.select("bed_id", flag.alias("stored"))
    counts = beds.groupBy("room_id").agg(F.sum(flag).alias("taken"), F.count(F.lit(1)).alias("beds"))
    asked = accepted.select("room_id", "bed_id", AT, ID, flag.alias("flag")).join(stored, "bed_id")
    turns = previous(in_ranges(asked, (AT, ID), keep=keep), "bed_id", (AT, ID), "flag", "before")
    turns = turns.withColumn("change", F.col("flag") - F.coalesce("before", "stored"))
    turns = running_sum(turns, "room_id", (AT, ID), "change", "more").filter("flag = 1")
    most = turns.groupBy("room_id").agg(F.max("more").alias("most"))
    return most.join(counts, "room_id").filter("taken + most = beds").select("room_id")


def set_bed_flags(t: Tables, requests: DataFrame, release: bool = True) -> JobResult:
    """Set the occupied flag of beds and recompute their rooms.

    ``requests`` holds request_id, requested_at, bed_id and is_occupied; the last
    request of a bed counts. A room becomes occupied when all its beds are. With
    ``release`` it also becomes free when one is not. Without, it stays occupied, so a
    room that was full at any turn of the batch is occupied after it.
    """
    known = t.beds.select("bed_id", "room_id")
    decisions = requests.join(known, "bed_id", "left").withColumn(
        "reason", F.when(F.col("room_id").isNull(), F.lit(V.BED_NOT_FOUND))
    )
    last = newest_value(decisions.filter("reason is null"), "bed_id", "is_occupied")
    beds = update(t, "beds", last, {"is_occupied": F.coalesce("new.is_occupied", F.lit(False))})
    if release:
        touched = beds.changed.select("room_id").distinct()
        rooms = room_occupancy(beds.state).join(touched, "room_id", "left_semi").select("room_id", "room_full")
    else:
        rooms = filled_rooms(t.beds, decisions.filter("reason is null")).withColumn("room_full", F.lit(True))
    return JobResult(
        decisions.drop("room_id"),
        updated={
            "beds": beds,
            "rooms": update(t, "rooms", rooms, {"is_occupied": F.col("new.room_full")}),
        },
    )


def set_room_flags(t: Tables, requests: DataFrame) -> JobResult:
    """Set the occupied flag of rooms directly; the last request of a room counts."""
    known = t.rooms.select("room_id", F.lit(True).alias("known"))
    decisions = requests.join(known, "room_id", "left").withColumn(
        "reason", F.when(F.col("known").isNull(), F.lit(V.NOT_FOUND))
    )
    last = newest_value(decisions.filter("reason is null"), "room_id", "is_occupied")
    values = {"is_occupied": F.coalesce("new.is_occupied", F.lit(False))}
    return JobResult(decisions.drop("known"), updated={"rooms": update(t, "rooms", last, values)})
