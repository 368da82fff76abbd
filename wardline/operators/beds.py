"""Bed rows generated from rooms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V


def beds_per_room(type_name: Column) -> Column:
    """Beds a room of this type holds; other types hold none."""
    return (
        F.when(type_name.ilike(f"{V.WARD_PREFIX}%"), F.lit(V.BEDS_PER_WARD))
        .when(F.lower(type_name) == V.PRIVATE_ROOM.lower(), F.lit(V.BEDS_PER_PRIVATE_ROOM))
        .otherwise(F.lit(0))
    )


def expand_beds(rooms: DataFrame, room_types: DataFrame) -> DataFrame:
    """One free bed row per place: ``bed_id, bed_code, room_id, bed_number, is_occupied``."""
    sized = rooms.join(room_types.select("room_type_id", "type_name"), "room_type_id").select(
        "room_id", "room_number", beds_per_room(F.col("type_name")).alias("places")
    )
    numbered = sized.filter("places > 0").select(
        "room_id", "room_number", F.explode(F.sequence(F.lit(1), "places")).alias("bed_number")
    )
    # Room ids are spaced by the ward size, so the key needs no numbering pass.
    return numbered.select(
        ((F.col("room_id") - 1) * V.BEDS_PER_WARD + F.col("bed_number")).cast("bigint").alias("bed_id"),
        F.concat("room_number", F.lit("-B"), F.col("bed_number").cast("string")).alias("bed_code"),
        "room_id",
        "bed_number",
        F.lit(False).alias("is_occupied"),
    )
