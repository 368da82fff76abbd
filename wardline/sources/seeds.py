"""Seed rows of the small dimensions as frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from wardline import fixed_values as V
from wardline.operators.beds import expand_beds
from wardline.sources.model import TABLES
from wardline.sources.tables import conform


def _numbered(spark: SparkSession, name: str, columns: str, rows: Iterable[tuple]) -> DataFrame:
    data = [(i, *row) for i, row in enumerate(rows, start=1)]
    return conform(spark.createDataFrame(data, f"{TABLES[name].key} bigint, {columns}"), name)


def specializations(spark: SparkSession) -> DataFrame:
    return _numbered(spark, "specializations", "specialization_name string, description string", V.SPECIALIZATIONS)


def appointment_statuses(spark: SparkSession) -> DataFrame:
    return _numbered(spark, "appointment_statuses", "status_name string", [(n,) for n in V.APPOINTMENT_STATUSES])


def action_types(spark: SparkSession) -> DataFrame:
    return _numbered(spark, "action_types", "action_name string", [(n,) for n in V.ACTION_TYPES])


def time_slots(spark: SparkSession) -> DataFrame:
    starts = [V.FIRST_SLOT_MINUTE + i * V.SLOT_MINUTES for i in range(V.SLOTS_PER_DAY)]
    rows = [(i, start, start + V.SLOT_MINUTES) for i, start in enumerate(starts, start=1)]
    return _numbered(spark, "time_slots", "slot_number int, start_min int, end_min int", rows)


def room_types(spark: SparkSession) -> DataFrame:
    frame = _numbered(spark, "room_types", "type_name string, description string, per_day_charges int", V.ROOM_TYPES)
    return frame.withColumn("per_day_charges", frame.per_day_charges.cast("decimal(10,2)"))


def rooms(spark: SparkSession) -> DataFrame:
    rows = [(number, kind, floor, False) for number, kind, floor in V.ROOMS]
    return _numbered(spark, "rooms", "room_number string, room_type_id bigint, floor_number int, is_occupied boolean", rows)


def beds(spark: SparkSession) -> DataFrame:
    return expand_beds(rooms(spark), room_types(spark))


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {
        "specializations": specializations(spark),
        "appointment_statuses": appointment_statuses(spark),
        "action_types": action_types(spark),
        "time_slots": time_slots(spark),
        "room_types": room_types(spark),
        "rooms": rooms(spark),
        "beds": beds(spark),
    }
