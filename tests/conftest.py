from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from wardline.session import local_session
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    session = local_session(cores=8, shuffle_partitions=4, app="wardline-tests")
    yield session
    session.stop()


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def on(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def table_frame(spark: SparkSession, name: str, rows: list[dict]) -> DataFrame:
    """A table in its declared schema; columns a row leaves out are NULL."""
    schema = TABLES[name].schema
    decimals = {c.name for c in TABLES[name].columns if c.type.startswith("decimal")}
    data = [
        {f: Decimal(str(row[f])) if f in decimals and row.get(f) is not None else row.get(f) for f in schema.fieldNames()}
        for row in rows
    ]
    return spark.createDataFrame(pa.Table.from_pylist(data, schema=to_arrow_schema(schema)), schema)


@pytest.fixture()
def hospital(spark) -> Callable[..., Tables]:
    """Tables from row dictionaries; all others are empty."""

    def build(**rows: list[dict]) -> Tables:
        return Tables({name: table_frame(spark, name, rows.get(name, [])) for name in TABLES})

    return build


@pytest.fixture()
def requests(spark) -> Callable[..., DataFrame]:
    """Request frames: ``request_id`` and ``requested_at`` follow the list order."""

    def build(schema: str, rows: list[tuple]) -> DataFrame:
        start = at("2024-01-01 08:00:00")
        data = [(i, start + dt.timedelta(minutes=i), *row) for i, row in enumerate(rows, start=1)]
        return spark.createDataFrame(data, f"request_id bigint, requested_at timestamp_ntz, {schema}")

    return build


def dicts(df: DataFrame, *keys: str) -> list[dict]:
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple((r[k] is not None, r[k]) for k in keys)) if keys else rows


# A small staff and calendar most tests share. 2024-03-03 is a Sunday.
DIMENSIONS = {
    "specializations": [{"specialization_id": 1, "specialization_name": "Cardiology"}],
    "doctors": [
        {"doctor_id": 10, "doctor_login_id": "D10", "first_name": "Ann", "last_name": "Lee", "age": 50,
         "specialization_id": 1, "consultation_fee": 100, "experience_years": 5, "registration_number": "R1", "room_no": 1},
        {"doctor_id": 20, "doctor_login_id": "D20", "first_name": "Bob", "last_name": "Ray", "age": 40,
         "specialization_id": 1, "consultation_fee": 50, "experience_years": 5, "registration_number": "R2", "room_no": 2},
    ],
    "patients": [
        {"patient_id": 1000 + i, "patient_login_id": f"P{1000 + i}", "first_name": f"F{i}", "last_name": "X", "age": 30,
         "gender": "Male", "created_at": at("2020-01-01")}
        for i in range(6)
    ],
    "receptionists": [{"receptionist_id": 5, "first_name": "Desk", "last_name": "One"}],
    "admin": [{"admin_id": 1, "username": "root"}],
    "time_slots": [
        {"slot_id": i, "slot_number": i, "start_min": 360 + 30 * (i - 1), "end_min": 390 + 30 * (i - 1)}
        for i in range(1, 5)
    ],
    "appointment_statuses": [
        {"status_id": 1, "status_name": "Scheduled"}, {"status_id": 2, "status_name": "Completed"},
        {"status_id": 3, "status_name": "Cancelled"},
    ],
    "action_types": [{"action_type_id": 1, "action_name": "Admit"}, {"action_type_id": 2, "action_name": "X-Ray"}],
}
