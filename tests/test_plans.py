"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from conftest import DIMENSIONS, at, on
from test_datasets import ROOMS, stay, visit

from checks.queries import QUERIES
from wardline.jobs import booking
from wardline.plans import billing, reports, visits, wards
from wardline.session import cluster_settings, stage
from wardline.sources import sinks
from wardline.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    """Plans as they are when no table is small enough to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_query_needs_a_product_a_python_worker_or_a_global_window(no_broadcast, name):
    text = plan(QUERIES[name](no_broadcast, FOLDER))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastExchange", "EvalPython", "MapInPandas"):
        assert operator not in text, operator
    # One partition is for totals and limits only: its rows come from partial results.
    for match in re.finditer(r"Exchange SinglePartition.*\n(.*)", text):
        assert "Aggregate" in match.group(1) or "partial_" in match.group(1), match.group(0)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory) -> Tables:
    root = str(tmp_path_factory.mktemp("hospital"))
    from conftest import table_frame
    from wardline.sources.model import TABLES

    rows = {
        **DIMENSIONS, **ROOMS,
        "appointments": [{"appointment_id": 1, "patient_id": 1000, "doctor_id": 10, "appointment_date": on("2024-03-02"),
                          "slot_id": 1, "status_id": 2}],
        "admissions": [stay(1)],
        "admitted_patient_visits": [visit(1, 1, "2024-03-02 08:00:00", ready=True)],
        "discharges": [{"discharge_id": 1, "admission_id": 9, "patient_id": 1000, "doctor_id": 10,
                        "discharge_date": at("2024-03-02"), "total_amount": 1}],
    }
    for name in TABLES:
        sinks.write_table(table_frame(spark, name, rows.get(name, [])), name, f"{root}/{name}")
    return Tables.parquet(spark, root)


def scans(text: str, table: str) -> list[str]:
    return [line for line in text.splitlines() if "FileScan" in line and f"/{table}]" in line]


def test_filters_and_columns_reach_the_scan(stored, no_broadcast):
    text = plan(reports.doctors_range(stored, "2024-03-01", "2024-03-31"))
    (line,) = scans(text, "appointments")
    assert "GreaterThanOrEqual(appointment_date,2024-03-01)" in line
    assert "(month#" in line and ">= 2024-03)" in line and "<= 2024-03)" in line
    assert "ReadSchema: struct<appointment_id:bigint,doctor_id:bigint,appointment_date:date,status_id:bigint>" in line
    (line,) = scans(text, "admitted_patient_visits")
    assert "GreaterThanOrEqual(visit_datetime,2024-03-01T00:00)" in line
    (line,) = scans(text, "consultations")
    assert "ReadSchema: struct<appointment_id:bigint>" in line
    text = plan(reports.daily_summary(stored, "2024-03-02"))
    assert all("PushedFilters: [IsNotNull" in line for name in ("patients", "appointments", "admissions")
               for line in scans(text, name))
    (line,) = scans(plan(wards.active_admissions_report(stored)), "admissions")
    assert "EqualTo(is_active,true)" in line
    (line,) = scans(plan(billing.doctor_discharge_stats(stored, "2024-03-31")), "discharges")
    assert "GreaterThanOrEqual(discharge_date,2024-02-29T00:00)" in line and ">= 2024-01)" in line


def test_the_daily_patient_report_reads_no_billing_tables(stored, no_broadcast):
    text = plan(reports.daily_patients(stored, "2024-03-02"))
    assert not scans(text, "consultations") and not scans(text, "discharges") and not scans(text, "doctors")


def test_groups_are_cut_before_the_shuffle(stored, no_broadcast):
    for df in (
        visits.doctor_recent_visits(stored),
        billing.doctor_discharged_patients(stored),
    ):
        text = plan(df)
        partial = re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*WindowGroupLimit[^\n]*Partial", text)
        assert partial, text


def test_latest_moments_are_partial_before_the_shuffle(stored, no_broadcast):
    text = plan(visits.ready_for_discharge(stored, "2024-03-03"))
    assert re.search(r"Exchange hashpartitioning\(admission_id[^\n]*\n[^\n]*partial_max\(visit_datetime", text), text
    assert "Window" not in text


def test_booking_reduces_a_hot_slot_before_its_rows_meet(stored, no_broadcast, requests):
    asked = requests("patient_id bigint, doctor_id bigint, appointment_date date, slot_id bigint",
                     [(1000, 10, on("2024-03-04"), 1)])
    plans: list[str] = []

    def keep(df):
        plans.append(plan(df))
        return stage(df)

    booking.book_slots(stored, asked, "2024-03-03", keep=keep)
    partial = r"Exchange hashpartitioning\(doctor_id[^\n]*\n[^\n]*partial_min"
    # the first of equal requests, then the first of each slot and of each patient
    assert re.search(partial, plans[1]), plans[1]
    assert len(re.findall(partial, plans[2])) == 2, plans[2]
    assert not any("Window" in text for text in plans)


def test_limits_do_not_sort_the_table(stored, no_broadcast):
    text = plan(billing.recent_discharges(stored))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_a_hot_key_is_split_at_the_join(spark, no_broadcast, hospital):
    """A third of all discharges belong to one patient; its join partition is split."""
    from pyspark.sql import functions as F

    settings = {
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(0, 120_000, 1, 8)
        hot = F.when(F.col("id") % 3 == 0, 1000).otherwise(1000 + F.pmod(F.xxhash64("id"), F.lit(5000)))
        bills = rows.select(
            F.col("id").alias("discharge_id"), F.col("id").alias("admission_id"), hot.cast("bigint").alias("patient_id"),
            F.lit(10).cast("bigint").alias("doctor_id"), F.lit(5).cast("bigint").alias("processed_by_receptionist_id"),
            F.lit(at("2024-03-01")).alias("discharge_date"),
        )
        people = spark.range(1000, 6000, 1, 8).select(
            F.col("id").alias("patient_id"), F.lit("A").alias("first_name"), F.lit("B").alias("last_name")
        )
        t = hospital(**DIMENSIONS).replacing(discharges=bills, patients=people)
        df = billing.discharge_search(t, "cardio")
        assert len(df.collect()) == 120_000
        assert "skew=true" in plan(df)
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_partitions_follow_the_bytes():
    numbers = [int(cluster_settings(size, 100)["spark.sql.shuffle.partitions"]) for size in (1 << 40, 10 << 40)]
    assert numbers[1] == 10 * numbers[0] > 1000
