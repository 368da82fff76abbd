"""Shared column semantics on hand-made values."""

from __future__ import annotations

import pytest
from conftest import at, on
from pyspark.sql import functions as F

from wardline.functions import (
    as_moment,
    between_days,
    clock,
    contains_text,
    days_between,
    first_given,
    full_name,
    mean,
    months_before,
    or_default,
    same_text,
    spaced_name,
    started_days,
    to_last_second,
    weekday,
)
from wardline.session import checkpoint_folder, cluster_settings, stage


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_names_read_or_propagate_null(spark):
    df = spark.createDataFrame([("Ann", "Lee"), ("Ann", None), (None, None)], "first_name string, last_name string")
    got = df.select(full_name(), spaced_name(), full_name(title="Dr. ")).collect()
    assert [tuple(r) for r in got] == [
        ("Ann Lee", "Ann Lee", "Dr. Ann Lee"),
        ("Ann ", None, "Dr. Ann "),
        (" ", None, "Dr.  "),
    ]


def test_two_day_counts(spark):
    rows = [
        (at("2024-01-01 23:59:00"), at("2024-01-02 00:01:00")),
        (at("2024-01-01 00:01:00"), at("2024-01-01 23:59:00")),
        (at("2024-01-01 10:00:00"), at("2024-01-01 10:00:00")),
        (at("2024-01-01 10:00:00"), at("2024-01-03 10:00:00")),
        (at("2024-01-01 10:00:00"), at("2024-01-03 10:00:01")),
        (at("2024-01-02 10:00:00"), at("2024-01-01 09:00:00")),
    ]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    got = [tuple(r) for r in df.select(days_between("a", "b"), started_days("a", "b")).collect()]
    assert got == [(1, 1), (0, 1), (0, 0), (2, 2), (2, 3), (-1, -1)]


def test_weekday_starts_on_sunday(spark):
    df = spark.createDataFrame([(on(f"2024-03-0{d}"),) for d in range(3, 10)], "d date")
    assert [r[0] for r in df.select(weekday("d")).collect()] == [0, 1, 2, 3, 4, 5, 6]


def test_ranges_end_differently(spark):
    moments = ["2024-03-05 00:00:00", "2024-03-06 10:00:00", "2024-03-06 23:59:59", "2024-03-06 23:59:59.500", "2024-03-07"]
    df = spark.createDataFrame([(at(m),) for m in moments], "m timestamp_ntz")
    by_day = [r[0] for r in df.select(between_days("m", "2024-03-05", "2024-03-06")).collect()]
    by_second = [r[0] for r in df.select(to_last_second("m", "2024-03-05", "2024-03-06")).collect()]
    plain = [r[0] for r in df.select(F.col("m") <= as_moment("2024-03-06")).collect()]
    assert by_day == [True, True, True, True, False]
    assert by_second == [True, True, True, False, False]
    assert plain == [True, False, False, False, False]


def test_months_clip_at_the_end(spark):
    assert one(spark, months_before("2024-03-31 08:00:00", 1)) == at("2024-02-29 08:00:00")
    assert one(spark, months_before("2024-02-29", 12)) == at("2023-02-28")


def test_text_and_defaults(spark):
    df = spark.createDataFrame([("Paid", 0, ""), ("PAID", 5, "x"), (None, None, None)], "s string, n int, e string")
    got = df.select(
        same_text("s", "paid"), or_default("n", F.lit(1000)), first_given("e", "none"), contains_text("s", "a_d")
    ).collect()
    assert [tuple(r) for r in got] == [(True, 1000, "none", True), (True, 5, "x", True), (None, 1000, "none", None)]


def test_clock_and_mean(spark):
    assert one(spark, clock(F.lit(365))) == "06:05:00"
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    assert df.agg(mean("n")).first()[0] == 1.5
    assert df.filter("n > 9").agg(mean("n")).first()[0] is None


def test_shuffle_partitions_follow_the_data():
    small, large = cluster_settings(10**9, 16), cluster_settings(100 * 10**12, 8000)
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    assert (small[name], int(large[name]) > 700_000) == ("32", True)


def test_checkpoints_go_where_the_cluster_says(spark):
    folder = checkpoint_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir", None) or folder.startswith(spark.conf.get("spark.sql.warehouse.dir"))
    staged = stage(spark.range(3).selectExpr("id * 2 as n"))
    assert sorted(r["n"] for r in staged.collect()) == [0, 2, 4]
    assert "Project" not in staged._jdf.queryExecution().optimizedPlan().toString()
