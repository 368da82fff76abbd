"""Every registered query against its SQL on the smallest sample."""

from __future__ import annotations

import pytest

import __spark_entry__
from checks.compare import compare, database
from checks.queries import DATASETS, JOBS, QUERIES
from wardline.plans.order import ORDER, in_display_order

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, name):
    agrees, text = compare(spark, connection, FOLDER, name)
    assert agrees, text


@pytest.mark.parametrize("name", ["patient_visits_summary", "doctor_discharge_stats", "patients_range", "book_slots"])
def test_results_do_not_depend_on_partitioning(spark, name):
    def result(partitions: int, adaptive: bool) -> list[tuple]:
        before = {n: spark.conf.get(n) for n in ("spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes")}
        frame = QUERIES[name](spark, FOLDER)
        spark.conf.set("spark.sql.adaptive.enabled", str(adaptive).lower())
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(partitions * 4096))
        try:
            return sorted(tuple(map(repr, row)) for row in frame.collect())
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
            for setting, value in before.items():
                spark.conf.set(setting, value)

    assert result(1, True) == result(13, False)


@pytest.mark.parametrize("name", sorted(set(ORDER) & set(QUERIES)))
def test_display_order_uses_columns_of_the_dataset(spark, name):
    frame = QUERIES[name](spark, FOLDER)
    assert in_display_order(name, frame).columns == frame.columns


def test_every_query_has_sql():
    own = set(DATASETS) | set(JOBS)
    assert own <= set(__spark_entry__.queries()) and own <= set(__spark_entry__.oracle_sql())


def test_entry_returns_the_flagship_report(spark):
    frame = __spark_entry__.entry(spark)
    assert frame.count() > 0 and "total_revenue" in frame.columns
