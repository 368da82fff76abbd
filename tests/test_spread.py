"""Salted joins: the same rows as a plain join, and no task with a whole hot key."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wardline.operators.spread import WAYS, spread_join

ROWS = 30_000


@pytest.fixture()
def sides(spark):
    left = spark.range(ROWS).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 5000).alias("key"),
    )
    right = left.filter("key % 2 = 1").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return left, right


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti", "inner"])
def test_equals_the_plain_join(sides, how):
    left, right = sides
    plain = left.join(right, ["key"], how)
    spread = spread_join(left, right, ["key"], how, "request_id")
    assert sorted(spread.columns) == sorted(plain.columns)
    columns = sorted(plain.columns)
    assert sorted(map(repr, spread.select(*columns).collect())) == sorted(map(repr, plain.select(*columns).collect()))


def test_a_hot_key_lies_in_several_tasks(spark, sides):
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "32",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        left, right = sides
        joined = spread_join(left, right, ["key"], "left", "request_id")
        hot = joined.filter("key = 7").groupBy(F.spark_partition_id()).count().collect()
        assert len(hot) > WAYS / 2 and max(r["count"] for r in hot) < ROWS / 3 / 2
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
