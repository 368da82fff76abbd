"""Properties of the sample adapter that hold at every size."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.sources.sample import Sample

FOLDER = "/root/testdata/sf0.001"


def test_line_keys_stay_distinct_for_large_parts_and_suppliers(spark):
    lines = spark.range(4000).selectExpr(
        "id % 40 l_orderkey",
        "cast(id % 7 + 1 as int) l_linenumber",
        "100000 + id * 50 % 100000 l_partkey",
        "10000 - id % 9000 l_suppkey",
    )
    keyed = Sample(spark, FOLDER)._numbered(lines.distinct(), "key")
    total, different, orders = keyed.agg(F.count("key"), F.countDistinct("key"), F.countDistinct("l_orderkey")).first()
    assert total == different > 3000 and orders == 40


def test_beds_and_requests_reach_all_rooms(spark):
    sample = Sample(spark, FOLDER)
    beds = {r["bed_id"] for r in sample.beds().collect()}
    stays = {r["bed_id"] for r in sample.admissions().select("bed_id").distinct().collect()}
    assert beds == set(range(1, len(beds) + 1)) and stays <= beds
    assert sample.rooms().count() * 81 == len(beds) * 11


def test_schedules_of_one_small_file_are_made_by_all_tasks(spark, tmp_path):
    spark.range(500).selectExpr("id s_suppkey", "concat('S#', id) s_name", "cast(id % 25 as int) s_nationkey", "0.5D s_acctbal").coalesce(
        1
    ).write.parquet(f"{tmp_path}/supplier.parquet")
    made = Sample(spark, str(tmp_path)).doctor_schedules().groupBy(F.spark_partition_id()).count().collect()
    assert len(made) == 4 and sum(r["count"] for r in made) == 500 * 7 * 16
    assert max(r["count"] for r in made) < 2 * min(r["count"] for r in made)
