"""Wall time of the headline queries on one machine, as one JSON line.

Each query is materialised in full (``noop`` sink): after a warm-up pass over all of
them, the median of three runs, the building of the plan included. ``--product`` adds the activity reports in their plain join form, the
baseline the closed forms are compared with.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import pyspark
from pyspark.sql import DataFrame, SparkSession

from checks.queries import QUERIES
from wardline.session import local_session
from wardline.sources.sample import REPORT_RANGE, hospital_tables

HEADLINE = (
    "doctors_range",
    "patients_range",
    "daily_patients",
    "daily_doctors",
    "ready_for_discharge",
    "doctor_visits_summary",
    "patient_visits_summary",
    "doctor_patients_summary",
    "discharge_search",
    "weekly_availability",
    "medical_report",
    "patient_admitted_visits",
    "book_slots",
    "admit",
    "discharge_total_bill",
)
RUNS = 3


def doctors_product(spark: SparkSession, folder: str) -> DataFrame:
    """Doctors report over appointment x visit x admission rows."""
    t = hospital_tables(spark, folder)
    names = ("doctors", "specializations", "appointments", "consultations", "admitted_patient_visits", "admissions")
    first, last = REPORT_RANGE
    return spark.sql(
        f"""
        select d.doctor_id, count(distinct a.appointment_id) appointments, count(distinct c.consultation_id) consultations,
          count(distinct v.visit_id) visits, count(distinct h.admission_id) admissions,
          sum(case when a.status_id = 2 then d.consultation_fee else 0 end) revenue
        from {{doctors}} d join {{specializations}} s on s.specialization_id = d.specialization_id
        left join {{appointments}} a on a.doctor_id = d.doctor_id and a.appointment_date between '{first}' and '{last}'
        left join {{consultations}} c on c.appointment_id = a.appointment_id
        left join {{admitted_patient_visits}} v on v.doctor_id = d.doctor_id
          and v.visit_datetime between '{first}' and '{last} 23:59:59'
        left join {{admissions}} h on h.doctor_id = d.doctor_id
          and h.admission_date between '{first}' and '{last} 23:59:59'
        group by d.doctor_id""",
        **{name: t[name] for name in names},
    )


def run(spark: SparkSession, folder: str, query) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="wardline-bench")
    chosen = {name: QUERIES[name] for name in HEADLINE}
    if "--product" in sys.argv:
        chosen["doctors_range_product"] = doctors_product
    for query in chosen.values():
        run(spark, folder, query)
    times = {
        name: round(statistics.median(run(spark, folder, query) for _ in range(RUNS)), 3)
        for name, query in chosen.items()
    }
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cores,
                "spark": pyspark.__version__,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
