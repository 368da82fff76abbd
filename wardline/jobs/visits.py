"""Recording ward visits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, falsy
from wardline.functions.time import Moment
from wardline.jobs.result import JobResult, Keep, lazily, update
from wardline.operators.requests import AT, ID, as_table, first_reason, newest_value, with_new_key
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables

_TEXT = ("blood_pressure", "condition_status", "notes", "treatment_given")
_ALL = (
    "admission_id", "patient_id", "doctor_id", "temperature", "oxygen_saturation", "pulse_rate",
    "ready_for_discharge", "discharge_recommended_date", *_TEXT,
)


def _outside(value: Column, given: Column, limits: tuple[int, int]) -> Column:
    """A given value that is no number or lies outside the limits."""
    low, high = limits
    return given.isNotNull() & (value.isNull() | F.isnan(value) | (value < low) | (value > high))


def _whole(value: Column) -> Column:
    return F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))


def record_visits(t: Tables, rows: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Record visits of active admissions.

    Admission, patient and doctor must belong together, vitals lie in their ranges
    and the condition be one of the known ones. Vitals given as 0 are stored as not
    measured. A visit that recommends discharge dates the admission's discharge; the
    last one of the batch counts, and a date before the admission is left out.
    """
    kinds = TABLES["admitted_patient_visits"].by_name
    asked = rows.select(
        ID, AT, *[F.col(c) if c in rows.columns else F.lit(None).cast(kinds[c].type).alias(c) for c in _ALL]
    )
    numbers = {c: F.col(c).try_cast("double") for c in ("temperature", "oxygen_saturation", "pulse_rate")}
    whole = {c: _whole(numbers[c]) for c in ("oxygen_saturation", "pulse_rate")}
    stays = t.admissions.filter("is_active").select(
        "admission_id",
        F.col("patient_id").alias("stay_patient"),
        F.col("doctor_id").alias("stay_doctor"),
        F.col("admission_date").alias("stay_start"),
    )
    joined = asked.join(stays, "admission_id", "left")
    own = (F.col("stay_patient") == F.col("patient_id")) & (F.col("stay_doctor") == F.col("doctor_id"))
    condition = F.col("condition_status")
    reason = first_reason(
        (falsy("admission_id") | falsy("patient_id") | falsy("doctor_id"), V.FIELDS_REQUIRED),
        (~F.coalesce(own, F.lit(False)), V.VISIT_NO_ADMISSION),
        (_outside(numbers["temperature"], F.col("temperature"), V.TEMPERATURE_RANGE), V.VISIT_TEMPERATURE),
        (_outside(whole["oxygen_saturation"].cast("double"), F.col("oxygen_saturation"), V.OXYGEN_RANGE), V.VISIT_OXYGEN),
        (_outside(whole["pulse_rate"].cast("double"), F.col("pulse_rate"), V.PULSE_RANGE), V.VISIT_PULSE),
        (condition.isNotNull() & (condition != "") & ~condition.isin(*V.CONDITIONS), V.VISIT_CONDITION),
    )
    now = as_moment(as_of)
    # Vitals are known to be in range where they are used, so 0 is the only other case.
    stored = {
        "temperature": F.nullif(numbers["temperature"].try_cast("decimal(5,2)"), F.lit(0).cast("decimal(5,2)")),
        **{c: F.nullif(whole[c].try_cast("int"), F.lit(0)) for c in whole},
        **{c: F.nullif(F.col(c), F.lit("")) for c in _TEXT},
        "ready_for_discharge": F.coalesce("ready_for_discharge", F.lit(False)),
        "visit_datetime": now,
        "created_at": now,
    }
    decided = keep(joined.withColumn("reason", reason).withColumns(stored))
    decisions = with_new_key(decided, rows, t, "admitted_patient_visits")
    decisions = decisions.withColumn("visit_id", F.when(F.col("reason").isNull(), F.col("visit_id")))
    accepted = decisions.filter("reason is null")

    until = F.coalesce("discharge_recommended_date", now)
    dated = accepted.filter("ready_for_discharge").withColumn("until", until).filter("until >= stay_start")
    last = newest_value(dated, "admission_id", "until")
    return JobResult(
        decisions.select(ID, AT, "visit_id", *_ALL, "reason"),
        {"admitted_patient_visits": as_table(accepted, "admitted_patient_visits")},
        {"admissions": update(t, "admissions", last, {"discharge_date": F.col("new.until")})},
    )
