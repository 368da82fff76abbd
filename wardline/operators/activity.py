"""Activity of doctors and patients, without building the row product.

The activity reports sum fees over appointment x visit x admission rows of one
person. Each fact is reduced to one row per person first; the totals of the
product follow from these counts. With ``n`` appointments (``c`` completed),
``v`` visits and ``m`` admissions of a doctor, every appointment row is repeated
max(v, 1) * max(m, 1) times, so the fee total is fee * c * max(v, 1) * max(m, 1)
and rates are unchanged. Patients add an "any side matches" filter, see
``patient_activity``. The ``*_exact`` measures count every fee once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_day, as_moment, between_days, money, to_last_second
from wardline.functions.time import Moment, to_datetime
from wardline.operators.spread import spread_join
from wardline.sources.tables import Tables


# How a timestamp lies in a range of days: by calendar day, or to the last full second.
Within = Callable[[str, Moment, Moment], Column]
BY_DAY: Within = between_days
BY_SECOND: Within = to_last_second


def zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))


def at_least_one(column: str) -> Column:
    return F.greatest(zero(column), F.lit(1))


def _with_consultation(appointments: DataFrame, consultations: DataFrame) -> DataFrame:
    """Mark appointments that have a consultation (at most one each)."""
    done = consultations.select("appointment_id", F.lit(True).alias("consulted"))
    return appointments.join(done, "appointment_id", "left")


def _side_by_side(*parts: DataFrame) -> DataFrame:
    """Rows of several facts under each other, so that one aggregate counts them all."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), parts)


def doctor_activity(
    t: Tables,
    first: Moment,
    last: Moment,
    within: Within,
    skip_cancelled: bool = False,
    consulted_in_range: bool = False,
    admissions: bool = True,
) -> DataFrame:
    """All doctors with the counts of their facts in a range of days.

    The facts are counted in one aggregate: a single shuffle of partial counts.
    """
    booked = t.of_months("appointments", first, last)
    booked = booked.filter(F.col("appointment_date").between(as_day(first), as_day(last)))
    if skip_cancelled:
        booked = booked.filter(F.col("status_id") != V.CANCELLED)
    consultations = t.consultations
    if consulted_in_range:
        consultations = t.of_months("consultations", first, last).filter(within("consultation_date", first, last))
    booked = _with_consultation(booked.select("appointment_id", "doctor_id", "status_id"), consultations)
    visits = t.of_months("admitted_patient_visits", first, last).filter(within("visit_datetime", first, last))
    facts = [
        booked.select("doctor_id", "appointment_id", "status_id", "consulted"),
        visits.select("doctor_id", "visit_id"),
    ]
    if admissions:
        stays = t.of_months("admissions", first, last).filter(within("admission_date", first, last))
        facts.append(stays.select("doctor_id", "admission_id"))
    status = F.col("status_id")
    counts = [
        F.count("appointment_id").alias("appointments"),
        F.count_if(status == V.COMPLETED).alias("completed"),
        F.count_if(status == V.SCHEDULED).alias("scheduled"),
        F.count_if(status == V.CANCELLED).alias("cancelled"),
        F.count("consulted").alias("consultations"),
        F.count("visit_id").alias("visits"),
    ]
    if admissions:
        counts.append(F.count("admission_id").alias("admissions"))
    per_doctor = _side_by_side(*facts).groupBy("doctor_id").agg(*counts)
    names = t.specializations.select("specialization_id", "specialization_name")
    return t.doctors.join(names, "specialization_id").join(per_doctor, "doctor_id", "left")


def touched_patients(t: Tables, first: Moment, last: Moment, within: Within) -> DataFrame:
    """Patients who registered, had an appointment or were admitted in the range."""
    inside = F.col("appointment_date").between(as_day(first), as_day(last))
    parts = (
        t.patients.filter(within("created_at", first, last)),
        t.of_months("appointments", first, last).filter(inside),
        t.of_months("admissions", first, last).filter(within("admission_date", first, last)),
    )
    return reduce(DataFrame.unionAll, [p.select("patient_id") for p in parts]).distinct()


def patient_activity(t: Tables, first: Moment, last: Moment, within: Within, billing: bool = True) -> DataFrame:
    """Per patient touched in the range: counts and fee totals of the surviving rows.

    A row of the product of a patient's appointments and admissions survives if the
    patient registered in the range, or its appointment or its admission lies in it.
    With a_in / a_all appointments and d_in / d_all admissions:

    * registered in the range: every row survives, each appointment max(d_all, 1) times;
    * otherwise: an appointment in the range survives max(d_all, 1) times, another one
      once per admission in the range.

    So all appointments count if the patient registered in the range or d_in > 0, else
    those in the range; the same holds for admissions with a_in. ``since_all`` counts
    admissions from ``first`` on without an upper end. The touched patients are found
    first, from the range alone, and cut the all-time facts down where they are read.
    Without ``billing``, consultations, discharges and fees are left out.
    """
    touched = touched_patients(t, first, last, within)
    status = F.col("status_id")
    booked = spread_join(t.appointments, touched, ["patient_id"], "left_semi", "appointment_id").withColumn(
        "inside", F.col("appointment_date").between(as_day(first), as_day(last))
    )
    stays = spread_join(t.admissions, touched, ["patient_id"], "left_semi", "admission_id").withColumns(
        {
            "stay_inside": within("admission_date", first, last),
            "since": F.col("admission_date") >= as_moment(to_datetime(first).date()),
        }
    )
    inside, stay_inside = F.col("inside"), F.col("stay_inside")
    counts = [
        F.count("appointment_id").alias("a_all"),
        F.count_if(inside).alias("a_in"),
        F.count("admission_id").alias("d_all"),
        F.count_if(stay_inside).alias("d_in"),
        F.count_if("since").alias("since_all"),
    ]
    columns_a, columns_d = ["patient_id", "appointment_id", "inside"], ["patient_id", "admission_id", "stay_inside", "since"]
    if billing:
        fee = t.doctors.select("doctor_id", "consultation_fee")
        paid = F.when(status == V.COMPLETED, F.coalesce("consultation_fee", F.lit(0))).otherwise(F.lit(0))
        booked = _with_consultation(booked, t.consultations).join(fee, "doctor_id", "left").withColumn("paid", paid)
        day = F.col("appointment_date")
        released = t.discharges.select("admission_id", F.lit(True).alias("released"))
        stays = stays.join(released, "admission_id", "left")
        columns_a += ["appointment_date", "consulted", "paid"]
        columns_d += ["released"]
        counts += [
            F.count("consulted").alias("c_all"),
            F.count_if(inside & F.col("consulted")).alias("c_in"),
            F.sum("paid").alias("fee_all"),
            F.sum(F.when(inside, F.col("paid"))).alias("fee_in"),
            F.min(day).alias("first_all"),
            F.max(day).alias("last_all"),
            F.min(F.when(inside, day)).alias("first_in"),
            F.max(F.when(inside, day)).alias("last_in"),
            F.count("released").alias("r_all"),
            F.count_if(stay_inside & F.col("released")).alias("r_in"),
        ]
    per_patient = _side_by_side(booked.select(*columns_a), stays.select(*columns_d)).groupBy("patient_id").agg(*counts)
    # The counts tell who was touched, so the touched patients need no further join here.
    joined = (
        t.patients.withColumn("registered", F.coalesce(within("created_at", first, last), F.lit(False)))
        .join(per_patient, "patient_id", "left")
        .filter(F.col("registered") | (zero("a_in") > 0) | (zero("d_in") > 0))
    )
    all_appointments = F.col("registered") | (zero("d_in") > 0)
    all_admissions = F.col("registered") | (zero("a_in") > 0)

    def of_appointments(name: str) -> Column:
        return F.when(all_appointments, F.col(f"{name}_all")).otherwise(F.col(f"{name}_in"))

    def of_admissions(name: str) -> Column:
        return F.when(all_admissions, F.col(f"{name}_all")).otherwise(F.col(f"{name}_in"))

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0))

    columns: list[Column | str] = [
        "patient_id", "patient_login_id", "first_name", "last_name", "age", "gender", "blood_group", "phone_no",
        "created_at",
        or_zero(of_appointments("a")).alias("appointments"),
        zero("a_in").alias("appointments_in"),
        or_zero(of_admissions("d")).alias("admissions"),
        zero("d_in").alias("admissions_in"),
        # An admission of a later day is seen only through rows that survive anyway.
        F.when(all_admissions, zero("since_all")).otherwise(zero("d_in")).alias("admissions_since"),
    ]
    if billing:
        repeats = at_least_one("d_all")
        outside = zero("fee_all") - zero("fee_in")
        spent = F.when(F.col("registered"), zero("fee_all") * repeats).otherwise(
            zero("fee_in") * repeats + outside * zero("d_in")
        )
        columns += [
            or_zero(of_appointments("c")).alias("consultations"),
            or_zero(of_admissions("r")).alias("discharges"),
            of_appointments("first").alias("first_appointment_date"),
            of_appointments("last").alias("last_appointment_date"),
            money(spent).alias("spent"),
            money(or_zero(of_appointments("fee"))).alias("spent_exact"),
        ]
    return joined.select(*columns)
