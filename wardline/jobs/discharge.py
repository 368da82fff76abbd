"""Discharging patients and billing the stay, in three modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, falsy, or_default, started_days
from wardline.functions.time import Moment
from wardline.jobs.occupancy import room_occupancy
from wardline.jobs.result import JobResult, Keep, lazily, update
from wardline.operators.requests import (
    AT,
    ID,
    as_table,
    first_reason,
    turn,
    winners,
    with_known,
    with_new_key,
    with_references,
)
from wardline.operators.spread import spread_join
from wardline.sources.tables import Tables

BILL = "decimal(12,2)"
# A stored amount has ten digits; a larger one is rejected instead of failing the batch.
LARGEST = "99999999.99"
CHARGES = ("room_charges", "medical_charges", "doctor_visit_charges", "lab_charges", "other_charges")
_DETAILS = (
    "final_diagnosis", "discharge_summary", "discharge_instructions", "follow_up_required", "follow_up_date",
    "discharge_approved_by_visit_id",
)


def _amount(column: Column | str) -> Column:
    """An amount as given; one too large for the type reads as just above the largest."""
    value = F.col(column) if isinstance(column, str) else column
    return F.when(value.isNotNull(), F.coalesce(value.try_cast(BILL), F.lit("100000000").cast(BILL)))


def _too_large(column: str) -> Column:
    return F.col(column) > F.lit(LARGEST).cast(BILL)


def _first_of_stay(checked: DataFrame, closed_reason: str) -> DataFrame:
    """Let the first valid request close a stay; later ones find it closed."""
    first = winners(checked.filter("own_reason is null"), ["admission_id"])
    late = F.coalesce(F.col("winner_turn") < turn(), F.lit(False))
    return spread_join(checked, first, ["admission_id"], "left", ID).withColumn(
        "reason", F.when(late & ~F.col("before_stay"), F.lit(closed_reason)).otherwise(F.col("own_reason"))
    )


def _with_discharge(decided: DataFrame, requests: DataFrame, t: Tables) -> DataFrame:
    return with_new_key(decided, requests, t, "discharges").withColumn(
        "discharge_id", F.when(F.col("reason").isNull(), F.col("discharge_id"))
    )


def _already_billed(t: Tables, frame: DataFrame) -> DataFrame:
    return with_known(frame, t.discharges, "admission_id", "billed")


def _closed(t: Tables, accepted: DataFrame, now: Column):
    values = {"is_active": F.lit(False), "discharge_date": now}
    return update(t, "admissions", accepted.select("admission_id"), values)


def discharge_total_bill(t: Tables, requests: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Split a total bill into room and medical charges, paid in full.

    Requests hold admission_id, bed_id, total_bill, discharged_by_receptionist_id and
    optionally discharge_date. A stay counts at least one day; a room without a daily
    charge costs the default; a bill below the room charges is rejected. The stay is
    closed, the bed freed, and the room is occupied while any of its beds is.
    """
    now = as_moment(as_of)
    ends = F.col("discharge_date") if "discharge_date" in requests.columns else F.lit(None).cast("timestamp_ntz")
    desk = F.col("discharged_by_receptionist_id")
    asked = requests.select(
        ID, AT, "admission_id", "bed_id", _amount("total_bill").alias("total_bill"),
        desk.alias("processed_by_receptionist_id"), F.coalesce(ends, now).alias("discharge_date"),
    )
    charges = t.rooms.select(F.col("room_id").alias("initial_room_id"), "room_type_id").join(
        t.room_types.select("room_type_id", "per_day_charges"), "room_type_id", "left"
    )
    stays = (
        t.admissions.filter("is_active")
        .select("admission_id", "patient_id", "doctor_id", "initial_room_id", "admission_date")
        .join(t.patients.select("patient_id"), "patient_id", "left_semi")
        .join(t.doctors.select("doctor_id"), "doctor_id", "left_semi")
        .join(charges, "initial_room_id")
    )
    joined = asked.join(stays, "admission_id", "left")
    joined = with_known(joined, t.receptionists, "processed_by_receptionist_id", "desk_known", "receptionist_id")
    joined = _already_billed(t, joined)
    # GREATEST skips NULL, so a request without a stay is kept without days.
    days = F.when(
        F.col("admission_date").isNotNull(), F.greatest(F.lit(1), started_days("admission_date", "discharge_date"))
    )
    daily = or_default("per_day_charges", F.lit(V.DEFAULT_DAILY_CHARGE))
    priced = joined.withColumns({"total_days": days, "room_charges": (daily * days).try_cast(BILL)}).withColumn(
        "medical_charges", (F.col("total_bill") - F.col("room_charges")).try_cast(BILL)
    )
    incomplete = falsy("bed_id") | falsy("total_bill") | falsy("processed_by_receptionist_id")
    unknown = F.col("admission_date").isNull()
    checked = keep(
        priced.withColumns(
            {
                "before_stay": incomplete,
                "own_reason": first_reason(
                    (incomplete, V.FIELDS_REQUIRED),
                    (unknown, V.ADMISSION_NOT_ACTIVE),
                    (F.col("medical_charges") < 0, V.BILL_TOO_SMALL),
                    (_too_large("total_bill"), V.INVALID_VALUE),
                    (F.col("billed"), V.DUPLICATE_KEY),
                    (F.col("desk_known").isNull(), V.INVALID_REFERENCE),
                ),
            }
        )
    )
    decisions = _with_discharge(_first_of_stay(checked, V.ADMISSION_NOT_ACTIVE), requests, t)
    accepted = decisions.filter("reason is null")
    rows = accepted.withColumns(
        {
            "total_amount": F.col("total_bill"),
            "amount_paid": F.col("total_bill"),
            "payment_status": F.lit("Paid"),
            "follow_up_required": F.lit(False),
            **{c: F.lit(0).cast(BILL) for c in CHARGES[2:]},
        }
    )
    beds = update(t, "beds", accepted.select("bed_id").distinct(), {"is_occupied": F.lit(False)})
    rooms = accepted.select(F.col("initial_room_id").alias("room_id")).distinct()
    in_use = rooms.join(room_occupancy(beds.state), "room_id", "left").select(
        "room_id", F.coalesce("room_in_use", F.lit(False)).alias("room_in_use")
    )
    return JobResult(
        decisions.select(
            ID, AT, "discharge_id", "admission_id", "patient_id", "doctor_id", "total_days", "room_charges",
            "medical_charges", "total_bill", "discharge_date", "reason",
        ),
        {"discharges": as_table(rows, "discharges")},
        {
            "admissions": _closed(t, accepted, now),
            "beds": beds,
            "rooms": update(t, "rooms", in_use, {"is_occupied": F.col("new.room_in_use")}),
        },
    )


def discharge_itemised(t: Tables, requests: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Bill the five charges of a request as given.

    Missing charges are 0 and the total is their sum. The stay is closed; the bed
    stays occupied and the bill is unpaid.
    """
    now = as_moment(as_of)
    given = set(requests.columns)
    desk = "processed_by_receptionist_id"
    people = ["patient_id", "doctor_id", desk]
    asked = requests.select(
        ID, AT, "admission_id", *people,
        *[
            (F.coalesce(_amount(c), F.lit(0).cast(BILL)) if c in given else F.lit(0).cast(BILL)).alias(c)
            for c in CHARGES
        ],
        *[c for c in _DETAILS if c in given],
    )
    stays = t.admissions.select("admission_id", "admission_date", "is_active")
    joined = _already_billed(t, with_references(asked.join(stays, "admission_id", "left"), t, "discharges", people, "known"))
    total = _amount(sum((F.col(c) for c in CHARGES[1:]), F.col(CHARGES[0])))
    priced = joined.withColumns({"total_days": started_days("admission_date", now), "total_amount": total})
    broken = (F.col("total_days") < 0) | _too_large("total_amount")
    for charge in CHARGES:
        broken = broken | (F.col(charge) < 0)
    missing = falsy("admission_id") | falsy("patient_id") | falsy("doctor_id") | falsy(desk)
    not_found = F.col("admission_date").isNull()
    checked = keep(
        priced.withColumns(
            {
                "before_stay": missing,
                "own_reason": first_reason(
                    (missing, V.FIELDS_REQUIRED),
                    (not_found, V.ADMISSION_NOT_FOUND),
                    (~F.coalesce("is_active", F.lit(False)), V.ADMISSION_CLOSED),
                    (broken, V.INVALID_VALUE),
                    (F.col("billed"), V.DUPLICATE_KEY),
                    (~F.col("known"), V.INVALID_REFERENCE),
                ),
            }
        )
    )
    decisions = _with_discharge(_first_of_stay(checked, V.ADMISSION_CLOSED), requests, t)
    accepted = decisions.filter("reason is null")
    rows = accepted.withColumns(
        {"discharge_date": now, "payment_status": F.lit("Unpaid"), "amount_paid": F.lit(0).cast(BILL)}
    )
    if "follow_up_required" not in given:
        rows = rows.withColumn("follow_up_required", F.lit(False))
    rows = rows.withColumn("follow_up_required", F.coalesce("follow_up_required", F.lit(False)))
    return JobResult(
        decisions.select(ID, AT, "discharge_id", "admission_id", *people, "total_days", *CHARGES, "total_amount", "reason"),
        {"discharges": as_table(rows, "discharges")},
        {"admissions": _closed(t, accepted, now)},
    )


def discharge_final_amount(t: Tables, requests: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Bill one final amount as medical charges.

    Requests hold admission_id, final_bill_amount and discharged_by_receptionist_id.
    The stay is closed; its own bed and its room become free without further checks.
    """
    now = as_moment(as_of)
    asked = requests.select(
        ID, AT, "admission_id", _amount("final_bill_amount").alias("final_bill_amount"),
        F.col("discharged_by_receptionist_id").alias("processed_by_receptionist_id"),
    )
    stays = (
        t.admissions.filter("is_active")
        .select("admission_id", "patient_id", "doctor_id", "initial_room_id", "bed_id", "admission_date")
        .join(t.rooms.select(F.col("room_id").alias("initial_room_id")), "initial_room_id", "left_semi")
    )
    joined = asked.join(stays, "admission_id", "left")
    joined = with_known(joined, t.receptionists, "processed_by_receptionist_id", "desk_known", "receptionist_id")
    joined = _already_billed(t, joined).withColumn("total_days", started_days("admission_date", now))
    missing = falsy("admission_id") | falsy("final_bill_amount")
    broken = (F.col("total_days") < 0) | (F.col("final_bill_amount") < 0) | _too_large("final_bill_amount")
    unknown = F.col("admission_date").isNull()
    checked = keep(
        joined.withColumns(
            {
                "before_stay": missing,
                "own_reason": first_reason(
                    (missing, V.FIELDS_REQUIRED),
                    (unknown, V.ADMISSION_NOT_ACTIVE),
                    (broken, V.INVALID_VALUE),
                    (F.col("billed"), V.DUPLICATE_KEY),
                    (F.col("desk_known").isNull(), V.INVALID_REFERENCE),
                ),
            }
        )
    )
    decisions = _with_discharge(_first_of_stay(checked, V.ADMISSION_NOT_ACTIVE), requests, t)
    accepted = decisions.filter("reason is null")
    amount = F.col("final_bill_amount")
    rows = accepted.withColumns(
        {
            "discharge_date": now,
            "room_charges": F.lit(0).cast(BILL),
            "medical_charges": amount,
            "total_amount": amount,
            **{c: F.lit(0).cast(BILL) for c in CHARGES[2:]},
            "payment_status": F.lit("Unpaid"),
            "amount_paid": F.lit(0).cast(BILL),
            "follow_up_required": F.lit(False),
        }
    )
    freed = {"is_occupied": F.lit(False)}
    rooms = accepted.select(F.col("initial_room_id").alias("room_id")).distinct()
    return JobResult(
        decisions.select(
            ID, AT, "discharge_id", "admission_id", "patient_id", "doctor_id", "total_days", "final_bill_amount", "reason"
        ),
        {"discharges": as_table(rows, "discharges")},
        {
            "admissions": _closed(t, accepted, now),
            "beds": update(t, "beds", accepted.select("bed_id").distinct(), freed),
            "rooms": update(t, "rooms", rooms, freed),
        },
    )
