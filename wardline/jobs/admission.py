"""Admitting patients to beds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, falsy
from wardline.functions.time import Moment
from wardline.jobs.occupancy import room_occupancy
from wardline.jobs.result import JobResult, Keep, lazily, update
from wardline.operators.people import bed_numbers, doctor_names, patient_names, room_details
from wardline.operators.requests import (
    AT,
    ID,
    as_table,
    first_reason,
    turn,
    winners,
    with_new_key,
    with_references,
)
from wardline.operators.spread import spread_join
from wardline.sources.tables import Tables

_FIELDS = (
    "patient_id", "doctor_id", "consultation_id", "action_id", "initial_room_id", "bed_id",
    "assigned_by_receptionist_id",
)
_REFERENCES = [c for c in _FIELDS if c != "bed_id"]


def admit(t: Tables, requests: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Admit patients; the first valid request of a free bed gets it.

    Accepted requests create an active admission, complete the consultation action,
    occupy the bed, and mark the bed's room occupied when no free bed is left.
    Neither the ward's gender nor another admission of the patient is checked.
    """
    notes = F.col("admission_notes") if "admission_notes" in requests.columns else F.lit(None).cast("string")
    asked = requests.select(ID, AT, *_FIELDS, notes.alias("admission_notes"))
    places = t.beds.select("bed_id", F.col("room_id").alias("bed_room"), F.col("is_occupied").alias("bed_taken"))
    checked = with_references(asked.join(places, "bed_id", "left"), t, "admissions", _REFERENCES, "references_known")
    incomplete = F.lit(False)
    for column in _FIELDS:
        incomplete = incomplete | falsy(column)
    bed_missing = F.col("bed_room").isNull()
    bed_taken = F.coalesce("bed_taken", F.lit(False))
    checked = keep(
        checked.withColumn(
            "own_reason",
            first_reason(
                (incomplete, V.FIELDS_REQUIRED),
                (bed_missing, V.BED_NOT_FOUND),
                (bed_taken, V.BED_OCCUPIED),
                (~F.col("references_known"), V.INVALID_REFERENCE),
            ),
        )
    )
    first = winners(checked.filter("own_reason is null"), ["bed_id"])
    earlier = F.coalesce(F.col("winner_turn") < turn(), F.lit(False))
    decided = spread_join(checked, first, ["bed_id"], "left", ID).withColumn(
        "reason",
        F.when(F.col("own_reason").isNull() | (F.col("own_reason") == V.INVALID_REFERENCE),
               F.when(earlier, F.lit(V.BED_OCCUPIED)).otherwise(F.col("own_reason")))
        .otherwise(F.col("own_reason")),
    )
    decisions = with_new_key(decided, requests, t, "admissions").withColumn(
        "admission_id", F.when(F.col("reason").isNull(), F.col("admission_id"))
    )
    now = as_moment(as_of)
    accepted = decisions.filter("reason is null").withColumns({"admission_date": now, "is_active": F.lit(True)})

    beds = update(t, "beds", accepted.select("bed_id"), {"is_occupied": F.lit(True)})
    full = (
        room_occupancy(beds.state)
        .filter("room_full")
        .join(accepted.select(F.col("bed_room").alias("room_id")).distinct(), "room_id", "left_semi")
    )
    done = {"status": F.lit("Completed"), "completed_at": now}
    return JobResult(
        decisions.select(ID, AT, "admission_id", *_FIELDS, "admission_notes", "reason"),
        {"admissions": as_table(accepted, "admissions")},
        {
            "consultation_actions": update(t, "consultation_actions", accepted.select("action_id").distinct(), done),
            "beds": beds,
            "rooms": update(t, "rooms", full.select("room_id"), {"is_occupied": F.lit(True)}),
        },
    )


def admission_confirmations(t: Tables, admissions: DataFrame) -> DataFrame:
    """New admissions with the names, room and bed a confirmation shows."""
    rooms = room_details(t).select("initial_room_id", "room_number", "room_type")
    return (
        admissions.join(patient_names(t), "patient_id")
        .join(doctor_names(t), "doctor_id")
        .join(rooms, "initial_room_id")
        .join(bed_numbers(t), "bed_id")
        .select(
            *t.admissions.columns, "patient_name", "doctor_name", "room_number", "bed_number", "bed_code", "room_type"
        )
    )
