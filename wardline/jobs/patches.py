"""Partial updates: only the columns a patch names are changed.

A patch row is request_id, requested_at, the table's key and ``changes``, a
map<string,string> of column values. A column that is absent stays; one that is
present with NULL becomes NULL. Patches of a row apply in batch order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment
from wardline.functions.time import Moment
from wardline.jobs.result import JobResult, Keep, lazily, update
from wardline.operators.requests import AT, ID, first_reason, turn, with_known
from wardline.operators.unique_keys import refused_moves
from wardline.quality import value_rules
from wardline.session import stage
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables


@dataclass(frozen=True)
class Patchable:
    """Patch fields and the columns they set; flags read NULL as false."""

    fields: dict[str, str]
    flags: tuple[str, ...] = ()
    stamp: str | None = None  # set to the time of the run
    completes: bool = False  # status Completed sets completed_at
    unique: tuple[str, ...] = ()  # a unique key: a column that no patch sets, then those patches set


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


PATCHES = {
    "doctor_schedules": Patchable(
        _same("day_of_week", "slot_id", "is_active"), stamp="updated_at", unique=("doctor_id", "day_of_week", "slot_id")
    ),
    "consultation_actions": Patchable(_same("status", "notes"), completes=True),
    "admitted_patient_visits": Patchable(
        _same(
            "blood_pressure", "temperature", "oxygen_saturation", "pulse_rate", "condition_status", "notes",
            "treatment_given", "ready_for_discharge", "discharge_recommended_date",
        ),
        flags=("ready_for_discharge",),
    ),
    "discharges": Patchable(
        {
            "follow_up_required": "follow_up_required",
            "follow_up_date": "follow_up_date",
            "follow_up_notes": "discharge_instructions",
        },
        flags=("follow_up_required",),
    ),
}
COMPLETED = "Completed"


def _invalid(table: str, spec: Patchable) -> Column:
    """TRUE where a given value does not fit the column's type or rules."""
    bad = F.lit(False)
    for name, column in spec.fields.items():
        declared = TABLES[table].by_name[column]
        text = F.col("changes")[name]
        value = text.try_cast(declared.type)
        bad = bad | (text.isNotNull() & value.isNull())
        if declared.required:
            bad = bad | (F.map_contains_key("changes", name) & text.isNull())
        for rule in value_rules(declared, value):
            bad = bad | F.coalesce(rule.broken, F.lit(False))
    return bad


def _without_repeats(t: Tables, table: str, decisions: DataFrame) -> DataFrame:
    """Reject patches that would repeat the table's unique key, in batch order."""
    spec, key = PATCHES[table], TABLES[table].key
    group, *columns = spec.unique
    stored = t[table].select(key, group, *columns)
    given = {c: F.col("changes")[c].try_cast(stored.schema[c].dataType).alias(c) for c in columns}
    asked = decisions.filter("reason is null").select(ID, AT, key, *given.values())
    moves = stage(asked.filter(" or ".join(f"{c} is not null" for c in columns)).join(stored.select(key, group), key))
    refused = refused_moves(stored, moves, group, key, columns).withColumn("repeats", F.lit(True))
    reason = F.when(F.col("repeats"), F.lit(V.DUPLICATE_KEY)).otherwise(F.col("reason"))
    return decisions.join(refused, ID, "left").withColumn("reason", reason).drop("repeats")


def apply_patches(t: Tables, table: str, patches: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Apply partial updates to a table.

    A patch without a known field, for an unknown row, or with a value that breaks a
    rule of its column is rejected as a whole. So is one that would repeat a unique key
    of the table, given the patches accepted before it.
    """
    spec, key = PATCHES[table], TABLES[table].key
    asked = patches.select(ID, AT, key, "changes")
    # The table may be any size and its estimate far too low, so it is not broadcast.
    checked = with_known(asked, t[table].hint("merge"), key, "row_known")
    empty = ~F.arrays_overlap(
        F.coalesce(F.map_keys("changes"), F.array().cast("array<string>")), F.array(*map(F.lit, spec.fields))
    )
    cases = [(empty, V.NOTHING_TO_UPDATE), (F.col("row_known").isNull(), V.NOT_FOUND), (_invalid(table, spec), V.INVALID_VALUE)]
    if "slot_id" in spec.fields:
        slot = F.col("changes")["slot_id"].try_cast("bigint")
        slots = t.time_slots.select(F.col("slot_id").cast("bigint").alias("new_slot"), F.lit(True).alias("slot_known"))
        checked = checked.withColumn("new_slot", slot).join(slots, "new_slot", "left")
        cases.append((F.col("new_slot").isNotNull() & F.col("slot_known").isNull(), V.INVALID_REFERENCE))
    decisions = checked.withColumn("reason", first_reason(*cases)).select(ID, AT, key, "changes", "reason")
    if spec.unique:
        decisions = _without_repeats(t, table, decisions)
    decisions = keep(decisions)

    def last(name: str) -> Column:
        """The newest value given for a field; NULL if no patch names it."""
        named = F.when(F.map_contains_key("changes", name), F.struct(turn(), F.col("changes")[name].alias("value")))
        return F.max(named).alias(name)

    measures = [last(name) for name in spec.fields]
    if spec.completes:
        # An exact word, as stored; a later patch does not take the time back.
        measures.append(F.bool_or(F.col("changes")["status"] == COMPLETED).alias("completed"))
    merged = decisions.filter("reason is null").groupBy(key).agg(*measures)

    old = t[table]
    values: dict[str, Column] = {}
    for name, column in spec.fields.items():
        kind = TABLES[table].by_name[column].type
        given = F.col(f"new.{name}")
        value = given["value"].try_cast(kind)
        if column in spec.flags:
            value = F.coalesce(value, F.lit(False))
        values[column] = F.when(given.isNotNull(), value).otherwise(F.col(column).cast(kind))
    now = as_moment(as_of)
    if spec.stamp is not None:
        values[spec.stamp] = now
    if spec.completes:
        values["completed_at"] = F.when(F.col("new.completed"), now).otherwise(F.col("completed_at"))
    values = {c: v.cast(old.schema[c].dataType) for c, v in values.items()}
    return JobResult(decisions, updated={table: update(t, table, merged, values)})
