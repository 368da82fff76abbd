"""Adding rows to the entity, clinical and log tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import fixed_values as V
from wardline.functions import as_moment, falsy
from wardline.functions.time import Moment
from wardline.jobs.result import JobResult, Keep, lazily
from wardline.operators.requests import (
    AT,
    ID,
    as_table,
    first_reason,
    winners,
    with_new_key,
    with_references,
)
from wardline.quality import value_rules
from wardline.sources.model import NOW, TABLES
from wardline.sources.tables import Tables


@dataclass(frozen=True)
class Intake:
    """Fields a row must give, optional ones (empty reads as NULL), and its unique key."""

    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    zero_allowed: tuple[str, ...] = ()
    zero_default: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    duplicate: str = V.DUPLICATE_KEY


INTAKES = {
    "patients": Intake(("first_name", "last_name", "age", "gender"), ("blood_group", "phone_no")),
    "doctors": Intake(
        ("first_name", "last_name", "age", "specialization_id", "experience_years"),
        ("consultation_fee", "phone_no", "registration_number"),
        zero_default=("consultation_fee",), unique=("registration_number",),
    ),
    "doctor_schedules": Intake(
        ("doctor_id", "day_of_week", "slot_id"), ("is_active",),
        zero_allowed=("day_of_week",), unique=("doctor_id", "day_of_week", "slot_id"),
    ),
    "receptionists": Intake(("first_name", "last_name"), ("contact_no",)),
    "appointment_forms": Intake(
        ("appointment_id", "patient_id", "symptoms"), ("medical_history",),
        unique=("appointment_id",), duplicate=V.FORM_EXISTS,
    ),
    "consultations": Intake(
        ("appointment_id", "doctor_id", "patient_id"),
        ("blood_pressure", "temperature", "oxygen_saturation", "diagnosis"), unique=("appointment_id",),
    ),
    "prescribed_medicines": Intake(("consultation_id", "medicine_name", "dosage", "frequency", "duration")),
    "consultation_actions": Intake(("consultation_id", "action_type_id"), ("notes",)),
    "signin_logs": Intake(("user_id", "user_type")),
}


def _kind(table: str, column: str) -> T.DataType:
    return T.DataType.fromDDL(TABLES[table].by_name[column].type)


def _value(table: str, spec: Intake, column: str, given: set[str]) -> Column:
    """A field in its declared type: empty optional fields are NULL, defaults filled in."""
    declared = TABLES[table].by_name[column]
    if column not in given:
        value = F.lit(None).cast(declared.type)
    else:
        value = F.col(column).try_cast(declared.type)
        kind = _kind(table, column)
        if column in spec.optional and not isinstance(kind, T.BooleanType):
            value = F.when(falsy(value, kind), F.lit(None).cast(declared.type)).otherwise(value)
    if declared.default is not None and declared.default is not NOW:
        value = F.coalesce(value, F.lit(declared.default).cast(declared.type))
    return value


def ingest(t: Tables, table: str, rows: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Check and add rows.

    Rows hold request_id, requested_at and the fields of ``INTAKES[table]``. They get
    their key, login id and defaults. Within a batch the first valid row of a unique
    key is added. New patients also leave a sign-up log row.
    """
    spec, declared = INTAKES[table], TABLES[table]
    given = set(rows.columns)
    fields = [*spec.required, *spec.optional]
    unreadable = F.lit(False)
    for column in (c for c in fields if c in given):
        read = F.col(column).try_cast(declared.by_name[column].type)
        unreadable = unreadable | (F.col(column).isNotNull() & read.isNull())
    values = [_value(table, spec, c, given).alias(c) for c in fields]
    asked = rows.select(ID, AT, *values, unreadable.alias("unreadable"))
    references = [r.column for r in declared.references if r.column in fields]
    checked = with_references(asked, t, table, references, "references_known")

    def missing(column: str) -> Column:
        return F.col(column).isNull() if column in spec.zero_allowed else falsy(column, _kind(table, column))

    incomplete = F.lit(False)
    for column in spec.required:
        incomplete = incomplete | missing(column)
    cases = [(incomplete & ~F.col("unreadable"), V.FIELDS_REQUIRED)]
    if table == "appointment_forms":
        # The appointment must be the patient's own.
        own = t.appointments.select("appointment_id", F.col("patient_id").alias("own_patient"))
        checked = checked.join(own, "appointment_id", "left")
        owned = F.coalesce(F.col("own_patient") == F.col("patient_id"), F.lit(False))
        cases.append((~owned, V.FORM_NOT_OWNED))
    if spec.unique:
        # NULL is a key value like any other here, so it is compared null-safely.
        held = t[table].select(*[F.col(c).alias(f"held_{c}") for c in spec.unique]).distinct()
        held = held.withColumn("held", F.lit(True))
        match = F.lit(True)
        for column in spec.unique:
            match = match & F.col(column).eqNullSafe(F.col(f"held_{column}"))
        # the keys of a table of any size, whose estimate may be far too low, are not broadcast
        checked = checked.join(held.hint("merge"), match, "left").drop(*[f"held_{c}" for c in spec.unique])
    invalid = F.col("unreadable")
    for column in fields:
        for rule in value_rules(declared.by_name[column], F.col(column)):
            invalid = invalid | F.coalesce(rule.broken, F.lit(False))
    if spec.unique:
        cases.append((F.col("held"), spec.duplicate))
    cases += [(invalid, V.INVALID_VALUE), (~F.col("references_known"), V.INVALID_REFERENCE)]
    checked = keep(checked.withColumn("reason", first_reason(*cases)))
    if spec.unique:
        first = winners(checked.filter("reason is null"), list(spec.unique))
        first = first.select(F.col("winner_id").alias(ID), F.lit(True).alias("first"))
        lost = F.col("reason").isNull() & F.col("first").isNull()
        checked = checked.join(first, ID, "left").withColumn(
            "reason", F.when(lost, F.lit(spec.duplicate)).otherwise(F.col("reason"))
        )
    decisions = with_new_key(checked, rows, t, table)
    names = [declared.key, *([declared.login[0]] if declared.login else [])]
    for name in names:
        decisions = decisions.withColumn(name, F.when(F.col("reason").isNull(), F.col(name)))
    decisions = decisions.select(ID, AT, *names, *fields, "reason")

    now = as_moment(as_of)
    accepted = decisions.filter("reason is null")
    filled = {
        c.name: now if c.default is NOW else F.lit(c.default).cast(c.type)
        for c in declared.columns
        if c.default is not None and c.name not in fields
    }
    accepted = accepted.withColumns(filled)
    if table == "doctors":
        last = t.doctors.agg(F.coalesce(F.max("room_no"), F.lit(0)).cast("bigint")).scalar()
        base = rows.agg(F.min(ID)).scalar()
        accepted = accepted.withColumn("room_no", last + F.col(ID) - base + F.lit(1))
    appended = {table: as_table(accepted, table)}
    if table == "patients":
        log = with_new_key(accepted.withColumn("signup_datetime", now), rows, t, "signup_logs")
        appended["signup_logs"] = as_table(log, "signup_logs")
    return JobResult(decisions, appended)
