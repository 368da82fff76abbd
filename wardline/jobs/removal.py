"""Removing doctors and schedules, with everything that depends on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment, falsy, full_name
from wardline.functions.time import Moment
from wardline.jobs.result import JobResult, Keep, lazily, update, without
from wardline.operators.referential import OWNER, children, deletable, fallen_rows
from wardline.operators.requests import AT, ID, as_table, first_reason, turn, winners, with_known, with_new_key
from wardline.operators.spread import spread_join
from wardline.session import stage
from wardline.sources.model import TABLES
from wardline.sources.tables import Tables


def _doomed_rows(t: Tables, table: str, keys: DataFrame, owner: str, keep: Keep) -> dict[str, DataFrame]:
    """Rows that fall with removed parents: per table its keys, with the removed owner.

    Follows the cascading references of the model down from ``table``; ``keep`` lets
    each level be computed once for all levels below it.
    """
    fallen = {table: keys}
    pending = [table]
    while pending:
        parent = pending.pop()
        parent_key = TABLES[parent].key
        for child in TABLES.values():
            for reference in child.references:
                if reference.table != parent or reference.on_delete != "cascade" or child.name not in t:
                    continue
                gone = fallen[parent].select(F.col(parent_key).alias(reference.column), owner)
                rows = t[child.name].select(child.key, reference.column).join(gone, reference.column)
                rows = keep(rows.select(child.key, owner))
                fallen[child.name] = fallen[child.name].union(rows).distinct() if child.name in fallen else rows
                pending.append(child.name)
    return fallen


def _blocked_owners(t: Tables, fallen: dict[str, DataFrame], owner: str) -> DataFrame:
    """Owners whose removal would leave a row behind that still refers to a fallen one."""
    blocks = []
    for child in TABLES.values():
        if child.name not in t:
            continue
        for reference in child.references:
            if reference.on_delete != "reject" or reference.table not in fallen:
                continue
            parent = TABLES[reference.table]
            gone = fallen[parent.name].select(F.col(parent.key).alias(reference.column), owner)
            holders = t[child.name].select(child.key, reference.column).join(gone, reference.column)
            holders = holders.select(child.key, owner)
            if child.name in fallen:
                # A row that falls with the same owner does not hold it back.
                holders = holders.join(fallen[child.name], [child.key, owner], "left_anti")
            blocks.append(holders.select(owner))
    return reduce(DataFrame.unionAll, blocks).distinct()


def remove_doctors(t: Tables, requests: DataFrame, as_of: Moment, keep: Keep = lazily) -> JobResult:
    """Archive and remove doctors.

    Requests hold doctor_id, removal_reason and removed_by_admin_id. Rows that
    cascade (schedules, appointments and what hangs on them) fall with the doctor; a
    doctor that other rows still refer to is kept and the request rejected. References
    are judged on the stored tables: a row that falls with another doctor of the same
    batch still holds a doctor back until the next batch.
    """
    asked = requests.select(ID, AT, "doctor_id", "removal_reason", "removed_by_admin_id")
    people = t.doctors.select(
        "doctor_id", full_name().alias("doctor_name"), "specialization_id", "registration_number"
    )
    known = asked.select("doctor_id").distinct().join(people.select("doctor_id"), "doctor_id")
    owner = "removed_owner"
    fallen = _doomed_rows(t, "doctors", known.select("doctor_id", F.col("doctor_id").alias(owner)), owner, keep)
    blocked = _blocked_owners(t, fallen, owner).select(F.col(owner).alias("doctor_id"), F.lit(True).alias("blocked"))
    checked = spread_join(asked.join(people, "doctor_id", "left"), blocked, ["doctor_id"], "left", ID)
    checked = with_known(checked, t.admin, "removed_by_admin_id", "admin_known", "admin_id")
    required = F.col("removal_reason").isNull() | (F.col("removal_reason") == "") | falsy("removed_by_admin_id")
    unknown = F.col("doctor_name").isNull()
    checked = keep(
        checked.withColumn(
            "own_reason",
            first_reason(
                (required, V.FIELDS_REQUIRED),
                (unknown, V.BOOK_NO_DOCTOR),
                (F.col("admin_known").isNull(), V.INVALID_REFERENCE),
                (F.col("blocked"), V.STILL_REFERENCED),
            ),
        )
    )
    first = winners(checked.filter("own_reason is null"), ["doctor_id"])
    later = F.coalesce(F.col("winner_turn") < turn(), F.lit(False)) & ~required
    decided = spread_join(checked, first, ["doctor_id"], "left", ID).withColumn(
        "reason", F.when(later, F.lit(V.BOOK_NO_DOCTOR)).otherwise(F.col("own_reason"))
    )
    decisions = with_new_key(decided, requests, t, "removed_doctors").withColumn(
        "removed_doctor_id", F.when(F.col("reason").isNull(), F.col("removed_doctor_id"))
    )
    accepted = decisions.filter("reason is null").withColumn("removal_date", as_moment(as_of))
    gone_owners = accepted.select(F.col("doctor_id").alias(owner))
    updated = {}
    for name, rows in fallen.items():
        key = TABLES[name].key
        keys = rows.join(gone_owners, owner, "left_semi").select(key).distinct()
        updated[name] = without(t[name], keys, key)
    return JobResult(
        decisions.select(ID, AT, "doctor_id", "removal_reason", "removed_by_admin_id", "removed_doctor_id", "reason"),
        {"removed_doctors": as_table(accepted, "removed_doctors")},
        updated,
    )


def delete_schedules(t: Tables, requests: DataFrame) -> JobResult:
    """Delete schedule rows by id; a second request for a row finds nothing."""
    checked = with_known(requests.select(ID, AT, "schedule_id"), t.doctor_schedules.hint("merge"), "schedule_id", "row_known")
    first = winners(checked.filter("row_known"), ["schedule_id"])
    decisions = spread_join(checked, first, ["schedule_id"], "left", ID).select(
        ID,
        AT,
        "schedule_id",
        F.when(F.col("winner_id").isNull() | (F.col("winner_id") != F.col(ID)), F.lit(V.NOT_FOUND)).alias("reason"),
    )
    keys = decisions.filter("reason is null").select("schedule_id")
    return JobResult(decisions, updated={"doctor_schedules": without(t.doctor_schedules, keys, "schedule_id")})


def delete_rows(t: Tables, table: str, requests: DataFrame, keep: Keep = stage) -> JobResult:
    """Delete rows of a table by its key, with the referential actions of the model, in batch order.

    Rows that cascade fall too, and a column that is cleared becomes NULL in the rows that stay. A row
    that others still refer to is kept and its request rejected, given what the requests accepted
    before have deleted. A second request for a row finds nothing.
    """
    key = TABLES[table].key
    checked = with_known(requests.select(ID, AT, key), t[table], key, "row_known")
    first = keep(winners(checked.filter("row_known"), [key]))
    fallen = fallen_rows(t, table, first, keep)
    turns = first.select(F.col(key).alias(OWNER), F.col("winner_turn").alias("turn"))
    done = keep(deletable(t, fallen, turns, keep))
    marked = first.join(done.select(F.col(OWNER).alias(key), F.lit(True).alias("free")), key, "left")
    reason = first_reason(
        (F.col("winner_id").isNull(), V.NOT_FOUND),
        (F.col("free").isNull(), V.STILL_REFERENCED),
        (F.col("winner_id") != F.col(ID), V.NOT_FOUND),
    )
    decided = spread_join(checked, marked, [key], "left", ID).withColumn("reason", reason)
    updated = {}
    for name, rows in fallen.items():
        own = TABLES[name].key
        keys = rows.join(done, OWNER, "left_semi").select(own).distinct()
        updated[name] = without(t[name], keys, own)
    for parent, rows in fallen.items():
        for child, column in children(parent, "clear", t):
            gone = rows.join(done, OWNER, "left_semi").select(F.col(TABLES[parent].key).alias(column)).distinct()
            hit = t[child.name].select(child.key, column).join(gone, column, "left_semi").select(child.key)
            updated[child.name] = update(t, child.name, hit, {column: F.lit(None)})
    return JobResult(decided.select(ID, AT, key, "reason"), updated=updated)
