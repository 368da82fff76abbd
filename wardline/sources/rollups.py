"""Daily totals of stored facts, kept up folder by folder.

The folders of a ``Store`` never change, so what is totalled once for a folder stays right as
long as the folder is part of the state. A total per (folder, day, key) is stored; the totals
of any range of days are those of its days in the folders of the newest state, added up. After a
commit only the folders it wrote are read: an append totals the new rows, an update the
months it wrote again, and rows that left with their folder need no work at all.

Counts and sums add up; distinct ids do not, so they are kept as exact bitmaps: one bit per
id, in words of 64 ids, which are merged by OR. A word is one number, so a key that has few
ids, like a doctor on a day, takes little room. The ids may be of any size.

Totals are never stale: a folder that is not totalled yet is read as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import fixed_values as V
from wardline.functions import as_moment
from wardline.functions.text import same_text
from wardline.functions.time import Moment, to_datetime
from wardline.functions.values import exact_sum
from wardline.sources.commits import Folder, Store
from wardline.sources.model import MONTH, TABLES
from wardline.sources.sinks import NO_MONTH

DAY, PAGE = "day", "page"
#: A page of a bitmap holds so many ids, as a power of two: the bits of one number.
PAGE_POWER = 6
_LOG = "name string, part string, folders array<struct<table string, month string, commit string>>"


def _sum(name: str) -> Column:
    return F.sum(name).alias(name)


def _page(column: str) -> Column:
    return F.shiftright(F.col(column).cast("bigint"), PAGE_POWER).alias(PAGE)


def _ids(column: str) -> Column:
    bit = F.col(column).cast("bigint").bitwiseAND(F.lit((1 << PAGE_POWER) - 1)).cast("int")
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias("ids")


def _place(name: str) -> str:
    """The name that totals are stored under; bitmaps of another layout, under the plain name, are not read."""
    return name if ROLLUPS[name].distinct is None else f"{name}_words"


@dataclass(frozen=True)
class Rollup:
    """Totals of a fact per day and key; ``measures`` are aggregates whose sums are totals again.

    With ``distinct`` the only total is the set of the ids of that column. Without ``daily``
    the totals are those of whole folders.
    """

    table: str
    moment: str
    keys: tuple[str, ...] = ()
    measures: dict[str, Callable[[], Column]] = field(default_factory=dict)
    distinct: str | None = None
    daily: bool = True

    def group(self) -> list[Column]:
        return [*map(F.col, self.keys), *([] if self.distinct is None else [_page(self.distinct)])]

    def totals(self) -> list[Column]:
        if self.distinct is None:
            return [build().alias(name) for name, build in self.measures.items()]
        return [_ids(self.distinct)]

    def merged(self, rows: DataFrame) -> DataFrame:
        """Rows of any folders and days, one per key."""
        if self.distinct is None:
            aggregates = [_sum(name) for name in self.measures]
            return rows.groupBy(*self.keys).agg(*aggregates)
        pages = rows.groupBy(*self.keys, PAGE).agg(F.bit_or("ids").alias("ids"))
        return pages.groupBy(*self.keys).agg(F.sum(F.bit_count("ids")).alias("n"))


def _count() -> Column:
    return F.count(F.lit(1))


def _vitals() -> dict[str, Callable[[], Column]]:
    out: dict[str, Callable[[], Column]] = {}
    for name in ("temperature", "oxygen_saturation", "pulse_rate"):
        out[f"sum_{name}"] = lambda name=name: exact_sum(name)
        out[f"n_{name}"] = lambda name=name: F.count(name)
    return out


ROLLUPS: dict[str, Rollup] = {
    "new_patients": Rollup("patients", "created_at", measures={"n": _count}),
    "appointments": Rollup("appointments", "appointment_date", measures={"n": _count}),
    "consultations": Rollup("consultations", "consultation_date", measures={"n": _count}),
    "admissions": Rollup("admissions", "admission_date", measures={"n": _count}),
    "doctor_visits": Rollup(
        "admitted_patient_visits",
        "visit_datetime",
        ("doctor_id",),
        {
            "visits": _count,
            **{name.lower(): lambda name=name: F.count_if(same_text("condition_status", name)) for name in V.CONDITIONS},
            "ready": lambda: F.count_if("ready_for_discharge"),
            **_vitals(),
        },
    ),
    "doctor_discharges": Rollup(
        "discharges",
        "discharge_date",
        ("doctor_id",),
        {
            "discharges": _count,
            "follow_up": lambda: F.count_if("follow_up_required"),
            "billed": lambda: exact_sum("total_amount"),
            "n_billed": lambda: F.count("total_amount"),
            "days": lambda: exact_sum("total_days"),
            "n_days": lambda: F.count("total_days"),
            "received": lambda: exact_sum("amount_paid"),
            "pending": lambda: F.sum(F.col("total_amount") - F.col("amount_paid")),
            **{state.lower(): lambda state=state: F.count_if(same_text("payment_status", state)) for state in ("Paid", "Unpaid", "Partial")},
        },
    ),
    "doctor_patients": Rollup("appointments", "appointment_date", ("doctor_id",), distinct="patient_id"),
    # Which patients a folder holds rows of: an index that prunes facts of all time.
    "appointment_patients": Rollup("appointments", "appointment_date", distinct="patient_id", daily=False),
    "admission_patients": Rollup("admissions", "admission_date", distinct="patient_id", daily=False),
    "patients_visited": Rollup("admitted_patient_visits", "visit_datetime", distinct="patient_id"),
}


class Rollups:
    """The totals stored beside the tables of a store."""

    def __init__(self, store: Store):
        self.store, self.spark = store, store.spark

    def _covered(self, name: str) -> dict[Folder, str]:
        log = self.store._log("rollup_log", _LOG).where(F.col("name") == _place(name)).orderBy("part").collect()  # one row per refresh
        return {Folder(*folder): row.part for row in log for folder in row.folders}

    def _folders(self, name: str) -> list[Folder]:
        return [f for f in self.store.manifest().folders if f.table == ROLLUPS[name].table]

    def _of(self, name: str, folders: list[Folder], start: Moment | None = None) -> DataFrame:
        """Totals of folders by (commit, month, day, key), from the facts."""
        rollup = ROLLUPS[name]
        rows = self.store._rows(rollup.table, folders)
        if not folders:
            rows = rows.withColumn("commit", F.lit(None).cast("string"))
        if start is not None:
            rows = rows.filter(F.col(rollup.moment) >= as_moment(start))
        if rollup.distinct is not None:
            rows = rows.filter(F.col(rollup.distinct).isNotNull())
        month = F.col(MONTH) if TABLES[rollup.table].month_of is not None else F.lit(None).cast("string").alias(MONTH)
        day = (F.to_date(rollup.moment) if rollup.daily else F.lit(None).cast("date")).alias(DAY)
        return rows.groupBy("commit", month, day, *rollup.group()).agg(*rollup.totals())

    def refresh(self, *names: str) -> dict[str, list[Folder]]:
        """Total the folders of the newest state that are not yet; returns those folders."""
        done = {}
        for name in names or ROLLUPS:
            covered = self._covered(name)
            missing = [f for f in self._folders(name) if f not in covered]
            done[name] = missing
            if missing:
                part = f"p{uuid.uuid4().hex}"
                self._of(name, missing).write.parquet(f"{self.store.root}/rollups/{_place(name)}/part={part}")
                self.store._append("rollup_log", [(_place(name), part, [tuple(f) for f in missing])], _LOG)
        return done

    def days(self, name: str, first: Moment | None = None, last: Moment | None = None) -> DataFrame:
        """The totals of the days ``first`` to ``last`` by folder, day and key; rows without a date have no day."""
        rollup = ROLLUPS[name]
        covered, wanted = self._covered(name), self._folders(name)
        if TABLES[rollup.table].month_of is not None and (first is not None or last is not None):
            low = "" if first is None else f"{to_datetime(first):%Y-%m}"
            high = "9999-99" if last is None else f"{to_datetime(last):%Y-%m}"
            wanted = [f for f in wanted if f.month != NO_MONTH and low <= f.month <= high]
        rows = self._of(name, [f for f in wanted if f not in covered])
        stored = [f for f in wanted if f in covered]
        if stored:
            base = f"{self.store.root}/rollups/{_place(name)}"
            paths = [f"{base}/part={part}" for part in sorted({covered[f] for f in stored})]
            own = F.concat_ws("/", "commit", F.coalesce(MONTH, F.lit("")))
            asked = [f"{f.commit}/{f.month or ''}" for f in stored]
            rows = rows.unionByName(self.spark.read.schema(rows.schema).parquet(*paths).filter(own.isin(asked)))
        if first is not None:
            rows = rows.filter(F.col(DAY) >= F.lit(to_datetime(first).date()))
        if last is not None:
            rows = rows.filter(F.col(DAY) <= F.lit(to_datetime(last).date()))
        return rows

    def range(self, name: str, first: Moment | None = None, last: Moment | None = None) -> DataFrame:
        """Totals per key of a range of whole days, both included."""
        return ROLLUPS[name].merged(self.days(name, first, last))

    def since(self, name: str, start: Moment) -> DataFrame:
        """Totals per key from a moment on: whole days from the totals, the day it lies in from the facts."""
        start = to_datetime(start)
        wanted = [f for f in self._folders(name) if f.month is None or f.month == f"{start:%Y-%m}"]
        begun = self._of(name, wanted, start).filter(F.col(DAY) == F.lit(start.date()))
        later = self.days(name, start).filter(F.col(DAY) > F.lit(start.date()))
        return ROLLUPS[name].merged(begun.unionByName(later))

    def folders_with(self, name: str, ids: DataFrame) -> list[Folder]:
        """The folders that hold rows with one of the ids, a frame of one column.

        Pages of both sides meet by an equality join, and a folder stays if the AND of two pages is not
        empty. The result is at most one entry per folder.
        """
        asked = ids.where(F.col(ids.columns[0]).isNotNull()).groupBy(_page(ids.columns[0])).agg(_ids(ids.columns[0]))
        held = self.days(name).groupBy("commit", MONTH, PAGE).agg(F.bit_or("ids").alias("held"))
        shared = held.join(asked, PAGE).filter(F.col("held").bitwiseAND(F.col("ids")) != 0)
        hit = {(r["commit"], r[MONTH]) for r in shared.select("commit", MONTH).distinct().collect()}
        return [f for f in self._folders(name) if (f.commit, f.month) in hit]
