"""Tables whose changes are switched together: versioned folders and a manifest.

A commit writes new folders and never touches one that a reader may hold. Its last step
appends one row, the manifest, to ``root/commits``: the folders that make up every table from
now on. Spark moves the file of that row into place when its job commits, so readers see the
whole commit or nothing of it, and whatever fails before leaves the old state as it was.

    root/begun     a row per started commit: its id and the tables it writes
    root/data      <table>/commit=<id>[/month=<yyyy-mm>], one folder per commit and month
    root/commits   a row per finished commit: number, id, parent, the folders of all tables

Facts are kept by month. An update rewrites the months that hold changed rows, an append
adds a folder to its month. Readers take the folders from the manifest, so a dataset bounded by
dates reads the folders of its months only, and a state stays readable while commits go on.

One writer at a time: a commit names the one it was built on, and is refused if another
one was finished since. Built on data frames alone, so it works wherever Spark writes.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.time import Moment, to_datetime
from wardline.session import stage
from wardline.sources.model import MONTH, TABLES
from wardline.sources.sinks import NO_MONTH, by_month, with_month
from wardline.sources.tables import Tables

_COMMITS = "number bigint, id string, parent string, folders array<struct<table string, month string, commit string>>"
_BEGUN = "id string, tables array<string>"


class Folder(NamedTuple):
    """The rows of a table, or of one of its months, that a commit wrote."""

    table: str
    month: str | None
    commit: str

    @property
    def path(self) -> str:
        inside = "" if self.month is None else f"/{MONTH}={self.month}"
        return f"data/{self.table}/commit={self.commit}{inside}"


class Manifest(NamedTuple):
    number: int
    id: str | None
    folders: tuple[Folder, ...]


class Conflict(RuntimeError):
    """Another commit was finished since the state that this one was built on."""


class Change(NamedTuple):
    """Rows that replace, by key, those of a table; with ``gone`` the rows that leave it."""

    rows: DataFrame
    gone: bool = False


class Store:
    """The tables under ``root``, at the newest or at a given commit."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- reading

    def _log(self, name: str, schema: str) -> DataFrame:
        folder = f"{self.root}/{name}"
        try:
            return self.spark.read.schema(schema).parquet(folder)
        except Exception as error:  # noqa: BLE001 - the class differs between session kinds
            if "PATH_NOT_FOUND" in str(error):
                return self.spark.createDataFrame([], schema)
            raise

    def manifest(self, number: int | None = None) -> Manifest:
        """The state at a commit; by default at the newest, and without any an empty one."""
        commits = self._log("commits", _COMMITS)
        if number is not None:
            commits = commits.where(F.col("number") == number)
        row = commits.orderBy(F.desc("number"), "id").first()
        if row is None and number is not None:
            raise KeyError(f"no commit {number}")
        if row is None:
            return Manifest(0, None, ())
        return Manifest(row.number, row.id, tuple(Folder(*f) for f in row.folders))

    def _rows(self, table: str, folders: list[Folder]) -> DataFrame:
        schema = TABLES[table].schema
        if TABLES[table].month_of is not None:
            schema = schema.add(MONTH, "string")
        if not folders:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.root}/{f.path}" for f in folders]
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{table}").parquet(*paths)

    def tables(self, number: int | None = None) -> Tables:
        """The tables at a commit; all of them at the same one, however many follow."""
        state = self.manifest(number)
        own: dict[str, list[Folder]] = defaultdict(list)
        for folder in state.folders:
            own[folder.table].append(folder)
        return _Stored(self, dict(own))

    # ---- writing

    def commit(
        self, appended: Mapping[str, DataFrame] | None = None, changes: Mapping[str, Change] | None = None, onto: Manifest | None = None
    ) -> Manifest:
        """Append rows to some tables and change others, all or none.

        ``onto`` is the state that the rows were computed from; by default the newest. Changed
        rows are evaluated once, into the shared folder, and read from there.
        """
        appended, changes = dict(appended or {}), dict(changes or {})
        base = onto or self.manifest()
        commit = f"c{uuid.uuid4().hex}"
        names = sorted({*appended, *changes})
        self._append("begun", [(commit, names)], _BEGUN)
        # Every output may read any of the tables, so all are evaluated before the first is written.
        added = {table: stage(rows) for table, rows in appended.items()}
        changed = {table: Change(stage(change.rows), change.gone) for table, change in changes.items()}
        folders = list(base.folders)
        for table in names:
            folders = self._write(table, commit, folders, added.get(table), changed.get(table))
        self._publish(Manifest(base.number + 1, commit, tuple(folders)), base)
        return self.manifest(base.number + 1)

    def _write(self, table: str, commit: str, folders: list[Folder], added: DataFrame | None, change: Change | None) -> list[Folder]:
        """Write one table's part of a commit; returns the folders of all tables after it."""
        own = [f for f in folders if f.table == table]
        parts, replaced = [], set()
        if change is not None:
            months = _months(change.rows, table)
            replaced = {f for f in own if f.month in months}
            key = TABLES[table].key
            parts.append(self._typed(table, self._rows(table, sorted(replaced))).join(change.rows.select(key), key, "left_anti"))
            if not change.gone:
                parts.append(self._typed(table, change.rows))
        if added is not None:
            parts.append(self._typed(table, added))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        path = f"{self.root}/data/{table}/commit={commit}"
        by_month(rows, table).parquet(path)
        written = self.spark.read.schema(TABLES[table].schema.add(MONTH, "string")).parquet(path)
        if TABLES[table].month_of is None:
            new = [Folder(table, None, commit)]
        else:
            new = [Folder(table, r[0], commit) for r in written.select(MONTH).distinct().orderBy(MONTH).collect()]
        return [f for f in folders if f not in replaced] + new

    @staticmethod
    def _typed(table: str, rows: DataFrame) -> DataFrame:
        """Rows in the declared columns and types; the same file schema in all folders."""
        present = set(rows.columns)
        return rows.select(
            *((F.col(c.name) if c.name in present else F.lit(None)).cast(c.type).alias(c.name) for c in TABLES[table].columns)
        )

    def _append(self, log: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{log}")

    def _publish(self, new: Manifest, base: Manifest) -> None:
        if self.manifest().id != base.id:
            raise Conflict(f"commit {base.number} is not the newest any more")
        self._append("commits", [(new.number, new.id, base.id, [tuple(f) for f in new.folders])], _COMMITS)
        if self.manifest(new.number).id != new.id:
            raise Conflict(f"commit {new.number} was taken")

    # ---- upkeep

    def compact(self, most: int = 8) -> Manifest:
        """Write months, and tables without months, that lie in more than ``most`` folders again as one."""
        base = self.manifest()
        parts: dict[tuple, list[Folder]] = defaultdict(list)
        for folder in base.folders:
            parts[folder.table, folder.month].append(folder)
        crowded = {place: own for place, own in parts.items() if len(own) > most}
        if not crowded:
            return base
        commit, folders = f"c{uuid.uuid4().hex}", list(base.folders)
        names = sorted({table for table, _ in crowded})
        self._append("begun", [(commit, names)], _BEGUN)
        for table in names:
            old = [f for (name, _), own in crowded.items() if name == table for f in own]
            by_month(self._typed(table, self._rows(table, old)), table).parquet(f"{self.root}/data/{table}/commit={commit}")
            folders = [f for f in folders if f not in old] + [Folder(table, month, commit) for name, month in crowded if name == table]
        self._publish(Manifest(base.number + 1, commit, tuple(folders)), base)
        return self.manifest(base.number + 1)

    def remove_old(self, keep: int = 1) -> list[str]:
        """Empty the folders that none of the newest ``keep`` commits uses, failed ones' included.

        Only while no commit and no reader of an older state is at work. A folder is emptied by
        overwriting it with no rows, so it is left with one file of a few hundred bytes.
        """
        states = [
            [Folder(*f) for f in r.folders] for r in self._log("commits", _COMMITS).orderBy(F.desc("number")).collect()
        ]  # one row per commit
        used = {f for folders in states[:keep] for f in folders}
        paths = {f.path: f.table for folders in states[keep:] for f in folders if f not in used}
        finished = {r.id for r in self._log("commits", _COMMITS).select("id").collect()}
        for row in self._log("begun", _BEGUN).collect():
            if row.id not in finished:
                paths.update({Folder(table, None, row.id).path: table for table in row.tables})
        for path, table in sorted(paths.items()):
            self.spark.createDataFrame([], TABLES[table].schema).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/{path}")
        return sorted(paths)


class _Stored(Tables):
    """Tables at one commit; a range of months is a choice of folders."""

    def __init__(self, store: Store, folders: dict[str, list[Folder]]):
        self._store, self._folders = store, folders

        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: store._rows(name, folders.get(name, []))

        super().__init__({name: reader(name) for name in TABLES}, by_month=True)

    def of_months(self, name: str, first: Moment | None = None, last: Moment | None = None) -> DataFrame:
        if TABLES[name].month_of is None:
            return self[name]
        low = "" if first is None else f"{to_datetime(first):%Y-%m}"
        high = "9999-99" if last is None else f"{to_datetime(last):%Y-%m}"
        bounded = first is not None or last is not None
        chosen = [f for f in self._folders.get(name, []) if (low <= f.month <= high and f.month != NO_MONTH) or not bounded]
        return Tables({name: self._store._rows(name, chosen)})[name]


def _months(rows: DataFrame, table: str) -> set[str | None]:
    """The storage months of rows; of a table without months the one place all rows have."""
    if TABLES[table].month_of is None:
        return {None}
    return {r[0] for r in with_month(rows, table).select(MONTH).distinct().collect()}
