"""Batches of changes under a unique key, decided one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.requests import AT, ID
from wardline.session import stage


def _label(pairs: pa.Table) -> np.ndarray:
    """For each (row, place) the smallest row that is connected to it by shared places."""
    row = pairs["row"].to_numpy()
    places = np.stack([pairs[c].to_numpy() for c in pairs.column_names if c != "row"], axis=1)
    _, place = np.unique(places, axis=0, return_inverse=True)
    _, index = np.unique(row, return_inverse=True)
    label = row.copy()
    while True:
        of_place = np.full(place.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(of_place, place.ravel(), label)
        of_row = np.full(index.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(of_row, index, of_place[place.ravel()])
        if (of_row[index] == label).all():
            return label
        label = of_row[index]


def _components(options: DataFrame, group: str, key: str, columns: Sequence[str]) -> DataFrame:
    """``key, component`` of the rows that may ever want, hold or leave a place another row may.

    The work on a group is bounded by its unique key, which limits its rows and their places;
    it does not depend on the number of moves.
    """
    places = options.select(group, F.col(key).cast("bigint").alias("row"), *(f"{c}_options" for c in columns))
    for c in columns:
        places = places.withColumn(c, F.explode(f"{c}_options")).drop(f"{c}_options")
    shared = places.groupBy(group, *columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    pairs = places.join(shared, [group, *columns], "left_semi")

    def label(part: pa.Table) -> pa.Table:
        found = pa.table({"row": part["row"], "component": pa.array(_label(part.drop_columns([group])))})
        return found.group_by("row").aggregate([("component", "min")]).rename_columns([key, "component"])

    return pairs.groupBy(group).applyInArrow(label, f"{key} bigint, component bigint")


class _State:
    """The places of the rows of many components, as arrays."""

    def __init__(self, rows: pa.Table, columns: Sequence[str]):
        order = np.argsort(rows["row"].to_numpy())
        self.rows = rows["row"].to_numpy()[order]
        self.at = np.stack([rows[c].to_numpy()[order] for c in columns], axis=1)
        sizes = np.stack([rows[f"{c}_size"].to_numpy()[order] for c in columns], axis=1)
        component = rows["component"].to_numpy()[order]
        _, first, index = np.unique(component, return_index=True, return_inverse=True)
        places = sizes[first].prod(axis=1)
        base = np.concatenate([[0], np.cumsum(places)])
        self.base = base[index]
        # places of a component are numbered as digits of mixed radix
        self.weight = np.concatenate([np.cumprod(sizes[:, :0:-1], axis=1)[:, ::-1], np.ones((len(sizes), 1), np.int64)], axis=1)
        self.held = np.bincount(self._place(np.arange(len(self.rows)), self.at), minlength=base[-1])

    def _place(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.base[row] + (at * self.weight[row]).sum(axis=1)

    def refused(self, keys: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Make moves of different components at once, and tell which of them are refused."""
        row = np.searchsorted(self.rows, keys)
        old = self.at[row]
        new = np.where(given < 0, old, given)
        from_, to = self._place(row, old), self._place(row, new)
        taken = (from_ != to) & (self.held[to] > 0)
        done = (from_ != to) & ~taken
        self.held[from_[done]] -= 1
        self.held[to[done]] += 1
        self.at[row[done]] = new[done]
        return taken


def refused_moves(
    stored: DataFrame, moves: DataFrame, group: str, key: str, columns: Sequence[str], keep: Callable[[DataFrame], DataFrame] = stage
) -> DataFrame:
    """The ids of moves that would give two rows the same (group, *columns).

    ``stored`` holds key, group and columns, all numbers and none NULL. A move names a row
    (``key``) and its group, which never changes, and new values of some columns, NULL meaning
    the old one. Moves apply in batch order; a refused one changes nothing, and a later one may
    take a place that an earlier one left. Rows that repeat a key already may stay.

    A row can only come to places made of its own values and those its moves name. Rows that
    share such a place depend on each other; all others do not, even in one group. So:

    * the moves of a row that shares no place are accepted, without looking at them;
    * the others fall into components, which are spread over the tasks however many moves their
      group has. A task makes the n-th moves of all its components at once, in arrays.

    A task holds the rows of its components and a batch of moves. Only the moves of one
    component are one sequence, as each of them may depend on all before.
    """
    given = moves.groupBy(key).agg(*(F.collect_set(c).alias(f"{c}_given") for c in columns))
    base = stored.select(group, key, *columns).join(moves.select(group).distinct(), group, "left_semi")
    options = base.join(given, key, "left").select(
        group,
        key,
        *columns,
        *(
            F.coalesce(F.array_union(F.array(F.col(c)), f"{c}_given"), F.array(F.col(c))).alias(f"{c}_options")
            for c in columns
        ),
    )
    options = keep(options)
    members = options.join(_components(options, group, key, columns), key)
    # The values that a component can meet, in order: a value is coded by its place among them.
    values = members.groupBy("component").agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{c}_options")))).alias(f"{c}_values") for c in columns)
    )
    members = keep(members.join(values, "component").select(key, "component", *columns, *(f"{c}_values" for c in columns)))

    def coded(c: str):
        return F.coalesce(F.array_position(f"{c}_values", F.col(c)) - 1, F.lit(-1)).alias(c)

    sizes = [F.size(f"{c}_values").cast("bigint").alias(f"{c}_size") for c in columns]
    codes = [coded(c) for c in columns]
    unasked = [F.lit(None).cast(moves.schema[c].dataType).alias(c) for c in (AT, ID)]
    rows = members.select("component", F.col(key).alias("row"), *codes, *sizes, *unasked, F.lit(False).alias("asked"))
    known = members.drop(*columns)
    asked = moves.join(known, key).select("component", F.col(key).alias("row"), *codes, *sizes, AT, ID, F.lit(True).alias("asked"))
    turns = Window.partitionBy("component").orderBy("asked", AT, ID)
    ordered = asked.unionByName(rows).withColumn("n", F.row_number().over(turns)).sortWithinPartitions("asked", "n")
    names = list(columns)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        state: _State | None = None
        for batch in batches:
            is_move = batch["asked"].to_numpy(zero_copy_only=False)
            split = int(np.searchsorted(is_move, True))
            if split:
                waiting.append(batch.slice(0, split))
            if split == batch.num_rows:
                continue
            if state is None:
                state = _State(pa.Table.from_batches(waiting), names)
                waiting.clear()
            part = batch.slice(split)
            n, keys, ids = (part[c].to_numpy() for c in ("n", "row", ID))
            given = np.stack([part[c].to_numpy() for c in names], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1, [len(n)]])
            refused = [state.refused(keys[a:b], given[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({ID: pa.array(ids[np.concatenate(refused)], pa.int64())})

    return ordered.mapInArrow(decide, f"{ID} bigint")
