"""Bounded-space online packing of documents into windows of a fixed number of tokens.

Each input partition keeps a fixed number of open windows. A piece goes to the open
window that it fills best; if none has room, the fullest window is emitted and a new one
opened. A document longer than a window fills whole windows first; what is left of it is
one piece. The pieces of the windows that stay open at the end of the partitions are
merged in rounds: groups of partitions pack them again, best fit by falling length, and
pass on few windows, until one group is left.

Cases: null and empty texts are the end id alone; documents that repeat are packed as
often as they occur; an empty table gives no sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import slices, staged, utf8
from wardline.llm.tokens import encoder

CAPACITY, OPEN, GROUP = 2048, 64, 16
_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
_PLACED = pa.schema([*_PIECE, ("part", pa.int64()), ("window", pa.int64()), ("offset", pa.int64()), ("closed", pa.bool_())])
_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, window long, offset long, closed boolean"
)


class Packer:
    """Open windows by room; ``done`` has the pieces of emitted windows."""

    def __init__(self, capacity: int, most_open: int) -> None:
        self.capacity, self.most_open = capacity, most_open
        self.rooms: list[tuple[int, int]] = []  # (room, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.made = 0
        self.done: list[tuple[int, list[tuple]]] = []

    def add(self, piece: tuple) -> None:
        length = piece[2]
        at = bisect.bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, window = self.rooms.pop(at)
        else:
            if len(self.rooms) >= self.most_open:
                self.emit()
            room, window = self.capacity, self.made
            self.made += 1
            self.pieces[window] = []
        self.pieces[window].append(piece)
        if room == length:
            self.done.append((window, self.pieces.pop(window)))
        else:
            bisect.insort(self.rooms, (room - length, window))

    def emit(self) -> None:
        """Close the fullest window."""
        _, window = self.rooms.pop(0)
        self.done.append((window, self.pieces.pop(window)))

    def rows(self, part: int, closed: bool) -> list[tuple]:
        """The rows of the emitted windows, or else of the open ones."""
        out, windows = [], self.done if closed else list(self.pieces.items())
        for window, pieces in windows:
            offset = 0
            for piece in pieces:
                out.append((*piece, part, window, offset, closed))
                offset += piece[2]
        if closed:
            self.done = []
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_PLACED)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _PLACED, strict=True)], schema=_PLACED)


def _pack_partitions(docs: DataFrame, tokenizer: str, end_id: int, spaced: bool, capacity: int, most_open: int) -> DataFrame:
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer, spaced, "uint32"), Packer(capacity, most_open)
        part = TaskContext.get().partitionId()
        for rows in slices(batches):
            ids = rows.column(rows.schema.get_field_index("doc_id")).to_pylist()
            for doc_id, encoded in zip(ids, encode(utf8(rows)), strict=True):
                data = encoded + end
                n = len(data) // 4
                for start in range(0, n, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    packer.add((doc_id, start, len(piece) // 4, zlib.crc32(piece), n))
            yield _batch(packer.rows(part, True))
        yield _batch(packer.rows(part, False))

    return docs.select("doc_id", "text").mapInArrow(run, _DDL)


def _merge(leftovers: DataFrame, capacity: int, most_open: int, last: bool) -> DataFrame:
    """Pack the pieces of each group anew; all but ``most_open`` windows are closed."""

    def run(rows: pa.Table) -> pa.Table:
        group = rows.column("group")[0].as_py()
        rows = rows.sort_by([(n, "ascending") for n in ("part", "window", "offset")])
        pieces = list(zip(*(rows.column(name).to_pylist() for name, _ in _PIECE), strict=True))
        pieces.sort(key=lambda p: -p[2])
        packer = Packer(capacity, len(pieces))
        for piece in pieces:
            packer.add(piece)
        while len(packer.rooms) > (0 if last else most_open):
            packer.emit()
        return pa.Table.from_batches([_batch(packer.rows(group, True)), _batch(packer.rows(group, False))])

    group = (F.col("part") / GROUP).cast("long").alias("group")
    return leftovers.select("*", group).groupBy("group").applyInArrow(run, _DDL)


def packed(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    spaced: bool = True,
    capacity: int = CAPACITY,
    most_open: int = OPEN,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``."""
    placed = [staged(_pack_partitions(docs, tokenizer, end_id, spaced, capacity, most_open), "placed")]
    parts = placed[0].agg(F.max("part")).first()[0] or 0
    while True:
        last = parts < GROUP
        parts //= GROUP
        placed.append(staged(_merge(placed[-1].where("not closed").drop("closed"), capacity, most_open, last), "merged"))
        if last:
            break
    rounds = [x.where("closed").withColumn("round", F.lit(i)) for i, x in enumerate(placed)]
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return _numbered_windows(every)


def _numbered_windows(every: DataFrame) -> DataFrame:
    """Window numbers of all parts in a row: gaps only where a window was passed on."""
    keys = ["round", "part"]
    sizes = every.groupBy(*keys).agg((F.max("window") + 1).alias("n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    bases = staged(sizes.select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "bases")
    joined = every.join(bases, keys)
    names = [name for name, _ in _PIECE]
    return joined.select(*names, (F.col("base") + F.col("window")).alias("sequence_id"), "offset")
