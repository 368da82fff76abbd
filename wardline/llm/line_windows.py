"""Line dedup by overlapping three-line windows.

A window is three consecutive lines that hold a word, each without white space at its
ends. Windows that occur more than once in the whole table are repeated; the first
occurrence, by document id (null last), text hash and line, stays. The lines that later
occurrences cover are merged into runs and removed, with blank lines inside a run.

Cases: null stays null and counts no lines; texts with fewer than three lines that hold
a word have no window and stay as they are. Rows that share both id and text are one
document to the order: they lose the same lines. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import slices, staged, text_hash, utf8

LINES = 3
_BLANK = b" \t\n\r\x0b\x0c"


def _lines_with_words(text: bytes) -> tuple[list[bytes], list[int]]:
    lines = text.split(b"\n")
    return lines, [i for i, line in enumerate(lines) if line.strip(_BLANK)]


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``(high, low, doc_id, _hash, at)``: 128-bit hashes of all windows; ``at`` counts lines with words."""
    schema = docs.select(
        F.lit(0).cast("long").alias("high"), F.lit(0).cast("long").alias("low"), "doc_id", "__llm_hash", F.lit(0).alias("at")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, rows, places = [], [], []
            for row, text in enumerate(utf8(part)):
                every, full = _lines_with_words(text)
                stripped = [every[i].strip(_BLANK) for i in full]
                n = len(stripped) - lines + 1
                if n > 0:
                    hashes += [xxhash.xxh3_128_digest(b"\n".join(stripped[i : i + lines])) for i in range(n)]
                    rows += [row] * n
                    places += range(n)
            if rows:
                pair = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                take = pa.array(rows, type=pa.int64())
                own = [part.column(part.schema.get_field_index(c)).take(take) for c in ("doc_id", "__llm_hash")]
                columns = [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), *own, pa.array(places, type=pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select("doc_id", "__llm_hash", "text").mapInArrow(run, schema)


#: What :func:`without_repeated_windows` adds.
COUNTS = ("n_lines", "n_removed", "n_words_left")


def without_repeated_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` with the cleaned ``text`` and ``n_lines``, ``n_removed``, ``n_words_left``.

    Columns of these names that the table has give way; ``common.set_aside`` keeps them.
    """
    marked = docs.withColumn("__llm_hash", text_hash(F.col("text")))
    found = staged(windows(marked, lines), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__llm_hash", "at")
    repeated = found.groupBy("high", "low").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = staged(repeated.where(F.col("first") != F.col("last")).drop("last"), "repeated-windows")
    later = found.join(repeated, ["high", "low"]).where(place != F.col("first"))
    covered = staged(later.groupBy("doc_id", "__llm_hash").agg(F.collect_set("at").alias("__llm_starts")), "covered")
    covered = covered.select(F.col("doc_id").alias("__llm_id"), F.col("__llm_hash").alias("__llm_own"), "__llm_starts")
    same = marked.doc_id.eqNullSafe(F.col("__llm_id")) & (marked["__llm_hash"] == F.col("__llm_own"))
    # one plan at every size: the covered lines grow with the documents
    joined = marked.join(covered.hint("merge"), same, "left").drop("__llm_hash", "__llm_id", "__llm_own")
    return _cut(joined, docs, lines)


def remaining(text: bytes, starts: list[int], lines: int) -> tuple[bytes, int, int]:
    """The text without the lines under the windows at ``starts``; lines with words, removed ones."""
    every, full = _lines_with_words(text)
    covered = sorted({s + k for s in starts for k in range(lines)})
    drop: set[int] = set()
    for k, at in enumerate(covered):
        drop.add(full[at])
        if k and covered[k - 1] == at - 1:
            drop.update(range(full[at - 1], full[at]))
    return b"\n".join(line for i, line in enumerate(every) if i not in drop), len(full), len(covered)


def _cut(joined: DataFrame, docs: DataFrame, lines: int) -> DataFrame:
    counts = COUNTS
    columns = [c for c in docs.columns if c not in counts]
    schema = joined.select(*columns, *(F.lit(0).cast("long").alias(c) for c in counts)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            starts = part.column(part.schema.get_field_index("__llm_starts")).to_pylist()
            at = part.schema.get_field_index("text")
            null = part.column(at).is_null().to_pylist()
            texts, counted = [], []
            for text, own, missing in zip(utf8(part), starts, null, strict=True):
                left, n, gone = remaining(text, own or [], lines) if own else (text, len(_lines_with_words(text)[1]), 0)
                texts.append(None if missing else left)
                counted.append((n, gone, len(left.split())))
            cleaned = pa.array(texts, type=pa.binary()).cast(part.column(at).type, safe=False)  # bytes that are not UTF-8 stay
            out = [cleaned if c == "text" else part.column(part.schema.get_field_index(c)) for c in columns]
            out += [pa.array([row[k] for row in counted], type=pa.int64()) for k in range(len(counts))]
            yield pa.RecordBatch.from_arrays(out, names=schema.fieldNames())

    return joined.mapInArrow(run, schema)
