"""Token ids in flat binary files with 64-bit document offsets.

Format, for each part k of a folder: ``part-k.tokens`` holds unsigned little-endian ids of
all its documents in a row, ``part-k.offsets`` int64 positions in it, one more than there
are documents, ``part-k.ids`` int64 document ids and ``part-k.nulls`` one byte per
document (1: it has no id). Parts follow each other in ascending order of the ids, null
last. The manifest has one row per part; its ``first_token`` and ``first_doc`` are prefix
sums, so a document's place in the whole is that of its part plus its own offset.

A task writes its files under other names and moves them into place, so a task that is
run again replaces them by equal ones. The folder must be a path that all executors
mount, as memory mapping needs files.

Cases: null and empty texts hold the end id alone; rows that share an id come in the
order of their text hashes; an empty table has no documents.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import shared_folder, slices, staged, text_hash, utf8
from wardline.llm.tokens import encoder


def mounted(folder: str) -> str:
    """The path of a ``file:`` address."""
    scheme, colon, path = folder.partition(":")
    if not colon:
        return folder
    if scheme != "file":
        raise ValueError(f"memory mapping needs a mounted folder, not {folder}")
    return "/" + path.lstrip("/")


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, dtype: str = "uint16", spaced: bool = False, folder: str | None = None
) -> DataFrame:
    """Write all texts; returns the manifest."""
    spark = docs.sparkSession
    folder = mounted(folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}")
    little = np.dtype(dtype).newbyteorder("<")
    end = np.array([end_id], dtype=little).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced, dtype)
        part = TaskContext.get().partitionId()
        base, attempt = f"{folder}/part-{part:05d}", f".{TaskContext.get().taskAttemptId()}"
        os.makedirs(folder, exist_ok=True)
        docs_so_far = tokens_so_far = 0
        names = [f"{base}.{kind}" for kind in ("tokens", "offsets", "ids", "nulls")]
        files = [open(name + attempt, "wb") for name in names]  # noqa: SIM115
        try:
            tokens, offsets, ids, nulls = files
            offsets.write(np.zeros(1, dtype="<i8").tobytes())
            for rows in slices(batches):
                encoded = [x + end for x in encode(utf8(rows))]
                tokens.write(b"".join(encoded))
                ends = tokens_so_far + np.cumsum([len(x) // little.itemsize for x in encoded])
                offsets.write(ends.astype("<i8").tobytes())
                column = rows.column(rows.schema.get_field_index("doc_id"))
                ids.write(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                nulls.write(column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes())
                docs_so_far, tokens_so_far = docs_so_far + rows.num_rows, int(ends[-1])
        finally:
            for file in files:
                file.close()
        for name in names:
            os.replace(name + attempt, name)
        yield pa.RecordBatch.from_pylist([{"part": part, "path": base, "n_docs": docs_so_far, "n_tokens": tokens_so_far}])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("__llm_hash")]
    ordered = docs.select("doc_id", "text", text_hash(F.col("text")).alias("__llm_hash"))
    ordered = ordered.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    written = ordered.mapInArrow(run, "part long, path string, n_docs long, n_tokens long")
    written = staged(written, "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sums = [F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for c, n in (("n_docs", "first_doc"), ("n_tokens", "first_token"))]
    return staged(written.select("*", *sums, F.lit(dtype).alias("dtype")), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document from the mapped files: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                if not part["n_docs"]:
                    continue
                kind = np.dtype(part["dtype"]).newbyteorder("<")
                load = lambda name, dtype, p=part: np.memmap(f"{p['path']}.{name}", dtype=dtype, mode="r")
                tokens, offsets, ids, nulls = load("tokens", kind), load("offsets", "<i8"), load("ids", "<i8"), load("nulls", np.uint8)
                for at in range(0, part["n_docs"], 4096):
                    to = min(at + 4096, part["n_docs"])
                    bounds = np.array(offsets[at : to + 1])
                    crcs = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    columns = [
                        pa.array(np.array(ids[at:to], dtype=np.int64), mask=np.array(nulls[at:to], dtype=bool)),
                        pa.array(part["first_token"] + bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        pa.array(crcs, type=pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
