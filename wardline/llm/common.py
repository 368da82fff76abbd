"""What the operators share: tables, written intermediate results, text in Arrow batches."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That is enough in local mode and where all machines mount the code; elsewhere the
    package is shipped as usual, with ``--py-files``.
    """
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (known, root) if p)


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors reach.

    The cluster names it in ``spark.checkpoint.dir``; where that is unset, the
    warehouse, which they share as well, is used. A warehouse in the driver's own files
    is refused on a cluster, as executors would read less than was written.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if spark.conf.get("spark.checkpoint.dir", None) is None and re.match(r"file:|/", named) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/") + "/llm-staging"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df``, evaluated once into a table in the shared folder and read back.

    Cuts the lineage: a lost executor costs only tasks of the current step.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with its columns of these names renamed, and what gives a result their names and order back."""
    held = {c: f"__llm_own_{c}" for c in docs.columns if c in set(names)}

    def back(result: DataFrame) -> DataFrame:
        return result.select(*(F.col(held.get(c, c)).alias(c) for c in docs.columns))

    return docs.withColumnsRenamed(held), back


def text_hash(text: Column) -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small parts, so that a task holds few documents in a second form."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts as bytes; a null is empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return pc.fill_null(values, b"").to_pylist()
