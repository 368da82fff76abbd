from __future__ import annotations

import pyarrow.parquet as pq
import pytest

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows() -> list[dict]:
    """The small document table."""
    return pq.read_table(f"{SMALL}/documents.parquet").to_pylist()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


#: Nulls in every column, empty and blank texts, repeated rows and ids, ties, a very long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", "a", 4),
    (4, "one", "en", None, 3),
    (5, "one two three four", "xx", "b", 18),
    (5, "one two three four", "xx", "b", 18),
    (5, "another text under the same id", None, "b", 30),
    (None, "no id here", "en", "b", 10),
    (None, None, None, None, None),
    (6, "the cat and the dog of the house\n" * 3000, "en", "a", 99000),
    (7, "x" * 50_000, "en", "c", 50_000),
    (8, "Grüße éèê ¡hola! 日本語 \U0001f600 word joined", "de", "c", 40),
]
CLASHES = (
    "_fp", "size", "target", "taken", "copies", "source_size", "kept", "n_words", "n_lines", "n_removed", "component_id", "root",
    "score", "part", "window", "position", "hit", "spans", "held_out", "_hash", "rank", "weight", "whole", "key", "node",
)


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with extra columns named like those that operators use."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(ODD, DOCS)
    return frame.select("*", *(F.lit("x").alias(c) for c in CLASHES))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
