"""A corpus from raw documents to packed sequences, in five stages.

Each stage reads all that the one before kept, and writes a table. All but the last return
the columns of the documents, whatever others the table has and however they are named. A stage
that changes texts sets ``n_chars`` anew, where there is one.

Cases: a document with a null or empty text, or without words, goes at the quality rules, as the
base rules ask for 20 words; rows with null ids take part; of repeated rows one stays at the
near-dedup; bytes that are not UTF-8 count as replacement characters; texts of any length are read
whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import divergence, line_windows, mixing, packing, simhash
from wardline.llm.common import set_aside, staged, table, workers_import
from wardline.llm.queries import BYTE_END, vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and resemble their language."""
    own, back = set_aside(docs, divergence.ADDED)
    return back(divergence.judged(own).where("kept"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated three-line windows; one of which nothing is left goes."""
    own, back = set_aside(docs, line_windows.COUNTS)
    left = line_windows.without_repeated_windows(own).where("n_removed = 0 or n_words_left > 0")
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return back(left)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.simhash_survivors(docs, shingle=3, max_bits=2)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a document without words is not taken."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"), BYTE_END)


def _stage(name: str, function: Callable[..., DataFrame]) -> tuple[str, Callable[..., DataFrame]]:
    def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        workers_import(spark)
        return function(spark, docs, sf_dir)

    return name, apply


STAGES = [
    _stage("quality rules", quality_rules),
    _stage("line dedup", line_dedup),
    _stage("SimHash near-dedup", simhash_dedup),
    _stage("mixing to target weights", source_mix),
    _stage("packing", pack),
]

#: No SQL: fingerprints, tokenizers and learned references are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
