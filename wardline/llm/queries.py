"""The registered queries of the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import (
    byte_cnn,
    collocations,
    divergence,
    epsilon_grid,
    line_windows,
    mixing,
    multi_index,
    naive_bayes,
    packing,
    pii_boosting,
    simhash,
    token_files,
    toxic_cnn,
)
from wardline.llm.common import table

#: The end-of-document ids of the two vocabularies, as their users chose them.
WORD_END, BYTE_END = 2, 1


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.with_copies(table(spark, folder, "documents"))
    return mix.select("kept.doc_id", "size", "source_size", "target", "taken")


def op2_distribution_divergence(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text")
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return divergence.judged(docs).select("doc_id", *columns)


def op3_golay_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, folder, "documents"), shingle=3, max_bits=2)


def op4_epsilon_grid_join(spark: SparkSession, folder: str) -> DataFrame:
    return epsilon_grid.embedding_links(table(spark, folder, "embeddings"), threshold=0.95)


def op5_line_windows(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = line_windows.without_repeated_windows(table(spark, folder, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    manifest = token_files.write_token_files(docs, vocabulary("word_bpe_49k.json"), WORD_END)
    return token_files.read_token_files(manifest)


def op7_bounded_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"), BYTE_END)


def op8_candidate_boosting(spark: SparkSession, folder: str) -> DataFrame:
    return pii_boosting.pii(table(spark, folder, "documents"))


def op9_text_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return toxic_cnn.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_byte_cnn(spark: SparkSession, folder: str) -> DataFrame:
    return byte_cnn.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = multi_index.whole_rows(table(spark, folder, "embeddings"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return multi_index.hard_negatives(rows.withColumn("label", label), every=100)


def op12_naive_bayes(spark: SparkSession, folder: str) -> DataFrame:
    return naive_bayes.languages(table(spark, folder, "documents"))


def op13_son_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_source_mixing,
        op2_distribution_divergence,
        op3_golay_simhash,
        op4_epsilon_grid_join,
        op5_line_windows,
        op6_token_files,
        op7_bounded_packing,
        op8_candidate_boosting,
        op9_text_cnn,
        op10_byte_cnn,
        op11_multi_index,
        op12_naive_bayes,
        op13_son_phrases,
    )
}
