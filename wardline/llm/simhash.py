"""SimHash near-duplicates through Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments of 22, 21 and 21 bits. Of at most
two differing bits none lies in at least one segment (pigeonhole), and the next segment
then differs in at most two, so both fingerprints share one of its codeword indices.
A key is therefore one segment as it is (21 or 22 bits) and one codeword index (12 bits)
of the segment after it: three to eighteen keys for each fingerprint. Fingerprints that
share a key are compared bit by bit.

Cases: null and empty texts and texts without words have fingerprint zero and form one
group; a text with fewer words than a shingle is one shingle; copies share a fingerprint
and are compared once; an empty table gives an empty result. Rows with a null id count,
but lend their component no id: a component of such rows alone has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import golay
from wardline.llm.common import slices, staged, text_hash, utf8
from wardline.llm.components import connected, local_roots

BITS = 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Keys with more fingerprints than this are searched through midpoints, not by pairs.
PAIRWISE = 96
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(*(words[i:] for i in range(shingle)), strict=False)
    n = len(words) - shingle + 1
    hashes = np.fromiter((digest(join(g), SEED) for g in grams), dtype=np.uint64, count=n)
    ones = np.zeros(BITS, dtype=np.int64)
    for start in range(0, n, 1 << 14):
        part = hashes[start : start + (1 << 14), None].view(np.uint8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs`` with ``__llm_fp``, the fingerprint of ``text`` as a signed long."""
    schema = docs.select("*", F.lit(0).cast("long").alias("__llm_fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = np.array([fingerprint(t, shingle) for t in utf8(part)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def golay_keys(fingerprints: DataFrame) -> DataFrame:
    """``(key, fp)``: the keys under which each fingerprint meets all within two bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            fps = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            segments = [(fps >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            for i, exact in enumerate(segments):
                rows, index = golay.indices(segments[(i + 1) % len(segments)])
                keys = (np.int64(i) << 34) | (exact[rows] << golay.DATA_BITS) | index
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows].view(np.int64))], names=["key", "fp"])

    return fingerprints.select("fp").mapInArrow(run, "key long, fp long")


def _stars(groups: DataFrame, max_bits: int) -> DataFrame:
    """Links ``(a, b)`` that connect what is linked within each small list ``fps``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                x = np.sort(np.array(fps.values.to_numpy(zero_copy_only=False)))
                unsigned = x.view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
                linked = np.bitwise_count(unsigned[:, None] ^ unsigned[None, :]) <= max_bits
                roots = local_roots(linked)
                moved = roots != np.arange(len(x))
                a.append(x[moved])
                b.append(x[roots[moved]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return groups.select("fps").mapInArrow(run, "a long, b long")


def fingerprint_links(fingerprints: DataFrame, max_bits: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """Links that connect all distinct ``fp`` within ``max_bits`` (0 to 2) bits.

    A key with up to ``pairwise`` fingerprints compares them with each other. A fuller
    key is exact as well, without pairs: each of its fingerprints is filed under itself
    and its 64 neighbours at one bit; two fingerprints meet there if and only if they
    are within two bits, and at most 65 meet at one place.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys find fingerprints that differ in at most two bits")
    keys = staged(golay_keys(fingerprints), "golay-keys")
    sizes = staged(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "golay-sizes")
    few = keys.join(sizes.where(F.col("n") <= pairwise).select("key"), "key").groupBy("key")
    many = keys.join(sizes.where(F.col("n") > pairwise).select("key"), "key", "left_semi").select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)]
    near = many.select("fp", F.explode(F.array(*flips)).alias("place")).groupBy("place")
    lists = [group.agg(F.collect_list("fp").alias("fps")) for group in (few, near)]
    lists = [x.where(F.size("fps") > 1).select("fps") for x in lists]
    return _stars(lists[0].unionByName(lists[1]), max_bits).distinct()


def fingerprint_components(fingerprinted: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(__llm_fp, component_id)`` with one row per fingerprint, from rows ``(doc_id, __llm_fp)``."""
    distinct = staged(
        fingerprinted.groupBy(F.col("__llm_fp").alias("fp")).agg(F.min("doc_id").alias("first_id")), "fingerprints"
    )
    roots = connected(fingerprint_links(distinct, max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = staged(rooted, "rooted")
    ids = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    return staged(rooted.join(ids, "root").select(F.col("fp").alias("__llm_fp"), "component_id", "root"), "components")


def simhash_groups(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` in hex and ``component_id``."""
    marked = staged(with_fingerprints(docs.select("doc_id", "text"), shingle).drop("text"), "marked")
    groups = fingerprint_components(marked, max_bits).drop("root")
    return marked.join(groups, "__llm_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("__llm_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_survivors(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id.

    Rows that repeat the smallest id count as copies too; one of them stays, the one
    whose text comes first by its hash. If no row of a group has an id, one row stays.
    """
    keys = {"__llm_row": F.xxhash64("doc_id", "text"), "__llm_hash": text_hash(F.col("text"))}
    rows = docs.withColumns(keys)
    marked = with_fingerprints(rows.select("doc_id", "text", *keys), shingle).drop("text")
    marked = staged(marked, "marked")
    groups = fingerprint_components(marked.select("doc_id", "__llm_fp"), max_bits)
    first = marked.join(groups, "__llm_fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = first.groupBy("root").agg(F.min(F.struct("__llm_hash", "__llm_row")).alias("key")).select("key.*")
    # one plan at every size: the kept rows grow with the documents
    chosen = rows.join(staged(kept, "kept").hint("merge"), list(keys), "left_semi")
    return chosen.dropDuplicates(list(keys)).select(*docs.columns)
