"""Phrase collocations, mined by partitioning (SON): shards first, exact counts after.

A phrase is a run of words inside a piece of a text. Documents are dealt to shards by their id
without its last bits, so that shards are about equally large. With a support of s, a phrase that occurs s times in a language occurs, in at least
one shard, s times that shard's part of the language's words. So each shard is mined for all
phrases that reach this lowered support, and the union of what the shards find holds all
frequent phrases. One more pass counts the union exactly, by the words themselves.

A shard is mined by many tasks, level by level: a phrase of m words is counted only where
its first and its last m - 1 words are frequent in the shard (the last levels share a pass,
and there its parts of three words count). Tasks know these from bitmaps over phrase
hashes, of a bounded size. A false hit costs a count and changes no result.
The number of shards is fixed, so the lowered support does not fall as the data grow.

Cases: a null text is empty and has no phrases; a null language is ``und``; repeated rows and
ids count each time they occur; texts of any length are read whole; bytes that are not UTF-8
come out as replacement characters; ties are ordered by the phrase; an empty table gives an
empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import slices, staged, utf8

#: Least occurrences of a phrase, most words in it, and phrases reported of a language.
SUPPORT, LONGEST, TOP = 100, 5, 2000
SHARDS = 8
#: Phrases of up to so many words are mined level by level, longer ones in one pass.
SINGLY = 3
#: Ids that differ in the last so many bits only are in one shard; a small table is one shard.
NEAR = 11
#: Bytes of texts that a task holds at once, and that it hashes at once; longer texts and words make them longer.
CHUNK, STRETCH = 6_000_000, 1_000_000
#: Bits of a bitmap, as powers of two: at least, at most, and per frequent phrase.
LEAST_BITS, MOST_BITS, BITS_EACH = 16, 28, 16
#: One page of a bitmap, as Spark's bitmap functions build it.
PAGE_BITS = 8 * 4096
#: Separators of pieces become a full stop, white space a space, and A-Z lower case.
_FOLD = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x100000001B3
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _stretch_powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, dtype=np.uint64)
    factors[0] = 1
    return np.multiply.accumulate(factors)


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n - 1; those of a usual stretch are kept."""
    usual = 2 * STRETCH
    return _stretch_powers(base, usual)[:n] if n <= usual else _stretch_powers.__wrapped__(base, n)


def word_hashes(text: bytes) -> np.ndarray:
    """The words of a text in order as polynomial hashes, with 0 wherever a piece ends.

    Equal words have equal hashes; different ones may share one. All bytes of a stretch are hashed at
    once: the sum of byte * base^place over a word, divided by the power of the place it starts at.
    """
    folded, parts, start = text.translate(_FOLD), [], 0
    while start < len(folded):
        end = start + STRETCH
        if end < len(folded):  # not inside a word
            ends = [x for x in (folded.find(b" ", end), folded.find(b".", end)) if x >= 0]
            end = min(ends, default=len(folded))
        parts.append(_stretch(np.frombuffer(folded, dtype=np.uint8, count=min(end, len(folded)) - start, offset=start)))
        start = end
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)


def _stretch(data: np.ndarray) -> np.ndarray:
    stop = data == 46
    word = ~stop & (data != 32)
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    own = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts]
    stop[starts] = True
    at = np.flatnonzero(stop)
    out = np.zeros(len(at), dtype=np.uint64)
    out[word[at]] = np.maximum(own, np.uint64(1))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    x = (x ^ (x >> np.uint64(29))) * _MIX[1]
    return x ^ (x >> np.uint64(32))


class _Vocabulary:
    """Numbers for the words of a chunk; 0 ends a piece."""

    def __init__(self) -> None:
        self.ids: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids[b"."]

    def numbers(self, text: bytes) -> np.ndarray:
        words = text.translate(_FOLD).replace(b".", b" . ").split()
        words.append(b".")
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def hashes(self) -> np.ndarray:
        return word_hashes(b" ".join(self.ids))


def phrase_hits(words: np.ndarray, seed: int, bitmaps: list[np.ndarray], last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per number of words m up to ``last``: m, places where phrases worth counting start, all phrase hashes.

    A phrase is worth counting if both its parts of m - 1 words are in the bitmap of that
    level, and it is itself in the bitmap of its own level, where there is one.
    """
    n = len(words)
    ends = np.where(words == 0, np.arange(n), n)
    left = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)  # words from here to the end of the piece
    own = np.uint64(seed & 0xFFFFFFFFFFFFFFFF)
    key, alive = _mixed(words), left >= 1
    for m in range(1, last + 1):
        if m > 1:
            at = np.flatnonzero(alive[:-1] & alive[1:] & (left[:-1] >= m))
            grown = np.zeros_like(key)
            grown[at] = _mixed(key[at] * _MIX[0] + words[at + m - 1] + np.uint64(m))
            key, alive = grown, np.zeros(n, dtype=bool)
            alive[at] = True
        at = np.flatnonzero(alive)
        if len(bitmaps) >= m:
            bit = (key[at] ^ own) & np.uint64(8 * len(bitmaps[m - 1]) - 1)
            found = bitmaps[m - 1][(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1
            at = at[found == 1]
            alive = np.zeros(n, dtype=bool)
            alive[at] = True
        yield m, at, key


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[tuple, list[bytes]]]:
    """Texts in parts of about ``CHUNK`` bytes, by the values of ``keys``."""
    parts, held = defaultdict(list), 0
    for batch in slices(batches):
        groups = zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys), strict=True)
        for group, text in zip(groups, utf8(batch), strict=True):
            parts[group].append(text)
            held += len(text)
            if held >= CHUNK:
                yield parts
                parts, held = defaultdict(list), 0
    if parts:
        yield parts


def _hash_counts(docs: DataFrame, levels: list[int], bitmaps: list[np.ndarray]) -> DataFrame:
    """``lang, shard, m, hash, n`` of the phrases of ``levels`` words whose parts are frequent in their shard."""
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _chunks(batches, ["lang", "shard", "seed"]):
            for (lang, shard, seed), texts in parts.items():
                for m, at, key in phrase_hits(word_hashes(b".".join(texts) + b"."), seed, known.value, max(levels)):
                    if m not in levels:
                        continue
                    found, n = np.unique(key[at], return_counts=True)
                    same = [pa.repeat(lang, len(found)), *(pa.array(np.full(len(found), x, np.int32)) for x in (shard, m))]
                    columns = [*same, pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "shard", "m", "hash", "n"])

    counted = docs.mapInArrow(run, "lang string, shard int, m int, hash long, n long")
    return counted.groupBy("lang", "shard", "m", "hash").agg(F.sum("n").alias("n"))


def _phrase_counts(docs: DataFrame, bitmaps: list[np.ndarray]) -> DataFrame:
    """``lang, n_words, phrase, f``: exact counts of all phrases that the bitmaps let through."""
    known = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _chunks(batches, ["lang", "seed"]):
            for (lang, seed), joined in parts.items():
                words = _Vocabulary()
                ids = words.numbers(b".".join(joined))
                hashes, spelt = words.hashes(), list(words.ids)
                for m, at, key in phrase_hits(hashes[ids], seed, known.value, len(known.value)):
                    at = at[np.argsort(key[at], kind="stable")]
                    # Equal phrases follow each other; a run ends where the words differ, so that
                    # phrases of the same hash are never counted as one.
                    first = np.zeros(len(at), dtype=bool)
                    first[:1] = True
                    for k in range(m):
                        first[1:] |= ids[at[1:] + k] != ids[at[:-1] + k]
                    starts = np.flatnonzero(first)
                    n, rows = np.diff(np.append(starts, len(at))), at[starts].tolist()
                    texts = [b" ".join([spelt[i] for i in ids[i : i + m].tolist()]).decode("utf-8", "replace") for i in rows]
                    columns = [
                        pa.repeat(lang, len(texts)), pa.array(np.full(len(texts), m, np.int32)),
                        pa.array(texts, pa.string()), pa.array(n.astype(np.int64)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "n_words", "phrase", "f"])

    counted = docs.mapInArrow(run, "lang string, n_words int, phrase string, f long")
    return counted.groupBy("lang", "n_words", "phrase").agg(F.sum("f").alias("f"))


def _bitmap(hashes: DataFrame, seed: Column, n: int) -> np.ndarray:
    """Bits set where hashes fall: at most ``2 ** MOST_BITS`` of them, whatever the number of hashes."""
    bits = 1 << min(max((n * BITS_EACH).bit_length(), LEAST_BITS), MOST_BITS)
    placed = hashes.select(F.col("hash").bitwiseXOR(seed).bitwiseAND(F.lit(bits - 1)).alias("bit"))
    paged = placed.groupBy(F.floor(F.col("bit") / PAGE_BITS).alias("page"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for row in paged.agg(F.bitmap_construct_agg(F.col("bit") % PAGE_BITS).alias("bitmap")).collect():
        part = out[row.page * (PAGE_BITS // 8) :][: PAGE_BITS // 8]
        part[:] = np.frombuffer(row.bitmap, dtype=np.uint8)[: len(part)]
    return out


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``lang, n_words, phrase, f`` of all phrases with f >= ``support``, and ``lang, n`` (its words)."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    # Neighbouring ids share a shard: they often lie in one file, whose task then combines more.
    near = F.shiftright(F.coalesce(F.col("doc_id"), F.xxhash64("text")).cast("long"), NEAR)
    dealt = F.pmod(near, F.lit(shards)).cast("int").alias("shard")
    own = docs.select(lang, dealt, "text")
    sharded = own.withColumn("seed", F.xxhash64("lang", "shard"))
    limits, bitmaps, shared = None, [], []
    singly = min(SINGLY, longest)
    for levels in [*([m] for m in range(1, singly + 1)), list(range(singly + 1, longest + 1))]:
        if not levels:
            continue
        counts = _hash_counts(sharded, levels, bitmaps)
        if limits is None:
            counts = staged(counts, "phrase-words")
            sizes = counts.groupBy("lang", "shard").agg(F.sum("n").alias("words"))
            totals = staged(sizes.groupBy("lang").agg(F.sum("words").alias("n")), "phrase-totals")
            part = F.expr(f"({support} * words) div n")  # rounded down, so that no phrase is missed
            limits = staged(sizes.join(totals, "lang").select("lang", "shard", F.greatest(part, F.lit(1)).alias("least")), "phrase-limits")
        local = staged(counts.join(limits, ["lang", "shard"]).where("n >= least").drop("least"), f"phrases-{levels[0]}")
        if levels[-1] < longest:
            bitmaps.append(_bitmap(local, F.xxhash64("lang", "shard"), local.count()))
        union = staged(local.select("lang", "m", "hash").distinct(), f"phrase-union-{levels[0]}")
        found = {r.m: r["count"] for r in union.groupBy("m").count().collect()}
        shared += [_bitmap(union.where(F.col("m") == m), F.xxhash64("lang"), found.get(m, 0)) for m in levels]
    exact = _phrase_counts(own.select("lang", "text", F.xxhash64("lang").alias("seed")), shared)
    return staged(exact.where(F.col("f") >= support), "phrases"), totals


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, shards: int = SHARDS) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    A phrase scores by its worst cut: floor(1000 * a * n / (l * r)). One that is part of a
    longer phrase of the same count is left out.
    """
    found, totals = frequent_phrases(docs, support, longest, shards)
    phrases = found.where("n_words >= 2").select("lang", "phrase", F.col("f").alias("a"), "n_words")
    words, joined = F.split("phrase", " "), lambda words: F.array_join(words, " ")
    # A part with the same count, of whatever length, has one that is shorter by one word.
    parts = F.array(joined(F.slice(words, F.lit(1), F.col("n_words") - 1)), joined(F.slice(words, F.lit(2), F.col("n_words") - 1)))
    covered = phrases.where("n_words >= 3").select("lang", "a", F.explode(parts).alias("phrase")).distinct()
    cuts = (
        phrases.join(covered, ["lang", "phrase", "a"], "left_anti")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
        .withColumn("first", joined(F.slice(words, F.lit(1), F.col("k"))))
        .withColumn("rest", joined(F.slice(words, F.col("k") + 1, F.col("n_words") - F.col("k"))))
    )
    counts = found.select("lang", "phrase", "f")
    cuts = cuts.join(counts.toDF("lang", "first", "l"), ["lang", "first"]).join(counts.toDF("lang", "rest", "r"), ["lang", "rest"])
    exact = "(cast(a * 1000 as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"
    scored = cuts.join(totals, "lang").withColumn("score", F.expr(exact))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = worst.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
