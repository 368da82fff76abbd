"""What the trained classifiers share: labelled samples, an optimizer, calibration."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A score from here on predicts 1.
CUT = 0.3
#: Labelled rows that a classifier is fitted on, at most, and their largest size in bytes.
MAX_ROWS, MAX_BYTES = 6000, 60_000
#: Bits of the bitmap of labelled ids, as a power of two: at most 2^20 words of 64 go to every task.
BITMAP_POWER = 26


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return (F.crc32(doc_id.cast("string")) % folds).cast("int")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES
) -> pd.DataFrame:
    """At most ``max_rows`` labelled rows outside the held-out fold, as many of each class as there are.

    Columns ``doc_id``, ``data`` (the text in bytes), ``y``, ``lang``. The choice follows a
    hash of the id. The chosen ids are few, so Spark may broadcast them: the texts
    are read once and are not shuffled.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").alias("y"))
    mixed = F.xxhash64("doc_id", F.lit(label))
    halves = [known.where(F.col("y") == y).orderBy(mixed, "doc_id").limit(max_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(halves[0].unionByName(halves[1]))  # max_rows rows of two numbers
    texts = docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    texts = texts.where(F.octet_length("data") <= max_bytes)
    rows = texts.join(chosen, "doc_id").groupBy("doc_id").agg(
        F.first("y").alias("y"), F.min(F.struct("data", "lang")).alias("row")
    )
    frame = pd.DataFrame(
        [(r.doc_id, r.y, bytes(r["row"].data), r["row"].lang) for r in rows.collect()], columns=["doc_id", "y", "data", "lang"]
    )
    return frame.sort_values("doc_id", ignore_index=True)


def labelled_ids(labels: DataFrame, label: str, folds: int, held_out: int) -> DataFrame:
    """The label of every labelled id outside the held-out fold: ``doc_id, y``."""
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    return known.where(fold(F.col("doc_id"), folds) != held_out).groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))


def maybe_among(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The rows whose ``doc_id`` is in ``known``, and few others: those whose hash has the same bit in a bitmap.

    The bitmap's size is fixed, so every task gets it, and rows need no shuffle. With more ids than
    it tells apart more rows stay, so a join must follow.
    """
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << BITMAP_POWER))
    word, bit = F.shiftright(place, 6).alias("__llm_word"), place.bitwiseAND(F.lit(63)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    bitmap = known.groupBy(word).agg(F.bit_or(one).alias("__llm_bits"))
    found = rows.select("*", word, bit.alias("__llm_bit")).join(F.broadcast(bitmap), "__llm_word")
    return found.where(F.getbit("__llm_bits", F.col("__llm_bit")) == 1).select(*rows.columns)


class Adam:
    def __init__(self, values: list[np.ndarray], rate: float) -> None:
        self.values, self.rate, self.steps = values, rate, 0
        self.moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]

    def step(self, gradients: list[np.ndarray]) -> None:
        self.steps += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for value, (m, v), g in zip(self.values, self.moments, gradients, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            value -= scale * m / (np.sqrt(v) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


class Calibration(NamedTuple):
    """A rising map of raw outputs to scores that puts the best cut at ``CUT``."""

    slope: float
    middle: float

    def __call__(self, z: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * (z - self.middle) + np.log(CUT / (1 - CUT)))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at which youden's index (recall less false alarms) is highest."""
    if not len(z) or y.min() == y.max():
        return 0.0
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    index = np.cumsum(y) / y.sum() - np.cumsum(1 - y) / (1 - y).sum()
    index[:-1][z[:-1] == z[1:]] = -1
    top = np.flatnonzero(index == index.max())
    best = int(top[len(top) // 2])
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best])


def best_cut_of_counts(z: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> float:
    """``best_cut`` of rows that are counted per distinct output."""
    if not ones.sum() or not zeros.sum():
        return 0.0
    order = np.argsort(-z, kind="stable")
    z = z[order]
    index = np.cumsum(ones[order]) / ones.sum() - np.cumsum(zeros[order]) / zeros.sum()
    top = np.flatnonzero(index == index.max())
    best = int(top[len(top) // 2])
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best])


def calibrated(z: np.ndarray, y: np.ndarray) -> Calibration:
    middle = best_cut(z, y)
    spread = float(np.abs(z - middle).mean()) if len(z) else 1.0
    return Calibration(2.0 / max(spread, 1e-3), middle)
