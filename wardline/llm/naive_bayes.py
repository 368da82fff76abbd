"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every run of other characters than letters becomes one space.
Its n-grams of one to three characters are hashed to slots. Training counts the slots of
each language over all learning documents, as one aggregation; the log probabilities form a
matrix of slots by languages that is broadcast. Batches are scored as sparse counts of
(document, slot) times that matrix, in whole numbers of 2^-20, so that the sums do not
depend on how rows are batched. ``score`` is the posterior probability of the prediction.

Bounds: the matrix has at most ``CELLS`` cells; above ``CELLS / SLOTS`` languages the slots
are halved until it fits, and above ``MAX_LANGS`` those with the most documents are learned.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text where
there is nothing to learn from. A null id is never held out and never learned from. Repeated
rows count each time. Ties go to the language first by code point. Texts of any length are read
whole, in windows. Bytes that are not UTF-8 count as replacement characters, which are no letters.
An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import slices, utf8
from wardline.llm.learning import fold

SIZES = (1, 2, 3)
SLOTS, CELLS, MAX_LANGS = 1 << 16, 1 << 22, 1 << 12
FOLDS, HELD_OUT = 3, 1
#: Added to each count; a slot that a language never shows is unlikely, not impossible.
SMOOTHING = 0.1
UNKNOWN = "und"
#: Log probabilities in whole numbers of this part.
SCALE = 1 << 20
#: Places whose n-grams are hashed at once, and languages counted at once in a task.
WINDOW, HELD_LANGS = 1 << 20, 64
_MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normal_form(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with single spaces, the text each belongs to, and whether a text has a letter."""
    spaced = [f" {t.decode('utf-8', 'replace').lower()} " for t in texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le"), dtype="<u4")
    of = np.repeat(np.arange(len(texts)), [len(t) for t in spaced])
    letter = _letters()[points]
    some = np.bincount(of[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (of[1:] != of[:-1])
    keep[:1] = True
    return np.where(letter, points, 32)[keep], of[keep], some


def slot_windows(points: np.ndarray, of: np.ndarray, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams and the text that each belongs to, in parts of bounded size."""
    longest = max(SIZES)
    for start in range(0, len(points), WINDOW):
        own = points[start : start + WINDOW + longest - 1].astype(np.uint64)
        text = of[start : start + WINDOW + longest - 1]
        n = min(WINDOW, len(points) - start)
        for size in SIZES:
            m = min(n, len(own) - size + 1)
            if m <= 0:
                continue
            mixed = np.full(m, size, dtype=np.uint64)
            for k in range(size):
                mixed = (mixed * np.uint64(_MIX[0]) + own[k : k + m]) * np.uint64(_MIX[1])
                mixed ^= mixed >> np.uint64(29)
            inside = text[:m] == text[size - 1 : size - 1 + m]
            if size == 1:
                inside &= own[:m] != 32
            mixed = (mixed * np.uint64(_MIX[2]) >> np.uint64(16)) & np.uint64(slots - 1)
            yield mixed[inside].astype(np.int64), text[:m][inside]


class Model(NamedTuple):
    """``matrix`` is slots by languages; logarithms are in whole numbers of 1 / SCALE."""

    langs: list[str]
    prior: np.ndarray
    matrix: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        score = np.zeros(len(texts))
        if not texts or not self.langs:
            return [UNKNOWN] * len(texts), score
        points, of, some = normal_form(texts)
        total, slots = np.tile(self.prior, (len(texts), 1)), len(self.matrix)
        for slot, text in slot_windows(points, of, slots):
            cell, n = np.unique(text * slots + slot, return_counts=True)
            text, slot = np.divmod(cell, slots)
            starts = np.flatnonzero(np.diff(text, prepend=-1))
            if len(starts):
                total[text[starts]] += np.add.reduceat(n[:, None] * self.matrix[slot], starts, axis=0)
        best = total.argmax(axis=1)
        odds = np.exp((total - total.max(axis=1, keepdims=True)) / SCALE)
        score = np.where(some, 1.0 / odds.sum(axis=1), 0.0)
        return [self.langs[b] if s else UNKNOWN for b, s in zip(best, some, strict=True)], score


def _counts(learned: DataFrame, langs: list[str], slots: int) -> np.ndarray:
    """Occurrences of every slot in every language, over all learning documents."""
    place = {lang: i for i, lang in enumerate(langs)}

    def flush(held: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, n in held.items():
            at = np.flatnonzero(n)
            columns = [pa.array(np.full(len(at), lang, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "slot", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for part in slices(batches):
            own = np.array([place.get(x, -1) for x in part.column(part.schema.get_field_index("lang")).to_pylist()])
            points, of, _ = normal_form(utf8(part))
            for slot, text in slot_windows(points, of, slots):
                for lang in np.unique(own[own >= 0]).tolist():
                    if lang not in held and len(held) >= HELD_LANGS:
                        yield from flush(held)
                        held.clear()
                    n = np.bincount(slot[own[text] == lang], minlength=slots)
                    held[lang] = held.get(lang, 0) + n
        yield from flush(held)

    sums = learned.select("lang", "text").mapInArrow(run, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    found = sums.toArrow()  # at most CELLS rows
    out = np.zeros((slots, len(langs)), dtype=np.int64)
    out[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    return out


def model_of(documents: np.ndarray, counts: np.ndarray, langs: list[str]) -> Model:
    log = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts)))
    prior = np.log(documents / documents.sum())
    return Model(langs, np.rint(prior * SCALE).astype(np.int64), np.rint(log * SCALE).astype(np.int64))


def fit(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> Model:
    """The model of all documents outside the held-out fold whose language and id are known."""
    learned = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    learned = learned.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    sizes = learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    known = sorted((r.lang, r.n) for r in sizes.collect())  # at most MAX_LANGS rows
    langs, slots = [lang for lang, _ in known], SLOTS
    while len(langs) * slots > CELLS:
        slots //= 2
    if not langs:
        return Model([], np.zeros(0, np.int64), np.zeros((slots, 0), np.int64))
    return model_of(np.array([n for _, n in known], dtype=np.float64), _counts(learned, langs, slots), langs)


def languages(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))
    schema = docs.select("doc_id", F.lit(True).alias("held_out"), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            langs, score = model.value.predict(utf8(part))
            columns = [part.column(0), part.column(1), pa.array(langs, pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, schema)
