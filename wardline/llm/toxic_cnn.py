"""Toxicity by a convolutional text classifier, trained in numpy.

Words are hashed to rows of an embedding table. Filters over one, two and three words run
over the whole text, each keeps its largest answer (max pooling), and a linear layer
makes one number of them. The first embedding column starts at the log odds of a word's
hash in toxic documents, the others at random; all layers are trained.

All labelled rows train. Spark counts the words; then, in every round, each task descends
over its part of the rows from the same model, and the next model is the mean of theirs. The
driver holds models and counts, whose size does not depend on the number of rows.

The cut is set on rows kept apart from training: one cut for the score, which knows no
language, and a threshold per language, reported beside the score.

Cases: null and empty texts score as no words; a table without labels, or with one class
only, gives every document the share of toxic rows; a null id is never held out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import slices, staged, utf8
from wardline.llm.learning import CUT, Adam, Calibration, best_cut_of_counts, fold, labelled_ids, maybe_among, sigmoid

SLOTS, WIDTH, FILTERS, SPANS = 1 << 20, 4, 6, (1, 2, 3)
EPOCHS, BATCH, RATE = 6, 64, 0.02
FOLDS, HELD_OUT = 4, 2
#: Toxic and other validation rows that a language needs for a threshold of its own.
LEAST_OF_EACH = 10
#: Rows that a task trains on, about, at least.
PART_ROWS = 500
#: Outputs are counted in steps of this part of 1 to set the cuts.
STEPS = 256
#: Lower-case letters stay, ASCII punctuation and digits' separators become spaces.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c < 128 and not (48 <= c <= 57 or 97 <= c <= 122) else c for c in range(256)
)


def word_slots(text: bytes) -> list[int]:
    return [zlib.crc32(w) % (SLOTS - 1) + 1 for w in text.translate(_FOLD).split()]


def _joined(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All documents in a row, each followed by empty slots, and where each starts."""
    gap = [0] * (max(SPANS) - 1)
    flat = np.array([i for d in docs for i in (*d, *gap)] + gap, dtype=np.int64)
    return flat, np.cumsum([0, *(len(d) + len(gap) for d in docs)])


class Model(NamedTuple):
    table: np.ndarray
    filters: list[np.ndarray]  # span x width x filters
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def answers(self, flat: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Of each span, the filters' answers at each place; none reaches into the next document."""
        x, n, out = self.table[flat], int(starts[-1]), []
        for span, f, b in zip(SPANS, self.filters, self.biases, strict=True):
            h = x[:n] @ f[0] + b
            for k in range(1, span):
                h += x[k : n + k] @ f[k]
                h[starts[1:] - k] = -1e9
            out.append(h)
        return out

    def outputs(self, docs: list[list[int]]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        flat, starts = _joined(docs)
        pooled = np.concatenate([np.maximum.reduceat(h, starts[:-1]) for h in self.answers(flat, starts)], axis=1)
        return np.maximum(pooled, 0) @ self.weights + self.bias[0]


def log_odds(docs: list[list[int]], y: np.ndarray) -> np.ndarray:
    found = [np.zeros(SLOTS) for _ in range(2)]
    for slots, label in zip(docs, y, strict=True):
        found[int(label)][np.unique(np.array(slots, dtype=np.int64))] += 1
    sizes = [max(int((y == label).sum()), 1) for label in (0, 1)]
    odds = np.log((found[1] + 0.5) / (sizes[1] + 1)) - np.log((found[0] + 0.5) / (sizes[0] + 1))
    return np.where(found[0] + found[1] > 0, odds, 0.0)


def started(odds: np.ndarray, seed: int = 7) -> Model:
    """The model before training."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (SLOTS, WIDTH)).astype(np.float32)
    table[:, 0] = odds
    table[0] = 0
    filters = [rng.normal(0, 0.2, (s, WIDTH, FILTERS)).astype(np.float32) for s in SPANS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0])
    n_pooled = FILTERS * len(SPANS)
    return Model(table, filters, [np.zeros(FILTERS, np.float32) for _ in SPANS], np.full(n_pooled, 0.1, np.float32), np.full(1, -1.0, np.float32))


def small_parts(model: Model) -> list[np.ndarray]:
    return [*model.filters, *model.biases, model.weights, model.bias]


def weights_of(y: np.ndarray, share: float) -> np.ndarray:
    share = np.clip(share, 0.02, 0.98)
    return np.where(y == 1, 0.5 / share, 0.5 / (1 - share))


def train(docs: list[list[int]], y: np.ndarray, seed: int = 7) -> Model:
    """A model of rows at hand."""
    model = started(log_odds(docs, y), seed)
    adam, rng = Adam(small_parts(model), RATE), np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(docs)), -(-len(docs) // BATCH)):
            _descend(model, [docs[i] for i in at], y[at], weights_of(y[at], y.mean()), adam)
    return model


def _descend(model: Model, docs: list[list[int]], y: np.ndarray, weight: np.ndarray, adam: Adam) -> None:
    flat, starts = _joined(docs)
    answers = model.answers(flat, starts)
    places = [np.stack([s + h[s:e].argmax(axis=0) for s, e in zip(starts[:-1], starts[1:], strict=True)]) for h in answers]
    pooled = [np.take_along_axis(h, p, axis=0) for h, p in zip(answers, places, strict=True)]
    flow = np.concatenate(pooled, axis=1)
    z = np.maximum(flow, 0) @ model.weights + model.bias[0]
    error = (weight * (sigmoid(z) - y) / len(y)).astype(np.float32)
    back = error[:, None] * model.weights * (flow > 0)
    to_filters, to_biases, x = [], [], model.table[flat]
    for i, span in enumerate(SPANS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        to_biases.append(g.sum(axis=0))
        own = np.zeros_like(model.filters[i])
        for k in range(span):
            at = places[i] + k
            own[k] = np.einsum("df,dfw->wf", g, x[at])
            change = -RATE * g[:, :, None] * model.filters[i][k].T[None]
            slots = flat[at]
            np.add.at(model.table, slots[slots > 0], change[slots > 0])
        to_filters.append(own)
    adam.step([*to_filters, *to_biases, np.maximum(flow, 0).T @ error, error.sum(keepdims=True)])


class Classifier(NamedTuple):
    model: Model | None
    calibration: Calibration
    thresholds: dict[str | None, float]
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.prior)
        return self.calibration(self.model.outputs([word_slots(t) for t in texts]))


def _labelled_words(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, y, lang, slots, apart``, a row per id; a fifth of the ids is kept apart from training.

    Only words of texts that seem labelled meet the labels, so no texts are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = pa.array([word_slots(t) for t in utf8(part)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), words], names=["doc_id", "lang", "slots"])

    given = maybe_among(docs.select("doc_id", "lang", "text"), known)
    schema = given.select("doc_id", "lang", F.lit(None).cast("array<int>").alias("slots")).schema
    found = given.mapInArrow(run, schema).groupBy("doc_id").agg(F.min(F.struct("slots", "lang")).alias("row")).join(known, "doc_id")
    apart = (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("apart")
    return found.select("doc_id", "y", "row.lang", "row.slots", apart)


def _counted_odds(rows: DataFrame, sizes: tuple[int, int]) -> np.ndarray:
    """``log_odds`` from counts over all rows; at most one row per slot comes to the driver."""
    counts = (
        rows.select("y", F.explode(F.array_distinct("slots")).alias("slot"))
        .groupBy("slot")
        .agg(F.sum(F.col("y").cast("long")).alias("ones"), F.count(F.lit(1)).alias("n"))
        .toArrow()
    )
    slot, ones, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("slot", "ones", "n"))
    zeros, odds = n - ones, np.zeros(SLOTS)
    odds[slot] = np.log((ones + 0.5) / (max(sizes[1], 1) + 1)) - np.log((zeros + 0.5) / (max(sizes[0], 1) + 1))
    return odds


def _round(rows: DataFrame, model: Model, share: float, turn: int) -> Model:
    """One pass over all rows: the mean of the models to which the tasks descend from ``model``.

    A slot's row is the mean over the tasks that changed it. Tasks return rows of ``WIDTH``
    numbers: slots that changed, and at negative places what is not the table.
    """
    start = rows.sparkSession.sparkContext.broadcast(model)
    names = [f"v{k}" for k in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*(v.copy() if isinstance(v, np.ndarray) else [x.copy() for x in v] for v in start.value))
        adam, n = Adam(small_parts(own), RATE), 0
        rng = np.random.default_rng(turn)
        for part in slices(batches, 16 * BATCH):
            y, docs = part.column(0).to_numpy(zero_copy_only=False).astype(np.float64), part.column(1).to_pylist()
            for at in np.array_split(rng.permutation(len(y)), -(-len(y) // BATCH)):
                _descend(own, [docs[i] for i in at], y[at], weights_of(y[at], share), adam)
            n += len(y)
        if not n:
            return
        slots = np.flatnonzero((own.table != start.value.table).any(axis=1))
        small = np.concatenate([v.ravel() for v in small_parts(own)])
        small = np.pad(small, (0, -len(small) % WIDTH)).reshape(-1, WIDTH)
        place = np.concatenate([slots, -1 - np.arange(len(small))])
        values = np.concatenate([own.table[slots], small]).astype(np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.full(len(place), n)), *map(pa.array, values.T.copy())], names=["place", "n", *names])

    unit = F.lit(1 << 24)  # whole numbers, whose sum does not depend on the order of the tasks
    parts = rows.select("y", "slots").mapInArrow(run, "place long, n long, " + ", ".join(f"{v} double" for v in names))
    means = parts.groupBy("place").agg(*((F.sum(F.round(F.col(v) * unit).cast("long") * F.col("n")) / F.sum("n") / unit).alias(v) for v in names)).toArrow()
    start.destroy()
    place = means.column("place").to_numpy()
    values = np.stack([means.column(v).to_numpy() for v in names], axis=1).astype(np.float32)
    table = model.table.copy()
    table[place[place >= 0]] = values[place >= 0]
    small, at, parts_of = values[place < 0][np.argsort(-place[place < 0])].ravel(), 0, []
    for v in small_parts(model):
        parts_of.append(small[at : at + v.size].reshape(v.shape).copy())
        at += v.size
    k = len(SPANS)
    return Model(table, parts_of[:k], parts_of[k : 2 * k], parts_of[2 * k], parts_of[2 * k + 1])


def _cuts(rows: DataFrame, model: Model) -> tuple[Calibration, dict[str | None, float]]:
    """The calibration and the thresholds of languages, from counts of all rows per step of the output."""
    known = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            z = np.clip(known.value.outputs(part.column(2).to_pylist()), -60, 60).astype(np.float64)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.round(z * STEPS) / STEPS)], names=["lang", "y", "z"])

    def cut(own: pd.DataFrame) -> pd.DataFrame:
        enough = min(own["ones"].sum(), own["zeros"].sum()) >= LEAST_OF_EACH
        at = best_cut_of_counts(*(own[c].to_numpy() for c in ("z", "ones", "zeros"))) if enough else None
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "cut": [at]})

    z = rows.select("lang", "y", "slots").mapInArrow(run, "lang string, y int, z double")
    counts = staged(z.groupBy("lang", "z").agg(F.count_if(F.col("y") == 1).alias("ones"), F.count_if(F.col("y") == 0).alias("zeros")), "outputs")
    every = counts.groupBy("z").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).toArrow()  # 120 * STEPS rows at most
    z, ones, zeros = (every.column(c).to_numpy() for c in ("z", "ones", "zeros"))
    middle = best_cut_of_counts(z, ones, zeros)
    spread = float((np.abs(z - middle) * (ones + zeros)).sum() / max((ones + zeros).sum(), 1))
    calibration = Calibration(2.0 / max(spread, 1e-3), middle)
    found = counts.groupBy("lang").applyInPandas(cut, "lang string, cut double").where("cut is not null").collect()  # one row per language
    return calibration, {r.lang: float(calibration(np.array([r.cut]))[0]) for r in found}


def fit(docs: DataFrame, known: DataFrame) -> Classifier:
    """Of the documents with a label in ``known`` (``doc_id, y``) four fifths train, one fifth sets the cuts."""
    rows = staged(_labelled_words(docs, known), "labelled-words")
    found = {r.apart: (r.n - r.ones, r.ones) for r in rows.groupBy("apart").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).collect()}
    zeros, ones = (sum(v[i] for v in found.values()) for i in (0, 1))
    if zeros + ones < 20 or not zeros or not ones:
        return Classifier(None, Calibration(1.0, 0.0), {}, ones / (zeros + ones) if zeros + ones else 0.0)
    split = len(found) == 2 and all(min(v) > 0 for v in found.values())
    kept, apart = (rows.where("not apart"), rows.where("apart")) if split else (rows, rows)
    sizes = found[False] if split else (zeros, ones)
    parts = -(-sum(sizes) // PART_ROWS)
    mixed = kept.select("y", "slots", F.xxhash64("doc_id", F.lit("toxic")).alias("mixed"), "doc_id").repartition(parts, "doc_id")
    kept = staged(mixed.sortWithinPartitions("mixed", "doc_id").select("y", "slots"), "training-words")
    model = started(_counted_odds(kept, sizes))
    for turn in range(EPOCHS):
        model = _round(kept, model, sizes[1] / sum(sizes), turn)
    calibration, thresholds = _cuts(apart, model)
    return Classifier(model, calibration, thresholds, ones / (zeros + ones))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted, lang_threshold, flagged`` for every document."""
    learned = docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    classifier = docs.sparkSession.sparkContext.broadcast(fit(learned, labelled_ids(labels, "toxic", FOLDS, HELD_OUT)))
    schema = docs.select(
        "doc_id", F.lit(True).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"),
        F.lit(0.0).alias("lang_threshold"), F.lit(True).alias("flagged"),
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier.value
        for part in slices(batches):
            langs = part.column(part.schema.get_field_index("lang")).to_pylist()
            score = own.scores(utf8(part))
            limit = np.array([own.thresholds.get(lang, CUT) for lang in langs])
            columns = [
                part.column(0), part.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32)),
                pa.array(limit), pa.array(score >= limit),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "lang", "text").mapInArrow(run, schema)
