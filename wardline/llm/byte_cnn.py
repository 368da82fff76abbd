"""Quality by a byte-level convolutional network, trained in numpy.

Bytes have small embeddings; filters of eight bytes, every four bytes, run over the whole
text. Chunks of 512 bytes, each overlapping the next by half, keep the largest answer of
each filter. A document's features are the mean and the largest of its chunks' answers;
a linear layer combines them into one probability. Bytes after the end count as zero
bytes, so short and empty texts have one chunk.

Cases: null and empty texts score as one chunk of zero bytes; a table without labels, or
with one class only, gives every document the share of good rows; a null id is never
held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import slices, utf8
from wardline.llm.learning import CUT, Adam, Calibration, calibrated, fold, labelled_sample, sigmoid

SPAN, STRIDE, HALF, WIDTH, FILTERS = 8, 4, 256, 4, 16
EPOCHS, BATCH, RATE = 8, 64, 0.02
FOLDS, HELD_OUT = 5, 0
MAX_ROWS = 3000
#: Chunks of one text that one training step looks at, drawn anew each time.
TRAINING_CHUNKS = 8
#: Bytes that are scored at once.
AT_ONCE = 1 << 20
_PLACES = HALF // STRIDE  # filter places in half a chunk


def _halves(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as rows of half chunks, filled up with zero bytes, and where each text starts.

    A text has at least two halves, so that it has a chunk.
    """
    counts = np.array([max(2, -(-len(t) // HALF)) for t in texts])
    flat = np.zeros((int(counts.sum()), HALF), dtype=np.uint8)
    starts = np.cumsum(np.concatenate([[0], counts]))
    raw = flat.reshape(-1)
    for text, start in zip(texts, starts[:-1], strict=True):
        raw[start * HALF : start * HALF + len(text)] = np.frombuffer(text, dtype=np.uint8)
    return flat, starts


class Model(NamedTuple):
    table: np.ndarray  # 256 x WIDTH
    filters: np.ndarray  # SPAN * WIDTH x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    shift: np.ndarray

    def windows(self, halves: np.ndarray, following: np.ndarray) -> np.ndarray:
        """The embedded bytes under each filter place of each half; the last one reaches into ``following``."""
        x = self.table[np.concatenate([halves, following[:, : SPAN - STRIDE]], axis=1)].reshape(len(halves), -1)
        steps = x.strides[1]
        view = np.lib.stride_tricks.as_strided(
            x, (len(x), _PLACES, SPAN * WIDTH), (x.strides[0], STRIDE * WIDTH * steps, steps), writeable=False
        )
        return view.reshape(-1, SPAN * WIDTH)

    def pooled_halves(self, halves: np.ndarray, starts: np.ndarray) -> np.ndarray:
        following = np.zeros_like(halves)
        following[:-1] = halves[1:]
        following[starts[1:] - 1] = 0
        answers = self.windows(halves, following) @ self.filters + self.bias
        return np.maximum(answers.reshape(len(halves), _PLACES, FILTERS).max(axis=1), 0)

    def outputs(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        halves, starts = _halves(texts)
        step = AT_ONCE // HALF
        pooled = np.empty((len(halves), FILTERS), dtype=np.float32)
        for at in range(0, len(halves), step):
            to = min(at + step, len(halves))
            more = halves[at : to + 1]  # one more, for the bytes that follow
            inner = np.concatenate([[0], starts[(starts > at) & (starts < at + len(more))] - at, [len(more)]])
            pooled[at:to] = self.pooled_halves(more, inner)[: to - at]
        chunks = np.maximum(pooled[:-1], pooled[1:])
        ends = starts[1:] - 1  # the last half of a text starts no chunk
        chunks = np.concatenate([chunks, np.zeros((1, FILTERS), np.float32)])
        chunks[ends] = 0
        n_chunks = (np.diff(starts) - 1)[:, None]
        mean = np.add.reduceat(chunks, starts[:-1]) / n_chunks
        most = np.maximum.reduceat(chunks, starts[:-1])
        return np.concatenate([mean, most], axis=1) @ self.weights + self.shift[0]


def _drawn_chunks(texts: list[bytes], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Up to TRAINING_CHUNKS chunks of each text, as pairs of halves, and the text of each chunk."""
    halves, starts = _halves(texts)
    picks, of = [], []
    for i, (start, end) in enumerate(zip(starts[:-1], starts[1:] - 1, strict=True)):
        n = end - start
        chosen = np.arange(n) if n <= TRAINING_CHUNKS else rng.choice(n, TRAINING_CHUNKS, replace=False)
        picks.append(start + chosen)
        of.append(np.full(len(chosen), i))
    at = np.concatenate(picks)
    return np.stack([halves[at], halves[at + 1]], axis=1), np.concatenate(of)


def train(texts: list[bytes], y: np.ndarray, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(
        rng.normal(0, 0.5, (256, WIDTH)).astype(np.float32),
        rng.normal(0, 0.3, (SPAN * WIDTH, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32),
        np.zeros(1, np.float32),
    )
    adam = Adam(list(model), RATE)
    share = np.clip(y.mean(), 0.02, 0.98)
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(texts)), -(-len(texts) // BATCH)):
            weight = np.where(y[at] == 1, 0.5 / share, 0.5 / (1 - share))
            adam.step(_gradients(model, [texts[i] for i in at], y[at], weight, rng))
    return model


def _gradients(model: Model, texts: list[bytes], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    chunks, of = _drawn_chunks(texts, rng)
    n, m = len(texts), len(chunks)
    raw = chunks.reshape(m, 2 * HALF)
    places = np.arange(0, 2 * HALF - SPAN + 1, STRIDE)
    embedded = model.table[raw].reshape(m, -1)
    view = np.lib.stride_tricks.sliding_window_view(embedded, SPAN * WIDTH, axis=1)[:, :: STRIDE * WIDTH]
    answers = view.reshape(-1, SPAN * WIDTH) @ model.filters + model.bias
    answers = answers.reshape(m, len(places), FILTERS)
    top = answers.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(answers, top[:, None], axis=1)[:, 0], 0)
    counts = np.bincount(of, minlength=n)[:, None]
    edges = np.searchsorted(of, np.arange(n))
    mean = np.add.reduceat(pooled, edges) / counts
    most = np.maximum.reduceat(pooled, edges)
    features = np.concatenate([mean, most], axis=1)
    z = features @ model.weights + model.shift[0]
    error = (weight * (sigmoid(z) - y) / n).astype(np.float32)
    back = error[:, None] * model.weights
    is_most = pooled == most[of]
    flow = (back[of, :FILTERS] / counts[of] + back[of, FILTERS:] * is_most) * (pooled > 0)
    inputs = np.take_along_axis(view, top[:, :, None], axis=1)  # m x FILTERS x SPAN * WIDTH
    to_filters = np.einsum("mf,mfx->xf", flow, inputs)
    to_inputs = flow[:, :, None] * model.filters.T[None]
    under = raw[np.arange(m)[:, None, None], places[top][:, :, None] + np.arange(SPAN)]
    to_table = np.zeros_like(model.table)
    np.add.at(to_table, under.reshape(-1), to_inputs.reshape(-1, WIDTH))
    return [to_table, to_filters, flow.sum(axis=0), features.T @ error, error.sum(keepdims=True)]


class Classifier(NamedTuple):
    model: Model | None
    calibration: Calibration
    prior: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.model is None:
            return np.full(len(texts), self.prior)
        return self.calibration(self.model.outputs(texts))


def fit(sample: pd.DataFrame) -> Classifier:
    """Four fifths of the rows train, one fifth sets the cut."""
    y = sample["y"].to_numpy(dtype=np.float64)
    if len(y) < 20 or y.min() == y.max():
        return Classifier(None, Calibration(1.0, 0.0), float(y.mean()) if len(y) else 0.0)
    texts, apart = list(sample["data"]), np.arange(len(y)) % 5 == 0
    if y[apart].min() == y[apart].max() or y[~apart].min() == y[~apart].max():
        apart[:] = False
    model = train([texts[i] for i in np.flatnonzero(~apart)], y[~apart])
    check = np.flatnonzero(apart if apart.any() else ~apart)
    z = np.concatenate([model.outputs([texts[i] for i in part]) for part in np.array_split(check, -(-len(check) // 64))])
    return Classifier(model, calibrated(z, y[check]), float(y.mean()))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    sample = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, MAX_ROWS)
    classifier = docs.sparkSession.sparkContext.broadcast(fit(sample))
    schema = docs.select("doc_id", F.lit(True).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = classifier.value
        for part in slices(batches, 128):
            score = own.scores(utf8(part))
            columns = [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, "text").mapInArrow(run, schema)
