"""Hard-negative mining through an inverted multi-index.

Vectors become whole numbers, floor(256 * x), and score by their inner product. Each half of
the space has a codebook; a cell is a pair of codewords. For an anchor, a codeword bounds what
its half can add to a score: the product with the codeword plus the radius, the largest
distance of any row to it, times the length of the anchor's half. A heap visits the cells by
falling sum of the two bounds (multi-sequence), and stops once the next bound lies below what
is still needed, so the lists are exact. The codebooks are fitted on a bounded sample; all rows
are indexed, and the radii are taken over all rows.

On Spark: rows are sorted by cell and cut into blocks, so a cell of any size is split. Anchors
are sorted the same way and cut into blocks as well. In each round the anchors visit a
further, four times larger, number of rows; an equality join of wanted cells with the cells of
row blocks gives the pairs of blocks to compare, and every pair returns at most the sought
number of rows per anchor and window. Rounds raise what is needed, and end when no
unvisited cell can add a row.

Cases: rows with a null id, label or vector, or a null or non-finite component take no part. Shorter
vectors are filled up with zeros. Exact repeats of a row count once; rows that share an id and differ
are rows of their own, but an anchor's other rows have another id. Ties go to the smaller id. Scores
saturate at the ends of 64 bits. A positive with a negative score has an empty window and returns no
rows. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import staged
from wardline.llm.numbering import numbered

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
#: Codewords of a half, rows that the codebooks are fitted on at most, and steps of the fit.
WORDS, SAMPLE, STEPS = 32, 8192, 12
#: Rows and anchors in a block, rows that an anchor visits in the first round, growth of the next.
ROWS, ANCHORS, FIRST, GROWTH = 8192, 256, 32_768, 4
LOW, HIGH = -(1 << 63), (1 << 63) - 1


class Index(NamedTuple):
    """Codebooks and radii of the halves, and the number of rows of each cell."""

    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    width: int

    def bounds(self, anchor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each half, the least and the largest that its codewords' rows can add."""
        out = []
        for part, book, radius in zip(halves(anchor[None].astype(np.float64)), self.books, self.radii, strict=True):
            middle, length = book @ part[0], np.sqrt((part[0] ** 2).sum())
            slack = length * radius + 1e-9 * length * (np.sqrt((book**2).sum(axis=1)) + radius) + 1e-6
            out.append((middle - slack, middle + slack))
        return out


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = -(-x.shape[1] // 2)
    return x[:, :middle], x[:, middle:]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and the distance to it."""
    far = (book**2).sum(axis=1) - 2 * (x @ book.T)
    word = far.argmin(axis=1)
    return word, np.sqrt(((x - book[word]) ** 2).sum(axis=1))


def codebook(x: np.ndarray, words: int, steps: int = STEPS) -> np.ndarray:
    """Codewords by Lloyd's steps, from evenly spaced rows of the sorted sample."""
    x = np.unique(x, axis=0)
    book = x[np.linspace(0, len(x) - 1, min(words, len(x))).astype(int)]
    for _ in range(steps):
        word, _ = nearest(x, book)
        n = np.bincount(word, minlength=len(book))
        sums = np.stack([np.bincount(word, weights=c, minlength=len(book)) for c in x.T], axis=1) if x.shape[1] else book * 0
        book = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], book)
    return book


def visits(index: Index, anchor: np.ndarray) -> Iterator[tuple[float, int, float]]:
    """All cells by falling upper bound: (upper bound, cell, lower bound). A heap of two sequences."""
    (low_a, high_a), (low_b, high_b) = index.bounds(anchor)
    order_a, order_b = np.argsort(-high_a, kind="stable").tolist(), np.argsort(-high_b, kind="stable").tolist()
    top_a, top_b, n_b = high_a[order_a].tolist(), high_b[order_b].tolist(), len(order_b)
    least_a, least_b = low_a.tolist(), low_b.tolist()
    heap = [(-(top_a[0] + top_b[0]), 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        a, b = order_a[i], order_b[j]
        yield -bound, a * n_b + b, least_a[a] + least_b[b]
        if j + 1 < n_b:
            heapq.heappush(heap, (-(top_a[i] + top_b[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(order_a):
            heapq.heappush(heap, (-(top_a[i + 1] + top_b[0]), i + 1, 0))


def route(index: Index, anchor: np.ndarray, visited: int, rows: int, low: int, high: int) -> tuple[list[int], int, float | None]:
    """The cells after the first ``visited`` ones that hold the next ``rows`` rows.

    Returns them with the number of cells visited, and the bound of the next cell; None
    where no later cell reaches ``low``. Cells that lie above ``high`` as a whole are passed by.
    """
    cells, held, counts = [], 0, index.counts
    for place, (bound, cell, least) in enumerate(visits(index, anchor)):
        if bound < low:
            return cells, place, None
        if place < visited:
            continue
        if held >= rows:
            return cells, place, bound
        if counts[cell] and least <= high:
            cells.append(cell)
            held += counts[cell]
    return cells, len(counts), None


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two whole-number matrices, exact up to 64 bits."""
    most = x.shape[1] * max(1, int(np.abs(x.astype(object)).max(initial=0))) * max(1, int(np.abs(y.astype(object)).max(initial=0)))
    if most < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    if most <= HIGH:
        return x @ y.T
    exact = x.astype(object) @ y.astype(object).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


def best_rows(scores: np.ndarray, fit: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and row numbers of the best ``k`` fitting rows of each anchor, ties by id."""
    held = np.where(fit, scores, LOW)
    if held.shape[1] > k:
        held_k = np.partition(held, held.shape[1] - k, axis=1)[:, held.shape[1] - k]
        fit = fit & (scores >= held_k[:, None])
    anchor, row = np.nonzero(fit)
    order = np.lexsort((ids[row], -scores[anchor, row].astype(np.float64), anchor))
    # doubles may tie where long scores differ, so such rows are ordered again by the scores themselves
    if len(order) and np.abs(scores[anchor, row].astype(np.float64)).max() >= 1 << 53:
        exact = scores[anchor, row].tolist()
        order = np.array(sorted(range(len(anchor)), key=lambda i: (anchor[i], -exact[i], ids[row[i]])), dtype=np.int64)
    anchor, row = anchor[order], row[order]
    first = np.searchsorted(anchor, anchor)
    top = np.arange(len(anchor)) - first < k
    return anchor[top], row[top]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), dtype=np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _numbers(column: pa.Array, row: int) -> np.ndarray:
    return np.frombuffer(column[row].as_buffer(), dtype=np.int64)


def whole_rows(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, q``: the rows that take part, their components as whole numbers."""
    e = F.col("embedding")
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    q = F.transform(e, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).where(sound)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), q.alias("q"))


def _celled(rows: DataFrame, books: tuple[np.ndarray, np.ndarray], width: int) -> DataFrame:
    """``rows`` with their cell, its two codewords and the distances to these."""
    schema = "vec_id long, label long, q array<long>, cell int, a int, b int, far_a double, far_b double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = halves(_matrix(batch.column(2), width).astype(np.float64))
            (a, far_a), (b, far_b) = (nearest(x, book) for x, book in zip(parts, books, strict=True))
            found = [pa.array(c.astype(np.int32)) for c in (a * len(books[1]) + b, a, b)]
            names = ["vec_id", "label", "q", "cell", "a", "b", "far_a", "far_b"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found, pa.array(far_a), pa.array(far_b)], names=names)

    return rows.mapInArrow(run, schema)


class Store(NamedTuple):
    """The index and the written tables a search reads."""

    index: Index
    sequence: DataFrame  # place, block, vec_id, label, q, cell
    blocks: DataFrame  # block and its rows as binary columns
    spots: DataFrame  # the cells of each block


def build(rows: DataFrame, words: int = WORDS, block: int = ROWS, sample: int = SAMPLE) -> Store | None:
    """Codebooks from at most ``sample`` rows, an index of all; None for an empty table."""
    rows = staged(rows.distinct(), "whole-rows")
    width = rows.agg(F.max(F.size("q")).alias("width")).first().width
    if width is None:
        return None
    drawn = rows.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(sample).select("q").toArrow()
    parts = halves(_matrix(drawn["q"], width).astype(np.float64))
    books = tuple(codebook(x, words) for x in parts)
    celled = staged(_celled(rows, books, width), "celled-rows")
    radii = []
    for word, far, book in (("a", "far_a", books[0]), ("b", "far_b", books[1])):
        radius = np.zeros(len(book))
        for row in celled.groupBy(word).agg(F.max(far).alias("far")).collect():  # one row per codeword
            radius[row[word]] = row.far
        radii.append(radius)
    counts = np.zeros(len(books[0]) * len(books[1]), dtype=np.int64)
    for row in celled.groupBy("cell").count().collect():  # one row per cell
        counts[row.cell] = row["count"]
    ordered = numbered(celled.select("vec_id", "label", "q", "cell"), [F.col(c) for c in ("cell", "vec_id", "label", "q")], "place")
    sequence = staged(ordered.withColumn("block", F.floor(F.col("place") / block).cast("long")), "row-sequence")

    def pack(part: pa.Table) -> pa.Table:
        fixed = [_bytes(part[c].to_numpy().astype(np.int64)) for c in ("vec_id", "label", "cell")]
        return pa.table([part["block"][:1], *fixed, _bytes(_matrix(part["q"], width))], names=["block", "ids", "labels", "cells", "q"])

    packed = sequence.select("block", "vec_id", "label", "cell", "q").groupBy("block")
    blocks = staged(packed.applyInArrow(pack, "block long, ids binary, labels binary, cells binary, q binary"), "row-blocks")
    spots = staged(sequence.groupBy("cell", "block").agg(F.count(F.lit(1)).alias("n")).select("cell", "block"), "cell-blocks")
    return Store(Index(books, tuple(radii), counts, width), sequence, blocks, spots)


def _plan(pending: DataFrame, index: Index, rows: int) -> DataFrame:
    """One row per block of anchors: the anchors, the cells each visits in this round, and where it stopped."""
    known = pending.sparkSession.sparkContext.broadcast(index)

    def run(part: pa.Table) -> pa.Table:
        own, q = known.value, _matrix(part["q"], index.width)
        lows, highs = part["lows"].to_pylist(), part["highs"].to_pylist()
        wanted = np.zeros((len(q), len(own.counts)), dtype=bool)
        at, bounds = [], []
        for i, visited in enumerate(part["visited"].to_pylist()):
            cells, seen, bound = route(own, q[i], visited, rows, min(lows[i]), max(highs[i]))
            wanted[i, cells] = True
            at.append(seen)
            bounds.append(bound)
        n_windows = max(map(len, lows))
        spans = np.empty((len(q), n_windows, 2), dtype=np.int64)
        spans[:] = (HIGH, LOW)  # an empty window
        for i, (low, high) in enumerate(zip(lows, highs, strict=True)):
            spans[i, : len(low), 0], spans[i, : len(low), 1] = low, high
        columns = {
            "anchors": part["anchors"][:1],
            "cells": pa.array([np.flatnonzero(wanted.any(axis=0)).tolist()], pa.list_(pa.int32())),
            **{name: _bytes(part[name].to_numpy().astype(np.int64)) for name in ("place", "vec_id", "label")},
            "q": _bytes(q),
            "wanted": _bytes(np.packbits(wanted, axis=1)),
            "spans": _bytes(spans),
            "places": pa.array([part["place"].to_pylist()], pa.list_(pa.int64())),
            "visited": pa.array([at], pa.list_(pa.int32())),
            "bounds": pa.array([bounds], pa.list_(pa.float64())),
        }
        return pa.table(columns)

    schema = (
        "anchors long, cells array<int>, place binary, vec_id binary, label binary, q binary, wanted binary, spans binary, "
        "places array<long>, visited array<int>, bounds array<double>"
    )
    columns = ("anchors", "place", "vec_id", "label", "q", "lows", "highs", "visited")
    return pending.select(*columns).groupBy("anchors").applyInArrow(run, schema)


def _compare(tiles: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """``place, w, score, id``: of every pair of blocks the best rows of each anchor and window."""
    width, n_cells = index.width, len(index.counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                ids, labels, cells = (_numbers(column[c], i) for c in ("ids", "labels", "cells"))
                place, own, label = (_numbers(column[c], i) for c in ("place", "vec_id", "label"))
                spans = _numbers(column["spans"], i).reshape(len(place), -1, 2)
                bits = np.frombuffer(column["wanted"][i].as_buffer(), dtype=np.uint8).reshape(len(place), -1)
                wanted = np.unpackbits(bits, axis=1, count=n_cells).astype(bool)[:, cells]
                alike = label[:, None] == labels
                wanted &= alike & (own[:, None] != ids) if same else ~alike
                scores = products(_numbers(column["q"], i).reshape(-1, width), _numbers(column["rows"], i).reshape(-1, width))
                for w in range(spans.shape[1]):
                    inside = wanted & (scores >= spans[:, w, :1]) & (scores <= spans[:, w, 1:])
                    anchor, row = best_rows(scores, inside, ids, k)
                    out = [place[anchor], np.full(len(anchor), w), scores[anchor, row], ids[row]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["place", "w", "score", "id"])

    return tiles.mapInArrow(run, "place long, w long, score long, id long")


def search(store: Store, anchors: DataFrame, same: bool, k: int, first: int = FIRST) -> DataFrame:
    """The best ``k`` rows in each window of each anchor: ``place, w, rank, id, score``.

    ``anchors`` has ``anchors`` (its block), ``place, vec_id, label, q`` and the windows as
    arrays ``lows`` and ``highs``. ``same`` seeks rows of the anchor's label, else of other labels.
    """
    pending, found, rows = anchors.withColumn("visited", F.lit(0)), None, first
    best = Window.partitionBy("place", "w").orderBy(F.desc("score"), "id")
    while True:
        work = staged(_plan(pending, store.index, rows), "routes")
        wanted = work.select("anchors", F.explode("cells").alias("cell"))
        pairs = staged(wanted.join(store.spots, "cell").select("anchors", "block").distinct(), "block-pairs")
        n = pairs.count()
        asked = work.select("anchors", "place", "vec_id", "label", "q", "wanted", "spans")
        tiles = pairs.join(asked, "anchors").join(store.blocks.withColumnRenamed("q", "rows"), "block")
        tiles = tiles.repartition(max(min(n, 64), n // 16, 1), "block", "anchors")
        new = _compare(tiles, store.index, same, k)
        both = new if found is None else found.select("place", "w", "score", "id").unionByName(new)
        found = staged(both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "best-rows")
        stops = work.select(F.explode(F.arrays_zip("places", "visited", "bounds")).alias("s")).select("s.*").where("bounds is not null")
        last = found.where(F.col("rank") == k).groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last"))
        raised = F.expr("transform(lows, (x, i) -> greatest(x, coalesce(last[cast(i as bigint)], x)))")
        pending = pending.drop("visited").join(stops.withColumnRenamed("places", "place"), "place").join(last, "place", "left")
        pending = pending.withColumn("lows", raised).drop("last")
        # a window with k rows above the bound is complete, so it asks for no more
        open_ = F.exists("lows", lambda x: x.cast("double") <= F.col("bounds"))
        pending = staged(pending.where(open_).drop("bounds"), "open-anchors")
        if pending.isEmpty():
            return found
        rows *= GROWTH


def hard_negatives(
    rows: DataFrame, every: int = 100, words: int = WORDS, block: int = ROWS, anchors: int = ANCHORS, first: int = FIRST
) -> DataFrame:
    """Negatives for the rows whose id is divisible by ``every``; ``rows`` has ``vec_id, label, q``."""
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    store = build(rows, words, block)
    if store is None:
        return rows.sparkSession.createDataFrame([], names)
    chosen = store.sequence.where(F.col("vec_id") % every == 0).select("place", "vec_id", "label", "q")
    chosen = numbered(chosen, [F.col("place")], "at").withColumn("anchors", F.floor(F.col("at") / anchors).cast("long")).drop("at")
    chosen = staged(chosen, "anchors")
    if chosen.isEmpty():
        return rows.sparkSession.createDataFrame([], names)
    whole = chosen.withColumn("lows", F.array(F.lit(LOW))).withColumn("highs", F.array(F.lit(HIGH)))
    positives = search(store, whole, True, POSITIVES, first)
    # 100 * negative lies between 30 and 90 times the positive; as whole numbers, and without overflow
    wide = F.col("score").cast("decimal(20, 0)")
    low = (-F.floor(-wide * LOWEST / 100)).cast("long")
    high = F.floor(wide * HIGHEST / 100).cast("long")
    spans = positives.where("score >= 0").select("place", "rank", low.alias("low"), high.alias("high")).where("low <= high")
    spans = spans.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("rank", "low", "high"))).alias("spans"))
    windows = chosen.join(spans, "place").select("*", F.col("spans.low").alias("lows"), F.col("spans.high").alias("highs"))
    windows = staged(windows, "windows")
    if windows.isEmpty():
        return rows.sparkSession.createDataFrame([], names)
    negatives = search(store, windows.drop("spans"), False, NEGATIVES, first)
    of = windows.select("place", F.col("vec_id").alias("anchor_id"), F.posexplode("spans.rank").alias("w", "positive_rank"))
    named = positives.select("place", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    rows_out = negatives.join(of.withColumn("w", F.col("w").cast("long")), ["place", "w"]).join(named, ["place", "positive_rank"])
    return rows_out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
