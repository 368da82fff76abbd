"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with a cosine of at least t lie within the distance eps = sqrt(2 - 2t). The
vectors are turned to their principal axes and sorted by the cells, eps wide, of the
leading axes. The sequence is cut into blocks, blocks into a tree of intervals, and the
join goes down this tree: two intervals whose bounding boxes are more than eps apart are
provably distant and are skipped with all that is below them.

Cases: a vector that is null, empty, zero or holds a null or non-finite component links
with nothing. Vectors of different lengths compare as if the shorter had zeros at its end.
Equal vectors are joined once and counted as often as they occur. Null ids take part, but
name no component. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import staged
from wardline.llm.components import connected
from wardline.llm.numbering import numbered

#: Vectors in a block, and intervals that one interval of the level above holds.
BLOCK, FANOUT = 2048, 4
#: Blocks in a part; a task of the join holds one part and reads another.
PART_BLOCKS = 16
#: Principal axes in the sort key and in the bounding boxes.
SORT_AXES, BOX_AXES = 6, 24


def _usable(embedding: str = "embedding"):
    e = F.col(embedding)
    sound = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(sound & F.exists(e, lambda x: x != 0), F.lit(False))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles, short rows filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The principal axes as columns, leading ones first, from sums over all vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _unit(_rows(batch.column(0), width))
            total += x.T @ x
        i, j = np.divmod(np.arange(width * width), width)
        upper = i <= j
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[upper]), pa.array(j[upper]), pa.array(total.ravel()[upper])], names=["i", "j", "x"]
        )

    sums = vectors.select("embedding").mapInArrow(partial, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x"))
    moment = np.zeros((width, width))
    for row in sums.collect():  # width * (width + 1) / 2 rows
        moment[row.i, row.j] = moment[row.j, row.i] = row.x
    return np.linalg.eigh(moment)[1][:, ::-1].copy()


def _in_cells(vectors: DataFrame, axes: np.ndarray, eps: float) -> DataFrame:
    """``vectors`` with the cell number on each sort axis."""
    width, depth = axes.shape[0], min(SORT_AXES, axes.shape[1])
    names = [f"c{k}" for k in range(depth)]
    schema = vectors.select("*", *(F.lit(0).alias(c) for c in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("embedding")
            cells = np.floor(_unit(_rows(batch.column(at), width)) @ axes[:, :depth] / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in cells.T)], names=schema.fieldNames())

    return vectors.mapInArrow(run, schema)


def _blocks(sequence: DataFrame, axes: np.ndarray) -> DataFrame:
    """One row per block: its vectors, their counts, and its box on the leading axes."""
    width, depth = axes.shape[0], min(BOX_AXES, axes.shape[1])

    def run(rows: pa.Table) -> pa.Table:
        x = _unit(_rows(rows.column("embedding"), width))
        turned = x @ axes[:, :depth]
        return pa.table(
            {
                "block": [rows.column("block")[0].as_py()],
                "reps": [rows.column("rep").to_numpy().astype(np.int64)],
                "counts": [rows.column("n").to_numpy().astype(np.int64)],
                "units": [np.ascontiguousarray(x).tobytes()],
                "low": [turned.min(axis=0)],
                "high": [turned.max(axis=0)],
            }
        )

    schema = "block long, reps array<long>, counts array<long>, units binary, low array<double>, high array<double>"
    return sequence.select("block", "rep", "n", "embedding").groupBy("block").applyInArrow(run, schema)


def _gap_squared(low_a: str, high_a: str, low_b: str, high_b: str):
    apart = F.arrays_zip(F.col(low_a).alias("la"), F.col(high_a).alias("ha"), F.col(low_b).alias("lb"), F.col(high_b).alias("hb"))

    def add(total, x):
        gap = F.greatest(x["la"] - x["hb"], x["lb"] - x["ha"], F.lit(0.0))
        return total + gap * gap

    return F.aggregate(apart, F.lit(0.0), add)


def near_blocks(boxes: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """Pairs ``(a, b)``, a <= b, of blocks that may hold vectors within ``eps``."""
    spark = boxes.sparkSession
    levels = [boxes]
    while FANOUT ** (len(levels) - 1) < n_blocks:
        above = levels[-1].groupBy((F.col("block") / FANOUT).cast("long").alias("block"))
        axis = range(len(boxes.first().low))
        levels.append(
            staged(
                above.agg(
                    F.array(*(F.min(F.col("low")[k]) for k in axis)).alias("low"),
                    F.array(*(F.max(F.col("high")[k]) for k in axis)).alias("high"),
                ),
                "intervals",
            )
        )
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    limit = eps * eps * (1 + 1e-9) + 1e-12
    for level in reversed(levels[:-1]):
        for side in ("a", "b"):
            child = F.explode(F.sequence(F.col(side) * FANOUT, F.col(side) * FANOUT + FANOUT - 1))
            pairs = pairs.withColumn(side, child)
        left = level.select(F.col("block").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
        right = level.select(F.col("block").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
        near = pairs.where("a <= b").join(left, "a").join(right, "b")
        pairs = staged(near.where(_gap_squared("la", "ha", "lb", "hb") <= limit).select("a", "b"), "near-blocks")
    return pairs


def _join_blocks(pairs: DataFrame, blocks: DataFrame, axes: np.ndarray, threshold: float, n_blocks: int) -> DataFrame:
    """``(rep, links, root)``: for every pair of blocks, what each vector links with in it.

    ``links`` counts vectors, and ``root`` connects the vectors that are linked within
    the pair, so the rows stay linear in the block size however many links there are.

    The blocks are dealt to parts twice, and a task reads one part of each side. So what is
    shuffled is two copies of the blocks, however many pairs there are.
    """
    width, depth = axes.shape[0], min(BOX_AXES, axes.shape[1])
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n_blocks // PART_BLOCKS), min(n_blocks, math.isqrt(4 * cores)), 1)
    names = ("reps", "counts", "units")
    near = pairs.groupBy("a").agg(F.collect_set("b").alias("near"))
    left = blocks.select(F.col("block").alias("a"), *(F.col(n).alias(f"{n}_a") for n in names)).join(near, "a").repartition(parts)
    right = blocks.select(F.col("block").alias("b"), *(F.col(n).alias(f"{n}_b") for n in names)).repartition(parts)
    both = left.hint("shuffle_replicate_nl").join(right, F.array_contains("near", F.col("b"))).drop("near")

    def ahead(x: np.ndarray) -> np.ndarray:
        """The leading axes and the length of the rest: products of these are never below the cosine."""
        turned = x @ axes[:, :depth]
        rest = np.sqrt(np.maximum(1 - (turned * turned).sum(axis=1, keepdims=True), 0))
        return np.concatenate([turned, rest], axis=1).astype(np.float32)

    def join(a: int, b: int, reps: list, counts: list, units: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = (np.frombuffer(u).reshape(-1, width) for u in units)
        possible = (ahead(x) @ ahead(y).T) >= threshold - 1e-4  # far above the error of single precision
        if a == b:
            np.fill_diagonal(possible, False)
        rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
        linked = (x[rows] @ y[columns].T) >= threshold
        if a == b:
            linked &= rows[:, None] != columns
        some, others = linked.any(axis=1), linked.any(axis=0)
        linked, rows, columns = linked[np.ix_(some, others)], rows[some], columns[others]
        ids_x, ids_y = reps[0][rows], reps[1][columns]
        weight_x = linked @ counts[1][columns].astype(np.float64)
        weight_y = counts[0][rows].astype(np.float64) @ linked
        root_x, root_y = ids_x.copy(), ids_y.copy()
        top = np.iinfo(np.int64).max
        while len(rows):
            low_y = np.minimum(root_y, np.where(linked, root_x[:, None], top).min(axis=0))
            low_x = np.minimum(root_x, np.where(linked, low_y[None, :], top).min(axis=1))
            if (low_x == root_x).all() and (low_y == root_y).all():
                break
            root_x, root_y = low_x, low_y
        if a == b:
            return ids_x, weight_x.astype(np.int64), root_x
        return tuple(np.concatenate(z) for z in ((ids_x, ids_y), (weight_x.astype(np.int64), weight_y.astype(np.int64)), (root_x, root_y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
                lists = {n: row[n].values.to_numpy(zero_copy_only=False) for n in ("reps_a", "reps_b", "counts_a", "counts_b")}
                units = [row["units_a"].as_buffer(), row["units_b"].as_buffer()]
                out = join(
                    row["a"].as_py(), row["b"].as_py(),
                    [lists["reps_a"], lists["reps_b"]], [lists["counts_a"], lists["counts_b"]], units,
                )
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["rep", "links", "root"])

    return both.mapInArrow(run, "rep long, links long, root long")


def embedding_links(vectors: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """``vectors`` (``vec_id``, ``embedding``) to ``vec_id, n_links, component_id, kept``."""
    marked = vectors.select("vec_id", "embedding", _usable().alias("usable"))
    usable = marked.where("usable").select("vec_id", "embedding")
    alone = marked.where("not usable").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    grouped = usable.groupBy("embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    # a key of their own: ids may be null or repeat
    order = [F.col("first_id").asc_nulls_last(), F.col("embedding")]
    distinct = staged(numbered(grouped, order, "rep"), "distinct-vectors")
    facts = distinct.agg(F.max(F.size("embedding")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    if not facts.n:
        return alone.withColumn("kept", F.lit(True))
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    axes = principal_axes(distinct, facts.width)
    celled = _in_cells(distinct, axes, eps)
    cells = [F.col(c) for c in celled.columns if c[0] == "c" and c[1:].isdigit()]
    sequence = numbered(celled, [*cells, F.col("rep")], "place").withColumn("block", F.floor(F.col("place") / block).cast("long"))
    blocks = staged(_blocks(sequence, axes), "blocks")
    n_blocks = -(-facts.n // block)
    pairs = near_blocks(blocks.select("block", "low", "high"), n_blocks, eps)
    found = staged(_join_blocks(pairs, blocks, axes, threshold, n_blocks), "found")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = (
        distinct.join(counts, "rep", "left")
        .join(roots, F.col("rep") == F.col("node"), "left")
        .select("rep", "embedding", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    )
    classes = staged(classes, "classes")
    ids = staged(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")
    rooted = staged(classes.join(ids, "root").select("embedding", "n_links", "component_id"), "vector-classes")
    every = usable.join(rooted, "embedding").select("vec_id", "n_links", "component_id").unionByName(alone)
    return every.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


