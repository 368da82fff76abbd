"""Gradient boosted trees over small whole-number features, as SQL expressions.

Rows come as counts per distinct feature vector, which Spark has summed over all data; so
fitting looks at a table whose size depends on the features alone.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS, RATE, RIDGE = 30, 0.3, 1.0


class Pattern(NamedTuple):
    """A feature vector, and the weight of the rows of each class that have it."""

    features: tuple[int, ...]
    negative: float
    positive: float


class Leaf(NamedTuple):
    value: float


class Node(NamedTuple):
    """Feature ``feature`` up to ``at`` goes to ``low``."""

    feature: int
    at: int
    low: Node | Leaf
    high: Node | Leaf


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _value(rows: list[tuple[Pattern, float, float]]) -> float:
    return RATE * sum(g for _, g, _ in rows) / (sum(h for _, _, h in rows) + RIDGE)


def _grow(rows: list[tuple[Pattern, float, float]], depth: int) -> Node | Leaf:
    """Newton steps: the split with the largest gain, down to ``depth`` levels."""

    def score(part: list[tuple[Pattern, float, float]]) -> float:
        return sum(g for _, g, _ in part) ** 2 / (sum(h for _, _, h in part) + RIDGE)

    best, whole = None, score(rows)
    if depth:
        for feature in range(len(rows[0][0].features)):
            for at in sorted({p.features[feature] for p, _, _ in rows})[:-1]:
                low = [r for r in rows if r[0].features[feature] <= at]
                high = [r for r in rows if r[0].features[feature] > at]
                gain = score(low) + score(high) - whole
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = gain, feature, at, low, high
    if best is None:
        return Leaf(_value(rows))
    _, feature, at, low, high = best
    return Node(feature, at, _grow(low, depth - 1), _grow(high, depth - 1))


def answer(tree: Node | Leaf, features: tuple[int, ...]) -> float:
    while isinstance(tree, Node):
        tree = tree.low if features[tree.feature] <= tree.at else tree.high
    return tree.value


def boosted(patterns: list[Pattern], depth: int = 3) -> list[Node | Leaf]:
    """Trees whose answers add up to the log odds of the positive class."""
    totals = sum(p.negative for p in patterns), sum(p.positive for p in patterns)
    trees: list[Node | Leaf] = [Leaf(math.log((totals[1] + 1) / (totals[0] + 1)))]
    margins = [trees[0].value] * len(patterns)
    for _ in range(ROUNDS if patterns else 0):
        rows = []
        for p, z in zip(patterns, margins, strict=True):
            s, n = _sigmoid(z), p.negative + p.positive
            rows.append((p, p.positive - n * s, n * s * (1 - s)))
        trees.append(_grow(rows, depth))
        margins = [z + answer(trees[-1], p.features) for z, p in zip(margins, patterns, strict=True)]
    return trees


def margin(trees: list[Node | Leaf], features: tuple[int, ...]) -> float:
    return sum(answer(tree, features) for tree in trees)


def margin_column(trees: list[Node | Leaf], columns: list[str]) -> Column:
    def column(tree: Node | Leaf) -> Column:
        if isinstance(tree, Leaf):
            return F.lit(tree.value)
        return F.when(F.col(columns[tree.feature]) <= tree.at, column(tree.low)).otherwise(column(tree.high))

    total = F.lit(0.0)
    for tree in trees:
        total = total + column(tree)
    return total
