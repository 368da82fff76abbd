"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import staged


def local_roots(linked: np.ndarray) -> np.ndarray:
    """The smallest reachable index of each row of a small symmetric link matrix."""
    n = len(linked)
    roots = np.arange(n)
    while True:
        seen = np.where(linked, roots, n).min(axis=1, initial=n)
        lower = np.minimum(roots, seen)
        lower = lower[lower]
        if (lower == roots).all():
            return roots
        roots = lower


def connected(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node with a smaller one in reach; ``links`` has ``a`` and ``b``.

    Each round hooks a node to its smallest neighbour, shortens the hooks to their
    ends by pointer jumping and replaces the links by links between the ends. Links
    only move as rows of joins with one row per node, so a node with very many links
    is split like any skewed key.
    """
    live = staged(
        links.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "links",
    )
    total: DataFrame | None = None
    while not live.isEmpty():
        hooks = _shortened(staged(live.groupBy("hi").agg(F.min("lo").alias("lo")), "hooks"))
        total = hooks if total is None else staged(_follow(total, hooks).unionByName(hooks), "roots")
        ends = live.join(hooks.select("hi", F.col("lo").alias("x")), "hi").select("lo", "x")
        ends = _follow(ends.withColumnRenamed("x", "hi"), hooks).select(
            F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")
        )
        live = staged(ends.where("hi <> lo").distinct(), "links")
    if total is None:
        total = live
    return total.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _follow(pairs: DataFrame, hooks: DataFrame) -> DataFrame:
    """``pairs`` with ``lo`` replaced by the end of its hook."""
    ends = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("end"))
    return pairs.join(ends, "lo", "left").select("hi", F.coalesce("end", "lo").alias("lo"))


def _shortened(hooks: DataFrame) -> DataFrame:
    while True:
        ends = hooks.select(F.col("hi").alias("lo"), F.col("lo").alias("end"))
        jumped = staged(
            hooks.join(ends, "lo", "left").select(
                "hi", F.coalesce("end", "lo").alias("lo"), F.col("end").isNotNull().alias("moved")
            ),
            "hooks",
        )
        hooks = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return hooks
