"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of a budget of words by weight, at most ``most`` times its own
size; what is above goes to the others by weight, again and again until none is above.
A document's expected number of copies is its source's target over the source's size, or
in proportion to a preference column. The whole part of it is certain. For the rest, its
inclusion odds, documents draw random odds from a hash of their id; documents with the
smallest ratio of random odds to inclusion odds are taken, until the sample has the size,
in words, that the target leaves. So the size is fixed, and the odds may differ from
document to document.

The cut is found by sums over fixed buckets of the ratio, then over buckets of the bucket
that holds the cut, then in that small bucket row by row; no source is sorted as a whole.

Cases: a null text and a text without words have size 0 and are never copied; a null
source is a source of its own, last in the order; rows that share id and size are taken
alike; a null or negative preference counts as 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import WORD, staged
from wardline.llm.numbering import numbered

WEIGHTS, MOST = (1, 2, 3), 3
#: Buckets at each of the two levels of the search for the cut.
BUCKETS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """Hex digits that look random and depend on the id and the seed alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``, one row per source.

    Every round fixes the sources above their limit; two sums per round reach the driver.
    """
    listed = F.array(*(F.lit(w) for w in weights))
    # sources in code point order, null last
    placed = numbered(sizes, [F.col("source").asc_nulls_last()], "place")
    weighed = placed.select("source", "source_size", listed[F.col("place") % len(weights)].cast("long").alias("weight"))
    weighed = staged(weighed, "sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    budget = total if share == 1.0 else total * share
    unit, limit = F.lit(0.0), F.lit(most) * F.col("source_size")
    limited: tuple | None = None
    while True:
        above = F.col("weight") * unit >= limit if limited else F.lit(False)
        sums = weighed.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("weight"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if sums.weight is None or limited == (sums.n,):
            break
        limited = (sums.n,)
        unit = F.lit((budget - sums.fixed) / sums.weight)
    above = F.col("weight") * unit >= limit
    target = F.when(above, limit.cast("double")).otherwise(F.col("weight") * unit)
    return weighed.select("source", "source_size", target.alias("target"))


def _expected(sized: DataFrame, most: int, preference: bool) -> DataFrame:
    """``whole`` certain copies and ``odds`` of one more, and ``rank``: the ratio on a scale from 0 to 1."""
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    if preference:
        copies = copies * F.when(F.col("liked") > 0, F.col("liked") / F.col("mean_liked")).otherwise(0.0)
    copies = F.least(copies, F.lit(float(most)))
    whole = F.floor(copies)
    odds = copies - whole
    drawn = (F.conv(F.substring("drawn", 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    ratio = drawn / (1 - drawn) * ((1 - odds) / odds)
    rank = F.when(odds > 0, ratio / (1 + ratio))
    return sized.withColumns({"whole": whole.cast("long"), "rank": rank})


def _crossing(sums: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """The bucket of each source in which the running sum reaches ``need``, and what is missing before it."""
    window = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("run", F.sum("words").over(window))
    crossed = run.where((F.col("run") >= F.col("need")) & (F.col("run") - F.col("words") < F.col("need")))
    return crossed.select(*keys, bucket, (F.col("need") - F.col("run") + F.col("words")).alias("need"))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    preference: str | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """``(cuts, sources)``, for :func:`with_copies`.

    ``cuts`` has one row per source: buckets before ``cut_1``, ``cut_2`` are taken, and of
    that bucket the rows up to ``last``. Without a cut all rows are, if ``need_more``.
    """
    liked = F.col(preference).cast("double") if preference else F.lit(1.0)
    narrow = docs.select(
        "source", n_words(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("drawn"),
        F.greatest(F.coalesce(liked, F.lit(0.0)), F.lit(0.0)).alias("liked"),
    )
    narrow = staged(narrow, "sizes")
    sizes = staged(
        narrow.groupBy("source").agg(
            F.sum("size").alias("source_size"), (F.sum(F.col("liked") * F.col("size")) / F.sum("size")).alias("mean_liked")
        ),
        "source-sizes",
    )
    found = targets(sizes.select("source", "source_size"), weights, share, most)
    mean = sizes.select(F.col("source").alias("s"), "mean_liked")
    sources = staged(found.join(mean, F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    rows = staged(_expected(_same_source(narrow, sources), most, preference is not None), "ranked")
    whole = rows.groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    need = staged(whole.select("source", (F.col("target") - F.col("certain")).alias("need")), "need")

    open_rows = rows.where("rank is not null and size > 0").withColumn("b1", F.floor(F.col("rank") * BUCKETS))
    b2 = F.floor((F.col("rank") * BUCKETS - F.col("b1")) * BUCKETS)
    first = open_rows.groupBy("source", "b1").agg(F.sum("size").alias("words"))
    first = staged(_crossing(_same_source(first, need), ["source"], "b1"), "cut-1")
    inside = _same_source(open_rows, first.withColumnRenamed("b1", "at")).where("b1 = at").withColumn("b2", b2)
    inside = staged(inside.select("source", "b1", "b2", "need", "rank", "size", "drawn"), "cut-rows")
    second = inside.groupBy("source", "b1", "b2", "need").agg(F.sum("size").alias("words"))
    second = staged(_crossing(second, ["source", "b1"], "b2"), "cut-2")
    near = _same_source(inside.drop("need"), second.withColumnsRenamed({"b1": "at", "b2": "at2"})).where("b2 = at2")
    place = F.struct("rank", "size", "drawn")
    order = Window.partitionBy("source").orderBy(place).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = near.withColumn("run", F.sum("size").over(order))
    taken = run.where(F.col("run") - F.col("size") / 2 <= F.col("need"))
    last = taken.groupBy("source").agg(F.max(place).alias("last"))
    cuts = _same_source(need.select("source", (F.col("need") > 0).alias("need_more")), second.drop("need"), "left")
    cuts = _same_source(cuts, staged(last, "last"), "left")
    return staged(cuts.withColumnsRenamed({"b1": "cut_1", "b2": "cut_2"}), "cuts"), sources


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "__llm_source")
    return left.join(right, left["source"].eqNullSafe(right["__llm_source"]), how).drop("__llm_source")


def with_copies(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.0,
    most: int = MOST,
    preference: str | None = None,
    seed: int = 17,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``kept``, a struct of the columns ``keep``, with ``size, source_size, target, taken, copies``.

    ``copies`` is how often the mix takes the document, ``taken`` the words of that.
    """
    cuts, sources = mixed(docs, weights, share, most, preference, seed)
    liked = F.col(preference).cast("double") if preference else F.lit(1.0)
    rows = docs.select(
        F.struct(*keep).alias("kept"), "source", n_words(F.col("text")).alias("size"),
        draw(F.col("doc_id"), seed).alias("drawn"), F.coalesce(liked, F.lit(0.0)).alias("liked"),
    )
    rows = _expected(_same_source(rows, sources), most, preference is not None)
    rows = _same_source(rows, cuts)
    b1 = F.floor(F.col("rank") * BUCKETS)
    b2 = F.floor((F.col("rank") * BUCKETS - b1) * BUCKETS)
    before = (b1 < F.col("cut_1")) | ((b1 == F.col("cut_1")) & (b2 < F.col("cut_2")))
    at = (b1 == F.col("cut_1")) & (b2 == F.col("cut_2")) & (F.struct("rank", "size", "drawn") <= F.col("last"))
    extra = F.col("rank").isNotNull() & ((F.col("cut_1").isNull() & F.col("need_more")) | before | F.coalesce(at, F.lit(False)))
    copies = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(0)
    return rows.withColumn("copies", copies.cast("long")).select(
        "kept", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"
    )


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    mix = with_copies(docs, keep=tuple(docs.columns), **options).where("copies > 0")
    return mix.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("kept.*")
