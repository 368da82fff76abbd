"""The set of tables a dataset reads, conformed to the declared model."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.time import Moment, to_datetime
from wardline.sources.model import MONTH, TABLES

Frame = DataFrame | Callable[[], DataFrame]


class Tables:
    """Named frames of the hospital model, loaded on first use.

    A frame may lack nullable columns of the declaration: they are added as
    typed NULLs, so every dataset sees the full column list. Types that are
    already there are kept as they are. ``password`` columns never pass.
    """

    def __init__(self, frames: Mapping[str, Frame], by_month: bool = False):
        self._sources: dict[str, Frame] = dict(frames)
        self._by_month = by_month
        self._loaded: dict[str, DataFrame] = {}

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def __iter__(self) -> Iterable[str]:
        return iter(self._sources)

    def source(self, name: str) -> DataFrame:
        """The frame as given, before conforming."""
        if name not in self._sources:
            raise KeyError(f"table {name!r} was not given")
        frame = self._sources[name]
        if callable(frame):
            frame = self._sources[name] = frame()
        return frame

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._loaded:
            self._loaded[name] = conform(self.source(name), name)
        return self._loaded[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self[name]
        raise AttributeError(name)

    def of_months(self, name: str, first: Moment | None = None, last: Moment | None = None) -> DataFrame:
        """A fact for which only rows dated from ``first`` to ``last`` matter.

        Where the fact is stored by month, other months are not read. The rows of the
        first and last month are all there: filter them by the date itself.
        """
        if not self._by_month or TABLES[name].month_of is None or MONTH not in self.source(name).columns:
            return self[name]
        rows = self.source(name)
        if first is not None:
            rows = rows.filter(F.col(MONTH) >= f"{to_datetime(first):%Y-%m}")
        if last is not None:
            rows = rows.filter(F.col(MONTH) <= f"{to_datetime(last):%Y-%m}")
        return conform(rows, name)

    def replacing(self, **frames: Frame) -> "Tables":
        """A copy in which some tables are exchanged for new states."""
        return Tables({**self._sources, **frames}, self._by_month)

    @classmethod
    def parquet(cls, spark: SparkSession, root: str) -> "Tables":
        """Tables stored as ``root/<table>`` Parquet folders, read with the declared schema."""

        def reader(name: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                schema = TABLES[name].schema
                if TABLES[name].month_of is not None:
                    schema = schema.add(MONTH, "string")
                return spark.read.schema(schema).parquet(f"{root}/{name}")

            return load

        return cls({name: reader(name) for name in TABLES}, by_month=True)

    @classmethod
    def catalog(cls, spark: SparkSession, database: str) -> "Tables":
        """Tables of a database in the Spark catalog, where their bucketing is known."""

        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.table(f"{database}.{name}")

        return cls({name: reader(name) for name in TABLES})

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, properties: Mapping[str, str], partitions: int = 64) -> "Tables":
        """Tables read from a relational database, each split by ranges of its key."""

        def reader(name: str) -> Callable[[], DataFrame]:
            def load() -> DataFrame:
                key = TABLES[name].key
                base = {"url": url, **properties}
                bounds = (
                    spark.read.format("jdbc")
                    .options(**base, query=f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}")
                    .load()
                    .first()
                )
                options = split_options(name, key, bounds[0], bounds[1], partitions)
                return spark.read.format("jdbc").options(**base, **options).load()

            return load

        return cls({name: reader(name) for name in TABLES})


def split_options(table: str, key: str, low: int | None, high: int | None, partitions: int) -> dict[str, str]:
    """Reader options for parallel key ranges; an empty or tiny table is one read."""
    if low is None or high is None or high - low < partitions:
        return {"dbtable": table}
    return {
        "dbtable": table,
        "partitionColumn": key,
        "lowerBound": str(low),
        "upperBound": str(high),
        "numPartitions": str(partitions),
    }


def conform(df: DataFrame, name: str) -> DataFrame:
    present = set(df.columns)
    return df.select(
        *[
            F.col(c.name) if c.name in present else F.lit(None).cast(c.type).alias(c.name)
            for c in TABLES[name].columns
        ]
    )
