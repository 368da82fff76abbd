"""Data-quality rules of the model, evaluated declaratively.

``violations(t, table)`` lists every broken rule as (table, rule, key, detail).
Row rules share one scan of the table; unique keys are one aggregate each and
references one anti join each. Not-null rules cover the columns the source has.
``audit(t)`` gives the same rows for many tables at once, from two reads of each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import stage
from wardline.sources.model import TABLES
from wardline.sources.model import Column as Declared
from wardline.sources.tables import Tables


@dataclass(frozen=True)
class RowRule:
    """A rule on one row: ``broken`` is TRUE for offending rows (NULL counts as kept)."""

    name: str
    column: str
    broken: Column


def value_rules(declared: Declared, value: Column) -> list[RowRule]:
    """Range, list and length rules of a declared column, applied to ``value``."""
    rules = []
    if declared.low is not None or declared.high is not None:
        low = F.lit(False) if declared.low is None else value < F.lit(declared.low)
        high = F.lit(False) if declared.high is None else value > F.lit(declared.high)
        rules.append(RowRule("range", declared.name, low | high))
    if declared.one_of is not None:
        rules.append(RowRule("list", declared.name, ~F.lower(value).isin(*[v.lower() for v in declared.one_of])))
    if declared.max_len is not None:
        rules.append(RowRule("length", declared.name, F.length(value) > declared.max_len))
    return rules


def _cross_rules(table: str) -> list[RowRule]:
    if table == "appointments":
        one = F.col("slot_id").isNotNull() != F.col("appointment_datetime").isNotNull()
        # Checked when a row is stored, so the day of its creation is the "today".
        past = F.col("appointment_date") < F.to_date("created_at")
        return [RowRule("slot_or_datetime", "slot_id", ~one), RowRule("not_past", "appointment_date", past)]
    if table == "admissions":
        return [RowRule("discharge_after_admission", "discharge_date", F.col("discharge_date") < F.col("admission_date"))]
    return []


def positive_id(column: str) -> Column:
    """TRUE where an id field reads as a positive integer."""
    return F.coalesce(F.col(column).try_cast("bigint") > 0, F.lit(False))


def row_rules(table: str, present: Iterable[str]) -> list[RowRule]:
    declared = TABLES[table]
    present = set(present)
    rules: list[RowRule] = []
    for column in declared.columns:
        if column.name not in present:
            continue
        if column.required:
            rules.append(RowRule("not_null", column.name, F.col(column.name).isNull()))
        rules.extend(value_rules(column, F.col(column.name)))
    ids = [declared.key, *[r.column for r in declared.references]]
    for name in ids:
        if name in present:
            rules.append(RowRule("positive_id", name, F.col(name).isNotNull() & ~positive_id(name)))
    return rules + _cross_rules(table)


def broken_rows(t: Tables, table: str) -> DataFrame:
    key = TABLES[table].key
    rules = row_rules(table, t.source(table).columns)
    found = [
        F.when(
            r.broken,
            F.struct(
                F.lit(f"{r.name}:{r.column}").alias("rule"),
                F.coalesce(F.col(r.column).cast("string"), F.lit("null")).alias("detail"),
            ),
        )
        for r in rules
    ]
    return (
        t[table]
        .select(F.col(key).cast("string").alias("key"), F.explode(F.array_compact(F.array(*found))).alias("hit"))
        .select(F.lit(table).alias("table"), "hit.rule", "key", "hit.detail")
    )


def repeated_keys(t: Tables, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Unique keys held by several rows; NULLs are equal to each other here."""
    key = TABLES[table].key
    name = ",".join(columns)
    return (
        t[table]
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"))
        .filter("n > 1")
        .select(
            F.lit(table).alias("table"),
            F.lit(f"unique:{name}").alias("rule"),
            F.col("first_key").cast("string").alias("key"),
            F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"),
        )
    )


def lost_references(t: Tables, table: str, column: str, parent: str) -> DataFrame:
    key = TABLES[table].key
    parents = t[parent].select(F.col(TABLES[parent].key).alias(column))
    return (
        t[table]
        .filter(F.col(column).isNotNull())
        .select(key, column)
        .join(parents, column, "left_anti")
        .select(
            F.lit(table).alias("table"),
            F.lit(f"reference:{column}").alias("rule"),
            F.col(key).cast("string").alias("key"),
            F.col(column).cast("string").alias("detail"),
        )
    )


def violations(t: Tables, *names: str) -> DataFrame:
    """All broken rules of the named tables (default: every table given)."""
    parts: list[DataFrame] = []
    for name in names or [n for n in TABLES if n in t]:
        declared = TABLES[name]
        present = set(t.source(name).columns)
        parts.append(broken_rows(t, name))
        for columns in ((declared.key,), *declared.unique):
            if present.issuperset(columns):
                parts.append(repeated_keys(t, name, columns))
        for reference in declared.references:
            if reference.column in present and reference.table in t:
                parts.append(lost_references(t, name, reference.column, reference.table))
    return reduce(DataFrame.unionAll, parts)


def summary(found: DataFrame) -> DataFrame:
    """Number of violations per table and rule."""
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("violations"))


#: Up to so many suspicious keys, of about 100 bytes each, go to every task; more are shuffled.
FEW = 100_000


def _constraints(t: Tables, names: Iterable[str]) -> dict[tuple[str, str], int]:
    """A number for each (table, rule) of unique keys and references, which travels in place of the names."""
    found = []
    for name in names:
        declared, present = TABLES[name], set(t.source(name).columns)
        found += [(name, f"unique:{','.join(c)}") for c in ((declared.key,), *declared.unique) if present.issuperset(c)]
        found += [(name, f"reference:{r.column}") for r in declared.references if r.column in present and r.table in t]
    return {c: i for i, c in enumerate(dict.fromkeys(found))}


def _signals(t: Tables, table: str, numbers: dict[tuple[str, str], int]) -> list[Column]:
    """What a row tells about keys: ``(what, sig, parent)`` of unique keys and references.

    ``what`` numbers the constraint. The signal of a unique key is a hash of its values,
    that of a reference the value itself; the parent's rows send the same signals.
    """
    declared = TABLES[table]

    def signal(owner: str, rule: str, sig: Column, parent: bool, given: Column | None = None) -> Column:
        row = F.struct(F.lit(numbers[owner, rule]).alias("what"), sig.cast("bigint").alias("sig"), F.lit(parent).alias("parent"))
        return row if given is None else F.when(given, row)

    found = [
        signal(table, f"unique:{','.join(columns)}", F.xxhash64(*_spelt(columns)), False)
        for columns in ((declared.key,), *declared.unique)
        if (table, f"unique:{','.join(columns)}") in numbers
    ]
    found += [
        signal(table, f"reference:{r.column}", F.col(r.column), False, F.col(r.column).isNotNull())
        for r in declared.references
        if (table, f"reference:{r.column}") in numbers
    ]
    for child in TABLES.values():
        found += [
            signal(child.name, f"reference:{r.column}", F.col(declared.key), True, F.col(declared.key).isNotNull())
            for r in child.references
            if r.table == table and (child.name, f"reference:{r.column}") in numbers
        ]
    return found


def _spelt(columns: Iterable[str]) -> list[Column]:
    """The values of a unique key as text in which a NULL differs from every value."""
    return [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in columns]


def audit(t: Tables, *names: str, keep: Callable[[DataFrame], DataFrame] = stage) -> DataFrame:
    """The rows of ``violations``, from at most two reads of every table and one shuffle of all keys.

    First every row sends its keys and references, as numbers, and one aggregate counts them:
    most keys occur once and most references meet their parent, so few are suspicious. The
    second read evaluates the row rules, and of constraints those with a suspicious key; rows with
    such a key have their values themselves compared. Counts are partial before the shuffle, so a key that a large
    share of the rows repeats is one row per task.
    """
    asked = list(names or [n for n in TABLES if n in t])
    parents = {r.table for n in asked for r in TABLES[n].references}
    numbers = _constraints(t, asked)
    first = [
        t[n].select(F.explode(F.array_compact(F.array(*signals))).alias("s")).select("s.*")
        for n in TABLES
        if n in t and (n in asked or n in parents) and (signals := _signals(t, n, numbers))
    ]
    counted = reduce(DataFrame.unionAll, first).groupBy("what", "sig").agg(
        F.count_if(~F.col("parent")).alias("rows"), F.bool_or("parent").alias("met")
    )
    reference = F.col("what").isin([i for (_, rule), i in numbers.items() if rule.startswith("reference:")])
    bad = counted.filter((reference & ~F.col("met") & (F.col("rows") > 0)) | (~reference & (F.col("rows") > 1)))
    suspicious = keep(bad.select("what", "sig")).withColumn("seen", F.lit(True))
    broken = {r.what: r.n for r in suspicious.groupBy("what").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per constraint
    if sum(broken.values()) <= FEW:
        suspicious = F.broadcast(suspicious)

    second = []
    for name in asked:
        declared, present = TABLES[name], set(t.source(name).columns)
        key = F.col(declared.key)

        def hit(rule: str, detail: Column, sig: Column, values: Column, name: str = name, key: Column = key) -> Column:
            parts = (
                F.lit(rule).alias("rule"), key.cast("bigint").alias("key"), detail.alias("detail"),
                F.lit(numbers.get((name, rule))).cast("int").alias("what"), sig.alias("sig"), values.alias("values"),
            )
            return F.struct(*parts)

        nothing, no_text, no_values = (F.lit(None).cast(kind) for kind in ("bigint", "string", "array<string>"))
        hits = [
            F.when(r.broken, hit(f"{r.name}:{r.column}", F.coalesce(F.col(r.column).cast("string"), F.lit("null")), nothing, no_values))
            for r in row_rules(name, present)
        ]
        for columns in ((declared.key,), *declared.unique):
            if numbers.get((name, f"unique:{','.join(columns)}")) in broken:
                spelt = _spelt(columns)
                hits.append(hit(f"unique:{','.join(columns)}", no_text, F.xxhash64(*spelt), F.array(*spelt)))
        for r in declared.references:
            if numbers.get((name, f"reference:{r.column}")) in broken:
                value = F.col(r.column)
                hits.append(F.when(value.isNotNull(), hit(f"reference:{r.column}", value.cast("string"), value.cast("bigint"), no_values)))
        rows = t[name].select(F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(F.lit(name).alias("table"), "hit.*")
        second.append(rows)
    rows = reduce(DataFrame.unionAll, second)
    # A row rule has no signal and stays; a key or a reference stays if it is suspicious.
    marked = rows.join(suspicious, ["what", "sig"], "left")
    found = keep(marked.filter("sig is null or seen").select("table", "rule", "key", "detail", F.to_json("values").alias("values")))
    unique = F.col("rule").startswith("unique:")
    repeated = (
        found.filter(unique)
        .groupBy("table", "rule", "values")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
        .filter("n > 1")
        .select("table", "rule", F.col("key").cast("string").alias("key"), F.concat(F.col("n").cast("string"), F.lit(" rows")).alias("detail"))
    )
    single = found.filter(~unique).select("table", "rule", F.col("key").cast("string").alias("key"), "detail")
    return single.unionByName(repeated)
