"""Unions, differences, lookups and upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(tables: list[DataFrame], key: str, value: str, line: str | None = None) -> DataFrame:
    """Union of tables by key: the last table's value wins, and within a table the first line's."""
    tagged = [t.select(F.col(key), F.col(value), F.lit(i).alias("_file"), (F.col(line) if line else F.lit(0)).alias("_line")) for i, t in enumerate(tables)]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy(key).agg(F.max_by(value, F.struct(F.col("_file"), -F.col("_line"))).alias(value))


def merged_maps(*maps: Column) -> Column:
    """Maps as one; of equal keys the last map's value wins."""
    keep = lambda m, later: F.map_filter(m, lambda k, _: ~F.map_contains_key(later, k))
    return reduce(lambda a, b: F.map_concat(keep(a, b), b), maps)


def stacked(tables: list[DataFrame], name: str = "layer") -> DataFrame:
    """Tables one above the other, with a number for each."""
    return reduce(DataFrame.unionByName, [t.withColumn(name, F.lit(i)) for i, t in enumerate(tables)])


def all_of(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def distinct_union(tables: list[DataFrame]) -> DataFrame:
    return all_of(tables).distinct()


def missing_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in other."""
    return df.join(other.select(key), key, "left_anti")


def present_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def with_default(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """Left join; a default stands for each column of other that isn't found."""
    joined = df.join(other.select(key, *defaults), key, "left")
    return joined.select(*df.columns, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()])


def replaced(df: DataFrame, replacements: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose value gives way to that of replacements (key, value), where there is one."""
    other = replacements.select(key, F.col(value).alias("_new"))
    return df.join(other, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def upsert(old: DataFrame, seen: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Rows by key with the first and last time they were seen: old rows keep their first, new ones come in."""
    return old.select(key, first, last).unionByName(seen.select(key, first, last)).groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last))


def deduplicated(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first")).select(key, *[F.col(f"_first.`{c}`").alias(c) for c in rest]).select(*df.columns)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def zipped(a: DataFrame, b: DataFrame, at: str) -> DataFrame:
    """Rows that stand at the same place."""
    return a.join(b, at)


def in_given_order(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Rows by the place of their key in a list, as column place; others are dropped."""
    places = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.lit(i) for i in range(len(names))]))
    return df.withColumn("place", F.element_at(places, F.col(key))).where("place IS NOT NULL")


def page(df: DataFrame, order: list, start: int, length: int) -> DataFrame:
    return df.orderBy(*order).offset(start).limit(length)


def natural_order(column: str) -> list[Column]:
    """An order of a column that suits its type: numbers, also those written as text, by size and before other text; text by its characters; nulls last."""
    own = F.col(column)
    number = own.cast("string").try_cast("double")
    return [number.asc_nulls_last(), own.cast("string").asc_nulls_last()]
