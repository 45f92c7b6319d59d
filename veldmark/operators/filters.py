"""Predicates and projections that several flows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def at_least(df: DataFrame, value: str, threshold) -> DataFrame:
    return df.where(F.col(value) >= threshold)


def more_than(df: DataFrame, value: str, count) -> DataFrame:
    """Strictly more."""
    return df.where(F.col(value) > count)


def wide_and_few(features: DataFrame, min_angle: float, max_per_peak: int, id_col: str = "pid") -> DataFrame:
    """Features with the least angle or more, the first few of each peak."""
    w = W.partitionBy(id_col).orderBy("feature")
    return features.where(F.col("angle") >= min_angle).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= max_per_peak).drop("_n")


def within(df: DataFrame, intervals: dict[str, tuple]) -> DataFrame:
    """Rows inside all intervals, both bounds included."""
    for c, (lo, hi) in intervals.items():
        df = df.where(F.col(c).between(lo, hi))
    return df


def at_times(df: DataFrame, time: str, wanted: list) -> DataFrame:
    return df.where(F.col(time).isin(wanted))


def intersects(x: str, y: str, width: str, height: str, box: tuple[float, float, float, float]) -> Column:
    """A rectangle meets a box (x, y, width, height) in more than an edge."""
    bx, by, bw, bh = box
    return (F.col(x) < bx + bw) & (F.col(x) + F.col(width) > bx) & (F.col(y) < by + bh) & (F.col(y) + F.col(height) > by)


def set_but(df: DataFrame, present: str, absent: str) -> DataFrame:
    """Rows with one column set and another not."""
    return df.where(F.col(present).isNotNull() & F.col(absent).isNull())


def large_files(found: DataFrame, suffix: str, size: int = 1 << 26) -> DataFrame:
    """Files of a listing with a suffix and more than size bytes."""
    return found.where(F.endswith("path", F.lit(suffix)) & (F.col("length") > size))


def threshold_colour(red: Column, green: Column, least: int) -> Column:
    """Green where red reaches the least, else 0."""
    return F.when(red >= least, green).otherwise(0)


def scaled_bounds(columns: list[str], scale: float) -> list[Column]:
    """Columns times a scale, cut to integers."""
    return [(F.col(c) * scale).cast("int").alias(c) for c in columns]


def picked(df: DataFrame, ordinals: list[int]) -> DataFrame:
    """Columns by their places."""
    return df.select(*[F.col(f"`{df.columns[i]}`") for i in ordinals])
