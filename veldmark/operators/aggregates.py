"""Aggregates that have no built-in of the same meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.functions.text import _col
from veldmark.session import cut


def upper_median(value) -> Column:
    """sorted[n div 2] of a group that fits in memory: no mean of two middle values."""
    value = _col(value)
    return F.element_at(F.sort_array(F.collect_list(value)), (F.count(value) / 2).cast("int") + 1)


def upper_median_of(df: DataFrame, value: str) -> DataFrame:
    """One row: the upper median of a column of any length, from a running count over its distinct values.

    Distinct values are counted first. Counts are added up within ranges of the
    sorted values, so no task needs all of them.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranged = counted.repartitionByRange(F.col(value)).select(value, "n", F.spark_partition_id().alias("part"))
    ranged = cut(ranged)
    totals = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one number for each partition
    target, at = sum(totals.values()) // 2, 0
    for part in sorted(totals):
        if at + totals[part] > target:
            break
        at += totals[part]
    else:
        return df.select(value).limit(0).select(F.col(value).alias("median"))
    running = F.sum("n").over(W.partitionBy("part").orderBy(value))
    return ranged.where(F.col("part") == part).withColumn("_upto", running).where(F.col("_upto") > target - at).agg(F.min(value).alias("median"))


def bins(value, low: float, high: float, n: int) -> Column:
    """Bin of a value clamped to [low, high]: int((v - low) / (high - low) x (n - 1))."""
    held = F.greatest(F.lit(low), F.least(F.lit(high), _col(value)))
    return ((held - low) / (high - low) * (n - 1)).cast("int")


def histogram(df: DataFrame, value: str, n: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """(bin, n) of all bins that have values; the range is the data's where it isn't given (0 is a given bound)."""
    if low is None or high is None:
        r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
        low, high = float(r["lo"] if low is None else low), float(r["hi"] if high is None else high)
    return df.where(F.col(value).isNotNull()).groupBy(bins(value, low, high, n).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def frequencies(df: DataFrame, value: str, low: float, high: float, n: int) -> DataFrame:
    """Share of the rows in each of n bins of equal width; the upper end belongs to the last."""
    found = df.where(F.col(value).between(low, high)).groupBy(F.least(F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(n)), F.lit(n)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = found.agg(F.sum("n").alias("total"))
    return found.join(F.broadcast(total), F.lit(True)).select("bin", (F.col("n") / F.col("total")).alias("share"))


def display_range(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Lower and upper bin of 256 with more than a 2500th of the rows; bins with more than a tenth count as empty."""
    counts = histogram(df, value, 256, low, high)
    total = counts.agg(F.sum("n").alias("total"))
    fit = counts.join(F.broadcast(total), F.lit(True)).where((F.col("n") <= F.floor(F.col("total") / 10)) & (F.col("n") > F.floor(F.col("total") / 2500)))
    return fit.agg(F.min("bin").alias("lo_bin"), F.max("bin").alias("hi_bin"))


def bounds(axes: list[str]) -> list[Column]:
    """Least and greatest of each axis, and the extent."""
    return [c for a in axes for c in (F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"), (F.max(a) - F.min(a)).alias(f"extent_{a}"))]


def bounds_from_zero(axes: list[str]) -> list[Column]:
    """Bounds of all rows and 0."""
    return [c for a in axes for c in (F.least(F.lit(0), F.min(a)).alias(f"min_{a}"), F.greatest(F.lit(0), F.max(a)).alias(f"max_{a}"))]


def block_statistics(df: DataFrame, value: str, by: list[str], at: str, radius: int) -> DataFrame:
    """Mean, deviations and variances within radius places of each row."""
    w = W.partitionBy(*by).orderBy(at).rowsBetween(-radius, radius)
    return df.withColumns({"mean": F.avg(value).over(w), "std": F.stddev_pop(value).over(w), "variance": F.var_pop(value).over(w), "sample_variance": F.var_samp(value).over(w)})


def legacy_spread(value) -> Column:
    """Sum of squares less the square of the sum, 0 at least: an un-normalised stand-in for variance that older results use."""
    return F.greatest(F.lit(0.0), F.sum(_col(value) * _col(value)) - F.pow(F.sum(_col(value)), F.lit(2)))


def area_of_triangle(a: list, b: list, c: list) -> Column:
    """Half the length of the cross product of two sides."""
    u, v = [_col(y) - _col(x) for x, y in zip(a, b, strict=True)], [_col(y) - _col(x) for x, y in zip(a, c, strict=True)]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return F.sqrt(sum(x * x for x in cross)) / 2


def absolute_difference(a, b) -> Column:
    return F.sum(F.abs(_col(a) - _col(b)))


def lengths_in_map(m) -> Column:
    """Sum of the sizes of a map's lists."""
    return F.aggregate(F.map_values(_col(m)), F.lit(0), lambda n, v: n + F.size(v))


def named_groups(df: DataFrame, name: Column, member: str) -> DataFrame:
    """The sorted set of members of each name; rows without a name go."""
    return df.withColumn("_name", name).where("_name IS NOT NULL").groupBy(F.col("_name").alias("name")).agg(F.array_sort(F.collect_set(member)).alias("members"))
