"""Ordered computations as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.functions import affine


def _over(by: list[str], order: list[str]):
    return W.partitionBy(*by).orderBy(*order)


def baseline(df: DataFrame, value: str, by: list[str], order: list[str], window: int, name: str = "baseline") -> DataFrame:
    """Least value from half a window before to just before half a window after."""
    if window < 2:
        raise ValueError("a window has two points at least")
    half = window // 2
    return df.withColumn(name, F.min(value).over(_over(by, order).rowsBetween(-half, half - 1)))


def delta_f_over_f(df: DataFrame, value: str, by: list[str], order: list[str], window: int, noise: Column | float = 0.0, sigma: Column | float = 0.0, noise_in_value: bool = False, name: str = "dff") -> DataFrame:
    """(F - B) / (B - noise + sigma / 0.04); where both F and B hold the noise image, it cancels and isn't taken off."""
    based = baseline(df, value, by, order, window)
    b = F.col("baseline")
    below = b + sigma / 0.04 if noise_in_value else b - noise + sigma / 0.04
    return based.withColumn(name, F.try_divide(F.col(value) - b, below))


def moving_sum(df: DataFrame, value: str, by: list[str], order: list[str], frames: int, name: str = "total") -> DataFrame:
    """Sum of the last frames rows; rows before there are so many go."""
    w = _over(by, order)
    full = df.withColumn("_n", F.row_number().over(w)).withColumn(name, F.sum(value).over(w.rowsBetween(1 - frames, 0)))
    return full.where(F.col("_n") >= frames).drop("_n")


def cumulative(df: DataFrame, value: str, by: list[str], order: list[str], sign: int = -1, name: str = "cumulative") -> DataFrame:
    return df.withColumn(name, sign * F.sum(value).over(_over(by, order).rowsBetween(W.unboundedPreceding, 0)))


def cumulative_affine(df: DataFrame, matrix: str, by: list[str], order: str, d: int) -> DataFrame:
    """by, order, matrix: the identity in the first row of a group, then each row's inverse after what was before.

    Maps don't commute but they associate, so each round puts the product of the
    rows 1, 2, 4, ... places before in front; rounds are the logarithm of the longest group.
    """
    first = F.row_number().over(_over(by, [order])) == 1
    return running_product(df.select(*by, order, F.when(first, affine.identity(d)).otherwise(affine.invert(matrix, d)).alias(matrix)), matrix, by, order, d)


def running_product(df: DataFrame, matrix: str, by: list[str], order: str, d: int) -> DataFrame:
    """by, order, matrix: each row's map after those of the rows before it in its group, the first row's applied last."""
    w = _over(by, [order])
    state = df.select(*by, order, matrix)
    longest = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    shift = 1
    while shift < longest:
        placed = state.withColumn("_before", F.lag(matrix, shift).over(w))
        state = placed.select(*by, order, F.when(F.col("_before").isNull(), F.col(matrix)).otherwise(affine.concatenate("_before", matrix, d)).alias(matrix))
        shift *= 2
    return state


def sessions(df: DataFrame, at: str, by: list[str], order: list[str], gap, name: str = "session") -> DataFrame:
    """A running number that grows where two neighbours are further apart than gap."""
    w = _over(by, order)
    apart = F.abs(F.col(at) - F.lag(at).over(w)) > gap
    return df.withColumn("_new", F.coalesce(apart, F.lit(False)).cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def joined_sessions(df: DataFrame, text: str, at: str, by: list[str], gap) -> DataFrame:
    """Characters joined to tokens: a new one starts after a gap."""
    numbered = sessions(df, at, by, [at], gap)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(text).alias("text"))))
    return numbered.groupBy(*by, "session").agg(F.array_join(F.transform(ordered, lambda c: c["text"]), "").alias(text), F.min(at).alias(at))


def gaps(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Integers missing between the least and the greatest of each group, as ranges."""
    w = W.partitionBy(*by).orderBy(value)
    pairs = df.select(*by, value).distinct().withColumn("_last", F.lag(value).over(w)).where(F.col(value) - F.col("_last") > 1)
    return pairs.select(*by, (F.col("_last") + 1).alias("gap_from"), (F.col(value) - 1).alias("gap_to"))


def missing(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The same, one row per missing integer."""
    return gaps(df, value, by).select(*by, F.explode(F.sequence("gap_from", "gap_to")).alias(value))


def every_nth(df: DataFrame, by: list[str], order: list[str], n: int, k: int = 0) -> DataFrame:
    """Rows whose place, from 0, is k modulo n."""
    return df.withColumn("_at", F.row_number().over(_over(by, order)) - 1).where(F.pmod("_at", F.lit(n)) == k).drop("_at")


def chunks(df: DataFrame, by: list[str], order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Chunks of size rows, the last one shorter."""
    return df.withColumn(name, F.floor((F.row_number().over(_over(by, order)) - 1) / size))


def row_index(df: DataFrame, by: list[str], order: list[str], name: str = "row") -> DataFrame:
    """Row numbers from 1."""
    return df.withColumn(name, F.row_number().over(_over(by, order)))


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """Rows with their place in an order, from 0, without all of them in one task: ranges are sorted by themselves, and each begins after the rows of those before. One number for each range goes through the driver."""
    from veldmark.session import cut

    ranged = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts += [F.lit(part), F.lit(total).cast("long")]
        total += n
    local = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    start = F.element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(0).cast("long")
    return ranged.withColumn(name, start + local).drop("_part")


def centred_slices(df: DataFrame, by: list[str], order: list[str], width: int, turn: int = 0, mirror: bool = False) -> DataFrame:
    """For each place the places of a window centred on it, wrapped round the ends, turned by turn and optionally mirrored."""
    w = W.partitionBy(*by)
    numbered = df.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    shifts = F.sequence(F.lit(-(width // 2)), F.lit(width - width // 2 - 1))
    places = F.transform(shifts, lambda s: F.pmod(F.col("_at") + s + turn, F.col("_n")))
    return numbered.withColumn("window", F.reverse(places) if mirror else places).drop("_at", "_n")


def prefix_sum_2d(df: DataFrame, x: str, y: str, value: str, by: list[str], name: str = "integral") -> DataFrame:
    """Sum of all values left of and above each cell, itself included."""
    along = F.sum(value).over(W.partitionBy(*by, y).orderBy(x).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_row", along).withColumn(name, F.sum("_row").over(W.partitionBy(*by, x).orderBy(y).rowsBetween(W.unboundedPreceding, 0))).drop("_row")


def convolve(df: DataFrame, value: str, by: list[str], at: str, kernel: list[float], name: str = "filtered") -> DataFrame:
    """Weighted sum of the neighbours of each place; the first and last value stand for what is beyond."""
    w = W.partitionBy(*by).orderBy(at)
    whole = W.partitionBy(*by).orderBy(at).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last, half = F.first(value).over(whole), F.last(value).over(whole), len(kernel) // 2
    total = F.lit(0.0)
    for i, weight in enumerate(kernel):
        shift = i - half
        neighbour = F.coalesce(F.lag(value, -shift).over(w), first) if shift < 0 else F.coalesce(F.lead(value, shift).over(w), last) if shift else F.col(value)
        total = total + weight * neighbour
    return df.withColumn(name, total)


def consecutive(df: DataFrame, key: str, by: list[str], order: list[str]) -> DataFrame:
    """Each row's key with the next one's."""
    return df.withColumn("next", F.lead(key).over(_over(by, order))).where(F.col("next").isNotNull())


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k).drop("_rank")
