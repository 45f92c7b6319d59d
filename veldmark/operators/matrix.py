"""Labelled matrices as long tables: row_idx, row, col_idx, col, v."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions.text import common_prefix, strip_last_word
from veldmark.operators.windows import numbered

AGGREGATES: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg, "count": F.count}


def aggregate_by_name(name: str) -> Callable[[Column], Column]:
    """An aggregate that a user names; only those of the list."""
    if name not in AGGREGATES:
        raise ValueError(f"no aggregate {name!r}; there are {', '.join(AGGREGATES)}")
    return AGGREGATES[name]


def require_even(matrix: DataFrame) -> DataFrame:
    """Fail at run time if the number of rows or columns is odd."""
    size = matrix.agg((F.max("row_idx") + 1).alias("rows"), (F.max("col_idx") + 1).alias("cols"))
    odd = (F.col("rows") % 2 != 0) | (F.col("cols") % 2 != 0)
    checked = size.select(F.when(odd, F.raise_error(F.lit("rows and columns must come in pairs")).cast("boolean")).otherwise(F.lit(True)).alias("_even"))
    return matrix.join(F.broadcast(checked), F.col("_even")).drop("_even")  # one row


def combine_pairs(matrix: DataFrame, aggregate: str = "max", check: bool = False) -> DataFrame:
    """Consecutive rows and columns by two: one aggregate of each 2 x 2 block; a name is the common start of its pair."""
    source = require_even(matrix) if check else matrix
    first, last = (lambda c, i: F.min_by(c, i)), (lambda c, i: F.max_by(c, i))
    blocks = source.groupBy(F.floor(F.col("row_idx") / 2).alias("row_idx"), F.floor(F.col("col_idx") / 2).alias("col_idx")).agg(
        aggregate_by_name(aggregate)(F.col("v")).alias("v"), first("row", "row_idx").alias("r1"), last("row", "row_idx").alias("r2"), first("col", "col_idx").alias("c1"), last("col", "col_idx").alias("c2")
    )
    return blocks.select("row_idx", common_prefix("r1", "r2").alias("row"), "col_idx", common_prefix("c1", "c2").alias("col"), "v")


def combine_named(matrix: DataFrame, aggregate: str = "sum", key: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """Rows and columns with equal keys become one, in the order of their first appearance."""
    grouped = matrix.groupBy(key(F.col("row")).alias("row"), key(F.col("col")).alias("col")).agg(aggregate_by_name(aggregate)(F.col("v")).alias("v"), F.min("row_idx").alias("r"), F.min("col_idx").alias("c"))
    rows = grouped.groupBy("row").agg(F.min("r").alias("r"))
    cols = grouped.groupBy("col").agg(F.min("c").alias("c"))
    rank = lambda df, name, at: numbered(df, [at], f"{name}_idx").select(name, F.col(f"{name}_idx").cast("int"))
    return grouped.drop("r", "c").join(rank(rows, "row", "r"), "row").join(rank(cols, "col", "c"), "col").select("row_idx", "row", "col_idx", "col", "v")


def normalise(matrix: DataFrame, inputs: DataFrame) -> DataFrame:
    """Each cell over the number of inputs of its column (inputs: col, n_inputs); a column without one fails."""
    joined = matrix.join(inputs.select("col", "n_inputs"), "col", "left")
    share = F.when(F.col("n_inputs").isNull(), F.raise_error(F.concat(F.lit("no inputs of "), "col")).cast("double")).otherwise(F.try_divide(F.col("v").cast("double"), F.col("n_inputs")))
    return joined.select("row_idx", "row", "col_idx", "col", "v", share.alias("share"))


def merge_normalised(matrix: DataFrame, inputs: DataFrame, single: int, joint: int) -> DataFrame:
    """Pairs of homologues: 100 x the mean share of the cells with single or more, if each row of the block has one and the block's total reaches joint; else 0."""
    cells = normalise(matrix, inputs)
    strong = F.col("v") >= single
    blocks = cells.groupBy(F.floor(F.col("row_idx") / 2).alias("row_idx"), F.floor(F.col("col_idx") / 2).alias("col_idx")).agg(
        F.bool_or(strong & (F.col("row_idx") % 2 == 0)).alias("one"), F.bool_or(strong & (F.col("row_idx") % 2 == 1)).alias("two"), F.sum("v").alias("total"),
        F.avg(F.when(strong, F.col("share"))).alias("mean"), F.min_by("row", "row_idx").alias("row"), F.min_by("col", "col_idx").alias("col"),
    )
    value = F.when(F.col("one") & F.col("two") & (F.col("total") >= joint), 100 * F.col("mean")).otherwise(0.0)
    return blocks.select("row_idx", strip_last_word("row").alias("row"), "col_idx", strip_last_word("col").alias("col"), value.alias("v"))


def over_threshold(matrix: DataFrame, threshold: float) -> DataFrame:
    """Cells with the threshold or more as edges."""
    return matrix.where(F.col("v") >= threshold).select("row", "col", "v")


def dense(matrix: DataFrame, names: list[str]) -> DataFrame:
    """Wide form over given column names, 0 where there is no cell."""
    return matrix.groupBy("row").pivot("col", names).agg(F.sum("v")).na.fill(0)


def transposed(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("col_idx").alias("row_idx"), F.col("col").alias("row"), F.col("row_idx").alias("col_idx"), F.col("row").alias("col"), "v")
