"""Stripes taken out of planes: what is fine along rows and nearly constant along columns is damped in the frequency plane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Columns that are transformed together.
COLUMNS = 16


def fine_part(v: np.ndarray, least: int) -> np.ndarray:
    """A row without its waves of fewer than least periods."""
    waves = np.fft.rfft(v)
    waves[:least] = 0
    return np.fft.irfft(waves, len(v))


def slow_part(v: np.ndarray, width: float) -> np.ndarray:
    """Columns with their waves of k periods weighed by a Gaussian of k."""
    waves = np.fft.rfft(v, axis=0)
    weight = np.exp(-0.5 * (np.arange(len(waves)) / width) ** 2)
    return np.fft.irfft(waves * weight[:, None], len(v), axis=0)


def stripes_removed(plane: DataFrame, x: str, y: str, value: str, least: int = 1, width: float = 1.0, by: tuple[str, ...] = (), columns: int = COLUMNS, name: str = "clean") -> DataFrame:
    """Each pixel of a plane without the stripes that run along y: by, x, y (long), name.

    In the frequency plane a wave of kx periods along x, least or more, and ky
    along y loses the share exp(-(ky / width)^2 / 2). A weight that is a product needs no whole
    transform in one place: rows are transformed, then columns of what is left
    of them. For stripes along x give y, x for x, y.

    x and y are whole numbers; rows with a null place play no part. A plane is
    the interval of its pixels and goes on periodically; pixels without a row,
    null or nan ones count as 0, and of repeated ones the largest counts. Each pixel
    with a row comes out once. A row, and columns columns, fit in a task.
    """
    keys = list(by)
    number = F.col(value).cast("double")
    given = plane.select(*keys, F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), F.coalesce(F.when(F.isnan(number), None).otherwise(number), F.lit(float("-inf"))).alias("_v")).where("_x IS NOT NULL AND _y IS NOT NULL")
    extent = given.groupBy(*keys).agg(F.min("_x").alias("_fx"), F.max("_x").alias("_lx"), F.min("_y").alias("_fy"), F.max("_y").alias("_ly"))
    rows = given.groupBy(*keys, "_y").agg(F.collect_list(F.struct(F.col("_x").alias("x"), F.col("_v").alias("v"))).alias("_cells"))
    ends = ["_fx", "_lx", "_fy", "_ly"]
    if keys:
        same = F.lit(True)
        for k in keys:
            same = same & rows[k].eqNullSafe(extent[k])
        placed = rows.join(extent, same).select(*[rows[k] for k in keys], "_y", "_cells", *ends)
    else:
        one = extent.first()
        placed = rows.withColumns({c: F.lit(one[c] if one else None).cast("long") for c in ends})

    kind = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL("_part long, _fx long, _fy long, _ly long, _y long, _known array<boolean>, _data array<double>, _fine array<double>")])
    target = to_arrow_schema(kind)

    def along_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                at = lambda c, own=own: own.column(c)[0].as_py()
                cells = own.column("_cells")[0].values
                place = cells.field("x").to_numpy(zero_copy_only=False) - at("_fx")
                row, known = np.full(at("_lx") - at("_fx") + 1, -np.inf), np.zeros(at("_lx") - at("_fx") + 1, bool)
                np.maximum.at(row, place, cells.field("v").to_numpy(zero_copy_only=False))
                known[place] = True
                row[np.isneginf(row)] = 0.0
                fine = fine_part(row, least)
                starts = range(0, len(row), columns)
                cut = lambda a, kind, starts=starts: pa.array([a[s : s + columns] for s in starts], pa.list_(kind))
                n = len(starts)
                same = [pa.array([at(c)] * n, pa.int64()) for c in ("_fx", "_fy", "_ly", "_y")]
                yield pa.RecordBatch.from_arrays([*(own.column(k).take(pa.array(np.zeros(n, np.int64))) for k in keys), pa.array(range(n), pa.int64()), *same, cut(known, pa.bool_()), cut(row, pa.float64()), cut(fine, pa.float64())], schema=target)

    parts = placed.mapInArrow(along_rows, kind)
    bands = parts.groupBy(*keys, "_part").agg(F.first("_fx").alias("_fx"), F.first("_fy").alias("_fy"), F.first("_ly").alias("_ly"), F.collect_list(F.struct("_y", "_known", "_data", "_fine")).alias("_rows"))
    done = StructType([*(rows.schema[k] for k in keys), *StructType.fromDDL(f"`{x}` long, `{y}` long, `{name}` double")])
    made = to_arrow_schema(done)

    def down_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                at = lambda c, own=own: own.column(c)[0].as_py()
                cells = own.column("_rows")[0].values
                place = cells.field("_y").to_numpy(zero_copy_only=False) - at("_fy")
                dense = lambda c, cells=cells, n=len(place): cells.field(c).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                data, known = dense("_data"), dense("_known")
                fine = np.zeros((at("_ly") - at("_fy") + 1, data.shape[1]))
                fine[place] = dense("_fine")
                clean = data - slow_part(fine, width)[place]
                r, c = np.nonzero(known)
                xs, ys = c + at("_part") * columns + at("_fx"), place[r] + at("_fy")
                yield pa.RecordBatch.from_arrays([*(own.column(k).take(pa.array(np.zeros(len(r), np.int64))) for k in keys), pa.array(xs, pa.int64()), pa.array(ys, pa.int64()), pa.array(clean[r, c], pa.float64())], schema=made)

    return bands.mapInArrow(down_columns, done)
