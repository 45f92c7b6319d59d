"""Running sets of peaks held by cells of space: no task holds a series, and a batch is one exchange between cells."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from veldmark.session import cut, shared_folder

AXES = ("x", "y", "z")
#: What tells known peaks apart and puts them in order: when and where each was first seen, and its number among equal ones.
BORN = ("born", "born_x", "born_y", "born_z", "twin")


def folded(known: pd.DataFrame, peaks: pd.DataFrame, radius: float) -> pd.DataFrame:
    """The known peaks (x, y, z, n and BORN) after those of further time points (t, x, y, z).

    Time points are taken in order. A peak within radius of what was known before
    its time point moves the nearest, of equally near ones the first seen, to the
    mean of all that it stands for; the others become known after their time point.
    """
    known = known.sort_values(list(BORN))
    place, count, born = known[list(AXES)].to_numpy(float), known["n"].to_numpy(np.int64).copy(), known[list(BORN)].to_numpy(float)
    place = place.copy()
    for t, now in peaks.sort_values(["t", *AXES]).groupby("t", sort=True):
        p, frozen, fresh = now[list(AXES)].to_numpy(float), place.copy(), []
        # of known peaks at one place only the first seen can be met; places come out in order of x
        order = np.unique(frozen, axis=0, return_index=True)[1]
        first = np.searchsorted(frozen[order, 0], p[:, 0] - radius * 1.000001, "left")
        last = np.searchsorted(frozen[order, 0], p[:, 0] + radius * 1.000001, "right")
        k = -1
        for i, q in enumerate(p):
            if i == 0 or (q != p[i - 1]).any():
                near = order[first[i] : last[i]]
                d = np.linalg.norm(frozen[near] - q, axis=1)
                k = int(near[d == d.min()].min()) if len(d) and d.min() <= radius else -1
            if k >= 0:
                place[k] = (place[k] * count[k] + q) / (count[k] + 1)
                count[k] += 1
            else:
                fresh.append(i)
        new = p[fresh]
        twin = np.zeros(len(new))
        for i in range(1, len(new)):
            twin[i] = twin[i - 1] + 1 if (new[i] == new[i - 1]).all() else 0
        place, count = np.vstack([place, new]), np.append(count, np.ones(len(new), np.int64))
        born = np.vstack([born, np.column_stack([np.full(len(new), float(t)), new, twin])])
    out = pd.DataFrame(place, columns=list(AXES))
    out["n"] = count
    for k, name in enumerate(BORN):
        out[name] = born[:, k].astype(np.int64) if name in ("born", "twin") else born[:, k]
    return out


def _kind(series: StructField) -> StructType:
    return StructType([series, *(StructField(a, DoubleType()) for a in AXES), StructField("n", LongType()), *(StructField(b, LongType() if b in ("born", "twin") else DoubleType()) for b in BORN)])


def _reached(axis: str, side: float, halo: float) -> Column:
    return F.explode(F.sequence(F.floor((F.col(axis) - halo) / side), F.floor((F.col(axis) + halo) / side)))


def peaks_by_cell(peaks: DataFrame, series: str, radius: float, at: str = "t", steps: int = 4, side: float | None = None, known: DataFrame | None = None) -> DataFrame:
    """The set of peaks after all time points, as one ordered loop over each series leaves it: series, x, y, z, n and BORN; known is such a set from before.

    A known peak moves by less than radius at a time point, and what becomes of it
    hangs on what lies within twice that. So a cell that holds all within three
    times radius for each of some time points ends with its own part right, whatever its rim
    has come to: cells exchange their rims once in so many steps of whole-numbered
    time, and of what they end with keep what lies inside. A cell is side wide (or four
    times its rim); its peaks of these steps fit in a task.
    Rows where a place or the time is null or not finite play no part, repeated rows count each, series may be null.
    """
    spark = peaks.sparkSession
    halo = 3.0001 * radius * steps
    side = float(side or 4 * halo or 1.0)
    kind = _kind(StructField(series, peaks.schema[series].dataType))
    finite = [F.abs(F.col(a)) < F.lit(float("inf")) for a in AXES]
    rows = peaks.select(series, F.col(at).cast("long").alias("t"), *[F.col(a).cast("double").alias(a) for a in AXES]).where("t IS NOT NULL")
    for test in finite:
        rows = rows.where(test)
    path = f"{shared_folder(spark)}/veldmark-cut-{uuid.uuid4().hex}"
    rows = rows.withColumn("_chunk", F.floor(F.col("t") / steps))
    rows.repartitionByRange("_chunk", *AXES).write.partitionBy("_chunk").parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    known = spark.createDataFrame([], kind) if known is None else known.select(*kind.names)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = pdf["t"].isna()
        done = folded(pdf[seen], pdf[~seen], radius)
        own = np.floor(done[list(AXES)].to_numpy() / side) == pdf[["_c0", "_c1", "_c2"]].iloc[0].to_numpy(float)
        done = done[own.all(axis=1)]
        done.insert(0, series, pd.Series([pdf[series].iloc[0]] * len(done), index=done.index, dtype=object))
        return done

    # one number for each exchange
    for (chunk,) in sorted(rows.select("_chunk").distinct().collect()):
        both = known.unionByName(rows.where(F.col("_chunk") == chunk).drop("_chunk"), allowMissingColumns=True)
        for k, a in enumerate(AXES):
            both = both.withColumn(f"_c{k}", _reached(a, side, halo))
        known = cut(both.groupBy(series, "_c0", "_c1", "_c2").applyInPandas(one, kind))
    return known


def keep_peaks(stream: DataFrame, path: str, checkpoint: str, series: str, radius: float, at: str = "t", steps: int = 4, side: float | None = None) -> StreamingQuery:
    """peaks_by_cell over a stream, whose batches come in order of time and hold whole time points; kept_peaks reads the set.

    The set lies in two slots below path: a batch reads the one its predecessor
    left and overwrites the other, so a batch that runs again after a failure
    starts from the same set.
    """
    kind = _kind(StructField(series, stream.schema[series].dataType))

    def merge(batch: DataFrame, number: int) -> None:
        before = batch.sparkSession.read.schema(kind).parquet(f"{path}/slot-{(number + 1) % 2}") if number else None
        done = peaks_by_cell(batch, series, radius, at, steps, side, before)
        done.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/slot-{number % 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept_peaks(spark: SparkSession, path: str) -> DataFrame:
    """The set that the last batch left; read it between batches."""
    slots = spark.read.parquet(f"{path}/slot-*")
    return slots.join(F.broadcast(slots.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
