"""Structured Streaming forms of the incremental behaviour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def files(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", per_trigger: int = 1) -> DataFrame:
    """A stream of files, so many at a time."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def first_and_last(stream: DataFrame, key: str, at: str) -> DataFrame:
    """First and last time of each key so far, and how often it was seen; state is one row per key."""
    return stream.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("times"))


def upsert_into(stream: DataFrame, path: str, key: str, at: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Each batch leaves its keys with their first and last time in a folder of its own; a batch that runs again replaces it.

    upserted() reads the table. With every, a batch runs that often; else what
    there is runs and the query ends.
    """

    def merge(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.min(at).alias("first"), F.max(at).alias("last")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def upserted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """First and last time of each key over all batches."""
    return spark.read.parquet(path).groupBy(key).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def append_files(stream: DataFrame, path: str, checkpoint: str, kind: str = "csv") -> StreamingQuery:
    """Rows appended as files."""
    return stream.writeStream.format(kind).outputMode("append").option("checkpointLocation", checkpoint).option("header", "true").trigger(availableNow=True).start(path)


def sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Sessions by a gap in event time; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def merged_peaks(steps: list[np.ndarray], radius: float, state: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Peaks of consecutive time points merged in order.

    A peak within radius of a known one moves it to the mean of all it stands for;
    others become known after the step, so peaks of one step never merge with each
    other's new ones.
    """
    known, count = state if state is not None else (np.zeros((0, 3)), np.zeros(0, np.int64))
    known, count = known.copy(), count.copy()
    for peaks in steps:
        frozen, fresh = known.copy(), []
        for p in peaks:
            d = np.linalg.norm(frozen - p, axis=1) if len(frozen) else np.zeros(0)
            if len(d) and d.min() <= radius:
                i = int(d.argmin())
                known[i] = (known[i] * count[i] + p) / (count[i] + 1)
                count[i] += 1
            else:
                fresh.append(p)
        if fresh:
            known, count = np.vstack([known, fresh]), np.append(count, np.ones(len(fresh), np.int64))
    return known, count


def merge_peaks(peaks: DataFrame, series: str, radius: float, at: str = "t") -> DataFrame:
    """merged_peaks for each series of rows (series, t, x, y, z), in order of t, x, y, z: series, x, y, z, n."""
    kind = dict(peaks.dtypes)[series]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([at, "x", "y", "z"])
        known, count = merged_peaks([g[["x", "y", "z"]].to_numpy(float) for _, g in pdf.groupby(at, sort=True)], radius)
        return pd.DataFrame({series: key[0], "x": known[:, 0], "y": known[:, 1], "z": known[:, 2], "n": count})

    return peaks.select(series, at, "x", "y", "z").groupBy(series).applyInPandas(one, f"{series} {kind}, x double, y double, z double, n long")


def frequent(peaks: DataFrame, min_count: int) -> DataFrame:
    """Peaks seen more often than min_count."""
    return peaks.where(F.col("n") > min_count)


def running_peaks(stream: DataFrame, series: str, radius: float, at: str = "t") -> DataFrame:
    """merged_peaks over a stream: the known peaks of a series are its state; each batch gives the series' peaks so far. Batches come in order of time."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        known = np.array(held[0], float).reshape(-1, 3), np.array(held[1], np.int64)
        pdf = pd.concat(list(batches)).sort_values([at, "x", "y", "z"])
        known = merged_peaks([g[["x", "y", "z"]].to_numpy(float) for _, g in pdf.groupby(at, sort=True)], radius, known)
        state.update((known[0].ravel().tolist(), known[1].tolist()))
        yield pd.DataFrame({series: key[0], "x": known[0][:, 0], "y": known[0][:, 1], "z": known[0][:, 2], "n": known[1]})

    kind = dict(stream.dtypes)[series]
    return stream.groupBy(series).applyInPandasWithState(step, f"{series} {kind}, x double, y double, z double, n long", "places array<double>, counts array<long>", "append", "NoTimeout")
