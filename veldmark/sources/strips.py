"""Tagged image and section files by strip: directories are read first, then tasks seek to the strips or bands of rows they are dealt."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from itertools import batched
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veldmark.sources.binary import AT_CHANNELS, AT_HEIGHT, AT_WIDTH, HEADER, MAGIC, UNPACK, walk

#: Bytes of a band of a raw strip or a section, and about how many a task reads.
BAND_BYTES, TASK_BYTES = 1 << 20, 32 << 20
#: Rows, and about how many values, that leave a task together.
ROWS, HELD = 4096, 1 << 17

PLAN = "path string, slice int, width int, samples int, y long, rows long, skip long, place long, count long, compression int, kind string"


def opened(path: str) -> pyarrow.fs.FileInfo:
    system, name = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def exactly(f, path: str) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        data = f.read_at(n, at)
        if len(data) < n:
            raise ValueError(f"{path} ends before byte {at + n}")
        return data

    return read


def _bands(path: str, index: int, width: int, samples: int, first: int, rows: int, at: int, kind: str) -> Iterator[tuple]:
    """Uncompressed rows in bands: each can be read by itself."""
    line = width * samples * np.dtype(kind).itemsize
    step = max(1, BAND_BYTES // max(1, line))
    for y in range(0, rows, step):
        n = min(step, rows - y)
        yield path, index, width, samples, first + y, n, 0, at + y * line, n * line, 1, kind


def _strips(path: str, slices: tuple[int, int], ys: tuple[int, int]) -> Iterator[tuple]:
    with opened(path) as f:
        for index, d in enumerate(walk(exactly(f, path))):
            if index > slices[1]:
                return
            if index < slices[0]:
                continue
            if d["compression"] not in UNPACK:
                raise ValueError(f"compression {d['compression']} isn't read")
            kind = (">" if d["big_endian"] else "<") + {8: "u1", 16: "u2", 32: "f4"}[d["bits"]]
            for k, (at, count) in enumerate(zip(d["offsets"], d["counts"], strict=True)):
                first = k * d["rows_per_strip"]
                rows = min(d["rows_per_strip"], d["height"] - first)
                low, high = max(first, ys[0]), min(first + rows - 1, ys[1])
                if low > high:
                    continue
                if d["compression"] == 1:
                    line = d["width"] * d["samples"] * np.dtype(kind).itemsize
                    yield from _bands(path, index, d["width"], d["samples"], low, high - low + 1, at + (low - first) * line, kind)
                else:
                    yield path, index, d["width"], d["samples"], low, high - low + 1, low - first, at, count, d["compression"], kind


def _sections(path: str, slices: tuple[int, int], ys: tuple[int, int]) -> Iterator[tuple]:
    with opened(path) as f:
        head = exactly(f, path)(0, HEADER)
    if struct.unpack_from(">I", head)[0] != MAGIC:
        raise ValueError("not a section file")
    width, height = struct.unpack_from(">i", head, AT_WIDTH)[0], struct.unpack_from(">i", head, AT_HEIGHT)[0]
    low, high = max(0, ys[0]), min(height - 1, ys[1])
    yield from _bands(path, 0, width, head[AT_CHANNELS], low, max(0, high - low + 1), HEADER + low * width * head[AT_CHANNELS] * 2, ">i2")


def _planned(spark: SparkSession, path: str, each, slices: tuple[int, int] | None, ys: tuple[int, int] | None) -> DataFrame:
    """The strips that are wanted of all files of a path, dealt to as many tasks as their bytes need. Contents aren't read for it."""
    listing = spark.read.format("binaryFile").load(path).select("path", "length")
    files, size = listing.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    target = to_arrow_schema(StructType.fromDDL(PLAN))
    some, rows = slices or (0, 1 << 31), ys or (0, 1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for part in batched(each(name, some, rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), target, strict=True)], schema=target)

    planned = listing.select("path").repartition(max(1, min(int(files), spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, PLAN)
    return planned.repartition(max(1, ceil(size / TASK_BYTES)), "path", "slice", "y")


LINES = "path string, slice int, y long, samples int, data array<double>"


def _lines(planned: DataFrame) -> DataFrame:
    target = to_arrow_schema(StructType.fromDDL(LINES))

    def made(held: list[tuple]) -> pa.RecordBatch:
        paths, slices, ys, samples, data = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(slices, pa.int32()), pa.array(ys, pa.int64()), pa.array(samples, pa.int32()), pa.array(data, pa.list_(pa.float64()))], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, held, size = None, None, [], 0
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if r["path"] != name:
                        if f is not None:
                            f.close()
                        name, f = r["path"], opened(r["path"])
                    line = r["width"] * r["samples"]
                    raw = UNPACK[r["compression"]](exactly(f, name)(r["place"], r["count"]))
                    values = np.frombuffer(raw, r["kind"], r["rows"] * line, r["skip"] * line * np.dtype(r["kind"]).itemsize).reshape(-1, line)
                    for y in range(r["rows"]):
                        held.append((name, r["slice"], r["y"] + y, r["samples"], values[y].astype(float)))
                        size += line
                        if size >= HELD or len(held) >= ROWS:
                            yield made(held)
                            held, size = [], 0
            if held:
                yield made(held)
        finally:
            if f is not None:
                f.close()

    return planned.mapInArrow(run, LINES)


def read_rows(spark: SparkSession, path: str, slices: tuple[int, int] | None = None, ys: tuple[int, int] | None = None) -> DataFrame:
    """Rows of pixels of tagged image files, of the given slices and rows (both ends included): path, slice, y, samples, data (samples of a pixel side by side).

    A task reads the directories of its files, without pixels. The strips that
    hold wanted rows are dealt out, and tasks seek to theirs: uncompressed ones in
    bands of a megabyte, compressed ones as wholes, which must fit. Unknown
    compressions are an error. Paths must be ones that pyarrow's file systems open.
    """
    return _lines(_planned(spark, path, _strips, slices, ys))


def read_section_rows(spark: SparkSession, path: str, channel: int = -1, ys: tuple[int, int] | None = None) -> DataFrame:
    """Rows of section files: path, channel, y, data. A channel's values are moved up by its least one if that is negative, so its file is read once for the least values of whole planes and once for the wanted rows."""

    def channels(lines: DataFrame) -> DataFrame:
        split = F.transform(F.sequence(F.lit(0), F.col("samples") - 1), lambda c: F.struct(c.alias("channel"), F.filter("data", lambda _, i: i % F.col("samples") == c).alias("data")))
        own = lines.select("path", "y", F.inline(split))
        return own if channel < 0 else own.where(F.col("channel") == channel)

    lowest = channels(_lines(_planned(spark, path, _sections, None, None))).groupBy("path", "channel").agg(F.min(F.array_min("data")).alias("least"))
    rows = channels(_lines(_planned(spark, path, _sections, None, ys)))
    moved = F.transform("data", lambda v: (v - F.least(F.lit(0.0), F.col("least"))).cast("int"))
    return rows.join(lowest, ["path", "channel"]).select("path", "channel", "y", moved.alias("data"))
