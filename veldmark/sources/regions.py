"""A data source for regions of large raw images: tasks seek to their rows and read no more than the region."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from veldmark.sources.binary import KINDS


class Band(InputPartition):
    """Rows first..last of one file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class RegionReader(DataSourceReader):
    """Options: path (comma-separated for several), width, height, kind, header, bigendian, x0, x1, y0, y1 (both included), rows (of a task)."""

    def __init__(self, options: dict):
        number = lambda name, default: int(options.get(name, default))
        self.paths = [p for p in options["path"].split(",") if p]
        self.width, self.height, self.header = number("width", 0), number("height", 0), number("header", 0)
        self.kind = np.dtype((">" if options.get("bigendian", "true").lower() == "true" else "<") + KINDS[options.get("kind", "ushort")])
        self.x0, self.x1 = number("x0", 0), number("x1", self.width - 1)
        self.y0, self.y1 = number("y0", 0), number("y1", self.height - 1)
        self.rows = number("rows", 256)
        if not 0 < self.width or not 0 <= self.x0 <= self.x1 < self.width or self.y0 < 0 or self.y1 >= self.height:
            raise ValueError("the region isn't within the image")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on y narrow the rows; all others stay with Spark."""
        for f in filters:
            if getattr(f, "attribute", None) != ("y",):
                yield f
            elif isinstance(f, EqualTo):
                self.y0, self.y1 = max(self.y0, f.value), min(self.y1, f.value)
            elif isinstance(f, GreaterThan):
                self.y0 = max(self.y0, f.value + 1)
            elif isinstance(f, GreaterThanOrEqual):
                self.y0 = max(self.y0, f.value)
            elif isinstance(f, LessThan):
                self.y1 = min(self.y1, f.value - 1)
            elif isinstance(f, LessThanOrEqual):
                self.y1 = min(self.y1, f.value)
            else:
                yield f

    def partitions(self) -> list[Band]:
        return [Band(p, y, min(y + self.rows - 1, self.y1)) for p in self.paths for y in range(self.y0, self.y1 + 1, self.rows)]

    def read(self, band: Band | None) -> Iterator[pa.RecordBatch]:
        if band is None or band.first > band.last:
            return
        system, path = pyarrow.fs.FileSystem.from_uri(band.path) if "://" in band.path else (pyarrow.fs.LocalFileSystem(), band.path)
        n = self.x1 - self.x0 + 1
        with system.open_input_file(path) as f:
            for y in range(band.first, band.last + 1):
                raw = f.read_at(n * self.kind.itemsize, self.header + (y * self.width + self.x0) * self.kind.itemsize)
                if len(raw) < n * self.kind.itemsize:
                    raise ValueError(f"{band.path} ends before row {y}")
                values = np.frombuffer(raw, self.kind).astype(float)
                yield pa.RecordBatch.from_arrays([pa.array([band.path]), pa.array([y], pa.int32()), pa.array([self.x0], pa.int32()), pa.array([values], pa.list_(pa.float64()))], names=["path", "y", "x", "data"])


class RegionSource(DataSource):
    """Format raw_region: path, y, x (of the first pixel) and data (the row's pixels within the region)."""

    @classmethod
    def name(cls) -> str:
        return "raw_region"

    def schema(self) -> str:
        return "path string, y int, x int, data array<double>"

    def reader(self, schema) -> RegionReader:
        return RegionReader(self.options)


def read_region(spark: SparkSession, paths: str | list[str], width: int, height: int, **options) -> DataFrame:
    """Rows of a region of raw images; filters on y read fewer rows. Turns filter pushdown to Python sources on, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegionSource)
    reader = spark.read.format("raw_region").option("path", paths if isinstance(paths, str) else ",".join(paths)).option("width", width).option("height", height)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()


def read_cells(spark: SparkSession, paths: str | list[str], width: int, height: int, size: int, **options) -> DataFrame:
    """Large raw images cut to cells as they are read: path, cx, cy, y, and the row's pixels within the cell. A task has the rows of one band of cells."""
    rows = read_region(spark, paths, width, height, **{"rows": size} | options)
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size("data") - 1) / size).cast("int")), lambda i: F.struct(i.alias("cx"), F.slice("data", (i * size).cast("int") + 1, F.lit(size)).alias("data")))
    return rows.select("path", F.floor(F.col("y") / size).alias("cy"), "y", F.inline(parts)).select("path", "cx", "cy", "y", "data")
