"""The N5 layout of chunked arrays: a data source that reads the blocks it needs, and a writer whose data set appears as a whole or not at all."""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import posixpath
import struct
import uuid
from collections.abc import Iterator
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# Fixed values of the format
TYPES = {"uint8": "u1", "uint16": "u2", "uint32": "u4", "uint64": "u8", "int8": "i1", "int16": "i2", "int32": "i4", "int64": "i8", "float32": "f4", "float64": "f8"}
ATTRIBUTES = "attributes.json"


def _system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


def packed(raw: bytes, compression: dict) -> bytes:
    kind = compression.get("type", "raw")
    if kind == "gzip":
        level = int(compression.get("level", -1))
        return gzip.compress(raw, 6 if level < 0 else level, mtime=0)
    if kind in ("raw", "bzip2", "xz"):
        return {"raw": lambda: raw, "bzip2": lambda: bz2.compress(raw, int(compression.get("blockSize", 9))), "xz": lambda: lzma.compress(raw, preset=int(compression.get("preset", 6)))}[kind]()
    raise ValueError(f"blocks can't be compressed with {kind}")


def unpacked(data: bytes, compression: dict) -> bytes:
    kind = compression.get("type", "raw")
    if kind not in ("raw", "gzip", "bzip2", "xz"):
        raise ValueError(f"blocks compressed with {kind} can't be read")
    return data if kind == "raw" else {"gzip": gzip, "bzip2": bz2, "xz": lzma}[kind].decompress(data)


def block_bytes(values: np.ndarray, size: list[int], kind: str, compression: dict) -> bytes:
    """A block file: mode 0, the block's size, and its values, the first axis fastest."""
    head = struct.pack(f">HH{len(size)}I", 0, len(size), *size)
    return head + packed(np.asarray(values).astype(">" + TYPES[kind]).tobytes(), compression)


def block_values(data: bytes, kind: str, compression: dict) -> tuple[list[int], np.ndarray]:
    mode, axes = struct.unpack_from(">HH", data)
    if mode not in (0, 1):
        raise ValueError(f"blocks of mode {mode} can't be read")
    size = list(struct.unpack_from(f">{axes}I", data, 4))
    values = np.frombuffer(unpacked(data[4 + 4 * axes + (4 if mode else 0) :], compression), ">" + TYPES[kind])
    if len(values) < prod(size):
        raise ValueError("a block ends before its last value")
    return size, values[: prod(size)]


class Run(InputPartition):
    """Some of the wanted blocks, by their number among them."""

    def __init__(self, low: list[int], high: list[int], first: int, last: int):
        self.low, self.high, self.first, self.last = low, high, first, last

    def blocks(self) -> Iterator[tuple[int, ...]]:
        spans = [b - a + 1 for a, b in zip(self.low, self.high, strict=True)]
        for i in range(self.first, self.last + 1):
            place = []
            for a, n in zip(self.low, spans, strict=True):
                place.append(a + i % n)
                i //= n
            yield tuple(place)


class BlockReader(DataSourceReader):
    def __init__(self, path: str, attributes: dict, schema: StructType, blocks: int):
        self.path, self.attributes, self.kind, self.each = path.rstrip("/"), attributes, to_arrow_schema(schema), blocks
        self.low = [0] * len(attributes["dimensions"])
        self.high = [-(-n // b) - 1 for n, b in zip(attributes["dimensions"], attributes["blockSize"], strict=True)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds on g0, g1, ... narrow the blocks; all others stay with Spark."""
        for f in filters:
            name = getattr(f, "attribute", ("",))
            axis = int(name[0][1:]) if len(name) == 1 and name[0][:1] == "g" and name[0][1:].isdigit() else -1
            if not 0 <= axis < len(self.low):
                yield f
            elif isinstance(f, EqualTo):
                self.low[axis], self.high[axis] = max(self.low[axis], f.value), min(self.high[axis], f.value)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low[axis] = max(self.low[axis], f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high[axis] = min(self.high[axis], f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Run]:
        n = prod(max(0, b - a + 1) for a, b in zip(self.low, self.high, strict=True))
        return [Run(self.low, self.high, i, min(n, i + self.each) - 1) for i in range(0, n, self.each)]

    def read(self, run: Run | None) -> Iterator[pa.RecordBatch]:
        if run is None or not isinstance(run, Run):
            return
        system, root = _system(self.path)
        for place in run.blocks():
            name = posixpath.join(root, *map(str, place))
            if system.get_file_info(name).type != pyarrow.fs.FileType.File:
                continue
            with system.open_input_stream(name) as f:
                size, values = block_values(f.read(), self.attributes["dataType"], self.attributes.get("compression") or {})
            columns = [*(pa.array([g], pa.int32()) for g in place), pa.array([size], pa.list_(pa.int32())), pa.array([values.astype(float)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, self.kind, strict=True)], schema=self.kind)


class Written(WriterCommitMessage):
    def __init__(self, blocks: int):
        self.blocks = blocks


class BlockWriter(DataSourceArrowWriter):
    """Blocks go to a folder beside the data set; the commit writes the attributes and gives the folder its name."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.attributes = json.loads(options["attributes"])
        self.beside = f"{self.path}.writing-{uuid.uuid4().hex}"
        if self.attributes["dataType"] not in TYPES:
            raise ValueError(f"no type {self.attributes['dataType']}")
        packed(b"", self.attributes["compression"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _system(self.beside)
        count, axes = 0, len(self.attributes["dimensions"])
        for batch in iterator:
            for i in range(batch.num_rows):
                place = [batch.column(k)[i].as_py() for k in range(axes)]
                size, values = batch.column(axes)[i].as_py(), batch.column(axes + 1)[i].values.to_numpy(zero_copy_only=False)
                if len(values) != prod(size):
                    raise ValueError(f"block {place} has {len(values)} values, not {prod(size)}")
                folder = posixpath.join(root, *map(str, place[:-1]))
                system.create_dir(folder, recursive=True)
                # a task that runs twice leaves one whole file: each attempt writes its own and renames it
                own = posixpath.join(folder, f".{place[-1]}.{uuid.uuid4().hex}")
                with system.open_output_stream(own, compression=None) as f:
                    f.write(block_bytes(values, size, self.attributes["dataType"], self.attributes["compression"]))
                system.move(own, posixpath.join(folder, str(place[-1])))
                count += 1
        return Written(count)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _system(self.beside)
        _, final = _system(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(posixpath.join(root, ATTRIBUTES), compression=None) as f:
            f.write(json.dumps(self.attributes).encode())
        there = system.get_file_info(final).type != pyarrow.fs.FileType.NotFound
        if there and not self.overwrite:
            system.delete_dir(root)
            raise ValueError(f"{self.path} is there already")
        old = f"{final}.old-{uuid.uuid4().hex}"
        if there:
            system.move(final, old)
        system.move(root, final)
        if there:
            system.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _system(self.beside)
        if system.get_file_info(root).type != pyarrow.fs.FileType.NotFound:
            system.delete_dir(root)


class BlockSource(DataSource):
    """Format n5: g0, g1, ... (place of the block in the grid), size and data, the first axis fastest. Options: path; blocks (of a task, 16)."""

    @classmethod
    def name(cls) -> str:
        return "n5"

    def _attributes(self) -> dict:
        system, root = _system(self.options["path"].rstrip("/"))
        with system.open_input_stream(posixpath.join(root, ATTRIBUTES)) as f:
            return json.loads(f.read())

    def schema(self) -> str:
        axes = len(json.loads(self.options["attributes"])["dimensions"]) if "attributes" in self.options else len(self._attributes()["dimensions"])
        return ", ".join(f"g{k} int" for k in range(axes)) + ", size array<int>, data array<double>"

    def reader(self, schema: StructType) -> BlockReader:
        return BlockReader(self.options["path"], self._attributes(), schema, int(self.options.get("blocks", 16)))

    def writer(self, schema: StructType, overwrite: bool) -> BlockWriter:
        return BlockWriter(self.options, overwrite)


def read_blocks(spark: SparkSession, path: str, blocks: int = 16) -> DataFrame:
    """The blocks of a data set; filters on g0, g1, ... read fewer. A block without file has no row. Turns filter pushdown to Python sources on, which this one needs."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(BlockSource)
    return spark.read.format("n5").option("path", path).option("blocks", blocks).load()


def read_pixels(spark: SparkSession, path: str, axes: list[str], value: str, low: list[int] | None = None, high: list[int] | None = None) -> DataFrame:
    """One row per pixel of the blocks within low..high (both included; all without): axes, value. Blocks beyond aren't opened."""
    spark.dataSource.register(BlockSource)
    rows = read_blocks(spark, path)
    source = BlockSource({"path": path})._attributes()
    side = source["blockSize"]
    low, high = low or [0] * len(axes), high or [n - 1 for n in source["dimensions"]]
    for k, b in enumerate(side):
        rows = rows.where((F.col(f"g{k}") >= low[k] // b) & (F.col(f"g{k}") <= high[k] // b))
    long = rows.select("*", F.posexplode("data").alias("_at", value))
    step, places = F.lit(1), {}
    for k, a in enumerate(axes):
        places[a] = F.col(f"g{k}").cast("long") * side[k] + F.floor(F.col("_at") / step) % F.get("size", F.lit(k))
        step = step * F.get("size", F.lit(k))
    for k, a in enumerate(axes):
        long = long.withColumn(a, places[a])
        long = long.where(F.col(a).between(low[k], high[k]))
    return long.select(*axes, value)


def write_pixels(pixels: DataFrame, path: str, axes: list[str], value: str, dimensions: list[int], block: list[int], kind: str = "uint16", compression: dict | None = None, overwrite: bool = False) -> None:
    """Pixels (axes, value) as an N5 data set of the given dimensions and blocks; blocks without a pixel have no file, other pixels without a row are 0.

    Pixels are gathered by block, which fits in a task; positions outside the
    dimensions, nulls among them, are an error. Blocks at the far ends are as
    large as the array has room for. If a task fails for good, nothing is at path.
    """
    spark = pixels.sparkSession
    spark.dataSource.register(BlockSource)
    attributes = {"dimensions": list(dimensions), "blockSize": list(block), "dataType": kind, "compression": compression or {"type": "gzip", "level": 4}}
    grid = [f"g{k}" for k in range(len(axes))]
    inside = F.lit(True)
    for a, n in zip(axes, dimensions, strict=True):
        inside = inside & F.coalesce(F.col(a).between(0, n - 1), F.lit(False))
    sound = F.when(inside, F.col(value).cast("double")).otherwise(F.raise_error(F.lit("a pixel is outside the array")).cast("double"))
    sizes = [F.least(F.lit(b), F.lit(n) - F.floor(F.col(a) / b).cast("int") * b) for a, b, n in zip(axes, block, dimensions, strict=True)]
    at, step = F.lit(0), F.lit(1)
    for a, b, s in zip(axes, block, sizes, strict=True):
        at, step = at + (F.col(a) % b).cast("int") * step, step * s
    placed = pixels.select(*[F.floor(F.col(a) / b).cast("int").alias(g) for g, a, b in zip(grid, axes, block, strict=True)], F.array(*sizes).alias("size"), at.cast("int").alias("at"), sound.alias("v"))
    gathered = placed.groupBy(*grid, "size").agg(F.collect_list(F.struct("at", "v")).alias("cells"))
    schema = StructType.fromDDL(BlockSource({"attributes": json.dumps(attributes)}).schema())
    target = to_arrow_schema(schema)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                size, cells = batch.column(len(grid))[i].as_py(), batch.column(len(grid) + 1)[i].values
                out = np.zeros(prod(size))
                out[cells.field("at").to_numpy(zero_copy_only=False)] = np.nan_to_num(cells.field("v").to_numpy(zero_copy_only=False))
                columns = [*(batch.column(k).slice(i, 1) for k in range(len(grid) + 1)), pa.array([out], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    gathered.mapInArrow(dense, schema).write.format("n5").option("path", path).option("attributes", json.dumps(attributes)).mode("overwrite" if overwrite else "append").save()
