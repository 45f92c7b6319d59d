"""Raw and microscope binary files, read through Spark's own file systems."""

from __future__ import annotations

import bz2
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The header of a section file.
MAGIC, HEADER = 3555587570, 1024
AT_CHANNELS, AT_WIDTH, AT_HEIGHT = 32, 100, 104
KINDS = {"float": "f4", "ushort": "u2", "ubyte": "u1", "short": "i2"}


def raw_values(content: bytes, kind: str, header: int, big_endian: bool) -> np.ndarray:
    """Numbers after a header; a negative header counts from the end, and so gives the last bytes."""
    body = content[header:]
    size = np.dtype(KINDS[kind]).itemsize
    return np.frombuffer(body[: len(body) // size * size], (">" if big_endian else "<") + KINDS[kind])


def section(content: bytes, channel: int = -1) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(channel, width, height, pixels) of a section file: big-endian, channels interleaved, values moved so that none is negative."""
    magic, = struct.unpack_from(">I", content, 0)
    if magic != MAGIC:
        raise ValueError("not a section file")
    channels, width, height = content[AT_CHANNELS], *struct.unpack_from(">i", content, AT_WIDTH), *struct.unpack_from(">i", content, AT_HEIGHT)
    pixels = np.frombuffer(content, ">i2", width * height * channels, HEADER).reshape(-1, channels).astype(np.int32)
    for c in range(channels) if channel < 0 else [channel]:
        own = pixels[:, c]
        yield c, width, height, own - min(0, int(own.min(initial=0)))


def section_header(content: bytes) -> dict[str, int]:
    magic, = struct.unpack_from(">I", content, 0)
    return {"magic": magic, "channels": content[AT_CHANNELS], "width": struct.unpack_from(">i", content, AT_WIDTH)[0], "height": struct.unpack_from(">i", content, AT_HEIGHT)[0]}


def unpack_bits(data: bytes) -> bytes:
    """A count n below 128 brings n + 1 literal bytes, one above 128 repeats the next byte 257 - n times; 128 does nothing."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """Codes from nine to twelve bits, most significant bit first; 256 clears the table, 257 ends. Codes grow one entry early."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, held, bits, last = bytearray(), 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        while bits >= width:
            code = held >> (bits - width) & ((1 << width) - 1)
            bits -= width
            held &= (1 << bits) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, last = table[:258], 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            out += entry
            if last:
                table.append(last + entry[:1])
            last = entry
            width = 9 + sum(len(table) >= limit for limit in (511, 1023, 2047))
    return bytes(out)


# Tags and compressions of tagged image files.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "offsets", 277: "samples", 278: "rows_per_strip", 279: "counts"}
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
UNPACK = {1: bytes, 32773: unpack_bits, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress}


def walk(read: Callable[[int, int], bytes]) -> Iterator[dict]:
    """The image directories of a tagged image file, one after the other. read gives so many bytes from a place on: only directories and their lists are read."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    at, = struct.unpack_from(f"{order}I", head, 4)
    while at:
        n, = struct.unpack(f"{order}H", read(at, 2))
        body = read(at + 2, 12 * n + 4)
        found = {"big_endian": order == ">", "samples": 1, "compression": 1, "bits": 1}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", body, 12 * i)
            if tag not in TAGS or kind not in SIZES:
                continue
            field = body[12 * i + 8 : 12 * i + 12]
            if SIZES[kind] * count > 4:
                field = read(struct.unpack(f"{order}I", field)[0], SIZES[kind] * count)
            values = list(struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", field)) if kind in (1, 3, 4) else []
            found[TAGS[tag]] = values if TAGS[tag] in ("offsets", "counts") else values[0] if values else None
        found.setdefault("rows_per_strip", found.get("height"))
        yield found
        at, = struct.unpack_from(f"{order}I", body, 12 * n)


def directories(content: bytes) -> Iterator[dict]:
    """The image directories of a tagged image file that is held."""
    return walk(lambda at, n: content[at : at + n])


def pack_bits(data: bytes) -> bytes:
    """Runs of equal bytes as a count and the byte, others as they are, 128 at most together."""
    out, at = bytearray(), 0
    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 1:
            out += bytes([257 - run, data[at]])
            at += run
            continue
        stop = at + 1
        while stop < len(data) and stop - at < 128 and (stop + 1 >= len(data) or data[stop] != data[stop + 1]):
            stop += 1
        out += bytes([stop - at - 1]) + data[at:stop]
        at = stop
    return bytes(out)


PACK = {1: bytes, 32773: pack_bits, 8: zlib.compress}


def tagged_image(planes: list[np.ndarray], compression: int = 1, big_endian: bool = False, rows_per_strip: int | None = None) -> bytes:
    """A tagged image file of planes of u1, u2 or f4, in strips: raw (1), PackBits (32773) or deflate (8)."""
    order = ">" if big_endian else "<"
    out = bytearray((b"MM" if big_endian else b"II") + struct.pack(f"{order}HI", 42, 0))
    link = 4  # where the place of the next directory goes
    for p in planes:
        height, width = p.shape
        rows = rows_per_strip or height
        raw = p.astype(p.dtype.newbyteorder(order))
        strips = [PACK[compression](raw[y : y + rows].tobytes()) for y in range(0, height, rows)]
        offsets = []
        for strip in strips:
            offsets.append(len(out))
            out += strip + b"\0" * (len(strip) % 2)
        lists = {}
        for tag, values in ((273, offsets), (279, [len(x) for x in strips])):
            lists[tag] = len(out)
            out += struct.pack(f"{order}{len(values)}I", *values)
        tags = {256: width, 257: height, 258: p.dtype.itemsize * 8, 259: compression, 262: 1, 273: offsets, 277: 1, 278: rows, 279: [len(x) for x in strips], 339: 3 if p.dtype.kind == "f" else 1}
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags))
        for tag, value in tags.items():
            several = isinstance(value, list)
            out += struct.pack(f"{order}HHII", tag, 4, len(value) if several else 1, value if not several else value[0] if len(value) == 1 else lists[tag])
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


def section_file(planes: np.ndarray) -> bytes:
    """A section file of channel x height x width 16-bit values, channels interleaved."""
    channels, height, width = planes.shape
    head = bytearray(HEADER)
    struct.pack_into(">I", head, 0, MAGIC)
    head[AT_CHANNELS] = channels
    struct.pack_into(">i", head, AT_WIDTH, width)
    struct.pack_into(">i", head, AT_HEIGHT, height)
    return bytes(head) + planes.reshape(channels, -1).T.astype(">i2").tobytes()


def plane(content: bytes, directory: dict) -> np.ndarray:
    """The pixels of one directory; JPEG and unknown compressions fail."""
    if directory["compression"] not in UNPACK:
        raise ValueError(f"compression {directory['compression']} isn't read")
    raw = b"".join(UNPACK[directory["compression"]](content[o : o + n]) for o, n in zip(directory["offsets"], directory["counts"], strict=True))
    kind = {8: "u1", 16: "u2", 32: "f4"}[directory["bits"]]
    return np.frombuffer(raw, (">" if directory["big_endian"] else "<") + kind)


def region(content: bytes, width: int, low: tuple[int, int], high: tuple[int, int], kind: str = "ushort", header: int = 0, big_endian: bool = True) -> np.ndarray:
    """The pixels between two corners, both included: one run of bytes from each row."""
    item = np.dtype((">" if big_endian else "<") + KINDS[kind])
    rows = [np.frombuffer(content, item, high[0] - low[0] + 1, header + (y * width + low[0]) * item.itemsize) for y in range(low[1], high[1] + 1)]
    return np.stack(rows)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _spread(files: DataFrame, each, schema: str) -> DataFrame:
    """Rows of each(content) with the path; one file's content fits in a task."""
    import pandas as pd

    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, *r) for r in each(bytes(content))]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", *names])

    return files.mapInPandas(run, f"path string, {schema}")


def read_raw(spark: SparkSession, path: str, kind: str = "ushort", header: int = 0, big_endian: bool = True) -> DataFrame:
    """path and data (array<double>)."""
    return _spread(_files(spark, path), lambda c: [(raw_values(c, kind, header, big_endian).astype(float),)], "data array<double>")


def read_sections(spark: SparkSession, path: str, channel: int = -1, filtered: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """path, channel, width, height, data of section files: a row per channel. filtered: what is done to each plane (height x width) as it is read."""

    def each(content: bytes):
        for c, width, height, data in section(content, channel):
            yield c, width, height, data if filtered is None else np.asarray(filtered(data.reshape(height, width))).ravel()

    return _spread(_files(spark, path), each, "channel int, width int, height int, data array<int>")


def read_section_headers(spark: SparkSession, path: str) -> DataFrame:
    return _spread(_files(spark, path), lambda c: [tuple(section_header(c).values())], "magic long, channels int, width int, height int")


def read_directories(spark: SparkSession, path: str) -> DataFrame:
    """A row per image directory of tagged image files."""
    keys = ("width", "height", "bits", "compression", "samples", "rows_per_strip", "offsets", "counts", "big_endian")
    return _spread(_files(spark, path), lambda c: [(i, *(d.get(k) for k in keys)) for i, d in enumerate(directories(c))], "slice int, width int, height int, bits int, compression int, samples int, rows_per_strip int, offsets array<long>, counts array<long>, big_endian boolean")


def read_slices(spark: SparkSession, path: str) -> DataFrame:
    """A row per slice of tagged image files: path, slice, width, height, data."""
    return _spread(_files(spark, path), lambda c: [(i, d["width"], d["height"], plane(c, d).astype(float)) for i, d in enumerate(directories(c))], "slice int, width int, height int, data array<double>")


def read_region(spark: SparkSession, path: str, width: int, low: tuple[int, int], high: tuple[int, int], kind: str = "ushort", header: int = 0, big_endian: bool = True) -> DataFrame:
    """path, y and data (the row's pixels within the region)."""
    return _spread(_files(spark, path), lambda c: [(low[1] + i, r.astype(float)) for i, r in enumerate(region(c, width, low, high, kind, header, big_endian))], "y int, data array<double>")


def read_compressed_micrograph(spark: SparkSession, path: str) -> DataFrame:
    """The first 16-bit image of bzip2-compressed micrograph files: a header of 1024 bytes begins with width and height, of an order that makes them plausible."""

    def each(content: bytes):
        raw = bz2.decompress(content)
        order = "<" if 0 < struct.unpack_from("<i", raw)[0] < 1 << 16 else ">"
        width, height = struct.unpack_from(f"{order}2i", raw)
        return [(width, height, np.frombuffer(raw, f"{order}i2", width * height, 1024).astype(int))]

    return _spread(_files(spark, path), each, "width int, height int, data array<int>")


def cells(images: DataFrame, size: int) -> DataFrame:
    """Images (path, width, height, data) cut to cells: path, cx, cy, y, and the row's pixels within the cell. No row carries more than its own pixels; for large raw files, regions.read_cells reads no whole plane."""
    at = lambda i, n: (i * n).cast("int")
    part = lambda y, cx: F.slice("data", y * F.col("width") + at(cx, size) + 1, F.least(F.lit(size), F.col("width") - at(cx, size)))
    columns = F.sequence(F.lit(0), F.floor((F.col("width") - 1) / size).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda y: F.transform(columns, lambda cx: F.struct(cx.alias("cx"), F.floor(y / size).alias("cy"), y.alias("y"), part(y, cx).alias("data"))))
    return images.select("path", F.inline(F.flatten(rows)))
