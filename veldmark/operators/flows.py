"""Flows made of several operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions import affine
from veldmark.operators import images, registration, spatial, windows
from veldmark.session import cut
from veldmark.sources import sinks
from veldmark.streaming.streams import frequent, merge_peaks


def nuclei_over_time(volumes: DataFrame, series: str, time: str, shape: str, data: str, small: float, large: float, least: float, radius: float, min_count: int) -> DataFrame:
    """Peaks of each time point (array images), merged in order of time, and those seen more than min_count times."""
    keyed = volumes.withColumn("_key", F.struct(series, time))
    peaks = images.detect_peaks(keyed.withColumn("_text", F.to_json("_key")), "_text", shape, data, small, large, least)
    key = F.from_json("_text", f"{series} {dict(volumes.dtypes)[series]}, {time} {dict(volumes.dtypes)[time]}")
    rows = peaks.select(key.alias("k"), "at").select(f"k.{series}", f"k.{time}", *[F.get("at", F.lit(i)).alias(a) for i, a in enumerate(("x", "y", "z"))]).na.fill(0.0, ["z"])
    return frequent(merge_peaks(rows, series, radius, time), min_count)


def nuclei_by_projection(voxels: DataFrame, axes: list[str], value: str, least: float, mask: DataFrame | None = None) -> DataFrame:
    """Voxels of the projection over time that are greater than all their neighbours and the least, within the mask."""
    top = images.projected(voxels, axes, value).where(F.col(value) > least)
    near = spatial.radius_join(top.withColumn("pid", F.struct(*axes)), top.withColumn("pid", F.struct(*axes)), axes, 1.75)
    rivals = near.where("pid <> other").join(top.select(F.struct(*axes).alias("other"), F.col(value).alias("_rival")), "other").join(top.select(F.struct(*axes).alias("pid"), F.col(value).alias("_own")), "pid").where("_rival >= _own")
    peaks = top.join(rivals.select("pid").distinct(), F.struct(*axes) == F.col("pid"), "left_anti")
    return peaks if mask is None else spatial.masked(peaks, mask, axes, "set")


def measured(peaks: DataFrame, voxels: DataFrame, axes: list[str], radii: list[float], time: str, value: str, window: int, noise: float = 0.0, sigma: float = 0.0) -> DataFrame:
    """Series of each peak: mean of its region at each time point, the baseline and the relative change."""
    series = spatial.region_means(peaks, voxels, axes, radii, "pid", [time], value)
    return windows.delta_f_over_f(series.withColumn("f", F.col("mean").cast("float").cast("double")), "f", ["pid"], [time], window, noise, sigma)


def forward_transforms(matches: DataFrame, by: str, at: str, model: str = "translation", d: int = 2, **options) -> DataFrame:
    """A map for each time point to the first (matches: by, at, p1 of the earlier, p2 of the later): each one's map to the one before, after all before that. Times without consensus are left out.

    The maps of the times are fitted apart and multiplied by a scan, in as many rounds as the logarithm of the longest series.
    """
    fitted = registration.fit_pairs(matches.select(by, at, F.col("p2").alias("p1"), F.col("p1").alias("p2")), [by, at], model, **options)
    return windows.running_product(cut(fitted.where(F.col("matrix").isNotNull())), "matrix", [by], at, d)


def exported_chunk(value: Column | str, low: float, high: float, inverted: bool = True):
    """A pixel for export: clipped, optionally inverted, as a byte."""
    from veldmark.functions.numeric import to_byte_range

    byte = to_byte_range(value, low, high)
    return 255 - byte if inverted else byte


def exported(voxels: DataFrame, matrices: DataFrame, path: str, low: dict[str, int], high: dict[str, int], section: str = "section", bits: int = 8, display: tuple[float, float] = (0.0, 65535.0), inverted: bool = True, block: int = 128, level: int | None = 6) -> None:
    """Sections of 16 bits (section, x, y, v) cropped to an interval, inverted, moved by the map of each section, as 8 or 16 bits, in blocks.

    matrices: section, matrix (six numbers, from the cropped section to its place).
    Pixels from outside are 0. With 8 bits the display range becomes 0..255. A row
    is a block: section, bx, by, width, height and v, row by row, in a folder per section.
    """
    if bits not in (8, 16):
        raise ValueError("8 or 16 bits")
    own = images.cropped(voxels.select(section, "x", "y", F.col("v").cast("double").alias("v")), low, high, zero_min=True)
    own = own.withColumn("v", 65535 - F.col("v")) if inverted else own
    wanted = own.select(section, "x", "y").join(matrices.select(section, affine.invert("matrix", 2).alias("_m")), section)
    m = [F.get("_m", F.lit(i)) for i in range(6)]
    moved = images.affine_sampled(own, wanted, [[m[0], m[1], 0, m[2]], [m[3], m[4], 0, m[5]], [0, 0, 1, 0]], ["x", "y", section], "v")
    scaled = (F.col("v") - display[0]) * 255 / (display[1] - display[0]) if bits == 8 else F.col("v")
    held = images.converted(F.floor(scaled + 0.5), 0, (1 << bits) - 1, "smallint" if bits == 8 else "int")
    placed = moved.select(section, F.floor(F.col("x") / block).alias("bx"), F.floor(F.col("y") / block).alias("by"), "x", "y", held.alias("v"))
    size = lambda a: (F.max(a) - F.min(a) + 1).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "v")))
    blocks = placed.groupBy(section, "bx", "by").agg(size("x").alias("width"), size("y").alias("height"), F.transform(ordered, lambda r: r["v"]).alias("v"))
    sinks.chunks(blocks, path, [section], level)


def training_image(width: int, height: int, lines: int, blur: float, noise: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A synthetic image of filled lines with blur and noise, and its mask: a fixture for classifiers."""
    rng = np.random.default_rng(seed)
    mask = np.zeros((height, width), bool)
    ys, xs = np.mgrid[:height, :width]
    for _ in range(lines):
        angle, offset = rng.uniform(0, np.pi), rng.uniform(0.2, 0.8) * width
        mask |= np.abs((xs - offset) * np.cos(angle) + (ys - height / 2) * np.sin(angle)) < 2
    image = images._smooth(mask.astype(float), blur) + rng.normal(0, noise, mask.shape)
    return image, mask


def rotations(step: int = 10) -> list[tuple[float, list[list[float]]]]:
    """Angles in degrees and the maps that turn a plane by them."""
    return [(a, [[float(np.cos(np.radians(a))), float(-np.sin(np.radians(a))), 0.0], [float(np.sin(np.radians(a))), float(np.cos(np.radians(a))), 0.0]]) for a in range(0, 360, step)]
