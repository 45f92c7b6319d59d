"""Peaks of the difference of two Gaussians, of images of any size: blocks pass strips of their edges to their neighbours."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veldmark.operators.images import gaussian_kernel

#: Pixels of a block.
BLOCK = 1 << 18


def mirrored(at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Places beyond an interval reflected at its ends, the end itself once."""
    if first == last:
        return np.full(len(at), first)
    turn = 2 * (last - first)
    m = (at - first) % turn
    return first + np.minimum(m, turn - m)


def along(a: np.ndarray, kernel: np.ndarray, axis: int, margin: int) -> np.ndarray:
    """a, which has a margin at both ends of an axis, smoothed along it, without the margin. Taps are added in one order everywhere, so that blocks agree to the last bit."""
    half, n = len(kernel) // 2, a.shape[axis] - 2 * margin
    out = np.zeros([n if k == axis else s for k, s in enumerate(a.shape)])
    for k, w in enumerate(kernel):
        begin = margin - half + k
        out += w * a[tuple(slice(begin, begin + n) if i == axis else slice(None) for i in range(a.ndim))]
    return out


def maxima(a: np.ndarray, inside: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in a, which has a margin of one, that are above least and above all neighbours inside; their values; and where a parabola along each axis has its top, 0 beside an edge."""
    inner = tuple(slice(1, -1) for _ in range(a.ndim))
    held = np.where(inside, a, -np.inf)
    top = inside[inner] & (a[inner] > least)
    for step in product((-1, 0, 1), repeat=a.ndim):
        if any(step):
            top &= a[inner] > held[tuple(slice(1 + s, n - 1 + s) for s, n in zip(step, a.shape, strict=True))]
    at = np.argwhere(top) + 1
    value = a[tuple(at.T)]
    moved = np.zeros(at.shape)
    for k in range(a.ndim):
        step = np.eye(a.ndim, dtype=int)[k]
        low, high = held[tuple((at - step).T)], held[tuple((at + step).T)]
        known = np.isfinite(low) & np.isfinite(high)
        low, high = np.where(known, low, value), np.where(known, high, value)
        bend = low - 2 * value + high
        moved[:, k] = np.where(known & (bend != 0), 0.5 * (low - high) / np.where(bend == 0, 1.0, bend), 0.0)
    return at, value, moved


def gaussian_peaks(image: DataFrame, axes: list[str], value: str, small: float, large: float, least: float, by: tuple[str, ...] = (), calibration: list[float] | None = None, block: int | None = None) -> DataFrame:
    """Strict local maxima above least of the image smoothed by small less that by large: by, axes (double, refined by a parabola along each), value.

    Axes are whole numbers, sigmas and the places that come out are in
    calibrated units. An image is the interval from the least to the greatest
    place along each axis, pixels without a row, null and nan ones among them, are 0 and of
    repeated pixels the largest counts; rows with a null place play no part. It goes on mirrored
    beyond its edges, where there may be peaks too. Pixels are gathered once by
    block; what neighbours need of a block are strips as wide as the larger kernel reaches.
    A block (a side's pixels, or else 2^18 pixels) with its strips fits in a task.
    """
    scale = [float(c) for c in calibration or [1.0] * len(axes)]
    kernels = [[gaussian_kernel(s / c) for c in scale] for s in (small, large)]
    reach = [max(len(kernels[0][k]), len(kernels[1][k])) // 2 for k in range(len(axes))]
    side = [max(block or round(BLOCK ** (1 / len(axes))), r + 1) for r in reach]
    keys, grid, d = list(by), [f"_b{k}" for k in range(len(axes))], len(axes)
    number = F.col(value).cast("double")
    rows = image.select(*keys, *[F.col(a).cast("long").alias(f"_x{k}") for k, a in enumerate(axes)], F.when(F.isnan(number), None).otherwise(number).alias("_v")).na.drop(subset=[f"_x{k}" for k in range(d)])
    cell = F.struct(*[F.pmod(F.col(f"_x{k}"), F.lit(side[k])).cast("int").alias(f"i{k}") for k in range(d)], F.col("_v").alias("v"))
    bounds = [f(f"_x{k}").alias(f"{n}{k}") for k in range(d) for n, f in (("_f", F.min), ("_l", F.max))]
    packed = rows.groupBy(*keys, *[F.floor(F.col(f"_x{k}") / side[k]).alias(g) for k, g in enumerate(grid)]).agg(F.collect_list(cell).alias("_cells"))

    ends = [f"{n}{k}" for k in range(d) for n in ("_f", "_l")]
    strip_kind = StructType([*(packed.schema[k] for k in keys), *StructType.fromDDL(", ".join(f"{c} long" for c in grid) + ", _low array<long>, _size array<int>, _data array<double>")])
    strip_target = to_arrow_schema(strip_kind)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                at = [own.column(g)[0].as_py() for g in grid]
                cells = own.column("_cells")[0].values
                field = lambda n, cells=cells: cells.field(n).to_numpy(zero_copy_only=False)
                # only the box that has pixels
                at_cell = [field(f"i{k}") for k in range(d)]
                box = [int(c.min()) for c in at_cell]
                dense = np.full([int(c.max()) + 1 - b for c, b in zip(at_cell, box, strict=True)], -np.inf)
                v = field("v").astype(float)
                known = ~np.isnan(v)
                np.maximum.at(dense, tuple((c - b)[known] for c, b in zip(at_cell, box, strict=True)), v[known])
                dense[np.isneginf(dense)] = 0.0
                for step in product((-1, 0, 1), repeat=d):
                    # the block's cells within reach of the block that lies a step away
                    first = [max(b, n - r - 1) if s == 1 else b for s, n, r, b in zip(step, side, reach, box, strict=True)]
                    end = [min(b + m, r + 1) if s == -1 else b + m for s, r, b, m in zip(step, reach, box, dense.shape, strict=True)]
                    if any(f >= e for f, e in zip(first, end, strict=True)):
                        continue
                    data = dense[tuple(slice(f - b, e - b) for f, e, b in zip(first, end, box, strict=True))]
                    low = [a * n + f for a, n, f in zip(at, side, first, strict=True)]
                    values = [[a + s] for a, s in zip(at, step, strict=True)] + [[low], [list(data.shape)], [data.ravel()]]
                    yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *(pa.array(v, f.type) for v, f in zip(values, list(strip_target)[len(keys) :], strict=True))], schema=strip_target)

    sent = packed.mapInArrow(strips, strip_kind)
    gathered = sent.groupBy(*keys, *grid).agg(F.collect_list(F.struct("_low", "_size", "_data")).alias("_parts"))
    if keys:
        extent = rows.groupBy(*keys).agg(*bounds)
        same = F.lit(True)
        for k in keys:
            same = same & gathered[k].eqNullSafe(extent[k])
        placed = gathered.join(extent, same).select(*[gathered[k] for k in keys], *grid, "_parts", *ends)
    else:
        one = rows.agg(*bounds).first()
        placed = gathered.withColumns({c: F.lit(one[c]).cast("long") for c in ends})
    for k, g in enumerate(grid):
        placed = placed.where(F.col(g).between(F.floor(F.col(f"_f{k}") / side[k]), F.floor(F.col(f"_l{k}") / side[k])))

    kind = StructType([*(packed.schema[k] for k in keys), *StructType.fromDDL(", ".join(f"`{a}` double" for a in axes) + ", value double")])
    target = to_arrow_schema(kind)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                first, last = ([own.column(f"{n}{k}")[0].as_py() for k in range(d)] for n in ("_f", "_l"))
                start = [own.column(g)[0].as_py() * n for g, n in zip(grid, side, strict=True)]
                base = [max(f, s - r - 1) for f, s, r in zip(first, start, reach, strict=True)]
                region = np.zeros([min(e, s + n + r) - b + 1 for e, s, n, r, b in zip(last, start, side, reach, base, strict=True)])
                parts = own.column("_parts")[0].values
                for low, size, data in zip(parts.field("_low").to_pylist(), parts.field("_size").to_pylist(), parts.field("_data"), strict=True):
                    region[tuple(slice(a - b, a - b + n) for a, b, n in zip(low, base, size, strict=True))] = data.values.to_numpy(zero_copy_only=False).reshape(size)
                begin = [max(s, f) for s, f in zip(start, first, strict=True)]
                end = [min(s + n - 1, e) for s, n, e in zip(start, side, last, strict=True)]
                places = [np.arange(b - 1 - r, e + 2 + r) for b, e, r in zip(begin, end, reach, strict=True)]
                a = region[np.ix_(*(mirrored(p, f, e) - b for p, f, e, b in zip(places, first, last, base, strict=True)))]
                smooth = []
                for own_kernels in kernels:
                    s = a
                    for k, kernel in enumerate(own_kernels):
                        s = along(s, kernel, k, reach[k])
                    smooth.append(s)
                inside = np.ones(smooth[0].shape, bool)
                for k in range(d):
                    p = np.arange(begin[k] - 1, end[k] + 2)
                    inside &= ((p >= first[k]) & (p <= last[k])).reshape([-1 if j == k else 1 for j in range(d)])
                at, top, moved = maxima(smooth[0] - smooth[1], inside, least)
                at = (at - 1 + np.array(begin) + moved) * np.array(scale)
                n = len(top)
                yield pa.RecordBatch.from_arrays([*(own.column(k).take(pa.array(np.zeros(n, np.int64))) for k in keys), *(pa.array(at[:, k], pa.float64()) for k in range(d)), pa.array(top, pa.float64())], schema=target)

    return placed.mapInArrow(found, kind)
