"""Images as voxel tables (one row per pixel) or chunk tables (one array per row), and views of them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REDUCERS: dict[str, Callable[[Column], Column]] = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}


def cropped(df: DataFrame, low: dict[str, int], high: dict[str, int], zero_min: bool = False) -> DataFrame:
    """Pixels within an interval, both bounds included; optionally moved so that it begins at 0."""
    for a in low:
        df = df.where(F.col(a).between(low[a], high[a]))
    return translated(df, {a: -v for a, v in low.items()}) if zero_min else df


def translated(df: DataFrame, by: dict[str, int]) -> DataFrame:
    return df.withColumns({a: F.col(a) + s for a, s in by.items()})


def hyperslice(df: DataFrame, axis: str, at: int) -> DataFrame:
    """One slice, without its axis."""
    return df.where(F.col(axis) == at).drop(axis)


def permuted(df: DataFrame, a: str, b: str) -> DataFrame:
    names = {a: b, b: a}
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def added_dimension(df: DataFrame, axis: str, at: int = 0) -> DataFrame:
    return df.withColumn(axis, F.lit(at))


def collapsed(df: DataFrame, axes: list[str], last: str, value: str) -> DataFrame:
    """The last dimension as an array at each position."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(last).alias("at"), F.col(value).alias("v"))))
    return df.groupBy(*axes).agg(F.transform(ordered, lambda r: r["v"]).alias(value))


def subsampled(df: DataFrame, step: dict[str, int]) -> DataFrame:
    """Every n-th position of each axis."""
    for a, s in step.items():
        df = df.where(F.pmod(F.col(a), F.lit(s)) == 0).withColumn(a, F.floor(F.col(a) / s))
    return df


def rotated(df: DataFrame, x: str, y: str, width: int, height: int, clockwise: bool = True) -> DataFrame:
    """A quarter turn of a plane of width x height."""
    turned = {x: height - 1 - F.col(y), y: F.col(x)} if clockwise else {x: F.col(y), y: width - 1 - F.col(x)}
    return df.select(*[turned[c].alias(c) if c in turned else F.col(c) for c in df.columns])


def mirrored_index(i: Column, n: int) -> Column:
    """An index beyond the ends reflected at them, the end itself once."""
    if n == 1:
        return F.lit(0)
    m = F.pmod(i, F.lit(2 * n - 2))
    return F.least(m, 2 * n - 2 - m)


def extended(df: DataFrame, wanted: DataFrame, axes: dict[str, int], value: str, policy: str = "zero", fill: float = 0.0) -> DataFrame:
    """Values at wanted positions, some of which are outside: zero, value (fill), border or mirror."""
    keys = {}
    for a, n in axes.items():
        c = F.col(a)
        keys[f"_k{a}"] = F.greatest(F.lit(0), F.least(F.lit(n - 1), c)) if policy == "border" else mirrored_index(c, n) if policy == "mirror" else c
    other = df.select(*[F.col(a).alias(f"_k{a}") for a in axes], value)
    joined = wanted.withColumns(keys).join(other, list(keys), "left").drop(*keys)
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(fill if policy == "value" else 0.0))) if policy in ("zero", "value") else joined


def projected(df: DataFrame, axes: list[str], value: str, reducer: str = "max") -> DataFrame:
    """The dimensions that aren't in axes reduced to one value."""
    return df.groupBy(*axes).agg(REDUCERS[reducer](value).alias(value))


def projected_in_chunks(df: DataFrame, axes: list[str], last: str, k: int, value: str, reducer: str = "max") -> DataFrame:
    """Each k slices reduced to one, the last few among them."""
    return df.groupBy(*axes, F.floor(F.col(last) / k).alias(last)).agg(REDUCERS[reducer](value).alias(value))


def projected_arrays(df: DataFrame, by: list[str], values: str, reducer: str = "max") -> DataFrame:
    """Arrays of equal length reduced element by element."""
    long = df.select(*by, F.posexplode(values).alias("at", "v")).groupBy(*by, "at").agg(REDUCERS[reducer]("v").alias("v"))
    return collapsed(long, by, "at", "v").withColumnRenamed("v", values)


def flat(df: DataFrame, values: str) -> DataFrame:
    """One row per element, with its index."""
    return df.select(*[c for c in df.columns if c != values], F.posexplode(values).alias("at", "v"))


def converted(value, low: float, high: float, kind: str) -> Column:
    """A value held in the range of a narrower type."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.col(value) if isinstance(value, str) else value)).cast(kind)


def montage(df: DataFrame, x: str, y: str, slice_: str, columns: int, width: int, height: int, padding: int = 0) -> DataFrame:
    """Slices in a padded grid."""
    s = F.col(slice_)
    return df.withColumn(x, F.col(x) + F.pmod(s, F.lit(columns)) * (width + padding)).withColumn(y, F.col(y) + F.floor(s / columns) * (height + padding)).drop(slice_)


def pyramid(df: DataFrame, axes: list[str], level: int, value: str) -> DataFrame:
    """Mean of each 2^level wide cell."""
    return df.groupBy(*[F.floor(F.col(a) / (1 << level)).alias(a) for a in axes]).agg(F.avg(value).alias(value))


def block_sums(integral: DataFrame, x: str, y: str, value: str, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of each width x height block that begins at a pixel, from four corners of an integral image, or of one for each by."""
    corner = lambda dx, dy, name: integral.select(*by, (F.col(x) - dx).alias(x), (F.col(y) - dy).alias(y), F.col(value).alias(name))
    keys = [*by, x, y]
    far = corner(width - 1, height - 1, "_d")
    joined = far.join(corner(-1, height - 1, "_b"), keys, "left").join(corner(width - 1, -1, "_c"), keys, "left").join(corner(-1, -1, "_a"), keys, "left")
    none = F.lit(0)
    return joined.where((F.col(x) >= 0) & (F.col(y) >= 0)).select(*keys, (F.col("_d") - F.coalesce("_b", none) - F.coalesce("_c", none) + F.coalesce("_a", none)).alias("sum"))


def block_sums_in_bands(df: DataFrame, x: str, y: str, value: str, width: int, height: int, band: int = 256) -> DataFrame:
    """block_sums of an image of any height: integral images of bands of rows, each with the first rows of the next, so no column is in one task."""
    from veldmark.operators.windows import prefix_sum_2d

    first = F.greatest(F.floor((F.col(y) - height + 1) / band), F.lit(0))
    spread = df.select(x, y, value, F.explode(F.sequence(first, F.floor(F.col(y) / band))).alias("_band"))
    sums = block_sums(prefix_sum_2d(spread, x, y, value, ["_band"]), x, y, "integral", width, height, ("_band",))
    return sums.where(F.col(y) >= F.col("_band") * band).drop("_band")  # blocks that begin in the band


def shifted(df: DataFrame, axes: dict[str, int], value: str, name: str) -> DataFrame:
    """The value of the pixel at an offset from each pixel; null outside."""
    other = df.select(*[(F.col(a) - s).alias(a) for a, s in axes.items()], F.col(value).alias(name))
    return df.join(other, list(axes), "left")


def affine_sampled(df: DataFrame, wanted: DataFrame, inverse: list[list[float]], axes: list[str], value: str, border: tuple[int, ...] | None = None) -> DataFrame:
    """n-linear interpolation of an image at positions mapped back by an affine map (numbers, or Columns of wanted); 0 outside, or the nearest pixel of an image of the size that border gives."""
    place = {f"_p{i}": sum((F.col(a) * inverse[i][j] for j, a in enumerate(axes)), inverse[i][-1] if isinstance(inverse[i][-1], Column) else F.lit(float(inverse[i][-1]))) for i in range(len(axes))}
    at = wanted.withColumns(place)
    corners = F.array(*[F.struct(*[F.lit(c >> i & 1).alias(f"b{i}") for i in range(len(axes))]) for c in range(1 << len(axes))])
    spread = at.withColumn("_corner", F.explode(corners))
    weight = F.lit(1.0)
    keys = {}
    for i in range(len(axes)):
        low = F.floor(F.col(f"_p{i}"))
        part = F.col(f"_p{i}") - low
        weight = weight * F.when(F.col(f"_corner.b{i}") == 1, part).otherwise(1 - part)
        corner = low + F.col(f"_corner.b{i}")
        keys[f"_k{i}"] = corner if border is None else F.greatest(F.lit(0), F.least(F.lit(border[i] - 1), corner))
    other = df.select(*[F.col(a).alias(f"_k{i}") for i, a in enumerate(axes)], F.col(value).alias("_v"))
    joined = spread.withColumns(keys | {"_w": weight}).join(other, list(keys), "left")
    return joined.groupBy(*axes).agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias(value))


def constant(spark, width: int, height: int, value: float) -> DataFrame:
    return functional(spark, width, height, lambda x, y: F.lit(float(value)))


def functional(spark, width: int, height: int, f: Callable[[Column, Column], Column]) -> DataFrame:
    """An image that is a function of its coordinates."""
    return spark.range(width * height).select((F.col("id") % width).alias("x"), F.floor(F.col("id") / width).alias("y")).withColumn("v", f(F.col("x"), F.col("y")))


def mandelbrot(spark, width: int, height: int, steps: int = 50) -> DataFrame:
    """How many steps each point of the plane stays within 2."""

    def count(x, y):
        cx, cy = x * 3.0 / width - 2.25, y * 2.5 / height - 1.25
        start = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("n"))

        def step(s, _):
            a, b = s["a"] * s["a"] - s["b"] * s["b"] + cx, 2 * s["a"] * s["b"] + cy
            inside = s["a"] * s["a"] + s["b"] * s["b"] <= 4
            return F.struct(F.when(inside, a).otherwise(s["a"]).alias("a"), F.when(inside, b).otherwise(s["b"]).alias("b"), (s["n"] + inside.cast("int")).alias("n"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["n"])

    return functional(spark, width, height, count)


def gaussian_kernel(sigma: float) -> np.ndarray:
    half = max(1, int(3 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    return k / k.sum()


def _smooth(a: np.ndarray, sigma: float) -> np.ndarray:
    kernel = gaussian_kernel(sigma)
    half = len(kernel) // 2
    for axis in range(a.ndim):
        pad = [(half, half) if i == axis else (0, 0) for i in range(a.ndim)]
        padded = np.pad(a, pad, mode="reflect") if a.shape[axis] > half else np.pad(a, pad, mode="symmetric")
        a = np.apply_along_axis(lambda v: np.convolve(v, kernel, "valid"), axis, padded)
    return a


def difference_of_gaussians(a: np.ndarray, small: float, large: float, least: float) -> list[tuple]:
    """Strict local maxima of G(small) - G(large) above least: position, refined by a parabola along each axis, and value."""
    d = _smooth(a, small) - _smooth(a, large)
    out = []
    inner = tuple(slice(1, -1) for _ in range(a.ndim))
    for at in np.argwhere(d[inner] > least) + 1:
        box = d[tuple(slice(i - 1, i + 2) for i in at)]
        value = d[tuple(at)]
        if (box >= value).sum() != 1:
            continue
        place = []
        for axis, i in enumerate(at):
            step = np.eye(a.ndim, dtype=int)[axis]
            lo, hi = d[tuple(at - step)], d[tuple(at + step)]
            bend = lo - 2 * value + hi
            place.append(float(i + (0.5 * (lo - hi) / bend if bend else 0)))
        out.append((*place, float(value)))
    return out


def detect_peaks(images: DataFrame, by: str, shape: str, data: str, small: float, large: float, least: float) -> DataFrame:
    """Peaks of each image (by, shape array<int>, data array<double>): by, at array<double>, value. One image or chunk fits in a task."""
    kind = dict(images.dtypes)[by]

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for key, size, values in zip(pdf[by], pdf[shape], pdf[data], strict=True):
                rows += [(key, list(p[:-1]), p[-1]) for p in difference_of_gaussians(np.asarray(values, float).reshape(size), small, large, least)]
            yield pd.DataFrame(rows, columns=[by, "at", "value"])

    return images.select(by, shape, data).mapInPandas(run, f"`{by}` {kind}, at array<double>, value double")


def phase_correlation(a: np.ndarray, b: np.ndarray) -> tuple[int, ...]:
    """The shift of b against a at which their normalised cross power is greatest."""
    cross = np.fft.fftn(a) * np.conj(np.fft.fftn(b))
    peak = np.unravel_index(np.argmax(np.fft.ifftn(cross / np.maximum(np.abs(cross), 1e-12)).real), a.shape)
    return tuple(int(-(p - n if p > n // 2 else p)) for p, n in zip(peak, a.shape, strict=True))


def distance_transform(mask: DataFrame, x: str, y: str, value: str, reach: int, name: str = "distance") -> DataFrame:
    """Each pixel of a mask with its distance to the nearest pixel of the other kind: positive inside, negative outside, reach where none is as near."""
    from veldmark.operators.spatial import nearest

    ids = mask.select(F.struct(x, y).alias("pid"), x, y, (F.col(value) != 0).alias("inside"))
    inside, outside = ids.where("inside"), ids.where("NOT inside")
    to = lambda a, b: a.select("pid", x, y, "inside").join(nearest(a, b, [x, y], reach).select("pid", F.sqrt("d2").alias("d")), "pid", "left")
    both = to(inside, outside).union(to(outside, inside)).withColumn("d", F.coalesce("d", F.lit(float(reach))))
    return both.select(x, y, F.when(F.col("inside"), F.col("d")).otherwise(-F.col("d")).alias(name))


def interpolated_masks(lower: DataFrame, upper: DataFrame, x: str, y: str, value: str, weight: float, reach: float) -> DataFrame:
    """A mask between two masks: where the weighted sum of their signed distances to the edge is positive.

    A distance is to the nearest pixel of the other kind, reach at most.
    """
    from veldmark.operators.spatial import nearest

    def signed(mask: DataFrame, name: str) -> DataFrame:
        ids = mask.select(F.struct(x, y).alias("pid"), x, y, value)
        inside, outside = ids.where(F.col(value) != 0), ids.where(F.col(value) == 0)
        to = lambda a, b: a.select("pid").join(nearest(a, b, [x, y], reach).select("pid", F.sqrt("d2").alias("d")), "pid", "left").withColumn("d", F.coalesce("d", F.lit(reach)))
        return to(inside, outside).select("pid", F.col("d").alias(name)).union(to(outside, inside).select("pid", (-F.col("d")).alias(name)))

    both = signed(lower, "_a").join(signed(upper, "_b"), "pid")
    return both.select(F.col(f"pid.{x}").alias(x), F.col(f"pid.{y}").alias(y), ((F.col("_a") * (1 - weight) + F.col("_b") * weight) > 0).cast("int").alias(value))


def local_contrast(df: DataFrame, x: str, y: str, value: str, radius: int, deviations: float = 3.0) -> DataFrame:
    """Each value against the mean and deviation of its square window, scaled so that the given deviations span 0..1."""
    along = W.partitionBy(y).orderBy(x).rangeBetween(-radius, radius)
    across = W.partitionBy(x).orderBy(y).rangeBetween(-radius, radius)
    v = F.col(value).cast("double")
    rows = df.withColumns({"_n": F.count(value).over(along), "_s": F.sum(v).over(along), "_q": F.sum(v * v).over(along)})
    box = rows.withColumns({"_N": F.sum("_n").over(across), "_S": F.sum("_s").over(across), "_Q": F.sum("_q").over(across)})
    mean = F.col("_S") / F.col("_N")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_Q") / F.col("_N") - mean * mean))
    scaled = F.coalesce(F.try_divide(v - mean, 2 * deviations * spread), F.lit(0.0)) + 0.5
    return box.withColumn("contrast", F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))).drop("_n", "_s", "_q", "_N", "_S", "_Q")


def haar_bank(integral: DataFrame, x: str, y: str, value: str, size: int) -> DataFrame:
    """Block features at each pixel from an integral image: whole, left less right, top less bottom, centre less surround."""
    whole = block_sums(integral, x, y, value, size, size).withColumnRenamed("sum", "whole")
    half, third = size // 2, size // 3
    left = block_sums(integral, x, y, value, half, size).withColumnRenamed("sum", "left")
    top = block_sums(integral, x, y, value, size, half).withColumnRenamed("sum", "top")
    centre = translated(block_sums(integral, x, y, value, third, third).withColumnRenamed("sum", "centre"), {x: -third, y: -third})
    joined = whole.join(left, [x, y]).join(top, [x, y]).join(centre, [x, y])
    area = size * size
    return joined.select(x, y, (F.col("whole") / area).alias("mean"), (2 * F.col("left") - F.col("whole")).alias("left_right"), (2 * F.col("top") - F.col("whole")).alias("top_bottom"), (F.col("centre") / (third * third) - F.col("whole") / area).alias("centre_surround"))
