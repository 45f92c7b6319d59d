"""Features of scale space: extrema over octaves with their directions and 128 numbers, of images of any size, and their matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veldmark.operators.images import gaussian_kernel
from veldmark.operators.peaks import along, mirrored
from veldmark.session import cut

#: A feature's square has so many cells a side, each so many scales wide, and so many directions a cell.
CELLS, CELL, TURNS = 4, 3.0, 8
#: Bins of the directions round a feature, and the share of the fullest that makes another feature.
BINS, ALSO = 36, 0.8
FEATURE = "x double, y double, scale double, angle double, value double, descriptor array<float>"
PART = "_low array<int>, _size array<int>, _data array<double>"


def extrema(stack: np.ndarray, inside: np.ndarray, least: float, edge: float) -> list[tuple[int, int, int, float, float, float, float]]:
    """Places (layer, x, y, their moves to the top of a parabola in all three, value there) of a stack with a margin of one that are above or below all 26 neighbours.

    Those whose top lies over a pixel away, whose value is under least or that
    bend edge times as much along one direction as along the other are left out.
    """
    c = stack[1:-1, 1:-1, 1:-1]
    high, low = (c > least / 2) & inside, (c < -least / 2) & inside
    for i in range(27):
        if i != 13:
            d, x, y = i // 9, i // 3 % 3, i % 3
            other = stack[d : d + c.shape[0], x : x + c.shape[1], y : y + c.shape[2]]
            high &= c > other
            low &= c < other
    at = np.argwhere(high | low) + 1
    if not len(at):
        return []
    v = lambda *step: stack[tuple((at + np.array(step)).T)]
    unit = np.eye(3, dtype=int)
    slope = np.stack([(v(*u) - v(*-u)) / 2 for u in unit], 1)
    bend = np.empty((len(at), 3, 3))
    for i in range(3):
        bend[:, i, i] = v(*unit[i]) - 2 * v(0, 0, 0) + v(*-unit[i])
        for j in range(i):
            a, b = unit[i] + unit[j], unit[i] - unit[j]
            bend[:, i, j] = bend[:, j, i] = (v(*a) + v(*-a) - v(*b) - v(*-b)) / 4
    solid = np.abs(np.linalg.det(bend)) > 1e-300
    at, slope, bend = at[solid], slope[solid], bend[solid]
    moved = -np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
    value = v(0, 0, 0) + (slope * moved).sum(1) / 2
    sum_, product = bend[:, 1, 1] + bend[:, 2, 2], bend[:, 1, 1] * bend[:, 2, 2] - bend[:, 1, 2] ** 2
    kept = (np.abs(moved) <= 1).all(1) & (np.abs(value) >= least) & (sum_**2 * edge < (edge + 1) ** 2 * product)
    return [(*map(int, a), *map(float, m), float(t)) for a, m, t in zip(at[kept], moved[kept], value[kept], strict=True)]


def _window(px: float, py: float, reach: float, low: tuple[int, int], high: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    return np.meshgrid(np.arange(max(low[0], int(np.ceil(px - reach))), min(high[0], int(np.floor(px + reach))) + 1), np.arange(max(low[1], int(np.ceil(py - reach))), min(high[1], int(np.floor(py + reach))) + 1), indexing="ij")


def directions(gx: np.ndarray, gy: np.ndarray, px: float, py: float, scale: float, low: tuple[int, int], high: tuple[int, int]) -> list[float]:
    """Angles of the fullest bins of the slopes round a place, weighed by distance, of pixels from low to high."""
    x, y = _window(px, py, 4.5 * scale, low, high)
    far = (x - px) ** 2 + (y - py) ** 2
    x, y, far = x[far <= (4.5 * scale) ** 2], y[far <= (4.5 * scale) ** 2], far[far <= (4.5 * scale) ** 2]
    a, b = gx[x, y], gy[x, y]
    weight = np.hypot(a, b) * np.exp(-far / (2 * (1.5 * scale) ** 2))
    bin_ = np.arctan2(b, a) % (2 * np.pi) * BINS / (2 * np.pi)
    whole = np.floor(bin_).astype(int)
    h = np.bincount(whole % BINS, weight * (1 - (bin_ - whole)), BINS) + np.bincount((whole + 1) % BINS, weight * (bin_ - whole), BINS)
    for _ in range(2):
        h = (np.roll(h, 1) + h + np.roll(h, -1)) / 3
    left, right = np.roll(h, 1), np.roll(h, -1)
    tops = np.flatnonzero((h > left) & (h > right) & (h >= ALSO * h.max()))
    return [float((k + 0.5 * (left[k] - right[k]) / (left[k] - 2 * h[k] + right[k])) * 2 * np.pi / BINS % (2 * np.pi)) for k in tops]


def described(gx: np.ndarray, gy: np.ndarray, px: float, py: float, scale: float, angle: float, low: tuple[int, int], high: tuple[int, int]) -> np.ndarray:
    """128 numbers: slopes by cell and direction in the turned square round a place, shared among the nearest bins, of length 1 with none over a fifth."""
    x, y = _window(px, py, CELL * scale * (CELLS + 1) / 2 * np.sqrt(2), low, high)
    dx, dy = (x - px).ravel(), (y - py).ravel()
    u, v = (np.cos(angle) * dx + np.sin(angle) * dy) / (CELL * scale), (np.cos(angle) * dy - np.sin(angle) * dx) / (CELL * scale)
    near = (np.abs(u) < (CELLS + 1) / 2) & (np.abs(v) < (CELLS + 1) / 2)
    x, y, u, v = x.ravel()[near], y.ravel()[near], u[near], v[near]
    a, b = gx[x, y], gy[x, y]
    weight = np.hypot(a, b) * np.exp(-(u * u + v * v) / (CELLS * CELLS / 2))
    bins = [u + (CELLS - 1) / 2, v + (CELLS - 1) / 2, (np.arctan2(b, a) - angle) % (2 * np.pi) * TURNS / (2 * np.pi)]
    whole = [np.floor(p).astype(int) for p in bins]
    h = np.zeros((CELLS + 2, CELLS + 2, TURNS))
    for i in range(8):
        up = (i >> 2, i >> 1 & 1, i & 1)
        share = weight.copy()
        for p, w, s in zip(bins, whole, up, strict=True):
            share *= p - w if s else 1 - (p - w)
        np.add.at(h, (whole[0] + up[0] + 1, whole[1] + up[1] + 1, (whole[2] + up[2]) % TURNS), share)
    h = h[1:-1, 1:-1].ravel()
    h = np.minimum(h / max(np.linalg.norm(h), 1e-12), 0.2)
    return (h / max(np.linalg.norm(h), 1e-12)).astype(np.float32)


class Octave:
    """Smoothings and margins of an octave: layers of it lie 2^(1/layers) apart."""

    def __init__(self, first: bool, layers: int, sigma: float, given: float) -> None:
        self.layers, self.sigma = layers, sigma
        self.start = gaussian_kernel((sigma**2 - given**2) ** 0.5) if first and sigma > given else np.ones(1)
        self.kernels = [np.ones(1)] + [gaussian_kernel(sigma * (4 ** (i / layers) - 1) ** 0.5) for i in range(1, layers + 3)]
        self.smooth = max(len(k) // 2 for k in self.kernels)
        # as far as a feature of the coarsest layer looks, and one for slopes
        self.look = int(np.ceil(CELL * sigma * 2 ** ((layers + 1) / layers) * (CELLS + 1) / 2 * np.sqrt(2))) + 2
        self.margin = self.look + self.smooth + len(self.start) // 2

    def found(self, a: np.ndarray, begin: tuple[int, int], size: tuple[int, int], extent: tuple[int, int], least: float, edge: float) -> tuple[list[tuple], np.ndarray]:
        """Features (x, y, scale, angle, value, descriptor) of the block of an image that a holds with a margin, and the block's smoothed pixels at even places for the next octave."""
        for k in (0, 1):
            a = along(a, self.start, k, len(self.start) // 2)
        for_all = []
        for kernel in self.kernels:
            s = a
            for k in (0, 1):
                s = along(s, kernel, k, self.smooth)
            for_all.append(s)
        look, (w, h) = self.look, extent
        own = tuple(slice(look - 1, look + n + 1) for n in size)
        stack = np.stack([for_all[i + 1][own] - for_all[i][own] for i in range(self.layers + 2)])
        # pixels of an image's rim have no slope
        inside = np.ones((self.layers, *size), bool)
        for k, n in enumerate(extent):
            p = np.arange(begin[k], begin[k] + size[k])
            inside &= ((p > 0) & (p < n - 1)).reshape([1, -1, 1] if k == 0 else [1, 1, -1])
        # of pixels from low to high slopes are known
        low = tuple(max(1, 1 - b + look) for b in begin)
        high = tuple(min(m - 2, n - 2 - b + look) for m, n, b in zip(for_all[0].shape, (w, h), begin, strict=True))
        slopes, out = {}, []
        for layer, x, y, to, mx, my, value in extrema(stack, inside, least, edge):
            at = layer + to
            scale, nearest = self.sigma * 2 ** (at / self.layers), int(np.clip(round(at), 1, self.layers))
            if nearest not in slopes:
                slopes[nearest] = [(np.roll(for_all[nearest], -1, k) - np.roll(for_all[nearest], 1, k)) / 2 for k in (0, 1)]
            gx, gy = slopes[nearest]
            px, py = x - 1 + look + mx, y - 1 + look + my
            for angle in directions(gx, gy, px, py, scale, low, high):
                out.append((px - look + begin[0], py - look + begin[1], scale, angle, value, described(gx, gy, px, py, scale, angle, low, high)))
        even = for_all[self.layers][tuple(slice(look + b % 2, look + n, 2) for b, n in zip(begin, size, strict=True))]
        return out, even


def scale_features(image: DataFrame, x: str, y: str, value: str, by: tuple[str, ...] = (), octaves: int = 4, layers: int = 3, sigma: float = 1.6, given: float = 0.5, least: float = 0.01, edge: float = 10.0, block: int = 512) -> DataFrame:
    """Features of images: by, x, y, scale (pixels), angle (from x towards y), value of the difference, and 128 numbers, an array of floats of length 1.

    Each octave has half the pixels a side of the one before and is a job of its own, cut from the next;
    blocks get the pixels round them that their features look at, so
    what comes out doesn't hang on how an image is cut. An octave is left out where a side has
    under 8 pixels. An image is the interval from its least to its greatest whole-numbered
    x and y, mirrored beyond; pixels without a row, null and nan ones are 0, of repeated
    ones the largest counts, rows with a null place play no part. given is the
    smoothing that images come with. A block with its margins fits in a task.
    """
    keys = list(by)
    number = F.col(value).cast("double")
    rows = image.select(*keys, F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), F.when(F.isnan(number), None).otherwise(number).alias("_v")).na.drop(subset=["_x", "_y"])
    bounds = rows.groupBy(*keys).agg(F.array(F.min("_x"), F.min("_y")).alias("_first"), F.array(F.max("_x") - F.min("_x") + 1, F.max("_y") - F.min("_y") + 1).cast("array<int>").alias("_extent"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        bounds = bounds.withColumnRenamed(k, f"_k{i}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # without keys one row
    placed = rows.join(bounds if keys else F.broadcast(bounds), same).select(*keys, "_first", "_extent", "_x", "_y", "_v")
    local = [(F.col(f"_{a}") - F.get("_first", F.lit(k))).cast("int") for k, a in enumerate("xy")]
    cell = F.struct(*[F.pmod(p, F.lit(block)).cast("int").alias(n) for p, n in zip(local, ("i", "j"), strict=True)], F.col("_v").alias("v"))
    cells = placed.groupBy(*keys, "_first", "_extent", *[F.floor(p / block).cast("int").alias(n) for p, n in zip(local, ("_bx", "_by"), strict=True)]).agg(F.collect_list(cell).alias("_cells"))

    head = StructType([*(cells.schema[k] for k in keys), *StructType.fromDDL("_first array<long>, _extent array<int>")])
    part_kind = StructType([*head, *StructType.fromDDL(PART)])
    part_target = to_arrow_schema(part_kind)

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.slice(r, 1)
                extent, at = own.column("_extent")[0].as_py(), [own.column(n)[0].as_py() * block for n in ("_bx", "_by")]
                a = np.full([min(block, e - s) for e, s in zip(extent, at, strict=True)], -np.inf)
                held = own.column("_cells")[0].values
                i, j, v = (held.field(n).to_numpy(zero_copy_only=False) for n in ("i", "j", "v"))
                v = v.astype(float)
                known = ~np.isnan(v)
                np.maximum.at(a, (i[known], j[known]), v[known])
                a[np.isneginf(a)] = 0.0
                values = [[at], [list(a.shape)], [a.ravel()]]
                yield pa.RecordBatch.from_arrays([*(own.column(n) for n in head.names), *(pa.array(q, f.type) for q, f in zip(values, list(part_target)[len(head) :], strict=True))], schema=part_target)

    parts, features = cells.mapInArrow(dense, part_kind), []
    kind = StructType([*head, *StructType.fromDDL(f"{FEATURE}, {PART}")])
    target = to_arrow_schema(kind)
    for number_ in range(octaves):
        octave = Octave(number_ == 0, layers, sigma, given)
        parts = parts.where((F.get("_extent", F.lit(0)) >= 8) & (F.get("_extent", F.lit(1)) >= 8))
        sent = parts
        for k, n in enumerate(("_bx", "_by")):
            low, size, extent = (F.get(c, F.lit(k)) for c in ("_low", "_size", "_extent"))
            # blocks whose margin reaches the part
            least_block, last_block = F.greatest(low - octave.margin, F.lit(0)) / block, (F.least(low + size + octave.margin, extent) - 1) / block
            sent = sent.withColumn(n, F.explode(F.sequence(F.floor(least_block).cast("int"), F.floor(last_block).cast("int"))))
        gathered = sent.groupBy(*head.names, "_bx", "_by").agg(F.collect_list(F.struct("_low", "_size", "_data")).alias("_parts"))

        def found(batches: Iterator[pa.RecordBatch], octave: Octave = octave, number_: int = number_) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    own = batch.slice(r, 1)
                    extent, first = (own.column(n)[0].as_py() for n in ("_extent", "_first"))
                    begin = [own.column(n)[0].as_py() * block for n in ("_bx", "_by")]
                    size = [min(block, e - b) for e, b in zip(extent, begin, strict=True)]
                    base = [max(0, b - octave.margin) for b in begin]
                    end = [min(e, b + s + octave.margin) for e, b, s in zip(extent, begin, size, strict=True)]
                    a = np.zeros([e - b for e, b in zip(end, base, strict=True)])
                    held = own.column("_parts")[0].values
                    for low, n, data in zip(held.field("_low").to_pylist(), held.field("_size").to_pylist(), held.field("_data"), strict=True):
                        there = [(max(p, b), min(p + m, e)) for p, m, b, e in zip(low, n, base, end, strict=True)]
                        if all(f < e for f, e in there):
                            whole = data.values.to_numpy(zero_copy_only=False).reshape(n)
                            a[tuple(slice(f - b, e - b) for (f, e), b in zip(there, base, strict=True))] = whole[tuple(slice(f - p, e - p) for (f, e), p in zip(there, low, strict=True))]
                    at = [mirrored(np.arange(b - octave.margin, b + s + octave.margin), 0, e - 1) - o for b, s, e, o in zip(begin, size, extent, base, strict=True)]
                    done, even = octave.found(a[np.ix_(*at)], tuple(begin), tuple(size), tuple(extent), least, edge)
                    unit = 2**number_
                    columns = [[first[0] + f[0] * unit for f in done], [first[1] + f[1] * unit for f in done], [f[2] * unit for f in done], [f[3] for f in done], [f[4] for f in done], [f[5] for f in done]]
                    columns = [[*c, None] for c in columns] + [[None] * len(done) + [q] for q in ([(b + 1) // 2 for b in begin], list(even.shape), even.ravel())]
                    own = own.take(pa.array(np.zeros(len(done) + 1, np.int64)))
                    halved = pa.array([[(e + 1) // 2 for e in extent]] * (len(done) + 1), target.field("_extent").type)
                    yield pa.RecordBatch.from_arrays([*(own.column(n) for n in (*keys, "_first")), halved, *(pa.array(c, f.type) for c, f in zip(columns, list(target)[len(head) :], strict=True))], schema=target)

        both = cut(gathered.mapInArrow(found, kind))
        features.append(both.where("x IS NOT NULL").select(*keys, "x", "y", "scale", "angle", "value", "descriptor"))
        parts = both.where("_data IS NOT NULL").select(*part_kind.names)
    out = features[0]
    for f in features[1:]:
        out = out.union(f)
    return out


def descriptor_matches(a: DataFrame, b: DataFrame, by: list[str], id_col: str, ratio: float = 0.8, scales: float = 1.5, reach: float | None = None, area: float = 512.0) -> DataFrame:
    """Features of a with the nearest of b by their 128 numbers, if at most ratio times as far as the second nearest: by, id_col, other, distance, x, y, other_x, other_y.

    Of a feature those of b count whose scale is at most scales times larger or
    smaller, and, where reach is given, that lie within reach; images are those with equal by, a
    null there matches none. Ties go to the smaller id, and then only a ratio of 1 or more
    lets them pass; an only candidate stays. Areas of both images meet as arrays in one product each: with reach
    only those beside each other, else each of a with each of b of its image. An area's features fit in a task.
    """
    area = max(area, reach or 0.0)
    at = lambda axis: F.floor(F.col(axis) / area)
    pack = lambda df, name: df.groupBy(*by, at("x").alias("_ax"), at("y").alias("_ay")).agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "x", "y", "scale", "descriptor")).alias(name))
    left, right = pack(a, "_a"), pack(b, "_b")
    on = list(by)
    if reach is None:
        right = right.drop("_ax", "_ay")
    else:
        around: Column = F.array(*[F.lit(s) for s in (-1, 0, 1)])
        for c in ("_ax", "_ay"):
            left = left.withColumn("_step", F.explode(around)).withColumn(c, F.col(c) + F.col("_step")).drop("_step")
        on += ["_ax", "_ay"]
    if not on:
        left, right, on = left.withColumn("_one", F.lit(1)), right.withColumn("_one", F.lit(1)), ["_one"]
    pairs = left.join(right, on).select(*by, "_a", "_b")
    id_kind = dict(a.dtypes)[id_col]
    kind = StructType([*(pairs.schema[c] for c in by), *StructType.fromDDL(f"`{id_col}` {id_kind}, other {dict(b.dtypes)[id_col]}, distance double, x double, y double, other_x double, other_y double")])
    target = to_arrow_schema(kind)

    def numbers(held: pa.StructArray) -> tuple[np.ndarray, ...]:
        x, y, scale = (held.field(n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y", "scale"))
        return x, y, scale, np.stack([d.values.to_numpy(zero_copy_only=False) for d in held.field("descriptor")]).astype(float)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.slice(r, 1)
                one, two = own.column("_a")[0].values, own.column("_b")[0].values
                two = two.take(pa.array(np.argsort(np.array(two.field("id").to_pylist()), kind="stable")))
                (ax, ay, ascale, ad), (bx, by_, bscale, bd) = numbers(one), numbers(two)
                found_a, found_b, found_d = [], [], []
                for start in range(0, len(ad), 1024):
                    s = slice(start, start + 1024)
                    d = np.sqrt(np.maximum((ad[s] ** 2).sum(1)[:, None] + (bd**2).sum(1)[None] - 2 * ad[s] @ bd.T, 0.0))
                    far = np.maximum(ascale[s][:, None] / bscale[None], bscale[None] / ascale[s][:, None]) > scales
                    if reach is not None:
                        far |= (ax[s][:, None] - bx[None]) ** 2 + (ay[s][:, None] - by_[None]) ** 2 > reach * reach
                    d[far] = np.inf
                    for k in range(min(2, len(bd))):
                        best = d.argmin(1)
                        value = d[np.arange(len(d)), best]
                        some = np.isfinite(value)
                        found_a.append(np.flatnonzero(some) + start)
                        found_b.append(best[some])
                        found_d.append(value[some])
                        d[np.arange(len(d)), best] = np.inf
                i, j, v = (np.concatenate(f) if f else np.zeros(0) for f in (found_a, found_b, found_d))
                i, j = i.astype(np.int64), j.astype(np.int64)
                columns = [one.field("id").take(pa.array(i)), two.field("id").take(pa.array(j)), v, ax[i], ay[i], bx[j], by_[j]]
                yield pa.RecordBatch.from_arrays([*(own.column(c).take(pa.array(np.zeros(len(i), np.int64))) for c in by), *(c if isinstance(c, pa.Array) else pa.array(c, pa.float64()) for c in columns)], schema=target)

    near = pairs.mapInArrow(nearest, kind)
    w = W.partitionBy(*by, id_col).orderBy("distance", "other")
    ranked = near.withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.lead("distance").over(w))
    return ranked.where((F.col("_rank") == 1) & (F.col("_second").isNull() | (F.col("distance") <= F.col("_second") * ratio))).drop("_rank", "_second")
