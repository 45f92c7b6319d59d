"""Block matching between planes by normalised correlation, and contrast limited by tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Sides of the squares that planes are passed on in.
SQUARE = 64
#: Correlations closer than this count as equal: a plateau has no single best place.
EQUAL = 1e-9


def squares(plane: DataFrame, x: str, y: str, value: str, by: list[str], side: int = SQUARE) -> DataFrame:
    """A plane as squares: by, _tx, _ty, cells (x, y, v). A null value is no pixel."""
    cell = F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"), F.col(value).cast("double").alias("v"))
    kept = plane.where(F.col(value).isNotNull())
    return kept.groupBy(*by, F.floor(F.col(x) / side).alias("_tx"), F.floor(F.col(y) / side).alias("_ty")).agg(F.collect_list(cell).alias("cells"))


def _around(points: DataFrame, plane: DataFrame, x: str, y: str, value: str, by: list[str], reach: int, name: str, side: int) -> DataFrame:
    """Each point with the cells of the squares that its window touches: a join by square, so only windows near an edge need its neighbours."""
    span = lambda c: F.sequence(F.floor((F.col(c) - reach) / side), F.floor((F.col(c) + reach) / side))
    wanted = points.withColumn("_tx", F.explode(span("px"))).withColumn("_ty", F.explode(span("py")))
    inside = lambda c: (F.abs(c["x"] - F.col("px")) <= reach) & (F.abs(c["y"] - F.col("py")) <= reach)
    found = wanted.join(squares(plane, x, y, value, by, side), [*by, "_tx", "_ty"])
    return found.withColumn("cells", F.filter("cells", inside)).groupBy(*by, "px", "py").agg(F.flatten(F.collect_list("cells")).alias(name))


def window(cells: list[dict], px: int, py: int, reach: int) -> np.ndarray:
    """The window of a point, nan where there is no pixel."""
    out = np.full((2 * reach + 1, 2 * reach + 1), np.nan)
    for c in cells or ():
        out[c["y"] - py + reach, c["x"] - px + reach] = c["v"]
    return out


def correlations(block: np.ndarray, area: np.ndarray) -> np.ndarray:
    """Pearson's correlation of a block with each place of it in an area, nan where the area has gaps or no variance.

    Products come from one transform of the whole area, sums of values and of
    squares from integral images. Both are taken about the area's mean, so that
    squares stay small.
    """
    n, (h, w) = block.size, block.shape
    gaps = np.isnan(area)
    middle = np.nanmean(area) if not gaps.all() else 0.0
    a, b = np.where(gaps, 0.0, area - middle), block - block.mean()
    shape = (a.shape[0] + h - 1, a.shape[1] + w - 1)
    products = np.fft.irfft2(np.fft.rfft2(a, shape) * np.fft.rfft2(b[::-1, ::-1], shape), shape)[h - 1 : a.shape[0], w - 1 : a.shape[1]]

    def sums(v: np.ndarray) -> np.ndarray:
        whole = np.pad(v, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
        return whole[h:, w:] - whole[:-h, w:] - whole[h:, :-w] + whole[:-h, :-w]

    spread = sums(a * a) - sums(a) ** 2 / n
    own = (b * b).sum()
    good = (sums(gaps.astype(float)) < 0.5) & (spread > 1e-12 * max(1.0, (a * a).max()) * n) & (own > 0)
    return np.where(good, products / np.sqrt(np.where(good, spread * own, 1.0)), np.nan)


def best_place(r: np.ndarray) -> dict:
    """Where correlations are greatest, first by row, then by column, of those equal to it; the greatest of those that don't touch it; the parabola's top and the bend there.

    bend is the square of the trace over the determinant of the second
    differences, which a narrow ridge makes large; null at the area's edge, beside a gap, or without a top.
    """
    out = {"dx": None, "dy": None, "r": None, "second": None, "bend": None, "fx": None, "fy": None}
    if np.isnan(r).all():
        return out
    filled = np.where(np.isnan(r), -np.inf, r)
    top = float(filled.max())
    i, j = (int(v) for v in np.argwhere(filled >= top - EQUAL)[0])
    reach = len(r) // 2
    far = filled.copy()
    far[max(0, i - 1) : i + 2, max(0, j - 1) : j + 2] = -np.inf
    out |= {"dx": j - reach, "dy": i - reach, "r": float(filled[i, j]), "second": float(far.max()) if np.isfinite(far.max()) else None, "fx": float(j - reach), "fy": float(i - reach)}
    if 0 < i < len(r) - 1 and 0 < j < r.shape[1] - 1 and not np.isnan(r[i - 1 : i + 2, j - 1 : j + 2]).any():
        dxx, dyy = r[i, j - 1] - 2 * r[i, j] + r[i, j + 1], r[i - 1, j] - 2 * r[i, j] + r[i + 1, j]
        dxy = (r[i + 1, j + 1] - r[i + 1, j - 1] - r[i - 1, j + 1] + r[i - 1, j - 1]) / 4
        dx, dy = (r[i, j + 1] - r[i, j - 1]) / 2, (r[i + 1, j] - r[i - 1, j]) / 2
        det = dxx * dyy - dxy * dxy
        if det > 1e-12:
            out["bend"] = float((dxx + dyy) ** 2 / det)
            out["fx"] += float(np.clip(-(dyy * dx - dxy * dy) / det, -1, 1))
            out["fy"] += float(np.clip(-(dxx * dy - dxy * dx) / det, -1, 1))
    return out


MATCH = "dx int, dy int, r double, second double, bend double, fx double, fy double, accepted boolean"


def block_matches(source: DataFrame, target: DataFrame, points: DataFrame, x: str, y: str, value: str, by: tuple[str, ...] = (), block: int = 8, search: int = 8, least: float = 0.1, ratio: float = 0.9, bend: float = 10.0, side: int = SQUARE) -> DataFrame:
    """Where the block round each point of the source lies in the target: by, px, py and MATCH.

    points: by, px, py, whole numbers, each once. A block is 2 block + 1 wide and
    is looked for at shifts up to search. dx, dy is the shift of greatest
    correlation r, fx, fy its parabola's top. A match is accepted if r is at least
    `least`, (1 + second) / (1 + r) at most ratio, second being the greatest
    correlation that doesn't touch the best one, and bend at most
    (bend + 1)^2 / bend, so ridges go. Shifts for which the target has a gap don't
    count; points whose block has a gap in the source, or no variance, have null
    values and aren't accepted. Windows are bounded: no plane is in one task.
    """
    keys = list(by)
    places = points.select(*keys, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).distinct()
    both = places.join(_around(places, source, x, y, value, keys, block, "_a", side), [*keys, "px", "py"], "left")
    both = both.join(_around(places, target, x, y, value, keys, block + search, "_b", side), [*keys, "px", "py"], "left")
    kind = StructType([*(places.schema[k] for k in [*keys, "px", "py"]), *StructType.fromDDL(MATCH)])
    made, most = to_arrow_schema(kind), (bend + 1) ** 2 / bend

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                rows = []
                for r in batch.select(["px", "py", "_a", "_b"]).to_pylist():
                    own = window(r["_a"], r["px"], r["py"], block)
                    blank = np.isnan(own).any() or np.ptp(own) == 0
                    found = best_place(np.full((2 * search + 1,) * 2, np.nan) if blank else correlations(own, window(r["_b"], r["px"], r["py"], block + search)))
                    found["accepted"] = found["r"] is not None and found["r"] >= least and (found["second"] is None or (1 + found["second"]) / (1 + found["r"]) <= ratio) and found["bend"] is not None and found["bend"] <= most
                    rows.append(found)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, "px", "py"]), *(pa.array([r[f.name] for r in rows], f.type) for f in list(made)[len(keys) + 2 :])], schema=made)

    return both.select(*keys, "px", "py", "_a", "_b").mapInArrow(run, kind)


def equalised(plane: DataFrame, x: str, y: str, value: str, low: float, high: float, tile: int = 127, bins: int = 256, slope: float = 3.0, name: str = "contrast", by: tuple[str, ...] = ()) -> DataFrame:
    """Contrast limited adaptive equalisation: plane and name, from 0 to 1.

    Values from low to high fall into bins. Each tile's counts are cut at slope
    times their mean (1 at least) and what is cut goes to all bins alike; the share of
    counts up to a bin is its new value. A pixel's value is blended from the
    tables of the four tiles whose middles surround it; beyond the outer middles
    the nearest tile counts. A null value gives null and isn't counted; a tile
    without pixels stands back for those of the four that have some.

    Pixels are gathered by the square between four middles, so tables are joined
    once a square, not once a pixel. No Python.
    """
    keys = list(by)
    bin_ = F.when(F.col(value).isNotNull(), F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / (high - low) * bins)))).cast("int")
    rows = plane.withColumn("_bin", bin_)
    tiles = rows.where("_bin IS NOT NULL").groupBy(*keys, F.floor(F.col(x) / tile).alias("_tx"), F.floor(F.col(y) / tile).alias("_ty"), "_bin").agg(F.count(F.lit(1)).alias("_n"))
    counted = tiles.groupBy(*keys, "_tx", "_ty").agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_counts"), F.sum("_n").alias("_total"))
    limit = F.greatest(F.lit(1.0), F.col("_total") * slope / bins)
    held = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.least(F.coalesce(F.try_element_at("_counts", i), F.lit(0)).cast("double"), F.col("_limit")))
    cut_ = counted.withColumn("_limit", limit).withColumn("_held", held).withColumn("_over", (F.col("_total") - F.aggregate("_held", F.lit(0.0), lambda a, b: a + b)) / bins)
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("t"))
    summed = F.aggregate("_held", start, lambda a, v: F.struct((a["s"] + v).alias("s"), F.concat(a["t"], F.array(a["s"] + v)).alias("t")), lambda a: a["t"])
    tables = cut_.select(*keys, "_tx", "_ty", F.transform(summed, lambda s, i: (s + (i + 1) * F.col("_over")) / F.col("_total")).alias("_table"))
    # squares between middles: square k lies between the middles of tiles k - 1 and k
    square = lambda c: F.floor((F.col(c) - (tile - 1) / 2) / tile) + 1
    gathered = rows.groupBy(*keys, square(x).alias("_sx"), square(y).alias("_sy")).agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("_pixels"))
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    four = gathered.select(*keys, "_sx", "_sy", F.explode(corners).alias("_c")).withColumns({"_tx": F.col("_sx") - 1 + F.col("_c.i"), "_ty": F.col("_sy") - 1 + F.col("_c.j")})
    found = four.join(tables, [*keys, "_tx", "_ty"]).groupBy(*keys, "_sx", "_sy").agg(F.collect_list(F.struct("_c", "_table")).alias("_tables"))
    joined = gathered.join(found, [*keys, "_sx", "_sy"], "left")
    share = lambda p, axis, side: F.when(side == 1, (p[axis] - (tile - 1) / 2) / tile - (F.col("_sx" if axis == x else "_sy") - 1)).otherwise(1 - ((p[axis] - (tile - 1) / 2) / tile - (F.col("_sx" if axis == x else "_sy") - 1)))
    weight = lambda p, t: share(p, x, t["_c"]["i"]) * share(p, y, t["_c"]["j"])
    parts = lambda p: F.aggregate("_tables", F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda a, t: F.struct((a["v"] + weight(p, t) * F.get(t["_table"], p["_bin"])).alias("v"), (a["w"] + weight(p, t)).alias("w")), lambda a: F.try_divide(a["v"], a["w"]))
    blended = F.transform("_pixels", lambda p: F.struct(p.alias("p"), parts(p).alias("n")))
    done = joined.select(F.explode(blended).alias("_r"))
    return done.select(*[F.col(f"_r.p.`{c}`").alias(c) for c in plane.columns], F.col("_r.n").alias(name))
