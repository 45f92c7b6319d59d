"""Features of the neighbourhood of each pixel: blocks, lines and edges, kernels and patches.

Images are rows (by, x, y, value). Blocks are sums over rows of pixels and then over
columns of those sums, within bands of rows, so no task has a whole column; pixels
outside the image count as 0 in blocks, and as the nearest pixel in kernels and patches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a band.
BAND = 256

Block = tuple[int, int, int, int]  # first and last x, first and last y, against the pixel


def banded(df: DataFrame, y: str, above: int, below: int, band: int = BAND) -> DataFrame:
    """Rows with the bands that need them, as _band: their own, and those that begin or end as near as that."""
    return df.withColumn("_band", F.explode(F.sequence(F.floor((F.col(y) - above) / band), F.floor((F.col(y) + below) / band))))


def with_blocks(df: DataFrame, blocks: dict[str, Block], x: str, y: str, value: str, by: tuple[str, ...] = (), band: int = BAND) -> DataFrame:
    """A column for each block with the sum of its pixels."""
    above, below = max(0, *(b[3] for b in blocks.values())), max(0, *(-b[2] for b in blocks.values()))
    rows = banded(df, y, above, below, band)
    spans = sorted({b[:2] for b in blocks.values()})
    along = W.partitionBy(*by, "_band", y).orderBy(x)
    rows = rows.withColumns({f"_s{i}": F.sum(value).over(along.rangeBetween(*s)) for i, s in enumerate(spans)})
    across = W.partitionBy(*by, "_band", x).orderBy(y)
    rows = rows.withColumns({name: F.coalesce(F.sum(f"_s{spans.index(b[:2])}").over(across.rangeBetween(*b[2:])), F.lit(0).cast("double")) for name, b in blocks.items()})
    return rows.where(F.col("_band") == F.floor(F.col(y) / band)).drop("_band", *[f"_s{i}" for i in range(len(spans))])


def pairs_and_lines(short: int, long: int) -> dict[str, Block]:
    """Two blocks side by side and one above the other, and three in a row either way, about the pixel."""
    half, mid = long // 2, short // 2
    upright = lambda at: (at, at + short - 1, -half, -half + long - 1)
    flat = lambda at: (-half, -half + long - 1, at, at + short - 1)
    return {
        "_vl": upright(-short), "_vr": upright(0), "_ht": flat(-short), "_hb": flat(0),
        "_vl3": upright(-short - mid), "_vc3": upright(-mid), "_vr3": upright(mid), "_ht3": flat(-short - mid), "_hc3": flat(-mid), "_hb3": flat(mid),
    }


def _ratio(a: str, b: str) -> Column:
    """The smaller over the larger."""
    return F.when(F.col(a) > F.col(b), F.try_divide(F.col(b), F.col(a))).otherwise(F.try_divide(F.col(a), F.col(b)))


def _line(a: str, centre: str, b: str) -> Column:
    """Sides less the centre where both are brighter, else the mean of the three."""
    a, centre, b = F.col(a), F.col(centre), F.col(b)
    return F.when((a > centre) & (b > centre), a + b - centre).otherwise((a + centre + b) / 3)


def haar_like(df: DataFrame, x: str, y: str, value: str, by: tuple[str, ...] = (), short: int = 4, long: int = 8, band: int = BAND) -> DataFrame:
    """Columns side_ratio and stack_ratio (of two blocks), upright_line and flat_line (of three)."""
    blocks = pairs_and_lines(short, long)
    done = with_blocks(df, blocks, x, y, value, by, band)
    return done.withColumns({"side_ratio": _ratio("_vl", "_vr"), "stack_ratio": _ratio("_ht", "_hb"), "upright_line": _line("_vl3", "_vc3", "_vr3"), "flat_line": _line("_ht3", "_hc3", "_hb3")}).drop(*blocks)


def orthogonal_edges(df: DataFrame, x: str, y: str, value: str, by: tuple[str, ...] = (), short: int = 4, long: int = 8, band: int = BAND) -> DataFrame:
    """Differences of two blocks in all four directions, lines of three, and a small block less a large one on its other side."""
    large = long + long // 2
    low, mid = large // 2, short // 2
    blocks = pairs_and_lines(short, long) | {
        "_ll": (-large, -1, -low, -low + large - 1), "_lr": (0, large - 1, -low, -low + large - 1), "_lt": (-low, -low + large - 1, -large, -1), "_lb": (-low, -low + large - 1, 0, large - 1),
        "_sr": (0, short - 1, -mid, -mid + short - 1), "_sl": (-short, -1, -mid, -mid + short - 1), "_sb": (-mid, -mid + short - 1, 0, short - 1), "_st": (-mid, -mid + short - 1, -short, -1),
    }
    less = lambda a, b: F.col(a) - F.col(b)
    done = with_blocks(df, blocks, x, y, value, by, band)
    return done.withColumns({
        "left": less("_vl", "_vr"), "right": less("_vr", "_vl"), "top": less("_ht", "_hb"), "bottom": less("_hb", "_ht"), "upright_line": _line("_vl3", "_vc3", "_vr3"), "flat_line": _line("_ht3", "_hc3", "_hb3"),
        "spot_right": less("_sr", "_ll"), "spot_left": less("_sl", "_lr"), "spot_bottom": less("_sb", "_lt"), "spot_top": less("_st", "_lb"),
    }).drop(*blocks)


def block_statistics(df: DataFrame, x: str, y: str, value: str, by: tuple[str, ...] = (), width: int = 5, height: int = 5, band: int = BAND) -> DataFrame:
    """mean_square over a block about the pixel, and spread: the sum of squares less the square of the sum, 0 at least."""
    span = lambda n: (-(n // 2), n // 2 - (n % 2 == 0))
    block = (*span(width), *span(height))
    sums = with_blocks(df, {"_sum": block}, x, y, value, by, band)
    squares = with_blocks(sums.withColumn("_sq", F.col(value) * F.col(value)), {"_squares": block}, x, y, "_sq", by, band)
    spread = F.greatest(F.lit(0.0), F.col("_squares") - F.col("_sum") * F.col("_sum"))
    return squares.withColumns({"mean_square": F.col("_squares") / (width * height), "spread": spread}).drop("_sum", "_sq", "_squares")


def patch(df: DataFrame, x: str, y: str, value: str, width: int, height: int, radius: int, by: tuple[str, ...] = (), name: str = "patch") -> DataFrame:
    """The pixels about each pixel of an image of width x height, row by row, as an array; the nearest pixel stands for one outside.

    Each pixel goes to those that see it, so the patches come together by position.
    """
    side = 2 * radius + 1
    reach = lambda c, n: F.filter(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: (F.col(c) + d >= 0) & (F.col(c) + d < n))
    seen = df.select(*by, x, y, value).withColumn("_dx", F.explode(reach(x, width))).withColumn("_dy", F.explode(reach(y, height)))
    # pixel (x, y) is at offset (-dx, -dy) of the one at (x + dx, y + dy)
    own = seen.select(*by, (F.col(x) + F.col("_dx")).alias(x), (F.col(y) + F.col("_dy")).alias(y), F.struct(((radius - F.col("_dy")) * side + radius - F.col("_dx")).alias("at"), F.col(value).alias("v")).alias("_p"))
    held = own.groupBy(*by, x, y).agg(F.map_from_entries(F.collect_list("_p")).alias("_held"))
    nearest = lambda c, n, d: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col(c) + d)) - F.col(c)
    places = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: ((nearest(y, height, F.floor(i / side) - radius) + radius) * side + nearest(x, width, i % side - radius) + radius).cast("int"))
    return held.select(*by, x, y, F.transform(places, lambda p: F.element_at("_held", p)).alias(name))


def kernel(patches: DataFrame, weights: list[float], name: str, column: str = "patch") -> DataFrame:
    """The weighted sum of each patch; the weights are a square of its size, row by row."""
    side = round(len(weights) ** 0.5)
    if side * side != len(weights) or side % 2 == 0:
        raise ValueError("weights are a square of odd width")
    total = F.aggregate(F.zip_with(column, F.array(*[F.lit(float(w)) for w in weights]), lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    return patches.withColumn(name, total)


# The four kernels that find edges.
EDGES = {"top": [-1, -1, -1, 0, 0, 0, 1, 1, 1], "bottom": [1, 1, 1, 0, 0, 0, -1, -1, -1], "left": [-1, 0, 1] * 3, "right": [1, 0, -1] * 3}


def edges(df: DataFrame, x: str, y: str, value: str, width: int, height: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Columns top, bottom, left and right: the response to each of the four kernels."""
    done = patch(df, x, y, value, width, height, 1, by)
    for name, weights in EDGES.items():
        done = kernel(done, weights, name)
    return done.drop("patch")


def turned(df: DataFrame, x: str, y: str, value: str, width: int, height: int, degrees: float) -> tuple[DataFrame, int, int, int, int]:
    """An image turned about its middle, on a plane that holds all of it: the image, its width and height, and how far its corner is from the old one's. The nearest pixel stands for what is outside."""
    from math import ceil, cos, floor, radians, sin

    from veldmark.operators.images import affine_sampled, functional, translated

    c, s, cx, cy = cos(radians(degrees)), sin(radians(degrees)), width / 2, height / 2
    corners = [(c * (px - cx) - s * (py - cy) + cx, s * (px - cx) + c * (py - cy) + cy) for px in (0, width - 1) for py in (0, height - 1)]
    low = [floor(round(min(p[i] for p in corners), 9)) for i in (0, 1)]
    high = [ceil(round(max(p[i] for p in corners), 9)) for i in (0, 1)]
    w, h = high[0] - low[0] + 1, high[1] - low[1] + 1
    wanted = translated(functional(df.sparkSession, w, h, lambda a, b: F.lit(0.0)).drop("v").toDF(x, y), {x: low[0], y: low[1]})
    back = [[c, s, cx - c * cx - s * cy], [-s, c, cy + s * cx - c * cy]]
    out = affine_sampled(df.select(x, y, value), wanted, back, [x, y], value, (width, height))
    return translated(out, {x: -low[0], y: -low[1]}), w, h, low[0], low[1]


def over_angles(df: DataFrame, x: str, y: str, value: str, width: int, height: int, angles: list[float], bank, names: list[str]) -> DataFrame:
    """A bank of features of the turned image, each turned back: x, y, and each name for each angle (name_angle). bank(df) adds columns of these names."""
    from veldmark.operators.images import translated

    out = df.select(x, y)
    for a in angles:
        if a == 0:
            done = bank(df).select(x, y, *[F.col(n).alias(f"{n}_0") for n in names])
            out = out.join(done, [x, y])
            continue
        image, w, h, dx, dy = turned(df, x, y, value, width, height, a)
        features = bank(image)
        for n in names:
            back, _, _, bx, by = turned(features.select(x, y, F.col(n).cast("double").alias(value)), x, y, value, w, h, -a)
            # the middle of the turned plane against that of the image
            shift = {x: bx + round(width / 2 - w / 2), y: by + round(height / 2 - h / 2)}
            out = out.join(translated(back, shift).select(x, y, F.col(value).alias(f"{n}_{a:g}")), [x, y])
    return out
