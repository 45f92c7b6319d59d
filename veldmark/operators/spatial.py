"""Points, neighbours, constellation features and their matches.

Searches go by blocks (nearby). Range joins go through a grid whose cells are as wide as the radius: a point meets the
points of its own and the neighbouring cells in an equi-join, and the distance decides.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.functions.numeric import angle_between
from veldmark.operators import nearby


def squared_distance(a: list, b: list) -> Column:
    return sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))


def _cells(axes: list[Column], size: float) -> Column:
    return F.struct(*[F.floor(a / size).alias(f"c{i}") for i, a in enumerate(axes)])


def radius_join(left: DataFrame, right: DataFrame, axes: list[str], radius: float, id_col: str = "pid", strict: bool = False, by: list[str] = ()) -> DataFrame:
    """Pairs of points at most radius apart (less than, if strict): by, id, other, d2. Each left point goes to 3^d cells."""
    shifts = F.array(*[F.struct(*[F.lit(s).alias(f"s{i}") for i, s in enumerate(shift)]) for shift in product((-1, 0, 1), repeat=len(axes))])
    a = left.select(*by, F.col(id_col).alias(id_col), *[F.col(x).cast("double").alias(f"a_{x}") for x in axes], _cells([F.col(x).cast("double") for x in axes], radius).alias("_c"))
    a = a.withColumn("_s", F.explode(shifts)).select("*", *[(F.col(f"_c.c{i}") + F.col(f"_s.s{i}")).alias(f"_g{i}") for i in range(len(axes))]).drop("_c", "_s")
    b = right.select(*by, F.col(id_col).alias("other"), *[F.col(x).cast("double").alias(f"b_{x}") for x in axes], *[F.floor(F.col(x).cast("double") / radius).alias(f"_g{i}") for i, x in enumerate(axes)])
    d2 = squared_distance([F.col(f"a_{x}") for x in axes], [F.col(f"b_{x}") for x in axes])
    joined = a.join(b, [*by, *[f"_g{i}" for i in range(len(axes))]]).withColumn("d2", d2)
    return joined.where(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius).select(*by, id_col, "other", "d2")


def neighbours(points: DataFrame, axes: list[str], radius: float, id_col: str = "pid", by: list[str] = ()) -> DataFrame:
    """Each point's neighbours within radius by distance; the point itself has rank 0. Equal distances go by id."""
    return nearby.ranked(points, axes, radius, id_col, by)


def nearest(points: DataFrame, seeds: DataFrame, axes: list[str], radius: float, id_col: str = "pid") -> DataFrame:
    """Each point's nearest seed closer than radius; points without one are left out."""
    return nearby.nearest_of_tag(points, seeds, axes, radius, id_col, strict=True)


def k_nearest(points: DataFrame, axes: list[str], k: int, radius: float, id_col: str = "pid") -> DataFrame:
    """The k + 1 nearest of each point within radius, itself first."""
    return nearby.ranked(points, axes, radius, id_col, most=k)


def k_nearest_anywhere(points: DataFrame, axes: list[str], k: int, start_radius: float, id_col: str = "pid") -> DataFrame:
    """The k + 1 nearest of each point at any distance: points with too few neighbours look again twice as far."""
    from veldmark.session import cut

    total = points.count()
    k, radius, done, rest = min(k, total - 1), start_radius, None, points
    while True:
        pairs = radius_join(rest, points, axes, radius, id_col)
        w = W.partitionBy(id_col).orderBy("d2", (F.col("other") != F.col(id_col)).cast("int"), "other")
        ranked = cut(pairs.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") <= k))
        full = ranked.where(F.col("rank") == k).select(id_col)
        found = ranked.join(full, id_col, "left_semi")
        done = found if done is None else done.union(found)
        rest = cut(rest.join(full, id_col, "left_anti"))
        if rest.isEmpty():
            return done
        radius *= 2


def by_ratio(matches: DataFrame, id_col: str, distance: str, ratio: float) -> DataFrame:
    """The best match of each id if it is at most ratio times as far as the second best; an only match stays."""
    w = W.partitionBy(id_col).orderBy(distance, "other")
    ranked = matches.withColumn("_rank", F.row_number().over(w)).withColumn("_second", F.lead(distance).over(w))
    return ranked.where((F.col("_rank") == 1) & (F.col("_second").isNull() | (F.try_divide(F.col(distance).cast("double"), F.col("_second")) <= ratio))).drop("_rank", "_second")


def constellations(points: DataFrame, axes: list[str], radius: float, min_angle: float, max_per_peak: int, id_col: str = "pid", by: list[str] = ()) -> DataFrame:
    """Features of each point: the angle and squared lengths to two neighbours that follow each other by distance.

    Pairs are taken from the farthest inwards; those with a smaller angle are left
    out, and a point has max_per_peak features at most.
    """
    found = nearby.outer_pairs(points, axes, radius, min_angle, max_per_peak, id_col, by)
    angle = lambda p: angle_between([p[x] - F.col(f"p_{x}") for x in axes], [p[f"n_{x}"] - F.col(f"p_{x}") for x in axes])
    angled = F.transform("pairs", lambda p: F.struct(angle(p).alias("angle"), p["len1"].alias("len1"), p["len2"].alias("len2")))
    wide = F.slice(F.filter(angled, lambda p: p["angle"] >= min_angle), 1, max_per_peak)
    return found.select(*by, id_col, F.posexplode(wide).alias("feature", "_f"), *[F.col(f"p_{x}").alias(x) for x in axes]).select(*by, id_col, "feature", "_f.angle", "_f.len1", "_f.len2", *axes)


def constellations_of_all_pairs(points: DataFrame, axes: list[str], radius: float, id_col: str = "pid") -> DataFrame:
    """Features of each point with every two of its neighbours."""
    found = nearby.neighbour_arrays(points, axes, radius, id_col).where(F.size("near") > 1)
    one = found.withColumn("i", F.explode(F.sequence(F.lit(1), F.size("near") - 1)))
    both = one.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("near"))))
    a, b = F.get("near", F.col("i") - 1), F.get("near", F.col("j") - 1)
    angle = angle_between([a[x] - F.col(f"p_{x}") for x in axes], [b[x] - F.col(f"p_{x}") for x in axes])
    return both.select(id_col, "i", "j", angle.alias("angle"), a["d2"].alias("len1"), b["d2"].alias("len2"), *[F.col(f"p_{x}").alias(x) for x in axes])


def constellations_of_k(points: DataFrame, axes: list[str], radius: float, k: int, id_col: str = "pid", max_per_peak: int = 10) -> DataFrame:
    """Features of each point with k of its neighbours, nearest first: all their angles and squared lengths as arrays; the point itself is no neighbour."""
    near = k_nearest(points, axes, k + max_per_peak - 1, radius, id_col).where("rank > 0").join(points.select(F.col(id_col).alias("other"), *[F.col(x).alias(f"n_{x}") for x in axes]), "other")
    packed = near.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("rank", "d2", *[f"n_{x}" for x in axes]))).alias("near")).join(points.select(id_col, *axes), id_col)
    starts = packed.where(F.size("near") >= k).select(id_col, *axes, F.explode(F.sequence(F.lit(0), F.size("near") - k)).alias("feature"), "near").where(F.col("feature") < max_per_peak)
    chosen = starts.withColumn("chosen", F.slice("near", F.col("feature") + 1, k))
    vector = lambda n: [n[f"n_{x}"] - F.col(x) for x in axes]
    at = lambda i: F.element_at("chosen", i)
    angles = F.array(*[angle_between(vector(at(i)), vector(at(i + 1))) for i in range(1, k)])
    return chosen.select(id_col, "feature", angles.alias("angles"), F.transform("chosen", lambda n: n["d2"]).alias("lengths"))


def match_features(a: DataFrame, b: DataFrame, angle_epsilon: float, len_epsilon_sq: float, by: list[str] = (), scale_invariant: bool = False, axes: list[str] = ("x", "y", "z"), keep: list[str] | None = None) -> DataFrame:
    """Pairs of features whose angles differ by less than epsilon, and whose lengths differ together by less than len_epsilon_sq. keep: the columns that f1 and f2 need.

    Scale-invariant: the shares of the first length differ by less than
    len_epsilon_sq instead. Features meet in bands of angles one epsilon wide.
    """
    return nearby.matched(a, b, angle_epsilon, len_epsilon_sq, by, scale_invariant, keep)


def match_arrays(a: DataFrame, b: DataFrame, angle_epsilon: float, len_epsilon_sq: float, which: int = 3, by: list[str] = ()) -> DataFrame:
    """Features with as many angles and lengths, all of which are within epsilon: angles (which 1), lengths (2) or both (3).

    The first angle (length, for 2) puts features into bands that meet.
    """
    first, width = (F.get("angles", F.lit(0)), angle_epsilon) if which & 1 else (F.get("lengths", F.lit(0)), len_epsilon_sq)
    cell = F.floor(first / width)
    pack = lambda df: F.struct(*df.columns)
    left = a.select(*by, pack(a).alias("f1"), F.size("angles").alias("n"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_band"))
    right = b.select(*by, pack(b).alias("f2"), F.size("angles").alias("n"), cell.alias("_band"))
    close = lambda name, eps: F.forall(F.zip_with(F.col(f"f1.{name}"), F.col(f"f2.{name}"), lambda x, y: F.abs(x - y) <= eps), lambda ok: ok)
    condition = (close("angles", angle_epsilon) if which & 1 else F.lit(True)) & (close("lengths", len_epsilon_sq) if which & 2 else F.lit(True))
    return left.join(right, [*by, "n", "_band"]).where(condition).select("f1", "f2")


def match_nearby(a: DataFrame, b: DataFrame, axes: list[str], radius: float, angle_epsilon: float, len_epsilon_sq: float, id_col: str = "fid") -> DataFrame:
    """Features of b within radius of each feature of a that also match it. fid: a key of features."""
    near = radius_join(a, b, axes, radius, id_col)
    matched = match_features(a, b, angle_epsilon, len_epsilon_sq)
    return near.join(matched.select(F.col(f"f1.{id_col}").alias(id_col), F.col(f"f2.{id_col}").alias("other")), [id_col, "other"])


def band_pairs(df: DataFrame, at: str, n: int, inclusive: bool = False, complete: bool = True) -> DataFrame:
    """Pairs (i, j) of ordinals with j after i by n - 1 at most (n if inclusive); as an equi-join on the partner's ordinal.

    With complete=False, starts near the end have no pairs, as where each start needs all its partners.
    """
    reach = n if inclusive else n - 1
    total = df.agg((F.max(at) + 1).alias("_total"))
    starts = df.select(F.col(at).alias("i"))
    if not complete:
        limit = F.greatest(F.lit(1), F.col("_total") - n) if inclusive else F.col("_total") - n + 1
        starts = starts.join(F.broadcast(total), F.col("i") < limit).select("i")  # one row
    return starts.select("i", F.explode(F.sequence(F.col("i") + 1, F.col("i") + reach)).alias("j")).join(df.select(F.col(at).alias("j")), "j").select("i", "j")


def all_pairs(n: int, spark) -> DataFrame:
    """Unordered pairs of 0..n-1."""
    return spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("id") - 1, F.lit(0)))).alias("j")).where("j < i").select(F.col("j").alias("i"), F.col("i").alias("j"))


def lookup_voxels(points: DataFrame, voxels: DataFrame, axes: list[str], value: str, default=None) -> DataFrame:
    """Each point with the value of the voxel it lies in (coordinates cut to integers)."""
    keyed = points.withColumns({f"_v{a}": F.col(a).cast("int") for a in axes})
    other = voxels.select(*[F.col(a).cast("int").alias(f"_v{a}") for a in axes], F.col(value).alias("_value"))
    return keyed.join(other, [f"_v{a}" for a in axes], "left").withColumn(value, F.coalesce("_value", F.lit(default))).drop("_value", *[f"_v{a}" for a in axes])


def masked(points: DataFrame, mask: DataFrame, axes: list[str], value: str) -> DataFrame:
    """Points whose voxel is set in the mask."""
    keyed = points.withColumns({f"_v{a}": F.col(a).cast("int") for a in axes})
    other = mask.where(F.col(value) != 0).select(*[F.col(a).cast("int").alias(f"_v{a}") for a in axes])
    return keyed.join(other, [f"_v{a}" for a in axes], "left_semi").drop(*[f"_v{a}" for a in axes])


def ball_size(radii: list[float]) -> int:
    """Integer offsets within an ellipsoid: along the last axis their number is known, so only the others are gone through."""
    *others, last = radii
    total = 0
    for p in product(*[range(-int(r), int(r) + 1) for r in others]):
        left = 1 - sum((x / r) ** 2 for x, r in zip(p, others, strict=True) if r)
        if left >= 0:
            total += 2 * int(last * left**0.5 + 1e-9) + 1
    return total


def region_means(peaks: DataFrame, voxels: DataFrame, axes: list[str], radii: list[float], id_col: str, by: list[str], value: str) -> DataFrame:
    """Mean of the voxels within an ellipsoid of each peak, at each by; the divisor is the full number of voxels. Each peak goes to its ellipsoid's positions in its own task."""
    around, left = peaks.select(id_col, *[F.col(a).cast("int").alias(a) for a in axes]), F.lit(1 + 1e-9)
    for i, (_, r) in enumerate(zip(axes, radii, strict=True)):
        around = around.withColumn(f"_o{i}", F.explode(F.sequence(F.lit(-int(r)), F.lit(int(r)))))
        if r:
            left = left - F.pow(F.col(f"_o{i}") / float(r), F.lit(2))
    around = around.where(left >= 0).select(id_col, *[(F.col(a) + F.col(f"_o{i}")).alias(a) for i, a in enumerate(axes)])
    return around.join(voxels.select(*by, *axes, value), axes).groupBy(*by, id_col).agg((F.sum(value) / ball_size(radii)).alias("mean"))


def square_sums(peaks: DataFrame, pixels: DataFrame, x: str, y: str, radius: int, value: str, id_col: str) -> DataFrame:
    """Sum of the pixels in a square window round each peak."""
    side = F.sequence(F.lit(-radius), F.lit(radius))
    spread = peaks.select(id_col, F.col(x).cast("int").alias(x), F.col(y).cast("int").alias(y), F.explode(side).alias("_dx")).withColumn("_dy", F.explode(side))
    around = spread.select(id_col, (F.col(x) + F.col("_dx")).alias(x), (F.col(y) + F.col("_dy")).alias(y))
    return around.join(pixels.select(x, y, value), [x, y]).groupBy(id_col).agg(F.sum(value).alias("sum"))


def neighbour_histogram(points: DataFrame, axes: list[str], radius: float, id_col: str = "pid") -> DataFrame:
    """How many points have how many neighbours, themselves not counted."""
    counts = nearby.neighbour_counts(points, axes, radius, id_col)
    return counts.groupBy("neighbours").agg(F.count(F.lit(1)).alias("points"))


def nearest_by_tag(points: DataFrame, seeds: DataFrame, axes: list[str], radius: float, tag: str, id_col: str = "pid") -> DataFrame:
    """The nearest seed of each tag within radius of each point."""
    return nearby.nearest_of_tag(points, seeds, axes, radius, id_col, tag)


def match_counts(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Matches of each pair (i, j), pairs without one included."""
    return pairs.join(matches.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")), ["i", "j"], "left").na.fill(0, ["n"])


def calibrated(points: DataFrame, scale: dict[str, float]) -> DataFrame:
    return points.withColumns({a: F.col(a) * s for a, s in scale.items()})


def grid_points(spark, width: int, height: int, step: float, moved: dict[tuple[int, int], tuple[float, float]] = {}) -> DataFrame:  # noqa: B006
    """A regular grid of points and where each goes: selected ones by an offset."""
    grid = spark.range(width * height).select((F.col("id") % width).alias("i"), F.floor(F.col("id") / width).alias("j")).select("i", "j", (F.col("i") * step).alias("x1"), (F.col("j") * step).alias("y1"))
    dx, dy = F.lit(0.0), F.lit(0.0)
    for (i, j), (x, y) in moved.items():
        here = (F.col("i") == i) & (F.col("j") == j)
        dx, dy = F.when(here, x).otherwise(dx), F.when(here, y).otherwise(dy)
    return grid.select("i", "j", "x1", "y1", (F.col("x1") + dx).alias("x2"), (F.col("y1") + dy).alias("y2"))
