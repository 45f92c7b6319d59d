"""Queries of joint registration, distances, block matches and contrast on whole planes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators import blocks, distance, features, filter_bank, mosaics, peaks, stripes
from veldmark.plans.images import IMAGE, image, rounded
from veldmark.plans.registry import query
from veldmark.session import table


@query("""
    WITH e AS (SELECT vec_id // 8 AS ring, vec_id % 8 AS tile, 100 * CAST(embedding[1] AS DOUBLE) AS x, 100 * CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
    s AS (SELECT ring, tile, coalesce(sum(x) OVER before, 0) AS px, coalesce(sum(y) OVER before, 0) AS py, sum(x) OVER whole AS sx, sum(y) OVER whole AS sy, count(*) OVER whole AS n
        FROM e WINDOW before AS (PARTITION BY ring ORDER BY tile ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), whole AS (PARTITION BY ring))
    SELECT ring, tile, [1, 0, round(tile * sx / n - px, 4) + 0, 0, 1, round(tile * sy / n - py, 4) + 0] AS matrix FROM s WHERE n > 1""")
def n8_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of eight tiles, each moved against the next by two elements of a vector. No maps meet all of a ring's moves: the joint ones leave each an equal share of what the ring doesn't close by."""
    corners = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (30.0, 0.0), (0.0, 30.0), (17.0, 21.0))])
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    tiles = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("ring"), (F.col("vec_id") % 8).alias("i"), at(0).alias("x"), at(1).alias("y"))
    sizes = tiles.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    rows = tiles.join(sizes, "ring").where("n > 1").withColumn("j", (F.col("i") + 1) % F.col("n")).withColumn("p1", F.explode(corners))
    moved = rows.withColumn("p2", F.array(F.get("p1", F.lit(0)) + F.col("x"), F.get("p1", F.lit(1)) + F.col("y")))
    done = mosaics.joint_maps(moved, "ring", [0], "translation", 2)
    return done.select("ring", "tile", F.transform("matrix", lambda v: F.round(v, 4) + 0.0).alias("matrix"))


# Distances


def _nearest(mask: str) -> str:
    """SQL of the signed distance of each pixel of a table x, y, inside to the nearest of the other kind, all pairs compared."""
    return f"SELECT a.x, a.y, any_value(a.inside) AS inside, CASE WHEN any_value(a.inside) THEN 1 ELSE -1 END * sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM {mask} a JOIN {mask} b ON a.inside <> b.inside GROUP BY a.x, a.y"


@query(f"WITH {IMAGE}, m AS MATERIALIZED (SELECT x, y, v > 0.33 AS inside FROM img), d AS ({_nearest('m')}) SELECT x, y, round(d, 6) AS distance FROM d")
def n17_exact_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each pixel to the nearest of the other kind, however far, of a mask of few pixels."""
    mask = image(spark, sf_dir).select("x", "y", (F.col("v") > 0.33).cast("int").alias("v"))
    return rounded(distance.signed_distance(mask, "x", "y", "v"), "distance")


@query(f"""WITH {IMAGE}, m AS MATERIALIZED (SELECT x, y, v > 0.33 AS inside FROM img), k AS MATERIALIZED (SELECT 63 - x AS x, y, v < -0.32 AS inside FROM img), a AS ({_nearest('m')}), b AS ({_nearest('k')})
    SELECT x, y, CASE WHEN a.d * 0.4 + b.d * 0.6 > 0 THEN 1 ELSE 0 END AS v FROM a JOIN b USING (x, y)""")
def n16_between_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask between that of large values and the mirrored one of very negative values: neither is regular."""
    plane = image(spark, sf_dir)
    large, small = plane.select("x", "y", (F.col("v") > 0.33).cast("int").alias("v")), plane.select((63 - F.col("x")).alias("x"), "y", (F.col("v") < -0.32).cast("int").alias("v"))
    return distance.masks_between(large, small, "x", "y", "v", 0.6)


# Block matches


@query(f"""
    WITH {IMAGE}, two AS MATERIALIZED (SELECT a.x, a.y, 0.8 * a.v + 0.2 * b.v AS v FROM (SELECT x - 2 AS x, y - 1 AS y, v FROM img) a JOIN (SELECT 63 - x AS x, y, v FROM img) b USING (x, y)),
    p AS (SELECT x AS px, y AS py FROM img WHERE x % 16 = 8 AND y % 16 = 8), o AS (SELECT dx, dy FROM range(-3, 4) a(dx), range(-3, 4) b(dy)),
    k AS MATERIALIZED (SELECT px, py, x - px AS i, y - py AS j, v FROM p JOIN img ON x BETWEEN px - 4 AND px + 4 AND y BETWEEN py - 4 AND py + 4),
    c AS MATERIALIZED (SELECT px, py, dx, dy, corr(k.v, two.v) AS r FROM k CROSS JOIN o JOIN two ON two.x = px + i + dx AND two.y = py + j + dy GROUP BY px, py, dx, dy HAVING count(*) = 81),
    t AS (SELECT px, py, max(r) AS top FROM c GROUP BY px, py),
    b AS (SELECT c.px, c.py, dx AS bx, dy AS by_, r AS best FROM c JOIN t ON c.px = t.px AND c.py = t.py AND r >= top - 1e-9 QUALIFY row_number() OVER (PARTITION BY c.px, c.py ORDER BY dy, dx) = 1),
    n AS (SELECT b.px, b.py, bx, by_, best, max(r) FILTER (abs(dx - bx) > 1 OR abs(dy - by_) > 1) AS second, count(*) FILTER (abs(dx - bx) <= 1 AND abs(dy - by_) <= 1) AS near,
        {", ".join(f"max(r) FILTER (dx = bx + {dx} AND dy = by_ + {dy}) AS r{dx + 1}{dy + 1}" for dx in (-1, 0, 1) for dy in (-1, 0, 1))}
        FROM b JOIN c ON c.px = b.px AND c.py = b.py GROUP BY ALL),
    h AS (SELECT *, r01 - 2 * r11 + r21 AS xx, r10 - 2 * r11 + r12 AS yy, (r22 - r20 - r02 + r00) / 4 AS xy FROM n)
    SELECT p.px, p.py, CAST(bx AS INT) AS dx, CAST(by_ AS INT) AS dy, round(best, 6) AS r, round(second, 6) AS second,
        coalesce(best >= 0.5 AND (1 + second) / (1 + best) <= 0.9 AND near = 9 AND xx * yy - xy * xy > 1e-12 AND (xx + yy) * (xx + yy) / (xx * yy - xy * xy) <= 12.1, false) AS accepted
    FROM p LEFT JOIN h ON h.px = p.px AND h.py = p.py""")
def n10_block_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the whole plane found in one moved by (-2, -1), with a fifth of the mirrored plane over it."""
    one = image(spark, sf_dir).select("x", "y", "v")
    moved = one.select((F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), F.col("v").alias("a"))
    two = moved.join(one.select((63 - F.col("x")).alias("x"), "y", F.col("v").alias("b")), ["x", "y"]).select("x", "y", (0.8 * F.col("a") + 0.2 * F.col("b")).alias("v"))
    points = one.where("x % 16 = 8 AND y % 16 = 8").select(F.col("x").alias("px"), F.col("y").alias("py"))
    done = blocks.block_matches(one, two, points, "x", "y", "v", block=4, search=3, least=0.5)
    return rounded(done.select("px", "py", "dx", "dy", "r", "second", "accepted"), "r", "second")


# Contrast


@query(f"""
    WITH {IMAGE}, q AS MATERIALIZED (SELECT x, y, least(63, greatest(0, CAST(floor((v + 0.5) / 1.0 * 64) AS INT))) AS bin FROM img),
    n AS (SELECT x // 16 AS tx, y // 16 AS ty, count(*) AS n FROM q GROUP BY ALL), c AS (SELECT x // 16 AS tx, y // 16 AS ty, bin, count(*) AS c FROM q GROUP BY ALL),
    h AS (SELECT tx, ty, bin, n, least(coalesce(c, 0), greatest(1.0, n * 3.0 / 64)) AS held FROM n CROSS JOIN range(64) r(bin) LEFT JOIN c USING (tx, ty, bin)),
    t AS MATERIALIZED (SELECT tx, ty, bin, (sum(CAST(held AS DOUBLE)) OVER (PARTITION BY tx, ty ORDER BY bin) + (bin + 1) * (n - sum(CAST(held AS DOUBLE)) OVER (PARTITION BY tx, ty)) / 64) / n AS f FROM h),
    g AS (SELECT x, y, bin, (x - 7.5) / 16 AS gx, (y - 7.5) / 16 AS gy FROM q),
    k AS (SELECT x, y, bin, CAST(floor(gx) AS BIGINT) + i AS tx, CAST(floor(gy) AS BIGINT) + j AS ty, CASE i WHEN 1 THEN gx - floor(gx) ELSE 1 - (gx - floor(gx)) END * CASE j WHEN 1 THEN gy - floor(gy) ELSE 1 - (gy - floor(gy)) END AS w FROM g, range(2) a(i), range(2) b(j))
    SELECT k.x, k.y, round(sum(w * f) / sum(w), 6) AS contrast FROM k JOIN t USING (tx, ty, bin) GROUP BY k.x, k.y""")
def n18_equalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contrast of the whole plane, limited by tiles of 16."""
    done = blocks.equalised(image(spark, sf_dir).select("x", "y", "v"), "x", "y", "v", -0.5, 0.5, tile=16, bins=64)
    return rounded(done.select("x", "y", "contrast"), "contrast")


# Peaks


def _kernel(name: str, sigma: float, half: int) -> str:
    """SQL of a Gaussian's weights at the whole numbers up to half away."""
    return f"SELECT '{name}' AS g, i, exp(-0.5 * (i / {sigma}) * (i / {sigma})) / sum(exp(-0.5 * (i / {sigma}) * (i / {sigma}))) OVER () AS w FROM range(-{half}, {half} + 1) t(i)"


@query(f"""
    WITH {IMAGE}, e AS (SELECT max(y) AS h FROM img), k AS MATERIALIZED ({_kernel('small', 1.0, 3)} UNION ALL {_kernel('large', 2.0, 6)}),
    kx AS (SELECT x, g, w, ((x + i) % 126 + 126) % 126 AS m FROM range(64) t(x), k), ky AS (SELECT y, g, w, ((y + i) % (2 * h) + 2 * h) % (2 * h) AS m, h FROM (SELECT DISTINCT y FROM img), e, k),
    r AS MATERIALIZED (SELECT kx.x, y, g, sum(w * v) AS v FROM kx JOIN img ON img.x = least(m, 126 - m) GROUP BY kx.x, y, g),
    s AS (SELECT x, ky.y, ky.g, sum(w * v) AS v FROM ky JOIN r ON r.y = least(m, 2 * h - m) AND r.g = ky.g GROUP BY x, ky.y, ky.g),
    d AS MATERIALIZED (SELECT x, y, sum(CASE g WHEN 'small' THEN v ELSE -v END) AS v FROM s GROUP BY x, y),
    n AS (SELECT d.x, d.y, d.v, max(b.v) AS beside, max(b.v) FILTER (b.x = d.x - 1 AND b.y = d.y) AS xl, max(b.v) FILTER (b.x = d.x + 1 AND b.y = d.y) AS xh, max(b.v) FILTER (b.x = d.x AND b.y = d.y - 1) AS yl, max(b.v) FILTER (b.x = d.x AND b.y = d.y + 1) AS yh
        FROM d CROSS JOIN range(-1, 2) p(dx) CROSS JOIN range(-1, 2) q(dy) JOIN d b ON b.x = d.x + dx AND b.y = d.y + dy AND (dx <> 0 OR dy <> 0) WHERE d.v > 0.05 GROUP BY d.x, d.y, d.v)
    SELECT round((x + coalesce(0.5 * (xl - xh) / (xl - 2 * v + xh), 0)) * 0.5, 6) AS x, round((y + coalesce(0.5 * (yl - yh) / (yl - 2 * v + yh), 0)) * 0.5, 6) AS y, round(v, 6) AS value FROM n WHERE v > beside""")
def n1_peaks_of_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of the whole plane, cut into blocks; a pixel is half a unit wide."""
    done = peaks.gaussian_peaks(image(spark, sf_dir), ["x", "y"], "v", 0.5, 1.0, 0.05, calibration=[0.5, 0.5], block=32)
    return rounded(done, "x", "y", "value")


# Stripes


@query(f"""
    WITH {IMAGE}, s AS MATERIALIZED (SELECT x, y, v + CASE x % 4 WHEN 0 THEN 0.5 WHEN 2 THEN -0.5 ELSE 0 END AS v FROM img), e AS (SELECT max(y) + 1 AS h FROM img),
    kx AS MATERIALIZED (SELECT d, sum(cos(2 * pi() * k * d / 64)) / 64 AS w FROM range(64) a(d), range(8, 57) b(k) GROUP BY d),
    ky AS MATERIALIZED (SELECT d, any_value(h) AS h, sum(exp(-0.5 * least(k, h - k) * least(k, h - k) / 4.0) * cos(2 * pi() * k * d / h)) / any_value(h) AS w FROM e, (SELECT y AS d FROM img WHERE x = 0) a, (SELECT y AS k FROM img WHERE x = 0) b GROUP BY d),
    f AS MATERIALIZED (SELECT t.x, s.y, sum(w * v) AS v FROM range(64) t(x), kx JOIN s ON s.x = (t.x + kx.d) % 64 GROUP BY t.x, s.y),
    g AS (SELECT f.x, (f.y + ky.d) % h AS y, sum(w * v) AS v FROM f, ky GROUP BY ALL)
    SELECT s.x, s.y, round(s.v - g.v, 6) AS clean FROM s JOIN g USING (x, y)""")
def n25_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plane, with stripes of four columns laid over it, without them."""
    laid = F.when(F.col("x") % 4 == 0, 0.5).when(F.col("x") % 4 == 2, -0.5).otherwise(0.0)
    done = stripes.stripes_removed(image(spark, sf_dir).withColumn("v", F.col("v") + laid), "x", "y", "v", least=8, width=2.0)
    return rounded(done, "clean")


# Features of scale space


def _blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane summed over squares of nine pixels a side: elements of vectors alone have next to no extrema of scale."""
    summed = filter_bank.with_blocks(image(spark, sf_dir).select("x", "y", "v"), {"s": (-4, 4, -4, 4)}, "x", "y", "v")
    return summed.select("x", "y", (F.col("s") / 9).alias("v"))


def _features(plane: DataFrame) -> DataFrame:
    return features.scale_features(plane, "x", "y", "v", octaves=3)


@query()
def n11_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the whole plane, summed over squares, with their 128 numbers; tests hold the points against plain loops, as there is no SQL of the numbers."""
    found = _features(_blobs(spark, sf_dir))
    return rounded(found, "x", "y", "scale", "angle", "value").withColumn("descriptor", F.transform("descriptor", lambda v: F.round(v, 4)))


@query()
def n11_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the whole plane, summed over squares, found by their numbers in the plane moved by (-2, -1), with a tenth of the mirrored plane over it."""
    one = _blobs(spark, sf_dir)
    moved = one.select((F.col("x") - 2).alias("x"), (F.col("y") - 1).alias("y"), F.col("v").alias("a"))
    two = moved.join(one.select((63 - F.col("x")).alias("x"), "y", F.col("v").alias("b")), ["x", "y"]).select("x", "y", (0.9 * F.col("a") + 0.1 * F.col("b")).alias("v"))
    fid = F.xxhash64("x", "y", "scale", "angle").alias("fid")
    a, b = (_features(plane).select(fid, "*") for plane in (one, two))
    done = features.descriptor_matches(a, b, [], "fid", reach=16.0, area=64.0)
    return rounded(done.select("x", "y", "other_x", "other_y", "distance"), "x", "y", "other_x", "other_y", "distance")
