"""Embeddings as an image: one row per vector, 64 columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import numeric, pixels
from veldmark.operators import images, windows
from veldmark.plans.registry import query
from veldmark.session import table

IMAGE = "img AS (SELECT vec_id AS y, i - 1 AS x, label, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i))"


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), "label", "v")


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(f"WITH {IMAGE} SELECT x, label, max(v) AS v FROM img GROUP BY x, label")
def a12_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.projected(image(spark, sf_dir), ["x", "label"], "v")


@query(f"WITH {IMAGE}, m AS (SELECT label, x, max(v) AS v FROM img GROUP BY label, x) SELECT label, list(v ORDER BY x) AS embedding FROM m GROUP BY label")
def a12_projected_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("embedding"))
    return images.projected_arrays(vectors, ["label"], "embedding")


@query(f"WITH {IMAGE} SELECT x, y // 5 AS y, max(v) AS v FROM img GROUP BY x, y // 5")
def a13_chunk_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.projected_in_chunks(image(spark, sf_dir), ["x"], "y", 5, "v")


@query(f"WITH {IMAGE} SELECT y, list(v ORDER BY x) AS v FROM img GROUP BY y")
def v4_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.collapsed(image(spark, sf_dir), ["y"], "x", "v")


@query(f"WITH {IMAGE} SELECT x - 8 AS x, y - 10 AS y, v FROM img WHERE x BETWEEN 8 AND 20 AND y BETWEEN 10 AND 40")
def v1_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.cropped(image(spark, sf_dir).select("x", "y", "v"), {"x": 8, "y": 10}, {"x": 20, "y": 40}, zero_min=True)


@query(f"WITH {IMAGE} SELECT x, v FROM img WHERE y = 7")
def v2_hyperslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.hyperslice(image(spark, sf_dir).select("x", "y", "v"), "y", 7)


@query(f"WITH {IMAGE} SELECT y AS x, x AS y, v FROM img")
def v3_permute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.permuted(image(spark, sf_dir).select("x", "y", "v"), "x", "y")


@query(f"WITH {IMAGE} SELECT x // 4 AS x, y // 2 AS y, v FROM img WHERE x % 4 = 0 AND y % 2 = 0")
def v5_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.subsampled(image(spark, sf_dir).select("x", "y", "v"), {"x": 4, "y": 2})


@query(f"WITH {IMAGE} SELECT (SELECT max(vec_id) FROM embeddings) - y AS x, x AS y, v FROM img")
def v6_rotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1
    return images.rotated(image(spark, sf_dir).select("x", "y", "v"), "x", "y", 64, height)


@query(f"WITH {IMAGE}, w AS (SELECT i AS x, j AS y FROM range(-3, 68) a(i), range(-2, 12) b(j)) SELECT w.x, w.y, coalesce(v, 0) AS v FROM w LEFT JOIN img USING (x, y)")
def v7_extend_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.extended(image(spark, sf_dir).select("x", "y", "v"), around(spark), {"x": 64, "y": 500}, "v", "zero")


@query(f"WITH {IMAGE}, w AS (SELECT i AS x, j AS y, CASE WHEN i < 0 THEN -i WHEN i > 63 THEN 126 - i ELSE i END AS mx, abs(j) AS my FROM range(-3, 68) a(i), range(-2, 12) b(j)) SELECT w.x, w.y, v FROM w LEFT JOIN img ON mx = img.x AND my = img.y")
def v7_extend_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return images.extended(image(spark, sf_dir).select("x", "y", "v"), around(spark), {"x": 64, "y": n}, "v", "mirror")


@query(f"WITH {IMAGE}, w AS (SELECT i AS x, j AS y FROM range(-3, 68) a(i), range(-2, 12) b(j)) SELECT w.x, w.y, v FROM w LEFT JOIN img ON greatest(0, least(63, w.x)) = img.x AND greatest(0, w.y) = img.y")
def v7_extend_border(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "embeddings").count()
    return images.extended(image(spark, sf_dir).select("x", "y", "v"), around(spark), {"x": 64, "y": n}, "v", "border")


def around(spark: SparkSession) -> DataFrame:
    return spark.range(71 * 14).select((F.col("id") % 71 - 3).alias("x"), (F.floor(F.col("id") / 71) - 2).alias("y"))


@query(f"""
    WITH {IMAGE}, w AS (SELECT i AS x, j AS y, i + 0.25 AS px, j + 0.5 AS py FROM range(0, 64) a(i), range(0, 50) b(j)),
    c AS (SELECT w.x, w.y, floor(px) + dx AS kx, floor(py) + dy AS ky, CASE WHEN dx = 1 THEN px - floor(px) ELSE 1 - px + floor(px) END * CASE WHEN dy = 1 THEN py - floor(py) ELSE 1 - py + floor(py) END AS w FROM w, range(0, 2) a(dx), range(0, 2) b(dy))
    SELECT c.x, c.y, round(sum(w * coalesce(v, 0)), 6) AS v FROM c LEFT JOIN img ON kx = img.x AND ky = img.y GROUP BY c.x, c.y""")
def v8_affine_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.range(64 * 50).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    return rounded(images.affine_sampled(image(spark, sf_dir), wanted, [[1, 0, 0.25], [0, 1, 0.5]], ["x", "y"], "v"), "v")


@query("SELECT vec_id, i - 1 AS at, embedding[i] AS v FROM embeddings, range(1, 65) r(i)")
def v9_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.flat(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding").withColumn("at", F.col("at").cast("long"))


@query(f"WITH {IMAGE} SELECT x, y, CAST(trunc(greatest(0, least(255, v * 1000))) AS SMALLINT) AS v FROM img")
def v10_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).select("x", "y", images.converted(F.col("v") * 1000, 0, 255, "smallint").alias("v"))


@query(f"WITH {IMAGE} SELECT x + (label % 4) * 66 AS x, y + (label // 4) * 502 AS y, v FROM img")
def v11_montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.montage(image(spark, sf_dir), "x", "y", "label", 4, 64, 500, 2)


@query(f"WITH {IMAGE} SELECT x // 4 AS x, y // 4 AS y, round(avg(v), 6) AS v FROM img GROUP BY x // 4, y // 4")
def n15_pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.pyramid(image(spark, sf_dir), ["x", "y"], 2, "v"), "v")


INTEGRAL = f"{IMAGE}, r AS (SELECT x, y, label, sum(v) OVER (PARTITION BY label, y ORDER BY x) AS s FROM img), integral AS (SELECT x, y, label, sum(s) OVER (PARTITION BY label, x ORDER BY y) AS integral FROM r)"


@query(f"WITH {INTEGRAL} SELECT x, y, round(integral, 6) AS integral FROM integral")
def w5_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.prefix_sum_2d(image(spark, sf_dir), "x", "y", "v", ["label"]).select("x", "y", "integral"), "integral")


@query(f"""
    WITH {IMAGE}, r AS (SELECT x, y, sum(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN CURRENT ROW AND 3 FOLLOWING) AS s FROM img),
    b AS (SELECT x, y, sum(s) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN CURRENT ROW AND 2 FOLLOWING) AS s FROM r)
    SELECT x, y, round(s, 6) AS sum FROM b WHERE x <= 60 AND y <= (SELECT max(vec_id) - 2 FROM embeddings)""")
def w6_block_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.block_sums_in_bands(image(spark, sf_dir), "x", "y", "v", 4, 3), "sum")


@query(f"""WITH {IMAGE} SELECT x, y, round(0.25 * coalesce(lag(v) OVER w, v) + 0.5 * v + 0.25 * coalesce(lead(v) OVER w, v), 6) AS filtered FROM img WINDOW w AS (PARTITION BY y ORDER BY x)""")
def w7_convolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(windows.convolve(image(spark, sf_dir), "v", ["y"], "x", [0.25, 0.5, 0.25]).select("x", "y", "filtered"), "filtered")


@query(f"WITH {IMAGE} SELECT a.x, a.y, b.v - a.v AS v FROM img a JOIN img b ON b.x = a.x + 1 AND b.y = a.y")
def m8_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = images.shifted(image(spark, sf_dir).select("x", "y", "v"), {"x": 1, "y": 0}, "v", "right")
    return moved.where("right IS NOT NULL").select("x", "y", (F.col("right") - F.col("v")).alias("v"))


@query(f"""
    WITH {IMAGE} SELECT x, y, round(CASE WHEN v > 0.1 THEN pow(v + 0.5, 2) WHEN v < -0.1 AND NOT (x < 8 OR y < 8) THEN ln(exp(v) + 1) ELSE greatest(v, v * 2, 0.01) - least(v, 0.02) END, 6) AS v,
        (x > 3) <> (y > 3) AS odd FROM img""")
def m_pixel_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels
    near = p.either(p.less("x", 8), p.less("y", 8))
    body = p.when(p.greater("v", 0.1), p.power(p.add("v", 0.5), 2), p.when(p.both(p.less("v", -0.1), p.negated(near)), p.log(p.add(p.exp("v"), 1)), p.sub(p.maximum("v", p.mul("v", 2), 0.01), p.minimum("v", 0.02))))
    done = p.compute(image(spark, sf_dir), "v", body).withColumn("odd", p.one_of(p.greater("x", 3), p.greater("y", 3)))
    return rounded(done.select("x", "y", "v", "odd"), "v")


@query(f"WITH {IMAGE}, c AS (SELECT x, y, abs(v) * 500 AS red, abs(v) * 300 + x AS green, CAST(y % 256 AS DOUBLE) AS blue FROM img), m AS (SELECT *, greatest(red, green, blue) AS t FROM c) SELECT x, y, round(t / 255, 6) AS brightness, round(CASE WHEN t = 0 THEN 0 ELSE (t - least(red, green, blue)) / t END, 6) AS saturation FROM m")
def f16_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = image(spark, sf_dir).select("x", "y", (F.abs("v") * 500).alias("red"), (F.abs("v") * 300 + F.col("x")).alias("green"), (F.col("y") % 256).cast("double").alias("blue"))
    done = colours.withColumn("hsb", numeric.hue_saturation_brightness("red", "green", "blue"))
    return rounded(done.select("x", "y", "hsb.brightness", "hsb.saturation"), "brightness", "saturation")


@query(f"WITH {IMAGE}, s AS (SELECT *, min(v) OVER (PARTITION BY y) AS lo, max(v) OVER (PARTITION BY y) AS hi FROM img) SELECT x, y, round((v - lo) / (hi - lo + 1), 6) AS v FROM s")
def f14_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("y")
    ranged = image(spark, sf_dir).withColumns({"lo": F.min("v").over(w), "hi": F.max("v").over(w)})
    return rounded(ranged.select("x", "y", numeric.normalised("v", F.col("lo"), F.col("hi")).alias("v")), "v")


@query("SELECT i % 40 AS x, i // 40 AS y, round(pow(sin((i % 40) / pi()) + 1, 2) + 2 * (sin((i // 40) / pi()) + 1), 6) AS v FROM range(1600) r(i)")
def f15_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(images.functional(spark, 40, 40, numeric.surface), "v")


@query("SELECT n FROM range(2, 3000) r(n) WHERE NOT EXISTS (SELECT 1 FROM range(2, 60) d(k) WHERE k * k <= n AND n % k = 0)")
def pf18_primes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(2, 3000).where(numeric.is_prime("id")).select(F.col("id").alias("n"))


@query(f"WITH {IMAGE} SELECT y, [round(sum(v) FILTER (x % 4 = 0), 6), round(sum(v) FILTER (x % 4 = 1), 6), round(sum(v) FILTER (x % 4 = 2), 6), round(sum(v) FILTER (x % 4 = 3), 6)] AS sums FROM img GROUP BY y")
def f20_deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = numeric.deinterleave(F.col("embedding").cast("array<double>"), 4)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.transform(parts, lambda p: F.round(F.aggregate(p, F.lit(0.0), lambda a, b: a + b), 6)).alias("sums"))
