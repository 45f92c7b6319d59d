"""Points from the first elements of embeddings: radius joins, neighbours, features and their matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators import nearby, spatial
from veldmark.plans.registry import query
from veldmark.session import cut, table

AXES = ["x", "y", "z"]
POINTS = "p AS (SELECT vec_id AS pid, label, round(CAST(embedding[1] AS DOUBLE) * 1000) AS x, round(CAST(embedding[2] AS DOUBLE) * 1000) AS y, round(CAST(embedding[3] AS DOUBLE) * 1000) AS z FROM embeddings)"
D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
NEAR = f"near AS (SELECT a.pid, b.pid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, CASE WHEN a.pid = b.pid THEN 0 ELSE 1 END, b.pid) - 1 AS rank FROM p a JOIN p b ON {D2} <= 10000)"
RADIUS = 100.0


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounded, so that squared distances are whole numbers and ties are exact."""
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double") * 1000)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), "label", at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


@query(f"WITH {POINTS} SELECT a.pid, b.pid AS other, {D2} AS d2 FROM p a JOIN p b ON b.label = a.label + 1 AND {D2} <= 10000")
def j7_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for time points: points of each and those of the next."""
    found = points(spark, sf_dir).withColumnRenamed("label", "t")
    return spatial.radius_join(found, found.withColumn("t", F.col("t") - 1), AXES, RADIUS, by=["t"]).drop("t")


@query(f"WITH {POINTS}, {NEAR} SELECT pid, other, d2, CAST(rank AS INT) AS rank FROM near")
def j8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbours(points(spark, sf_dir), AXES, RADIUS)


@query(f"WITH {POINTS}, c AS (SELECT a.pid, b.pid AS other, {D2} AS d2 FROM p a JOIN p b ON {D2} < 10000 WHERE a.label <> 0 AND b.label = 0) SELECT pid, arg_min(other, (d2, other)) AS nearest, min(d2) AS d2 FROM c GROUP BY pid")
def j9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    return spatial.nearest(found.where("label <> 0"), found.where("label = 0"), AXES, RADIUS)


@query(f"WITH {POINTS}, n AS (SELECT a.pid, b.pid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, CASE WHEN a.pid = b.pid THEN 0 ELSE 1 END, b.pid) - 1 AS rank FROM p a CROSS JOIN p b) SELECT pid, other, d2, CAST(rank AS INT) AS rank FROM n WHERE rank <= 4")
def j10_k_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.k_nearest_anywhere(points(spark, sf_dir), AXES, 4, 60.0)


@query(f"WITH {POINTS}, {NEAR}, r AS (SELECT pid, other, d2, lead(d2) OVER (PARTITION BY pid ORDER BY d2, other) AS second, row_number() OVER (PARTITION BY pid ORDER BY d2, other) AS i FROM near WHERE rank > 0) SELECT pid, other, d2 FROM r WHERE i = 1 AND (second IS NULL OR d2 / nullif(second, 0) <= 0.5)")
def j11_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio looks at the two nearest others."""
    near = spatial.k_nearest(points(spark, sf_dir), AXES, 2, RADIUS).where("rank > 0").select("pid", "other", "d2")
    return spatial.by_ratio(near, "pid", "d2", 0.5)


@query("SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 2")
def j12_band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.band_pairs(table(spark, sf_dir, "embeddings"), "vec_id", 3)


@query("SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 3 WHERE a.vec_id < (SELECT greatest(1, max(vec_id) + 1 - 3) FROM embeddings)")
def j13_band_pairs_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.band_pairs(table(spark, sf_dir, "embeddings"), "vec_id", 3, inclusive=True, complete=False)


@query("SELECT a.i, b.i AS j FROM range(60) a(i) JOIN range(60) b(i) ON a.i < b.i")
def j14_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.all_pairs(60, spark)


@query(f"WITH {POINTS}, {NEAR}, c AS (SELECT pid, count(*) - 1 AS neighbours FROM near GROUP BY pid) SELECT neighbours, count(*) AS points FROM c GROUP BY neighbours")
def a28_neighbour_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.neighbour_histogram(points(spark, sf_dir), AXES, RADIUS)


@query(f"WITH {POINTS}, c AS (SELECT a.pid, b.label, b.pid AS other, {D2} AS d2 FROM p a JOIN p b ON {D2} <= 10000) SELECT pid, label, arg_min(other, (d2, other)) AS nearest, min(d2) AS d2 FROM c GROUP BY pid, label")
def n20_nearest_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    return spatial.nearest_by_tag(found, found, AXES, RADIUS, "label")


PAIRED = f"""{POINTS}, {NEAR}, placed AS (SELECT near.pid, rank, d2 AS len1, lead(d2) OVER w AS len2, q.x AS x1, q.y AS y1, q.z AS z1, lead(q.x) OVER w AS x2, lead(q.y) OVER w AS y2, lead(q.z) OVER w AS z2
        FROM near JOIN p q ON near.other = q.pid WHERE rank > 0 WINDOW w AS (PARTITION BY near.pid ORDER BY rank)),
    angled AS (SELECT pid, rank, len1, len2, p.x, p.y, p.z, label, acos(greatest(-1, least(1, ((x1 - x) * (x2 - x) + (y1 - y) * (y2 - y) + (z1 - z) * (z2 - z)) / nullif(sqrt(len1) * sqrt(len2), 0)))) AS angle
        FROM placed JOIN p USING (pid) WHERE len2 IS NOT NULL),
    feats AS (SELECT pid, label, row_number() OVER (PARTITION BY pid ORDER BY rank DESC) - 1 AS feature, angle, len1, len2, x, y, z FROM angled WHERE angle >= 0.25 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY rank DESC) <= 4)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches read them three times, so these cut them first."""
    found = points(spark, sf_dir)
    return spatial.constellations(found, AXES, RADIUS, 0.25, 4).join(found.select("pid", "label"), "pid")


@query(f"WITH {PAIRED} SELECT pid, CAST(feature AS INT) AS feature, round(angle, 6) AS angle, len1, len2, x, y, z FROM feats")
def n2_constellations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(spark, sf_dir).drop("label").withColumn("angle", F.round("angle", 6))


@query(f"WITH {PAIRED} SELECT a.pid AS pid1, CAST(a.feature AS INT) AS feature1, b.pid AS pid2, CAST(b.feature AS INT) AS feature2 FROM feats a JOIN feats b ON abs(a.angle - b.angle) < 0.05 AND abs(a.len1 - b.len1) + abs(a.len2 - b.len2) < 900.5 AND b.label = a.label + 1")
def j4_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(features(spark, sf_dir).withColumnRenamed("label", "t").drop(*AXES))
    pairs = spatial.match_features(found, found.withColumn("t", F.col("t") - 1), 0.05, 900.5, by=["t"], keep=["pid", "feature"])
    return pairs.select(F.col("f1.pid").alias("pid1"), F.col("f1.feature").alias("feature1"), F.col("f2.pid").alias("pid2"), F.col("f2.feature").alias("feature2"))


@query(f"WITH {PAIRED} SELECT a.pid AS pid1, CAST(a.feature AS INT) AS feature1, b.pid AS pid2, CAST(b.feature AS INT) AS feature2 FROM feats a JOIN feats b ON abs(a.angle - b.angle) < 0.05 AND abs(a.len1 / nullif(a.len1 + a.len2, 0) - b.len1 / nullif(b.len1 + b.len2, 0)) < 0.0300001 AND b.label = a.label + 1")
def j5_scale_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(features(spark, sf_dir).withColumnRenamed("label", "t").drop(*AXES))
    pairs = spatial.match_features(found, found.withColumn("t", F.col("t") - 1), 0.05, 0.0300001, by=["t"], scale_invariant=True, keep=["pid", "feature"])
    return pairs.select(F.col("f1.pid").alias("pid1"), F.col("f1.feature").alias("feature1"), F.col("f2.pid").alias("pid2"), F.col("f2.feature").alias("feature2"))


@query(f"""WITH {PAIRED}, m AS (SELECT a.label AS i, b.label AS j, count(*) AS n FROM feats a JOIN feats b ON b.label = a.label + 1 AND abs(a.angle - b.angle) < 0.05 AND abs(a.len1 - b.len1) + abs(a.len2 - b.len2) < 900.5 GROUP BY 1, 2)
    SELECT t.i, t.j, coalesce(n, 0) AS n FROM (SELECT DISTINCT label AS i, label + 1 AS j FROM embeddings) t LEFT JOIN m ON t.i = m.i AND t.j = m.j""")
def a27_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for time points: features of each meet those of the next."""
    found = cut(features(spark, sf_dir))
    counts = nearby.match_counts(found.withColumn("i", F.col("label")), found.withColumn("i", F.col("label") - 1), 0.05, 900.5, ["i"])
    pairs = table(spark, sf_dir, "embeddings").select(F.col("label").alias("i"), (F.col("label") + 1).alias("j")).distinct()
    return pairs.join(counts, "i", "left").select("i", "j", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {POINTS} SELECT pid, x * 2.0 AS x, y * 2.0 AS y, z * 5.0 AS z FROM p")
def pf20_calibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.calibrated(points(spark, sf_dir).select("pid", *AXES), {"x": 2.0, "y": 2.0, "z": 5.0})


@query("""
    WITH v AS (SELECT CAST(vec_id AS INT) AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
    k AS (SELECT vec_id AS pid, CAST((vec_id * 7) % 64 AS INT) AS x, CAST(vec_id AS INT) AS y FROM embeddings), s AS (SELECT k.pid, k.x + dx AS x, k.y + dy AS y FROM k, range(-2, 3) a(dx), range(-2, 3) b(dy))
    SELECT s.pid, round(sum(v.v), 6) AS sum FROM s JOIN v USING (x, y) GROUP BY s.pid""")
def a19_square_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    pixels = vectors.select(F.col("vec_id").cast("int").alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v"))
    peaks = vectors.select(F.col("vec_id").alias("pid"), (F.col("vec_id") * 7 % 64).cast("int").alias("x"), F.col("vec_id").cast("int").alias("y"))
    return spatial.square_sums(peaks, pixels, "x", "y", 2, "v", "pid").withColumn("sum", F.round("sum", 6))


@query("""
    WITH v AS (SELECT CAST(vec_id AS INT) AS y, i - 1 AS x, label, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
    k AS (SELECT vec_id AS pid, CAST((vec_id * 7) % 64 AS INT) AS x, CAST(vec_id AS INT) AS y FROM embeddings), s AS (SELECT k.pid, k.x + dx AS x, k.y + dy AS y FROM k, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy <= 4)
    SELECT s.pid, v.label, round(sum(v.v) / 13, 6) AS mean FROM s JOIN v USING (x, y) GROUP BY s.pid, v.label""")
def j21_region_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    pixels = vectors.select("label", F.col("vec_id").cast("int").alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v"))
    peaks = vectors.select(F.col("vec_id").alias("pid"), (F.col("vec_id") * 7 % 64).cast("int").alias("x"), F.col("vec_id").cast("int").alias("y"))
    return spatial.region_means(peaks, pixels, ["x", "y"], [2, 2], "pid", ["label"], "v").withColumn("mean", F.round("mean", 6))


@query(f"WITH {POINTS} SELECT pid, CASE WHEN CAST(trunc(x) AS INT) % 2 = 0 THEN 1 ELSE -1 END AS mark FROM p")
def j20_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    even = found.select(F.col("x").cast("int").alias("x")).where("x % 2 = 0").distinct().withColumn("mark", F.lit(1))
    return spatial.lookup_voxels(found, even, ["x"], "mark", -1).select("pid", "mark")


@query(f"WITH {POINTS} SELECT pid FROM p WHERE CAST(trunc(x) AS INT) % 2 = 0 AND CAST(trunc(x) AS INT) % 3 <> 0")
def pf7_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = points(spark, sf_dir)
    mask = found.select(F.col("x").cast("int").alias("x")).where("x % 2 = 0").distinct().withColumn("set", (F.col("x") % 3 != 0).cast("int"))
    return spatial.masked(found, mask, ["x"], "set").select("pid")


@query()
def a26_merge_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order decides, so there is no SQL; tests hold it against a plain loop."""
    from veldmark.streaming.streams import merge_peaks

    rows = points(spark, sf_dir).select((F.col("pid") % 5).alias("series"), F.col("label").alias("t"), *AXES)
    return merge_peaks(rows, "series", 60.0)


@query()
def st4_peaks_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running peaks of each series held by cells of space, a time point at a time; order decides, so there is no SQL, and tests hold it against the ordered loop."""
    from veldmark.streaming.cells import peaks_by_cell

    rows = points(spark, sf_dir).select((F.col("pid") % 5).alias("series"), F.col("label").alias("t"), *AXES)
    return peaks_by_cell(rows, "series", 20.0, steps=1).select("series", *AXES, "n")


@query()
def n6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations between the features of labels, by seeded sampling."""
    from veldmark.operators.consensus import fit_features

    found = cut(features(spark, sf_dir))
    return fit_features(found.withColumn("i", F.col("label")), found.withColumn("i", F.col("label") - 1), AXES, ["i"], 0.05, 900.5, "translation", iterations=100, epsilon=40.0, least=3)


@query()
def ml3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted class of each vector, 200 trees of two attributes at a split having learnt from those whose id isn't divisible by 4; a forest has no SQL."""
    from veldmark.operators import ml

    attributes = [f"a{i}" for i in range(6)]
    rows = table(spark, sf_dir, "embeddings").select("vec_id", (F.get("embedding", F.lit(0)) > F.get("embedding", F.lit(1))).cast("double").alias("label"), *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate(attributes)])
    model = ml.random_forest(rows.where("vec_id % 4 <> 0"), attributes)
    return ml.classify(model, rows.select("vec_id", "label", *attributes)).select("vec_id", (F.col("vec_id") % 4 == 0).alias("held_out"), F.col("label").cast("int").alias("truth"), "class")
