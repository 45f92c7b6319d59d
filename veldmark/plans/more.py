"""Further lines of the operator inventory on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.functions import affine, numeric, text
from veldmark.operators import aggregates, filters, images, sets, spatial, windows
from veldmark.plans.graphs import FOLDED, folded
from veldmark.plans.images import IMAGE, image
from veldmark.plans.points import AXES, POINTS, points
from veldmark.plans.registry import query
from veldmark.session import table


@query(f"WITH e AS ({FOLDED}) SELECT src, dst, weight FROM e WHERE weight >= 8")
def pf3_strong_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.at_least(folded(spark, sf_dir), "weight", 8)


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 70")
def pf6_more_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.more_than(table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")), "n", 70)


@query("SELECT event_id FROM events WHERE user_id IN (3, 5, 8) AND event_id BETWEEN 100 AND 5000")
def pf11_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.within(filters.at_times(table(spark, sf_dir, "events"), "user_id", [3, 5, 8]), {"event_id": (100, 5000)}).select("event_id")


@query("SELECT p_partkey FROM part WHERE p_size < 30 AND p_size + 5 > 20 AND p_retailprice < 1000 AND p_retailprice + 10 > 950")
def pf16_intersects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").withColumns({"w": F.lit(5), "h": F.lit(10)})
    return rows.where(filters.intersects("p_size", "p_retailprice", "w", "h", (20, 950, 10, 50))).select("p_partkey")


@query(f"WITH {IMAGE} SELECT x, y, CASE WHEN CAST(trunc(abs(v) * 500) AS INT) >= 60 THEN x ELSE 0 END AS green FROM img")
def pf17_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).select("x", "y", filters.threshold_colour((F.abs("v") * 500).cast("int"), F.col("x"), 60).alias("green"))


@query("SELECT p_partkey, p_brand FROM part")
def pf19_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.picked(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), [0, 2])


@query(f"WITH {POINTS} SELECT pid, CAST(trunc(x * 0.4) AS INT) AS x, CAST(trunc(y * 0.4) AS INT) AS y FROM p")
def pf21_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("pid", *filters.scaled_bounds(["x", "y"], 0.4))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE lang IS NOT NULL AND quality IS NULL")
def pf12_set_but(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return filters.set_but(table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left"), "lang", "quality").select("doc_id")


@query("SELECT user_id, CAST(count(*) AS INT) AS n FROM events GROUP BY user_id")
def a7_lengths_in_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("ids"))
    maps = listed.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "ids"))).alias("m"))
    return maps.select("user_id", aggregates.lengths_in_map("m").alias("n"))


@query(f"WITH {IMAGE} SELECT label, round(avg(v), 6) AS mean FROM img WHERE x BETWEEN 10 AND 20 GROUP BY label")
def a18_mean_over_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.projected(filters.within(image(spark, sf_dir), {"x": (10, 20)}), ["label"], "v", "mean").select("label", F.round("v", 6).alias("mean"))


@query(f"WITH {IMAGE} SELECT label, round(greatest(0, sum(v * v) - pow(sum(v), 2)), 6) AS spread FROM img GROUP BY label")
def x17_legacy_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).groupBy("label").agg(F.round(aggregates.legacy_spread("v"), 6).alias("spread"))


@query("SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem")
def a24_distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()


@query(f"WITH {POINTS}, t AS (SELECT round(sqrt(y * y + x * x) / 2, 6) AS area FROM p) SELECT round(sum(area), 3) AS area FROM t")
def a32_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of the origin, (0, 0, 1) and (x, y, 0)."""
    none = F.lit(0.0)
    area = aggregates.area_of_triangle([none, none, none], [none, none, F.lit(1.0)], [F.col("x"), F.col("y"), none])
    return points(spark, sf_dir).select(F.round(area, 6).alias("area")).agg(F.round(F.sum("area"), 3).alias("area"))


@query(f"WITH {POINTS} SELECT label * 500 + CAST(trunc(abs(z)) AS INT) AS slice, list_sort(list(pid)) AS pids FROM p GROUP BY 1")
def a34_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("label") * 500 + F.abs("z").cast("int")
    return points(spark, sf_dir).groupBy(key.alias("slice")).agg(F.array_sort(F.collect_list("pid")).alias("pids"))


@query("SELECT vec_id AS at, label, p_size AS size FROM embeddings JOIN part ON vec_id = p_partkey - 1")
def j3_zipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and parts by their places, from 0 on; the shorter table ends the pairs."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("at"), "label")
    return sets.zipped(vectors, table(spark, sf_dir, "part").select((F.col("p_partkey") - 1).alias("at"), F.col("p_size").alias("size")), "at")


@query("""
    WITH f AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS l1, CAST(embedding[3] AS DOUBLE) AS l2 FROM embeddings)
    SELECT x.vec_id AS id1, y.vec_id AS id2 FROM f x JOIN f y ON y.label = x.label + 1 AND abs(x.a - y.a) <= 0.03 AND abs(x.l1 - y.l1) <= 0.05 AND abs(x.l2 - y.l2) <= 0.05""")
def j6_match_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for time points: the arrays of each meet those of the next."""
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("t"), F.array(at(0)).alias("angles"), F.array(at(1), at(2)).alias("lengths"))
    pairs = spatial.match_arrays(rows, rows.withColumn("t", F.col("t") - 1), 0.03, 0.05, by=["t"])
    return pairs.select(F.col("f1.vec_id").alias("id1"), F.col("f2.vec_id").alias("id2"))


D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"""
    WITH {POINTS}, near AS (SELECT a.pid, b.pid AS other, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, CASE WHEN a.pid = b.pid THEN 0 ELSE 1 END, b.pid) - 1 AS rank FROM p a JOIN p b ON {D2} <= 3600)
    SELECT n.pid, CAST(n.rank AS INT) AS i, CAST(m.rank AS INT) AS j, n.d2 AS len1, m.d2 AS len2 FROM near n JOIN near m ON n.pid = m.pid AND n.rank < m.rank WHERE n.rank > 0""")
def n4_all_pairs_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.constellations_of_all_pairs(points(spark, sf_dir), AXES, 60.0).select("pid", "i", "j", "len1", "len2")


@query(f"""
    WITH {POINTS}, near AS (SELECT a.pid, {D2} AS d2, row_number() OVER (PARTITION BY a.pid ORDER BY {D2}, CASE WHEN a.pid = b.pid THEN 0 ELSE 1 END, b.pid) - 1 AS rank FROM p a JOIN p b ON {D2} <= 10000),
    s AS (SELECT pid, rank, [d2, lead(d2) OVER w, lead(d2, 2) OVER w] AS lengths, lead(d2, 2) OVER w AS last FROM near WHERE rank BETWEEN 1 AND 12 WINDOW w AS (PARTITION BY pid ORDER BY rank))
    SELECT pid, CAST(rank - 1 AS INT) AS feature, lengths FROM s WHERE last IS NOT NULL""")
def n3_features_of_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.constellations_of_k(points(spark, sf_dir), AXES, 100.0, 3).select("pid", "feature", "lengths")


@query("SELECT i, j, i * 5.0::DOUBLE AS x1, j * 5.0::DOUBLE AS y1, i * 5.0::DOUBLE + CASE WHEN i = 2 AND j = 3 THEN 1.5 ELSE 0 END AS x2, j * 5.0::DOUBLE - CASE WHEN i = 2 AND j = 3 THEN 2 ELSE 0 END AS y2 FROM range(8) a(i), range(6) b(j)")
def n24_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.grid_points(spark, 8, 6, 5.0, {(2, 3): (1.5, -2.0)})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey")
def o1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, most orders first."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey")


@query("SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey) AS INT) AS place FROM customer")
def o2_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.row_index(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_name", "c_custkey"], "place").select("c_custkey", "place")


@query("SELECT n_nationkey, CAST(split_part(n_name, '_', 2) AS INT) AS suffix FROM nation ORDER BY suffix")
def o3_integer_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", F.element_at(F.split("n_name", "_"), 2).cast("int").alias("suffix")).orderBy("suffix")


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 30 OFFSET 20")
def o6_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.page(table(spark, sf_dir, "part").select("p_partkey"), ["p_partkey"], 20, 30)


@query("""
    WITH even AS (SELECT user_id, event_type, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), odd AS (SELECT user_id, event_type, min(event_id) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2)
    SELECT coalesce(e.user_id, o.user_id) AS user_id, coalesce(e.event_type, o.event_type) AS key, coalesce(o.v, e.v) AS value FROM even e FULL JOIN odd o ON e.user_id = o.user_id AND e.event_type = o.event_type""")
def u2_merged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps of each user, of the last even and of the first odd event of each type, as one; the second wins."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    typed = rows.groupBy("user_id", "event_type").agg(F.max(F.when(F.col("event_id") % 2 == 0, F.col("event_id"))).alias("even"), F.min(F.when(F.col("event_id") % 2 == 1, F.col("event_id"))).alias("odd"))
    packed = lambda name: F.map_from_entries(F.filter(F.collect_list(F.struct("event_type", name)), lambda e: e[name].isNotNull()))
    maps = typed.groupBy("user_id").agg(packed("even").alias("even"), packed("odd").alias("odd"))
    return maps.select("user_id", F.explode(sets.merged_maps(F.col("even"), F.col("odd"))).alias("key", "value"))


@query("SELECT vec_id FROM embeddings WHERE label < 2 UNION ALL SELECT vec_id FROM embeddings WHERE label < 1")
def u3_concatenated(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return sets.all_of([rows.where("label < 2"), rows.where("label < 1")]).select("vec_id")


@query(f"WITH {POINTS} SELECT min(x) AS min_x, max(x) AS max_x, max(x) - min(x) AS extent_x, min(y) AS min_y, max(y) AS max_y, max(y) - min(y) AS extent_y FROM p")
def u7_union_of_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).agg(*aggregates.bounds(["x", "y"]))


@query("SELECT p_partkey, 'Author' || p_partkey || '1999' AS handle FROM part")
def f5_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("Author"), F.col("p_partkey").cast("string"), F.lit(" A., Other B. (2001). "), F.col("p_name"), F.lit(" (1999)."))
    return table(spark, sf_dir, "part").select("p_partkey", text.citation_handle(item).alias("handle"))


@query("SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '/' || printf('%.2f::%.2f::%.2f', p_retailprice, 1.0, 2.5) AS label FROM part")
def f9_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat_ws("/", F.lpad(F.col("p_partkey").cast("string"), 6, "0"), text.coordinates_label("p_retailprice", F.lit(1.0), F.lit(2.5)))
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("label"))


@query(f"WITH {POINTS} SELECT pid, round(acos(greatest(-1, least(1, (x * y + y * z + z * x) / nullif(sqrt(x * x + y * y + z * z) * sqrt(y * y + z * z + x * x), 0)))), 6) AS angle FROM p")
def f12_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y, z = map(F.col, AXES)
    return points(spark, sf_dir).select("pid", F.round(numeric.angle_between([x, y, z], [y, z, x]), 6).alias("angle"))


@query(f"WITH {IMAGE} SELECT x, y, CAST(trunc((greatest(-0.2, least(0.2, v)) + 0.2) / 0.4 * 255) AS INT) AS byte FROM img")
def f13_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte = ((numeric.clamp("v", -0.2, 0.2) + 0.2) / 0.4 * 255).cast("int")
    return image(spark, sf_dir).select("x", "y", byte.alias("byte"))


@query("SELECT i AS c, round(CASE WHEN i <= 0 THEN 0 ELSE least(255, greatest(0, exp(0.45 * ln(i / 255)) * 255)) END, 6) AS v FROM range(256) r(i)")
def f17_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(256).select(F.col("id").alias("c"), F.round(numeric.gamma("id", 0.45), 6).alias("v"))


@query("SELECT p_partkey, CAST(p_size % 256 AS INT) AS green, CAST(p_partkey % 256 AS INT) AS red FROM part")
def f18_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = table(spark, sf_dir, "part").withColumn("c", numeric.argb(F.lit(200), F.col("p_partkey") % 256, F.col("p_size") % 256, F.lit(7)))
    return packed.select("p_partkey", numeric.channel("c", 1).alias("green"), numeric.channel("c", 2).alias("red"))


@query(f"WITH {POINTS} SELECT pid, round(x, 4) AS x, round(y, 4) AS y FROM p")
def f19_affine_and_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map and then its inverse."""
    m = F.array(*[F.lit(v) for v in (0.8, -0.6, 12.0, 0.6, 0.8, -7.0)])
    there = points(spark, sf_dir).select("pid", *[c.alias(n) for c, n in zip(affine.apply(m, [F.col("x"), F.col("y")]), ("tx", "ty"), strict=True)])
    back = affine.apply(affine.invert(m, 2), [F.col("tx"), F.col("ty")])
    return there.select("pid", *[(F.round(c, 4) + 0.0).alias(n) for c, n in zip(back, ("x", "y"), strict=True)])


FLIPPED = " + ".join(f"CAST((p_partkey >> {8 * i}) & 255 AS HUGEINT) * {1 << (56 - 8 * i)}" for i in range(8))


@query(f"WITH u AS (SELECT p_partkey, {FLIPPED} AS u FROM part) SELECT p_partkey, CAST(CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END AS BIGINT) AS flipped FROM u")
def f21_reversed_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All eight bytes of every key; the SQL sums them beyond a long and wraps."""
    return table(spark, sf_dir, "part").select("p_partkey", numeric.reverse_bytes("p_partkey").alias("flipped"))


@query("SELECT p_partkey, p_partkey % 7 AS x, p_partkey // 7 AS y, p_partkey AS back FROM part")
def f22_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "part").select("p_partkey", numeric.grid_position("p_partkey", 7).alias("at"))
    return at.select("p_partkey", "at.x", "at.y", numeric.grid_index(F.col("at.x"), F.col("at.y"), 7).alias("back"))


@query("SELECT i % 30 AS x, i // 30 AS y, 2.5::DOUBLE AS v FROM range(600) r(i)")
def v14_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.constant(spark, 30, 20, 2.5)


@query(f"WITH {IMAGE} SELECT x, y, round(avg(v) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS mean FROM img")
def n18_window_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("y").orderBy("x").rangeBetween(-3, 3)
    return image(spark, sf_dir).select("x", "y", F.round(F.avg("v").over(w), 6).alias("mean"))


@query("SELECT vec_id, CAST(((vec_id % 7) + 3) % 7 - 3 AS INT) AS dy, CAST(((vec_id // 7) % 7 + 3) % 7 - 3 AS INT) AS dx FROM embeddings")
def n13_phase_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 image against another one: itself moved by -3 to 3 either way, as its id says, with a tenth of the reversed vector over it. The shift comes back."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for key, v in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                a = np.asarray(v, float).reshape(8, 8)
                shift = (int(key % 7) + 3) % 7 - 3, (int(key // 7 % 7) + 3) % 7 - 3
                rows.append((key, *images.phase_correlation(a, np.roll(a, shift, (0, 1)) + 0.1 * a[::-1, ::-1])))
            yield pd.DataFrame(rows, columns=["vec_id", "dy", "dx"])

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, dy int, dx int")


@query()
def n1_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each label's vectors as an image; a filter with reflection has no short SQL."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(F.lit(8), F.lit(8)).alias("size"), F.col("embedding").cast("array<double>").alias("data"))
    return images.detect_peaks(rows, "vec_id", "size", "data", 0.8, 1.6, 0.02)
