"""Pixel expressions, masks, filter banks, transforms, learners and graphs that have no query elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import affine, pixels
from veldmark.operators import filter_bank, filters, flows, graph, images, ml, registration, sets, spatial, windows
from veldmark.operators.matrix import AGGREGATES, aggregate_by_name
from veldmark.plans.images import IMAGE, image, rounded
from veldmark.plans.points import AXES, D2, PAIRED, POINTS, RADIUS, points
from veldmark.plans.registry import query
from veldmark.session import table

#: Whole numbers from 1 on, so that sums and ratios are exact.
COUNTED = "img AS (SELECT vec_id AS y, i - 1 AS x, trunc(abs(CAST(embedding[i] AS DOUBLE)) * 10000) + 1 AS v FROM embeddings, range(1, 65) r(i))"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image(spark, sf_dir).select("x", "y", ((F.abs("v") * 10000).cast("long") + 1).cast("double").alias("v"))


def height(spark: SparkSession, sf_dir: str) -> int:
    return (table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] or 0) + 1


# The pixel language


@query(f"WITH {IMAGE} SELECT x, y, round(v + x + 2 - v * 3 * x + v / (x + 1) / 4, 6) AS v FROM img")
def m1_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels
    body = p.add(p.sub(p.add("v", "x", 2), p.mul("v", 3, "x")), p.div("v", p.add("x", 1), 4))
    return rounded(p.compute(image(spark, sf_dir), "v", body).select("x", "y", "v"), "v")


@query(f"WITH {IMAGE} SELECT x, y, round(greatest(v, -v, 0.05) - least(v, 0.1, v * 2), 6) AS v FROM img")
def m2_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels
    body = p.sub(p.maximum("v", p.mul("v", -1), 0.05), p.minimum("v", 0.1, p.mul("v", 2)))
    return rounded(p.compute(image(spark, sf_dir), "v", body).select("x", "y", "v"), "v")


@query(f"WITH {IMAGE} SELECT x, y, round(pow(v, 3) + ln(exp(v) + 2), 6) AS v FROM img")
def m3_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels
    body = p.add(p.power("v", 3), p.log(p.add(p.exp("v"), 2)))
    return rounded(p.compute(image(spark, sf_dir), "v", body).select("x", "y", "v"), "v")


@query(f"WITH {IMAGE} SELECT x, y, CASE WHEN x = y % 64 THEN 0 WHEN v < -0.1 THEN 1 WHEN v > 0.1 THEN 2 ELSE 3 END AS v FROM img")
def m4_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels
    body = p.when(p.equal("x", F.col("y") % 64), 0, p.when(p.less("v", -0.1), 1, p.when(p.greater("v", 0.1), 2, 3)))
    return p.compute(image(spark, sf_dir), "v", body, "int").select("x", "y", "v")


@query(f"WITH {IMAGE} SELECT x, y, (v > 0 AND x > 9) AS a, (v > 0 OR x > 9) AS o, (v > 0) <> (x > 9) AS e, NOT (v > 0) AS n FROM img")
def m5_logic(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pixels
    one, two = p.greater("v", 0), p.greater("x", 9)
    return image(spark, sf_dir).select("x", "y", p.both(one, two).alias("a"), p.either(one, two).alias("o"), p.one_of(one, two).alias("e"), p.negated(one).alias("n"))


@query(f"WITH {IMAGE}, l AS (SELECT x, y, v * v + 1 AS s FROM img) SELECT x, y, round(s * s + ln(s), 6) AS v FROM l")
def m6_let(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subexpression with a name, and one that uses it."""
    p = pixels
    bound = p.let({"s": p.add(p.mul("v", "v"), 1), "l": lambda s: p.log(s)}, lambda s, l: p.add(p.mul(s, s), l))  # noqa: E741
    return rounded(bound(image(spark, sf_dir), "out").select("x", "y", F.col("out").alias("v")), "v")


SEEDS = "seeds AS (SELECT vec_id AS seed, vec_id * 11 % 64 AS sx, vec_id AS sy, label + 1 AS paint FROM embeddings WHERE vec_id % 3 = 0)"


@query(f"""
    WITH {IMAGE}, {SEEDS}, o AS (SELECT seed, paint, sx + dx AS x, sy + dy AS y, dx * dx + dy * dy AS d2 FROM seeds, range(-4, 5) a(dx), range(-4, 5) b(dy) WHERE dx * dx + dy * dy < 16),
    n AS (SELECT x, y, arg_min(paint, (d2, seed)) AS paint FROM o GROUP BY x, y) SELECT x, y, coalesce(paint, 0) AS v FROM img LEFT JOIN n USING (x, y)""")
def m9_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pixel takes the value of the nearest seed closer than 4, else 0."""
    plane = image(spark, sf_dir).select("x", "y", (F.col("y") * 64 + F.col("x")).alias("pid"))
    seeds = table(spark, sf_dir, "embeddings").where("vec_id % 3 = 0").select(F.col("vec_id").alias("pid"), (F.col("vec_id") * 11 % 64).alias("x"), F.col("vec_id").alias("y"), (F.col("label") + 1).alias("paint"))
    near = spatial.nearest(plane, seeds, ["x", "y"], 4.0).join(seeds.select(F.col("pid").alias("nearest"), "paint"), "nearest")
    return plane.join(near.select("pid", "paint"), "pid", "left").select("x", "y", F.coalesce("paint", F.lit(0)).alias("v"))


@query(f"WITH {POINTS}, s AS (SELECT * FROM p WHERE label % 4 = 0), c AS (SELECT a.pid, arg_min(b.pid, ({D2}, b.pid)) AS seed FROM p a JOIN s b ON {D2} < 4900 GROUP BY a.pid) SELECT c.pid, s.label * 10 AS value FROM c JOIN s ON c.seed = s.pid")
def n21_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points inside spheres about some others, with the value of the nearest one's."""
    found = points(spark, sf_dir)
    seeds = found.where("label % 4 = 0")
    inside = spatial.nearest(found, seeds, AXES, 70.0)
    return inside.join(seeds.select(F.col("pid").alias("nearest"), (F.col("label") * 10).alias("value")), "nearest").select("pid", "value")


@query(f"WITH {IMAGE} SELECT x, y // 4 AS t, v FROM img WHERE y % 4 = 2")
def v12_fixed_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One z of a stack whose slices are numbered t x depth + z."""
    stack = image(spark, sf_dir).select("x", F.floor(F.col("y") / 4).alias("t"), (F.col("y") % 4).alias("z"), "v")
    return images.hyperslice(stack, "z", 2)


# Predicates, pairs and groups


@query("SELECT l_partkey % 100 AS src, l_suppkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL HAVING count(*) >= 5")
def pf2_weighty_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_weights(table(spark, sf_dir, "lineitem").withColumn("part", F.col("l_partkey") % 100), "part", "l_suppkey", 5)


@query(f"WITH {PAIRED} SELECT pid, CAST(feature AS INT) AS feature FROM feats WHERE angle >= 0.5 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY feature) <= 2")
def pf8_wide_and_few(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spatial.constellations(points(spark, sf_dir), AXES, RADIUS, 0.25, 4)
    return filters.wide_and_few(found, 0.5, 2).select("pid", "feature")


@query(f"WITH {IMAGE} SELECT x - 5 AS x, y - 10 AS y, v FROM img WHERE x BETWEEN 5 AND 20 AND y BETWEEN 10 AND 400")
def pf15_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.cropped(image(spark, sf_dir).select("x", "y", "v"), {"x": 5, "y": 10}, {"x": 20, "y": 400}, zero_min=True)


PAIRS = "e AS (SELECT o_custkey % 40 AS src, o_orderkey % 40 AS dst, count(*) AS weight FROM orders GROUP BY ALL)"


@query(f"WITH {PAIRS} SELECT a.src, a.dst, a.weight, b.weight AS back_weight FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst AND a.weight >= 2 AND b.weight >= 2")
def j18_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b"))
    return graph.reciprocal(graph.edge_weights(rows, "a", "b"), 2)


@query(f"WITH {PAIRS} SELECT * FROM e")
def a2_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b"))
    return graph.edge_weights(rows, "a", "b")


@query("SELECT l_returnflag, name, CAST(CASE name WHEN 'max' THEN max(l_quantity) WHEN 'min' THEN min(l_quantity) WHEN 'sum' THEN sum(l_quantity) WHEN 'mean' THEN round(avg(l_quantity), 6) ELSE count(l_quantity) END AS DOUBLE) AS v FROM lineitem, (VALUES ('max'), ('min'), ('sum'), ('mean'), ('count')) n(name) GROUP BY l_returnflag, name")
def ud1_named_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every aggregate that a user can name."""
    done = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*[F.round(aggregate_by_name(n)(F.col("l_quantity")).cast("double"), 6).alias(n) for n in AGGREGATES])
    return done.select("l_returnflag", F.explode(F.create_map(*[x for n in AGGREGATES for x in (F.lit(n), F.col(n))])).alias("name", "v"))


@query("""
    WITH c AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size * 10 AS VARCHAR) WHEN 1 THEN p_brand END AS c FROM part)
    SELECT p_partkey, row_number() OVER (ORDER BY try_cast(c AS DOUBLE) NULLS LAST, c NULLS LAST, p_partkey) - 1 AS place FROM c""")
def o7_natural_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of the rows by a column that holds numbers, text and nulls."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(size % 3 == 0, (size * 10).cast("string")).when(size % 3 == 1, F.col("p_brand")).alias("c"))
    return windows.numbered(rows, [*sets.natural_order("c"), F.col("p_partkey")]).select("p_partkey", "place")


@query("SELECT p_partkey AS node, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS root FROM part QUALIFY count(*) OVER (PARTITION BY p_brand, p_size) > 1")
def g9_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a brand and size, each linked to the next."""
    linked = windows.consecutive(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey", ["p_brand", "p_size"], ["p_partkey"])
    return graph.components(linked.select(F.col("next").alias("src"), F.col("p_partkey").alias("dst")))


# Measurements over time


@query("""
    WITH v AS (SELECT vec_id % 8 AS t, i - 1 AS x, vec_id // 8 AS y, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
    k AS (SELECT DISTINCT vec_id // 8 AS pid, CAST((vec_id // 8) * 7 % 64 AS INT) AS kx, vec_id // 8 AS ky FROM embeddings),
    s AS (SELECT pid, kx + dx AS x, ky + dy AS y FROM k, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx * dx + dy * dy <= 1),
    m AS (SELECT pid, t, CAST(CAST(sum(v) / 5 AS FLOAT) AS DOUBLE) AS f FROM s JOIN v USING (x, y) GROUP BY pid, t),
    b AS (SELECT pid, t, f, min(f) OVER (PARTITION BY pid ORDER BY t ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS b FROM m)
    SELECT pid, t, round(f, 5) AS f, round((f - b) / (b + 1), 5) AS dff FROM b""")
def a17_measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a region at each time point, its sliding baseline, and the relative change."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("t"), F.floor(F.col("vec_id") / 8).alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v"))
    peaks = rows.select("y").distinct().select(F.col("y").alias("pid"), (F.col("y") * 7 % 64).alias("x"), "y")
    done = flows.measured(peaks, rows, ["x", "y"], [1, 1], "t", "v", 4, sigma=0.04)
    return done.select("pid", "t", F.round("f", 5).alias("f"), F.round("dff", 5).alias("dff"))


@query("""
    WITH v AS (SELECT vec_id % 8 AS t, i - 1 AS x, vec_id // 8 AS y, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i)),
    top AS (SELECT x, y, max(v) AS v FROM v GROUP BY x, y HAVING max(v) > 0.15),
    o AS (SELECT x + dx AS x, y + dy AS y, max(v) AS rival FROM top, range(-1, 2) a(dx), range(-1, 2) b(dy) WHERE dx <> 0 OR dy <> 0 GROUP BY 1, 2)
    SELECT x, y, v FROM top LEFT JOIN o USING (x, y) WHERE rival IS NULL OR rival < v""")
def n22_nuclei(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maxima of the projection over time."""
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 8).alias("t"), F.floor(F.col("vec_id") / 8).alias("y"), F.posexplode(F.col("embedding").cast("array<double>")).alias("x", "v"))
    return flows.nuclei_by_projection(rows.select("t", F.col("x").cast("long").alias("x"), "y", "v"), ["x", "y"], "v", 0.15).select("x", "y", "v")


# Masks


@query(f"WITH {IMAGE} SELECT x, y, CASE WHEN x <= 14 THEN 1 ELSE 0 END AS v FROM img")
def n16_interpolated_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask half way between one of the first ten columns and one of the first twenty."""
    plane = image(spark, sf_dir).select("x", "y")
    return images.interpolated_masks(plane.withColumn("v", (F.col("x") < 10).cast("int")), plane.withColumn("v", (F.col("x") < 20).cast("int")), "x", "y", "v", 0.5, 12.0)


@query(f"""
    WITH {IMAGE}, m AS (SELECT x, y, v > 0 AS inside FROM img),
    o AS (SELECT x + dx AS x, y + dy AS y, inside, min(dx * dx + dy * dy) AS d2 FROM m, range(-2, 3) a(dx), range(-2, 3) b(dy) WHERE dx * dx + dy * dy BETWEEN 1 AND 8 GROUP BY ALL)
    SELECT m.x, m.y, round(CASE WHEN m.inside THEN 1 ELSE -1 END * coalesce(sqrt(o.d2), 3), 6) AS distance FROM m LEFT JOIN o ON m.x = o.x AND m.y = o.y AND m.inside <> o.inside""")
def n17_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each pixel to the nearest of the other sign, 3 at most."""
    mask = image(spark, sf_dir).select("x", "y", (F.col("v") > 0).cast("int").alias("v"))
    return rounded(images.distance_transform(mask, "x", "y", "v", 3), "distance")


# Filter banks


def _bound(n: int) -> str:
    return f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"


def _boxes(blocks: dict[str, tuple[int, int, int, int]], value: str = "v") -> str:
    """SQL of block sums, pixels outside counting 0."""
    spans = sorted({b[:2] for b in blocks.values()})
    rows = ", ".join(f"sum({value}) OVER (PARTITION BY y ORDER BY x RANGE BETWEEN {_bound(a)} AND {_bound(b)}) AS s{i}" for i, (a, b) in enumerate(spans))
    sums = ", ".join(f"coalesce(sum(s{spans.index(b[:2])}) OVER (PARTITION BY x ORDER BY y RANGE BETWEEN {_bound(b[2])} AND {_bound(b[3])}), 0) AS {name[1:]}" for name, b in blocks.items())
    return f"rs AS (SELECT x, y, {rows} FROM img), bs AS (SELECT x, y, {sums} FROM rs)"


def _line(a: str, c: str, b: str) -> str:
    return f"round(CASE WHEN {a} > {c} AND {b} > {c} THEN {a} + {b} - {c} ELSE ({a} + {c} + {b}) / 3 END, 4)"


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {a} > {b} THEN {b} / nullif({a}, 0) ELSE {a} / nullif({b}, 0) END, 6)"


LINES = f"{_line('vl3', 'vc3', 'vr3')} AS upright_line, {_line('ht3', 'hc3', 'hb3')} AS flat_line"


@query(f"WITH {COUNTED}, {_boxes(filter_bank.pairs_and_lines(4, 8))} SELECT x, y, {_ratio('vl', 'vr')} AS side_ratio, {_ratio('ht', 'hb')} AS stack_ratio, {LINES} FROM bs")
def n19_haar_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filter_bank.haar_like(counted(spark, sf_dir), "x", "y", "v")
    return done.select("x", "y", *[F.round(c, 6).alias(c) for c in ("side_ratio", "stack_ratio")], *[F.round(c, 4).alias(c) for c in ("upright_line", "flat_line")])


SPOTS = {"_ll": (-12, -1, -6, 5), "_lr": (0, 11, -6, 5), "_lt": (-6, 5, -12, -1), "_lb": (-6, 5, 0, 11), "_sr": (0, 3, -2, 1), "_sl": (-4, -1, -2, 1), "_sb": (-2, 1, 0, 3), "_st": (-2, 1, -4, -1)}


@query(f"""WITH {COUNTED}, {_boxes(filter_bank.pairs_and_lines(4, 8) | SPOTS)} SELECT x, y, vl - vr AS "left", vr - vl AS "right", ht - hb AS top, hb - ht AS bottom, {LINES},
    sr - ll AS spot_right, sl - lr AS spot_left, sb - lt AS spot_bottom, st - lb AS spot_top FROM bs""")
def n19_orthogonal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filter_bank.orthogonal_edges(counted(spark, sf_dir), "x", "y", "v")
    return done.drop("v").withColumns({c: F.round(c, 4) for c in ("upright_line", "flat_line")})


@query(f"WITH {COUNTED}, q AS (SELECT x, y, v, v * v AS sq FROM img), rs AS (SELECT x, y, sum(v) OVER w AS s, sum(sq) OVER w AS q FROM q WINDOW w AS (PARTITION BY y ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)), b AS (SELECT x, y, sum(s) OVER w AS s, sum(q) OVER w AS q FROM rs WINDOW w AS (PARTITION BY x ORDER BY y RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) SELECT x, y, round(q / 25, 2) AS mean_square, round(greatest(0, q - s * s), 2) AS spread FROM b")
def n19_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = filter_bank.block_statistics(counted(spark, sf_dir), "x", "y", "v")
    return done.select("x", "y", F.round("mean_square", 2).alias("mean_square"), F.round("spread", 2).alias("spread"))


BORDERED = f"""{COUNTED}, size AS (SELECT max(y) AS last FROM img),
    o AS (SELECT x, y, dx, dy, greatest(0, least(63, x + dx)) AS px, greatest(0, least(last, y + dy)) AS py FROM img, size, range(-1, 2) a(dx), range(-1, 2) b(dy)),
    n AS (SELECT o.x, o.y, dx, dy, i.v FROM o JOIN img i ON i.x = px AND i.y = py)"""


@query(f"""WITH {BORDERED} SELECT x, y, sum(v * dy) AS top, -sum(v * dy) AS bottom, sum(v * dx) AS "left", -sum(v * dx) AS "right" FROM n GROUP BY x, y""")
def n19_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four kernels that find edges, the nearest pixel standing for one outside."""
    return filter_bank.edges(counted(spark, sf_dir), "x", "y", "v", 64, height(spark, sf_dir))


@query(f"WITH {BORDERED} SELECT x, y, list(v ORDER BY dy, dx) AS patch FROM n GROUP BY x, y")
def n19_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_bank.patch(counted(spark, sf_dir), "x", "y", "v", 64, height(spark, sf_dir), 1)


@query(f"""
    WITH {COUNTED}, size AS (SELECT max(y) + 1 AS h, CAST(floor(33 - (max(y) + 1) / 2) AS BIGINT) AS lx, CAST(ceil(32 + (max(y) + 1) / 2) AS BIGINT) AS hx, CAST(floor((max(y) + 1) / 2 - 32) AS BIGINT) AS ly, CAST(ceil((max(y) + 1) / 2 + 31) AS BIGINT) AS hy FROM img),
    w AS (SELECT x, y, y + ly + 32 - h / 2 AS sx, 32 + h / 2 - x - lx AS sy, h FROM size, range(hx - lx + 1) a(x), range(hy - ly + 1) b(y)),
    c AS (SELECT w.x, w.y, greatest(0, least(63, CAST(floor(sx) AS BIGINT) + i)) AS px, greatest(0, least(h - 1, CAST(floor(sy) AS BIGINT) + j)) AS py, CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END * CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END AS g
        FROM w, range(2) a(i), range(2) b(j))
    SELECT c.x, c.y, round(sum(g * v), 4) AS v FROM c JOIN img ON img.x = px AND img.y = py GROUP BY c.x, c.y""")
def n19_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plane turned by a right angle about its middle: where only one side is even, each pixel lies between four."""
    return filter_bank.turned(counted(spark, sf_dir), "x", "y", "v", 64, height(spark, sf_dir), 90.0)[0].select("x", "y", F.round("v", 4).alias("v"))


# Transforms


@query("SELECT vec_id % 5 AS series, vec_id // 5 AS t, [1, 0, CAST(-sum(label) OVER w AS DOUBLE), 0, 1, CAST(-sum(vec_id % 3) OVER w AS DOUBLE)] AS matrix FROM embeddings WINDOW w AS (PARTITION BY vec_id % 5 ORDER BY vec_id ROWS UNBOUNDED PRECEDING)")
def n7_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from each time point to the first, from matches that a vector's label and id move."""
    corners = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (7.0, 10.0), (4.0, 4.0), (9.0, 1.0))])
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 5).alias("series"), F.floor(F.col("vec_id") / 5).alias("t"), "label", (F.col("vec_id") % 3).alias("up"), F.explode(corners).alias("p1"))
    moved = rows.withColumn("p2", F.array(F.get("p1", F.lit(0)) + F.col("label"), F.get("p1", F.lit(1)) + F.col("up")))
    done = flows.forward_transforms(moved, "series", "t", iterations=3, epsilon=0.1)
    return done.select("series", "t", F.transform("matrix", lambda v: F.round(v, 6) + 0.0).alias("matrix"))


@query("SELECT DISTINCT label, CAST(tile AS INT) AS tile, [1, 0, CAST(tile * label AS DOUBLE), 0, 1, CAST(tile * tile AS DOUBLE)] AS matrix FROM embeddings, range(4) r(tile)")
def n8_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four tiles for each label, whose points are those of one plane moved: the maps that bring them together."""
    corners = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (30.0, 0.0), (0.0, 30.0), (17.0, 21.0))])
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 2), (2, 3), (0, 2))])
    rows = table(spark, sf_dir, "embeddings").select("label").distinct().select("label", F.explode(pairs).alias("p")).select("label", "p", F.explode(corners).alias("w"))
    put = lambda t: F.array(F.get("w", F.lit(0)) - F.col(t) * F.col("label"), F.get("w", F.lit(1)) - F.col(t) * F.col(t))
    done = registration.relax_groups(rows.select("label", "p.i", "p.j", put("p.i").alias("p1"), put("p.j").alias("p2")), "label", [0], "translation", tolerance=1e-12)
    return done.select("label", "tile", F.transform("matrix", lambda v: F.round(v, 3) + 0.0).alias("matrix"))


@query("SELECT vec_id, [0, -1, 9, 1, 0, CAST(2 * label - 7 AS DOUBLE)] AS matrix FROM embeddings")
def n9_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse move, the origin of a region of interest, and a fine quarter turn as one map."""
    number = lambda *vs: F.array(*[F.lit(float(v)) if isinstance(v, int) else v.cast("double") for v in vs])
    label = F.col("label")
    merged = affine.merge(number(1, 0, label, 0, 1, 5), [F.lit(7.0), F.lit(11.0)], number(0, -1, 3, 1, 0, label), 2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(merged, lambda v: v + 0.0).alias("matrix"))


@query("WITH p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 100 AS x, CAST(embedding[2] AS DOUBLE) * 100 AS y FROM embeddings) SELECT vec_id, [round(1.1 * x + 0.2 * y + 3, 3), round(-0.1 * x + 0.9 * y + label, 3)] AS place FROM p")
def n12_elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved by the spline through the matches of their label, which lie on a flat map: the spline is that map."""
    corners = F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in ((-30.0, -30.0), (30.0, -25.0), (-28.0, 30.0), (33.0, 31.0), (2.0, 4.0))])
    x, y = F.get("p1", F.lit(0)), F.get("p1", F.lit(1))
    vectors = table(spark, sf_dir, "embeddings")
    matches = vectors.select("label").distinct().select("label", F.explode(corners).alias("p1")).withColumn("p2", F.array(1.1 * x + 0.2 * y + 3, -0.1 * x + 0.9 * y + F.col("label")))
    at = lambda i: F.get("embedding", F.lit(i)).cast("double") * 100
    done = registration.elastic(matches, vectors.select("label", "vec_id", F.array(at(0), at(1)).alias("p")), ["label"], "vec_id")
    return done.select("vec_id", F.transform("place", lambda v: F.when(v < 0, -F.round(-v, 3)).otherwise(F.round(v, 3))).alias("place"))  # a small negative number becomes -0.0, as in SQL


@query("SELECT CAST(a * 10 AS INT) AS angle, [round(cos(radians(a * 10)), 9) + 0.0, round(-sin(radians(a * 10)), 9) + 0.0, 0, round(sin(radians(a * 10)), 9) + 0.0, round(cos(radians(a * 10)), 9) + 0.0, 0] AS matrix FROM range(36) r(a)")
def n26_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps that turn a training image by each ten degrees: a fixed list, no table."""
    made = spark.createDataFrame([(int(a), [v for row in m for v in row]) for a, m in flows.rotations()], "angle int, matrix array<double>")
    return made.select("angle", F.transform("matrix", lambda v: F.round(v, 9) + 0.0).alias("matrix"))


# Learners: the label is whether the first element is greater than the second


ATTRIBUTES = [f"a{i}" for i in range(6)]


def _attributes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Attributes of every vector, and the labels of those that teach."""
    vectors = table(spark, sf_dir, "embeddings")
    attributes = vectors.select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate(ATTRIBUTES)])
    samples = vectors.where("vec_id % 4 <> 0").select("vec_id", (F.get("embedding", F.lit(0)) > F.get("embedding", F.lit(1))).cast("double").alias("label"))
    return attributes, samples


@query("SELECT vec_id, CAST(embedding[1] > embedding[2] AS DOUBLE) AS label, CAST(embedding[1] AS DOUBLE) AS a0, CAST(embedding[6] AS DOUBLE) AS a5 FROM embeddings WHERE vec_id % 4 <> 0")
def ml1_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes, samples = _attributes(spark, sf_dir)
    return ml.training_set(samples, attributes, ["vec_id"]).select("vec_id", "label", "a0", "a5")


def _classified(spark: SparkSession, sf_dir: str, fit, probability_of: int | None = None) -> DataFrame:
    attributes, samples = _attributes(spark, sf_dir)
    model = fit(ml.training_set(samples, attributes, ["vec_id"]))
    done = ml.classify(model, attributes, probability_of)
    return done.select("vec_id", (F.col("vec_id") % 4 == 0).alias("held_out"), (F.col("a0") > F.col("a1")).cast("int").alias("truth"), done.columns[-1])


@query()
def ml2_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, lambda rows: ml.support_vectors(rows, ATTRIBUTES))


@query()
def ml4_perceptron(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, lambda rows: ml.perceptron(rows, ATTRIBUTES, 2))


@query()
def ml5_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, lambda rows: ml.random_forest(rows, ATTRIBUTES, 50), 1)
