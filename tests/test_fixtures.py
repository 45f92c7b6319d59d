"""Hand-computed results of small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.functions import affine, numeric, pixels, text
from veldmark.operators import aggregates, graph, images, matrix, registration, sets, spatial, windows
from veldmark.sources import sinks, tables
from veldmark.streaming import streams

MATRIX = '''"", "MBON-a1 left", "MBON-a1 right", "MBON-a2 left", "MBON-a2 right", "MBON-b1 left", "MBON-b1 right", "MBON-b2 left", "MBON-b2 right"
"MBIN-b1 left", 0, 0, 0, 2, 0, 18, 0, 12
"MBIN-b1 right", 0, 0, 1, 0, 20, 0, 11, 0
"MBIN-b2 left", 0, 0, 0, 1, 0, 14, 0, 12
"MBIN-b2 right", 1, 0, 1, 0, 15, 0, 12, 0
"OAN-a1", 3, 6, 14, 10, 0, 0, 0, 0
"OAN-a2", 2, 11, 10, 11, 0, 0, 0, 0
'''


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.fixture(scope="module")
def cells(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("m") / "matrix.csv"
    path.write_text(MATRIX)
    return tables.labelled_matrix(spark, str(path)).cache()


def test_labelled_matrix(cells, spark, tmp_path):
    assert cells.count() == 48 and cells.where("v >= 5").count() == 14
    (tmp_path / "odd.csv").write_text('"", "a, b", "a, b"\n"x,y", 1.5, 2\n\n"x,y", 3, 4\n')
    got = tables.labelled_matrix(spark, str(tmp_path / "odd.csv"), kind="double").orderBy("row_idx", "col_idx").collect()
    assert [(r.row, r.col, r.v) for r in got] == [("x,y", "a, b", 1.5), ("x,y", "a, b", 2.0), ("x,y", "a, b", 3.0), ("x,y", "a, b", 4.0)]


def test_merged_pairs_over_threshold(cells, tmp_path):
    merged = matrix.combine_pairs(cells.drop("file"), "max", check=True)
    got = [tuple(r) for r in matrix.over_threshold(merged.orderBy("row_idx", "col_idx"), 5).collect()]
    assert got == [("MBIN-b1 ", "MBON-b1 ", 20), ("MBIN-b1 ", "MBON-b2 ", 12), ("MBIN-b2 ", "MBON-b1 ", 15), ("MBIN-b2 ", "MBON-b2 ", 12), ("OAN-a", "MBON-a1 ", 11), ("OAN-a", "MBON-a2 ", 14)]
    sinks.edges_csv(matrix.over_threshold(merged, 15).orderBy("row_idx", "col_idx"), str(tmp_path / "out"))
    lines = next((tmp_path / "out").glob("part-*")).read_text().splitlines()
    assert lines == ['"MBIN-b1 ","MBON-b1 ",20', '"MBIN-b2 ","MBON-b1 ",15']
    with pytest.raises(Exception, match="pairs"):
        matrix.combine_pairs(cells.where("row_idx < 5"), "max", check=True).collect()
    with pytest.raises(ValueError):
        matrix.combine_pairs(cells, "__import__")


def test_homologs(spark):
    rows = [(0, "A left", 0, "N left", 5), (0, "A left", 1, "N right", 0), (1, "A right", 0, "N left", 4), (1, "A right", 1, "N right", 3)]
    m = spark.createDataFrame(rows, "row_idx int, row string, col_idx int, col string, v int")
    inputs = spark.createDataFrame([("N left", 100), ("N right", 50)], "col string, n_inputs int")
    got = matrix.merge_normalised(m, inputs, 3, 10).first()
    assert (got.row, got.col) == ("A", "N") and got.v == pytest.approx(5.0)
    assert matrix.merge_normalised(m, inputs, 3, 13).first().v == 0
    with pytest.raises(Exception, match="no inputs"):
        matrix.normalise(m, inputs.where("n_inputs = 50")).collect()


def test_windows(spark):
    f = spark.createDataFrame([(0, t, float(v)) for t, v in enumerate([5, 3, 4, 1, 2])], "s int, t int, f double")
    values = lambda df, c: [r[c] for r in df.orderBy("t").collect()]
    assert values(windows.baseline(f, "f", ["s"], ["t"], 3), "baseline") == [5, 3, 3, 1, 1]
    assert values(windows.moving_sum(f, "f", ["s"], ["t"], 2), "total") == [8, 7, 5, 3]
    with pytest.raises(ValueError):
        windows.baseline(f, "f", ["s"], ["t"], 1)
    dff = spark.createDataFrame([(0, 0, 110.0), (0, 1, 100.0)], "s int, t int, f double")
    got = windows.delta_f_over_f(dff, "f", ["s"], ["t"], 4, noise=100.0, sigma=4.0)
    assert values(got, "dff")[0] == pytest.approx(0.1)
    chars = spark.createDataFrame([(0, "a", 0.0), (0, "b", 1.0), (0, "c", 5.0), (0, "d", 5.5)], "s int, c string, x double")
    assert [(r.c, r.x) for r in windows.joined_sessions(chars, "c", "x", ["s"], 1.5).orderBy("x").collect()] == [("ab", 0.0), ("cd", 5.0)]
    n = spark.createDataFrame([(0, k) for k in (1, 2, 5, 9)], "s int, k int")
    assert sorted(r.k for r in windows.missing(n, "k", ["s"]).collect()) == [3, 4, 6, 7, 8]


def test_text(spark):
    assert one(spark, text.common_prefix(F.lit("MBIN-b1 left"), F.lit("MBIN-b1 right"))) == "MBIN-b1 "
    assert one(spark, text.common_prefix(F.lit("abc"), F.lit("ab"))) == "ab" and one(spark, text.common_prefix(F.lit("x"), F.lit("y"))) == ""
    assert one(spark, text.expand_ints(F.lit("2,3,8-9"))) == [2, 3, 8, 9] and one(spark, text.expand_ints(F.lit("7, 9-8"))) == [7]
    assert [one(spark, text.clock_seconds(F.lit(t))) for t in ("7", "7.5", "3.24.56")] == ["7", "7.5", "204.56"]
    assert one(spark, text.clock_interval(F.lit("1.0.0"), F.lit("1.2.5")))["duration"] == pytest.approx(2.5)
    assert one(spark, text.citation_handle(F.lit("Smith J., Doe A. (2010). On (old) things (1999)."))) == "Smith1999"
    assert one(spark, text.first_token(F.lit("x, PN-1 ,y"), "PN")) == "PN-1" and one(spark, text.first_token(F.lit("solo"), "PN")) == "solo"
    assert one(spark, text.quoted_labels(F.lit('"a, b" 1 "c"'))) == ["a, b", "c"]
    assert one(spark, text.coordinates_label(F.lit(1.0), F.lit(2.5), F.lit(3.125))) in ("1.00::2.50::3.13", "1.00::2.50::3.12")
    paths = spark.createDataFrame([("/TM0001/a",), ("/TM0/b",)], "p string")
    assert paths.where(text.search("p", "/TM0+1")).count() == 1 and paths.where(text.search("p", "TM0")).count() == 2 and paths.where(text.search("p", "")).count() == 2


def test_numbers(spark):
    assert one(spark, numeric.deinterleave(F.array(*map(F.lit, [1, 10, 2, 20, 3, 30])), 2)) == [[1, 2, 3], [10, 20, 30]]
    assert one(spark, numeric.to_unsigned(F.array(*map(F.lit, [-5, 0, 7])))) == [0, 5, 12] and one(spark, numeric.to_unsigned(F.array(*map(F.lit, [2, 3])))) == [2, 3]
    assert one(spark, numeric.reverse_bytes(F.lit(1))) == 1 << 56
    assert one(spark, numeric.channel(numeric.argb(F.lit(255), F.lit(1), F.lit(2), F.lit(3)), 2)) == 1
    assert [r.id for r in spark.range(60).where(numeric.is_prime("id")).collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59]
    hsb = one(spark, numeric.hue_saturation_brightness(F.lit(0), F.lit(255), F.lit(0)))
    assert tuple(hsb) == pytest.approx((1 / 3, 1, 1)) and tuple(one(spark, numeric.hue_saturation_brightness(F.lit(0), F.lit(0), F.lit(0)))) == (0, 0, 0)
    v = spark.createDataFrame([(x,) for x in (1.0, 4.0, 2.0, 3.0)], "v double")
    assert aggregates.upper_median_of(v, "v").first().median == 3 and v.agg(aggregates.upper_median("v").alias("m")).first().m == 3
    b = spark.createDataFrame([(0.0,), (5.0,), (10.0,)], "v double")
    assert sorted(tuple(r) for r in aggregates.histogram(b, "v", 3, 0.0, 10.0).collect()) == [(0, 1), (1, 1), (2, 1)]
    assert spark.range(1).select(aggregates.area_of_triangle([F.lit(0), F.lit(0), F.lit(0)], [F.lit(3), F.lit(0), F.lit(0)], [F.lit(0), F.lit(4), F.lit(0)]).alias("a")).first().a == 6


def test_pixel_expressions(spark):
    volume = spark.range(1000).select(pixels.power(pixels.add(F.lit(0), 5), 2).alias("v"))
    assert volume.agg(F.sum("v")).first()[0] == 25000
    truth = spark.createDataFrame([(a, b) for a in (0, 1) for b in (0, 1)], "a int, b int")
    got = truth.select(pixels.both("a", "b").alias("n"), pixels.either("a", "b").alias("o"), pixels.one_of("a", "b").alias("x"), pixels.negated("a").alias("t")).collect()
    assert [tuple(r) for r in got] == [(False, False, False, True), (False, True, True, True), (False, True, True, False), (True, True, False, False)]
    done = pixels.let({"s": pixels.add("a", "b"), "t": lambda s: s * 10}, lambda s, t: s + t)(truth, "v")
    assert [r.v for r in done.collect()] == [0, 11, 11, 22] and done.columns == ["a", "b", "v"]
    assert one(spark, pixels.div(F.lit(1.0), 0.0)) is None


def test_affine(spark):
    rng = np.random.default_rng(3)
    for d in (2, 3):
        m = rng.normal(size=(d, d + 1))
        row = F.array(*[F.lit(float(x)) for x in m.ravel()])
        same = one(spark, affine.concatenate(row, affine.invert(row, d), d))
        assert np.allclose(np.array(same).reshape(d, d + 1), np.eye(d, d + 1), atol=1e-9)
        p = rng.normal(size=d)
        got = spark.range(1).select(*affine.apply(row, [F.lit(float(x)) for x in p])).first()
        assert np.allclose(list(got), m[:, :d] @ p + m[:, d])
    maps = [np.hstack([np.eye(2) + 0.1 * rng.normal(size=(2, 2)), rng.normal(size=(2, 1))]) for _ in range(11)]
    df = spark.createDataFrame([(0, i, m.ravel().tolist()) for i, m in enumerate(maps)], "g int, i int, m array<double>")
    got = [r.m for r in windows.cumulative_affine(df, "m", ["g"], "i", 2).orderBy("i").collect()]
    full = lambda m: np.vstack([m, [0, 0, 1]])
    last = np.eye(3)
    for i, m in enumerate(maps):
        last = last if i == 0 else last @ np.linalg.inv(full(m))
        assert np.allclose(np.array(got[i]).reshape(2, 3), last[:2])
    assert one(spark, affine.invert(F.array(*[F.lit(0.0)] * 6), 2)) == [None] * 6


def test_neighbours(spark):
    pts = spark.createDataFrame([(i, 1.0, 1.0, float(i)) for i in range(10)], "pid int, x double, y double, z double")
    near = spatial.neighbours(pts, ["x", "y", "z"], 3.0).where("pid = 1").orderBy("rank").collect()
    assert [(r.other, r.d2) for r in near] == [(1, 0.0), (0, 1.0), (2, 1.0), (3, 4.0), (4, 9.0)]
    plan = spatial.radius_join(pts, pts, ["x", "y", "z"], 3.0)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_radius_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(-20, 20, (80, 2))
    pts = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "pid int, x double, y double")
    for strict in (False, True):
        got = {(r.pid, r.other) for r in spatial.radius_join(pts, pts, ["x", "y"], 5.0, strict=strict).collect()}
        d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
        assert got == {(i, j) for i in range(80) for j in range(80) if (d2[i, j] < 25 if strict else d2[i, j] <= 25)}
    knn = spatial.k_nearest_anywhere(pts, ["x", "y"], 3, 0.5).groupBy("pid").count().collect()
    assert {r["count"] for r in knn} == {4} and len(knn) == 80


def test_feature_matches(spark):
    f = lambda rows: spark.createDataFrame(rows, "id int, angle double, len1 double, len2 double")
    a, b = f([(0, 1.0, 4.0, 9.0)]), f([(0, 1.01, 4.0, 9.0)])
    assert spatial.match_features(a, b, 0.02, 1.0).count() == 1 and spatial.match_features(a, b, 0.01, 1.0).count() == 0
    arrays = lambda rows: spark.createDataFrame(rows, "angles array<double>, lengths array<double>")
    x, y = arrays([([1.0], [4.0, 9.0])]), arrays([([1.5], [4.0, 9.0]), ([1.0, 2.0], [1.0, 1.0, 1.0])])
    assert [spatial.match_arrays(x, y, 0.1, 0.5, which).count() for which in (1, 2, 3)] == [0, 1, 0]
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 0.0, 2.0), (3, 3.0, 0.0)], "pid int, x double, y double")
    got = spatial.constellations(pts, ["x", "y"], 2.5, 0.1, 5).where("pid = 0").collect()
    assert [(r.len1, r.len2) for r in got] == [(1.0, 4.0)] and got[0].angle == pytest.approx(math.pi / 2)
    assert spatial.constellations_of_all_pairs(pts, ["x", "y"], 5.0).where("pid = 0").count() == 3
    k = spatial.constellations_of_k(pts, ["x", "y"], 5.0, 3).where("pid = 0").first()
    assert k.lengths == [1.0, 4.0, 9.0] and len(k.angles) == 2


def test_band_pairs(spark):
    df = spark.range(10).withColumnRenamed("id", "at")
    size = lambda **k: spatial.band_pairs(df, "at", 3, **k).count()
    assert (size(complete=False), size(inclusive=True, complete=False), size(), size(inclusive=True)) == (16, 21, 17, 24)
    assert spatial.all_pairs(5, spark).count() == 10


def test_graphs(spark):
    e = spark.createDataFrame([("a", "b", 3), ("b", "a", 4), ("a", "c", 2), ("c", "a", 9), ("d", "d", 3)], "src string, dst string, weight int")
    assert {frozenset((r.src, r.dst)) for r in graph.reciprocal(e, 3).collect()} == {frozenset("ab"), frozenset("d")}
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2), (5, 4), (9, None)], "node int, parent int")
    assert {r.node: (r.root, r.depth) for r in graph.path_to_root(tree).collect()} == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 2), 5: (1, 3), 9: (9, 0)}
    chosen = spark.createDataFrame([(3,), (5,)], "node int")
    assert graph.nearest_common_ancestor(tree, chosen).first().nca == 2
    cuts = spark.createDataFrame([(4,)], "node int")
    assert {r.node: r.part for r in graph.compartments(tree, cuts).collect() if r.part == "axon"} == {5: "axon"}
    assert {r.node: r.parent for r in graph.rerooted(tree, 5).collect()} == {5: None, 4: 5, 2: 4, 1: 2, 3: 2, 9: None}
    far = graph.distances_from_common_ancestor(tree, chosen.union(spark.createDataFrame([(77,)], "node int")), F.lit(1.0)).collect()
    assert {r.node: r.distance for r in far} == {3: None, 5: None, 77: None}
    assert {r.node: r.distance for r in graph.distances_from_common_ancestor(tree, chosen, F.lit(1.0)).collect()} == {3: 1.0, 5: 2.0}


def test_sets(spark):
    t = lambda rows: spark.createDataFrame(rows, "key string, body string, line int")
    got = sets.last_wins([t([("a", "1", 0), ("a", "2", 1), ("b", "1", 2)]), t([("a", "3", 5), ("a", "4", 6)])], "key", "body", "line")
    assert {r.key: r.body for r in got.collect()} == {"a": "3", "b": "1"}
    merged = one(spark, sets.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))))
    assert merged == {"a": 1, "b": 3}


def test_images(spark):
    img = images.functional(spark, 4, 3, lambda x, y: (x + 10 * y).cast("double"))
    turned = {(r.x, r.y): r.v for r in images.rotated(img, "x", "y", 4, 3).collect()}
    assert turned == {(2 - y, x): float(x + 10 * y) for x in range(4) for y in range(3)}
    integral = windows.prefix_sum_2d(img.withColumn("g", F.lit(0)), "x", "y", "v", ["g"])
    sums = {(r.x, r.y): r["sum"] for r in images.block_sums(integral, "x", "y", "integral", 2, 2).collect()}
    assert sums == {(x, y): sum(float(x + i + 10 * (y + j)) for i in (0, 1) for j in (0, 1)) for x in range(3) for y in range(2)}
    chunked = images.projected_in_chunks(img, ["x"], "y", 2, "v").where("x = 0").orderBy("y").collect()
    assert [r.v for r in chunked] == [10.0, 20.0]
    a = np.zeros((21, 21))
    a[8, 12] = 100.0
    peaks = images.detect_peaks(spark.createDataFrame([(1, [21, 21], a.ravel().tolist())], "id int, size array<int>, data array<double>"), "id", "size", "data", 1.0, 2.0, 0.5).collect()
    assert len(peaks) == 1 and np.allclose(peaks[0]["at"], [8, 12])
    b = np.random.default_rng(1).normal(size=(32, 32))
    assert images.phase_correlation(b, np.roll(b, (3, -5), (0, 1))) == (3, -5)
    square = lambda r: images.functional(spark, 21, 21, lambda x, y: ((F.abs(x - 10) <= r) & (F.abs(y - 10) <= r)).cast("int"))
    middle = images.interpolated_masks(square(2), square(6), "x", "y", "v", 0.5, 20.0)
    assert 25 < middle.agg(F.sum("v")).first()[0] < 169
    flat = images.local_contrast(images.constant(spark, 5, 5, 3.0), "x", "y", "v", 1)
    assert {r.contrast for r in flat.collect()} == {0.5}
    assert images.haar_bank(integral, "x", "y", "integral", 3).count() >= 1
    assert images.mandelbrot(spark, 9, 7, 20).agg(F.max("v")).first()[0] == 20


def test_fits(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0, 100, (60, 3))
    m = np.hstack([np.linalg.qr(rng.normal(size=(3, 3)))[0], [[5.0], [1.0], [-2.0]]])
    if np.linalg.det(m[:, :3]) < 0:
        m[:, 0] *= -1
    q = p @ m[:, :3].T + m[:, 3]
    q[:20] = rng.uniform(0, 100, (20, 3))
    rows = spark.createDataFrame([(1, a.tolist(), b.tolist()) for a, b in zip(p, q)], "pair int, p1 array<double>, p2 array<double>")
    for model in ("rigid", "affine"):
        got = registration.fit_pairs(rows, ["pair"], model, iterations=300, epsilon=0.5).first()
        assert got.inliers == 40 and np.allclose(np.array(got.matrix).reshape(3, 4), m, atol=1e-6)
    assert registration.fit_pairs(rows.limit(3), ["pair"]).first().matrix is None
    shifts = np.array([[0, 0, 0], [3.0, 1, 0], [5.0, 2, 1]])
    world = rng.uniform(0, 10, (8, 3))
    tiles = [(i, j, world - shifts[i], world - shifts[j]) for i in range(3) for j in range(i)]
    maps = registration.relax(3, [0], tiles, "translation")
    assert np.allclose(maps[:, :, 3], shifts, atol=1e-4)
    spline = registration.thin_plate(p[:10, :2], q[:10, :2])
    assert np.allclose(spline(p[:10, :2]), q[:10, :2], atol=1e-5)


def test_merged_peaks(spark):
    steps = [np.array([[0.0, 0, 0], [10.0, 0, 0]]), np.array([[1.0, 0, 0]]), np.array([[20.0, 0, 0], [20.1, 0, 0]])]
    known, count = streams.merged_peaks(steps, 2.0)
    assert known[:, 0].tolist() == [0.5, 10.0, 20.0, 20.1] and count.tolist() == [2, 1, 1, 1]
    rows = [("s", t, *map(float, p)) for t, s in enumerate(steps) for p in s]
    got = streams.merge_peaks(spark.createDataFrame(rows, "series string, t int, x double, y double, z double"), "series", 2.0)
    assert sorted((r.x, r.n) for r in got.collect()) == [(0.5, 2), (10.0, 1), (20.0, 1), (20.1, 1)]
    assert streams.frequent(got, 1).count() == 1


def test_flows(spark):
    from veldmark.operators import filters, flows, ml

    rows = []
    for t in range(4):
        a = np.zeros((15, 15))
        a[5, 6] = a[9, 3 if t == 2 else 11] = 50.0
        rows.append(("s", t, [15, 15], a.ravel().tolist()))
    volumes = spark.createDataFrame(rows, "series string, t int, size array<int>, data array<double>")
    found = flows.nuclei_over_time(volumes, "series", "t", "size", "data", 1.0, 2.0, 1.0, 1.5, 1).collect()
    assert sorted((round(r.x), round(r.y), r.n) for r in found) == [(5, 6, 4), (9, 11, 3)]
    voxels = spark.createDataFrame([(t, x, y, float(10 * (x == 2 and y == 2) + t)) for t in range(6) for x in range(5) for y in range(5)], "t int, x int, y int, v double")
    peaks = flows.nuclei_by_projection(voxels, ["x", "y"], "v", 6.0)
    assert [(r.x, r.y) for r in peaks.collect()] == [(2, 2)]
    dff = flows.measured(peaks.withColumn("pid", F.lit(0)).select("pid", "x", "y"), voxels, ["x", "y"], [1, 1], "t", "v", 4).orderBy("t").collect()
    assert [r.mean for r in dff] == [2.0 + t for t in range(6)] and dff[3].dff == pytest.approx((5 - 3) / 3)
    steps = [("s", t, [float(i), float(i * i % 7)], [i + 2.0, i * i % 7 + 1.0]) for t in (1, 2) for i in range(8)]
    maps = flows.forward_transforms(spark.createDataFrame(steps, "s string, t int, p1 array<double>, p2 array<double>"), "s", "t", iterations=50, epsilon=0.1).orderBy("t").collect()
    assert np.allclose([m.matrix for m in maps], [[1, 0, -2, 0, 1, -1], [1, 0, -4, 0, 1, -2]])
    image, mask = flows.training_image(30, 30, 3, 1.0, 0.01)
    pixels_ = [(x, y, float(image[y, x]), float(np.abs(x - 15)), float(mask[y, x])) for y in range(30) for x in range(30)]
    table = spark.createDataFrame(pixels_, "x int, y int, a double, b double, label double")
    attributes, samples = table.drop("label"), table.where("(x + y) % 3 = 0").select("x", "y", "label")
    train = ml.training_set(samples, attributes, ["x", "y"])
    for model in (ml.random_forest(train, ["a", "b"], 20), ml.support_vectors(train, ["a", "b"]), ml.perceptron(train, ["a", "b"], 2)):
        done = ml.classify(model, attributes).join(table.select("x", "y", "label"), ["x", "y"])
        assert done.where("class = label").count() > 780
    shares = ml.classify(ml.random_forest(train, ["a", "b"], 20), attributes, probability_of=1)
    assert shares.where("probability BETWEEN 0 AND 1").count() == 900
    assert len(flows.rotations()) == 36 and filters.large_files(spark.createDataFrame([("a.tif", 1 << 27), ("b.tif", 5)], "path string, length long"), ".tif").count() == 1
    assert one(spark, flows.exported_chunk(F.lit(0.0), 0.0, 10.0)) == 255
