"""Searches by blocks equal plain loops, and no row of theirs is a pair that only serves to find the answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.operators import nearby, spatial
from veldmark.plans import catalogue

SF = "/root/testdata/sf0.001"
AXES = ["x", "y"]


def plan(spark, name):
    return catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def cloud(spark):
    """Whole places, several points in some of them, one without a place."""
    rng = np.random.default_rng(3)
    rows = [(int(i), *map(float, rng.integers(-12, 12, 2)), int(rng.integers(0, 3))) for i in rng.permutation(150)]
    return rows, spark.createDataFrame([*rows, (999, None, 1.0, 0)], "pid long, x double, y double, label int")


def around(rows, p, radius):
    d2 = lambda q: (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2
    return sorted(((d2(q), q[0] != p[0], q[0], q) for q in rows if d2(q) <= radius * radius), key=lambda r: r[:3])


def test_neighbours_in_blocks(spark, cloud, monkeypatch):
    """F8: j8_neighbours ranks inside its blocks, however small these are."""
    rows, df = cloud
    monkeypatch.setattr(nearby, "TILE", 40)
    got = sorted(map(tuple, spatial.neighbours(df, AXES, 5.0).select("pid", "other", "d2", "rank").collect()))
    assert got == sorted((p[0], r[2], r[0], k) for p in rows for k, r in enumerate(around(rows, p, 5.0)))
    assert "Window" not in plan(spark, "j8_neighbours")


def test_a_key_of_many_rows_has_many_blocks(spark, cloud):
    rows, df = cloud
    keyed = df.where("x IS NOT NULL").select(F.lit(1).alias("k"), "pid")

    def settle(key, ours, theirs):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"line": pa.array([key["_line"]], pa.int32()), "ours": pa.array([ours.num_rows]), "theirs": pa.array([theirs.num_rows])})

    got = nearby.by_block(keyed, keyed, ["k"], settle, "line int, ours long, theirs long", line=20).collect()
    assert len(got) > 4 and sum(r.ours for r in got) == len(rows) and all(r.theirs == len(rows) for r in got)


def test_ratio_of_the_two_nearest(spark, cloud):
    """j11_ratio looks for two neighbours of each point, not for all."""
    rows, df = cloud
    got = sorted(map(tuple, spatial.k_nearest(df, AXES, 2, 5.0).select("pid", "other", "rank").collect()))
    assert got == sorted((p[0], r[2], k) for p in rows for k, r in enumerate(around(rows, p, 5.0)[:3]))
    assert plan(spark, "j11_ratio").count("MapInArrow") == 1


def test_nearest_of_each_tag(spark, cloud):
    """n20_nearest_by_tag has no row for a seed that isn't the nearest."""
    rows, df = cloud
    want = {}
    for p in rows:
        for d2, _, other, q in around(rows, p, 5.0):
            want[p[0], q[3]] = min(want.get((p[0], q[3]), (np.inf, 0)), (d2, other))
    got = {(r.pid, r.label): (r.d2, r.nearest) for r in spatial.nearest_by_tag(df, df, AXES, 5.0, "label").collect()}
    assert got == want and "MapInArrow" in plan(spark, "n20_nearest_by_tag")


def test_nearest_closer_than_radius(spark, cloud):
    """n21_spheres has no row for a sphere that isn't the nearest."""
    rows, df = cloud
    seeds = [q for q in rows if q[3] == 0]
    want = {p[0]: near[0][:1] + (min(r[2] for r in near if r[0] == near[0][0]),) for p in rows if (near := [r for r in around(seeds, p, 3.0) if r[0] < 9])}
    got = {r.pid: (r.d2, r.nearest) for r in spatial.nearest(df, df.where("label = 0"), AXES, 3.0).collect()}
    assert got == want and "MapInArrow" in plan(spark, "n21_spheres")


@pytest.mark.parametrize("most,least", [(1, 0.3), (4, 0.3), (40, 1.2), (500, 0.0)])
def test_constellations_from_the_farthest(spark, cloud, most, least):
    """n2_constellations has no row for a neighbour outside its features."""
    rows, df = cloud
    got = {}
    for r in spatial.constellations(df, AXES, 9.0, least, most).collect():
        got.setdefault(r.pid, []).append((r.feature, r.len1, r.len2, round(r.angle, 9), r.x, r.y))
    for p in rows:
        near, want = around(rows, p, 9.0)[1:], []
        for a, b in reversed(list(zip(near, near[1:], strict=False))):
            v, w = (np.subtract(r[3][1:3], p[1:3]) for r in (a, b))
            size = np.sqrt(v @ v) * np.sqrt(w @ w)
            if size and len(want) < most and (angle := np.arccos(np.clip(v @ w / size, -1, 1))) >= least:
                want.append((len(want), a[0], b[0], round(float(angle), 9), p[1], p[2]))
        assert sorted(got.get(p[0], [])) == want
    assert "Window" not in plan(spark, "n2_constellations")


def test_wide_and_few_shuffles_features_only(spark):
    """pf8_wide_and_few has no window over neighbours."""
    found = plan(spark, "pf8_wide_and_few")
    assert "MapInArrow" in found and "lead(" not in found


def test_features_of_k_take_the_nearest(spark, cloud):
    """n3_features_of_k ranks no neighbour beyond those that its features use."""
    rows, df = cloud
    got = {(r.pid, r.feature): list(r.lengths) for r in spatial.constellations_of_k(df, AXES, 9.0, 3, max_per_peak=4).collect()}
    want = {}
    for p in rows:
        far = [r[0] for r in around(rows, p, 9.0)[1:7]]
        want |= {(p[0], k): far[k : k + 3] for k in range(len(far) - 2)}
    assert got == want and "Window" not in plan(spark, "n3_features_of_k")


def test_all_pairs_of_neighbours(spark, cloud):
    """n4_all_pairs_features makes its pairs from a point's own array, without a join of neighbours with neighbours."""
    rows, df = cloud
    got = sorted((r.pid, r.i, r.j, r.len1, r.len2) for r in spatial.constellations_of_all_pairs(df, AXES, 4.0).collect())
    near = {p[0]: around(rows, p, 4.0)[1:] for p in rows}
    assert got == sorted((p, i, j, a[0], b[0]) for p, n in near.items() for i, a in enumerate(n, 1) for j, b in enumerate(n, 1) if i < j)
    found = plan(spark, "n4_all_pairs_features")
    assert "Window" not in found and "SortMergeJoin" not in found.split("MapInArrow")[0]


@pytest.fixture(scope="module")
def angles(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)), float(rng.uniform(0, 3)), *map(float, rng.integers(0, 40, 2))) for i in range(240)]
    return rows, spark.createDataFrame(rows, "pid long, t int, angle double, len1 double, len2 double")


def agreeing(rows, share=False):
    for a in rows:
        for b in rows:
            if b[1] == a[1] + 1 and abs(a[2] - b[2]) < 0.2:
                one, two = (r[3] / (r[3] + r[4]) if r[3] + r[4] else np.nan for r in (a, b))
                if abs(one - two) < 0.1 if share else abs(a[3] - b[3]) + abs(a[4] - b[4]) < 12:
                    yield a, b


def test_matches_in_blocks(spark, angles):
    """j4_match compares features in blocks of a band of angles, without a join."""
    rows, df = angles
    got = sorted((r.f1.pid, r.f2.pid) for r in spatial.match_features(df, df.withColumn("t", F.col("t") - 1), 0.2, 12.0, by=["t"]).collect())
    assert got and got == sorted((a[0], b[0]) for a, b in agreeing(rows))
    assert "Join" not in plan(spark, "j4_match").split("MapInArrow")[0]


def test_matches_of_any_scale_in_blocks(spark, angles):
    """j5_scale_invariant too; features without lengths match nothing."""
    rows, df = angles
    got = sorted((r.f1.pid, r.f2.pid) for r in spatial.match_features(df, df.withColumn("t", F.col("t") - 1), 0.2, 0.1, by=["t"], scale_invariant=True).collect())
    assert got and got == sorted((a[0], b[0]) for a, b in agreeing(rows, share=True))
    assert "Join" not in plan(spark, "j5_scale_invariant").split("MapInArrow")[0]


def test_counts_of_matches_without_their_rows(spark, angles):
    """a27_match_counts counts in blocks."""
    rows, df = angles
    want = {}
    for a, _ in agreeing(rows):
        want[a[1]] = want.get(a[1], 0) + 1
    assert {r.t: r.n for r in nearby.match_counts(df, df.withColumn("t", F.col("t") - 1), 0.2, 12.0, ["t"]).collect()} == want


def test_ids_of_several_fields(spark, cloud):
    """ids may be structs, as those of pixels."""
    rows, df = cloud
    keyed = df.withColumn("pid", F.struct((F.col("pid") % 3).alias("a"), "pid"))
    plain = {r.pid: r.nearest for r in spatial.nearest(df, df.where("label = 0").withColumn("pid", F.col("pid")), AXES, 3.0).collect()}
    got = {r.pid.pid: r.nearest for r in spatial.nearest(keyed, keyed.where("label = 0"), AXES, 3.0).collect()}
    place = {p[0]: p[1:3] for p in rows}
    assert got.keys() == plain.keys() and all(sum((u - v) ** 2 for u, v in zip(place[k], place[got[k].pid])) == sum((u - v) ** 2 for u, v in zip(place[k], place[plain[k]])) for k in got)


def test_dense_cells_are_not_copied(spark, monkeypatch):
    """pf8_wide_and_few sends the points round a cell of 6,000 to one block."""
    own, seen = nearby.dealt, []
    monkeypatch.setattr(nearby, "dealt", lambda *args: seen.append(own(*args)) or seen[-1])
    points = spark.range(6000).select(F.col("id").alias("pid"), *[(F.col("id") * k % 97 / 100).alias(a) for k, a in zip((1, 7, 31), AXES)])
    spatial.constellations(points, AXES, 1.0, 0.25, 4)
    assert seen[0][2].agg(F.max("_lines")).first()[0] == 1


def test_pairs_of_a_dense_cell_are_dealt(spark, cloud, monkeypatch):
    """F1 (r04): n4_all_pairs_features makes the pairs of a cell of 600 points in several blocks of few points, and the same pairs."""
    own, seen = nearby.dealt, []
    monkeypatch.setattr(nearby, "dealt", lambda *args: seen.append(own(*args)) or seen[-1])
    pairs = lambda df, radius: sorted(map(tuple, spatial.constellations_of_all_pairs(df, AXES, radius).select("pid", "i", "j", "len1", "len2").collect()))
    dense = spark.range(600).select(F.col("id").alias("pid"), *[(F.col("id") * k % 97 / 100).alias(a) for k, a in zip((1, 7), AXES)])
    spatial.constellations_of_all_pairs(dense, AXES, 1.0)
    sizes = [r["count"] for r in seen[0][0].groupBy("_g0", "_g1", "_line").count().collect()]
    assert len(sizes) >= 4 and max(sizes) <= 2 * nearby.FEW and sum(sizes) == 600
    want = pairs(cloud[1], 4.0)
    monkeypatch.setattr(nearby, "FEW", 2)
    assert want and pairs(cloud[1], 4.0) == want


def test_neighbours_are_told_by_rank(spark):
    """F2 (r04): j8_neighbours tells the neighbours of 16 points together by rank."""
    points = spark.range(64).select(F.col("id").alias("pid"), *[(F.col("id") * k % 97 / 100).alias(a) for k, a in zip((1, 7), AXES)])
    first = spatial.neighbours(points.repartition(1), AXES, 2.0).where("rank < 3").collect()
    assert [r["rank"] for r in first] == [k for _ in range(4) for k in (0, 1, 2) for _ in range(16)]


@pytest.mark.parametrize("step", [1.0, 0.1])
def test_neighbours_among_groups_of_points(spark, step):
    """Whole and other places, many points in a cell, with and without most, and their counts."""
    rng = np.random.default_rng(8)
    at = rng.integers(-20, 20, (500, 2)) * step
    rows = [(int(i), float(x), float(y)) for i, (x, y) in zip(rng.permutation(500), at)]
    df = spark.createDataFrame(rows, "pid long, x double, y double")
    ids, x, y = (np.array(c) for c in zip(*rows))
    want, radius = [], 15 * step
    for p, u, v in rows:
        d2 = (u - x) * (u - x) + (v - y) * (v - y)
        near = np.flatnonzero(d2 <= radius * radius)
        near = near[np.lexsort((ids[near], ids[near] != p, d2[near]))]
        want += [(p, int(ids[j]), float(d2[j]), k) for k, j in enumerate(near)]
    got = sorted(map(tuple, spatial.neighbours(df, AXES, radius).select("pid", "other", "d2", "rank").collect()))
    assert got == sorted(want)
    assert sorted(map(tuple, spatial.k_nearest(df, AXES, 3, radius).select("pid", "other", "d2", "rank").collect())) == sorted(r for r in want if r[3] <= 3)
    assert {r.pid: r.neighbours for r in nearby.neighbour_counts(df, AXES, radius).collect()} == {p: sum(r[0] == p for r in want) - 1 for p in ids.tolist()}


@pytest.mark.parametrize("name", ["j4_match", "j5_scale_invariant", "a27_match_counts"])
def test_features_are_searched_once(spark, name):
    """F3 (r04): j4_match looks for its features once, not for each side and for the sizes of blocks, and gets only ids of matches."""
    assert plan(spark, name).count("MapInArrow") == 1


@pytest.mark.parametrize("share", [False, True])
def test_matches_among_sorted_angles(share):
    """F3 (r04): j4_match compares features with those of about the same angle; all that agree are found, none with NaN."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    side = lambda n: {"_angle": np.append(rng.integers(0, 60, n) * 0.05, [np.nan, 1.0]), "_len1": np.append(rng.integers(0, 30, n) * 1.0, [3.0, 0.0]), "_len2": np.append(rng.integers(0, 30, n) * 1.0, [3.0, 0.0])}
    a, b = side(300), side(200)
    with np.errstate(invalid="ignore"):
        one, two = (t["_len1"] / (t["_len1"] + t["_len2"]) for t in (a, b))
    apart = np.abs(one[:, None] - two) if share else np.abs(a["_len1"][:, None] - b["_len1"]) + np.abs(a["_len2"][:, None] - b["_len2"])
    want = np.argwhere((np.abs(a["_angle"][:, None] - b["_angle"]) < 0.05) & (apart < (0.1 if share else 9))).tolist()
    got, compared = [], 0
    for i, j, ok in nearby._agreeing(pa.table(a), pa.table(b), 0.05, 0.1 if share else 9, share):
        compared += ok.size
        got += [[int(i[k]), int(j[m])] for k, m in np.argwhere(ok)]
    assert want and sorted(got) == want and compared < 302 * 202 / 2
