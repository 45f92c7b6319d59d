"""Features of scale space: however an image is cut, under shifts and a quarter turn, against plain loops; matches against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.operators import features
from veldmark.operators.images import gaussian_kernel
from veldmark.operators.peaks import mirrored
from veldmark.plans import catalogue
from veldmark.sources import kept

SF = "/root/testdata/sf0.001"


def spots(n, seed, wide=None):
    """Blurred spots of several sizes, with odd sides so that every second pixel stays one under a turn."""
    r = np.random.default_rng(seed)
    wide = wide or n
    x, y = np.meshgrid(np.arange(n), np.arange(wide), indexing="ij")
    a = np.zeros((n, wide))
    for _ in range(n * wide // 150):
        s, t = r.uniform(1.2, 5, 2)
        u, v, turn = r.uniform(0, n), r.uniform(0, wide), r.uniform(0, math.pi)
        dx, dy = x - u, y - v
        a += r.uniform(-1, 1) * np.exp(-((dx * math.cos(turn) + dy * math.sin(turn)) ** 2) / (2 * s * s) - (dy * math.cos(turn) - dx * math.sin(turn)) ** 2 / (2 * t * t))
    return a


def frame(spark, images):
    rows = [(g, int(x) + ox, int(y) + oy, float(a[x, y])) for g, (a, ox, oy) in images.items() for x, y in np.ndindex(*a.shape)]
    return spark.createDataFrame(rows, "g string, x long, y long, v double").repartition(4)


def found(df, g=None, **options):
    got = features.scale_features(df, "x", "y", "v", by=("g",), **options).collect()
    return sorted(((r.x, r.y, r.scale, r.angle, r.value, np.array(r.descriptor)) for r in got if r.g == g), key=lambda f: tuple(round(v, 6) for v in f[:4]))


def alike(one, two, near=1e-6):
    return len(one) == len(two) and all(np.allclose(p[:5], q[:5], atol=near) and np.allclose(p[5], q[5], atol=max(near, 1e-5)) for p, q in zip(one, two, strict=True))


def plain_points(a, octaves, layers=3, sigma=1.6, given=0.5, least=0.01, edge=10.0):
    """x, y, scale and value of all extrema, by loops over the whole array."""

    def smooth(a, s):
        kernel = gaussian_kernel(s)
        half = len(kernel) // 2
        for axis in (0, 1):
            at = mirrored(np.arange(-half, a.shape[axis] + half), 0, a.shape[axis] - 1)
            a = np.apply_along_axis(lambda v, at=at: np.convolve(v[at], kernel, "valid"), axis, a)
        return a

    out, base = [], smooth(a, math.sqrt(sigma**2 - given**2))
    for octave in range(octaves):
        if min(base.shape) < 8:
            break
        level = [base] + [smooth(base, sigma * math.sqrt(4 ** (i / layers) - 1)) for i in range(1, layers + 3)]
        d = np.array([q - p for p, q in zip(level, level[1:], strict=False)])
        for s in range(1, layers + 1):
            for x in range(1, base.shape[0] - 1):
                for y in range(1, base.shape[1] - 1):
                    cube = d[s - 1 : s + 2, x - 1 : x + 2, y - 1 : y + 2]
                    others, c = np.delete(cube.ravel(), 13), cube[1, 1, 1]
                    if not ((c > least / 2 and c > others.max()) or (c < -least / 2 and c < others.min())):
                        continue
                    g = np.array([(cube[2, 1, 1] - cube[0, 1, 1]) / 2, (cube[1, 2, 1] - cube[1, 0, 1]) / 2, (cube[1, 1, 2] - cube[1, 1, 0]) / 2])
                    h = np.array([[cube[2, 1, 1] - 2 * c + cube[0, 1, 1], (cube[2, 2, 1] + cube[0, 0, 1] - cube[2, 0, 1] - cube[0, 2, 1]) / 4, (cube[2, 1, 2] + cube[0, 1, 0] - cube[2, 1, 0] - cube[0, 1, 2]) / 4], [0, cube[1, 2, 1] - 2 * c + cube[1, 0, 1], (cube[1, 2, 2] + cube[1, 0, 0] - cube[1, 2, 0] - cube[1, 0, 2]) / 4], [0, 0, cube[1, 1, 2] - 2 * c + cube[1, 1, 0]]])
                    h = np.triu(h) + np.triu(h, 1).T
                    move = -np.linalg.inv(h) @ g
                    value, trace, det = c + g @ move / 2, h[1, 1] + h[2, 2], h[1, 1] * h[2, 2] - h[1, 2] ** 2
                    if abs(move).max() <= 1 and abs(value) >= least and trace**2 * edge < (edge + 1) ** 2 * det:
                        out.append(((x + move[1]) * 2**octave, (y + move[2]) * 2**octave, sigma * 2 ** ((s + move[0]) / layers) * 2**octave, value))
        base = level[layers][::2, ::2]
    return out


@pytest.fixture(scope="module")
def picture():
    return spots(97, 1, 73)


def test_points_are_those_of_plain_loops_however_cut(spark, picture):
    df = frame(spark, {"a": (picture, 0, 0)})
    whole, cut_up = found(df, "a", octaves=3, block=512), found(df, "a", octaves=3, block=20)
    assert len(whole) > 30 and alike(whole, cut_up)
    got = sorted({tuple(np.round((f[0], f[1], f[2], f[4]), 6)) for f in whole})
    want = sorted(tuple(np.round(f, 6)) for f in plain_points(picture, 3))
    assert len(got) == len(want) and np.allclose(got, want, atol=2e-6)
    assert len({f[2] > 4.1 for f in whole}) == 2  # of two octaves
    assert all(abs(np.linalg.norm(f[5]) - 1) < 1e-5 for f in whole)


def test_shift_and_quarter_turn(spark, picture):
    """A moved image, in another image's key, gives the same features moved; a turned one the same turned, with the same numbers."""
    turned = picture.T[::-1]  # x, y go to height - 1 - y, x
    df = frame(spark, {"a": (picture, 0, 0), None: (picture, -40, 1000), "t": (turned, 0, 0)})
    one = found(df, "a", octaves=3, block=64)
    assert alike(one, [(f[0] + 40, f[1] - 1000, *f[2:]) for f in found(df, None, octaves=3, block=64)])
    back = [(f[1], picture.shape[1] - 1 - f[0], f[2], (f[3] - math.pi / 2) % (2 * math.pi), *f[4:]) for f in found(df, "t", octaves=3, block=64)]
    # an angle near 0 may come out near a whole turn
    place = lambda f: (*(round(v, 5) for v in f[:3]), round(math.cos(f[3]), 4), round(math.sin(f[3]), 4))
    back, one = sorted(back, key=place), sorted(one, key=place)
    assert len(one) == len(back) and np.allclose([f[:3] for f in one], [f[:3] for f in back], atol=1e-4)
    assert all(abs(math.cos(p[3] - q[3]) - 1) < 1e-6 and np.allclose(p[5], q[5], atol=1e-3) for p, q in zip(one, back, strict=True))


def test_matches_are_those_of_all_pairs_and_find_the_turn(spark, picture):
    noise = np.random.default_rng(4).normal(0, 0.002, picture.shape)
    df = frame(spark, {"a": (picture, 0, 0), "t": ((picture + noise).T[::-1], 0, 0)})
    both = features.scale_features(df, "x", "y", "v", by=("g",), octaves=3).withColumn("id", F.xxhash64("g", "x", "y", "angle"))
    a, b = both.where("g = 'a'").drop("g"), both.where("g = 't'").drop("g")
    rows_a, rows_b = a.collect(), b.collect()
    want = {}
    for p in rows_a:
        near = sorted((float(np.linalg.norm(np.array(p.descriptor) - np.array(q.descriptor))), q.id) for q in rows_b if max(p.scale / q.scale, q.scale / p.scale) <= 1.5)
        if near and (len(near) == 1 or near[0][0] <= near[1][0] * 0.8):
            want[p.id] = near[0][1]
    got = features.descriptor_matches(a, b, [], "id", area=30.0).collect()
    assert {r.id: r.other for r in got} == want and len(got) > 0.6 * len(rows_a)
    right = [abs(r.other_x - (picture.shape[1] - 1 - r.y)) < 1 and abs(r.other_y - r.x) < 1 for r in got]
    assert sum(right) >= 0.95 * len(right)


def test_matches_within_reach(spark, picture):
    df = frame(spark, {"a": (picture, 0, 0), "b": (picture, 3, -2)})
    both = features.scale_features(df, "x", "y", "v", by=("g",), octaves=2).withColumn("id", F.xxhash64("g", "x", "y", "angle"))
    got = features.descriptor_matches(both.where("g = 'a'").drop("g"), both.where("g = 'b'").drop("g"), [], "id", reach=10.0, area=16.0).collect()
    assert len(got) > 20 and all(abs(r.other_x - r.x - 3) < 1e-6 and abs(r.other_y - r.y + 2) < 1e-6 for r in got)


def test_queries_on_whole_planes(spark):
    """Points of the query are those of plain loops; its matches find the move of the other plane."""
    a = np.array([r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()], float).T
    a = np.array([[a[max(0, x - 4) : x + 5, max(0, y - 4) : y + 5].sum() / 9 for y in range(a.shape[1])] for x in range(64)])
    got = catalogue.queries()["n11_features"](spark, SF).collect()
    want = sorted(tuple(np.round(f, 4)) for f in plain_points(a, 3))
    points = sorted({(round(r.x, 4), round(r.y, 4), round(r.scale, 4), round(r.value, 4)) for r in got})
    assert len(points) == len(want) > 20 and np.allclose(points, want, atol=2e-4)
    found = catalogue.queries()["n11_matches"](spark, SF).collect()
    right = [abs(r.other_x - r.x + 2) < 1 and abs(r.other_y - r.y + 1) < 1 for r in found]
    assert len(found) > 10 and sum(right) > 0.9 * len(right)


def test_odd_images(spark):
    """Flat, tiny and empty images have no features; null, nan and repeated pixels are as stated."""
    a = spots(41, 3)
    rows = frame(spark, {"a": (a, 0, 0), "flat": (np.ones((30, 30)), 0, 0), "tiny": (a[:5, :5], 0, 0)})
    more = spark.createDataFrame([("a", None, 3, 9.0), ("a", 0, 0, None), ("a", 0, 0, float("nan")), ("a", 1, 1, float(a[1, 1]) - 1)], rows.schema)
    with_more = rows.union(more)
    assert alike(found(rows, "a", octaves=2), found(with_more, "a", octaves=2)) and found(rows, "a", octaves=2)
    assert not found(with_more, "flat", octaves=2) and not found(with_more, "tiny", octaves=2)
    assert features.scale_features(rows.limit(0), "x", "y", "v").count() == 0


def test_features_are_kept_by_their_parameters(spark, picture, tmp_path):
    df, runs = frame(spark, {"a": (picture, 0, 0)}), []

    def features_of(least):
        def compute():
            runs.append(least)
            return features.scale_features(df, "x", "y", "v", octaves=2, least=least)

        return kept.find_or_compute(spark, str(tmp_path), "features", {"octaves": 2, "least": least}, compute).count()

    assert features_of(0.01) == features_of(0.01) >= features_of(0.1) and runs == [0.01, 0.1]
