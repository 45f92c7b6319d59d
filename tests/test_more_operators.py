"""Operators beside the driver's tables: small inputs against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.operators import filter_bank, graph, images, registration, sets, spatial, windows
from veldmark.sources import binary, regions, sinks

rng = random.Random(11)


def test_components_of_a_path_a_star_and_loops(spark):
    path = list(range(100, 160))
    rng.shuffle(path)
    edges = [*zip(path, path[1:], strict=False), *((5, i) for i in range(10, 40)), (3, 3), (7, 8), (8, 7), (7, 8)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {p: 100 for p in path} | {i: 5 for i in [5, *range(10, 40)]} | {3: 3, 7: 7, 8: 7}
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_numbered_and_natural_order(spark):
    values = [str(rng.randrange(50)) if rng.random() < 0.6 else rng.choice(["b", "a10", "a9", None, "1e2", ""]) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id long, c string").repartition(7)
    got = sorted(windows.numbered(df, [*sets.natural_order("c"), F.col("id")]).collect(), key=lambda r: r.place)

    def key(i):
        c = values[i]
        try:
            return 0, float(c), "", c, i
        except (TypeError, ValueError):
            return 1, 0.0, c is None, c or "", i

    assert [r.id for r in got] == sorted(range(300), key=key) and [r.place for r in got] == list(range(300))
    assert windows.numbered(df.limit(0), [F.col("id")]).count() == 0


def test_written_files_are_read_again(spark, tmp_path):
    r = np.random.default_rng(4)
    for kind, high in ((np.uint8, 4), (np.uint16, 60_000), (np.float32, 9)):
        planes = [(r.integers(0, high, (7, 5)) // 2).astype(kind) for _ in range(3)]
        for compression in binary.PACK:
            for big in (False, True):
                for rows in (None, 1, 3, 7):
                    content = binary.tagged_image(planes, compression, big, rows)
                    found = [binary.plane(content, d).reshape(7, 5) for d in binary.directories(content)]
                    assert len(found) == 3 and all(np.array_equal(a, b) for a, b in zip(found, planes, strict=True))
    for _ in range(300):
        data = bytes(rng.choice([0, 0, 0, 1, 2]) for _ in range(rng.randint(0, 400)))
        assert binary.unpack_bits(binary.pack_bits(data)) == data
    df = spark.createDataFrame([(f"a/{i}.bin", bytes([i]) * i) for i in range(20)], "name string, content binary").repartition(4)
    for folder in (f"file://{tmp_path}/one", str(tmp_path / "one")):
        assert sinks.files(df, folder) == 20
        assert {p.name: p.read_bytes() for p in (tmp_path / "one/a").iterdir()} == {f"{i}.bin": bytes([i]) * i for i in range(20)}


def test_cells_of_raw_images(spark, tmp_path):
    grid = np.arange(11 * 9, dtype=">u2").reshape(11, 9)
    (tmp_path / "a.raw").write_bytes(b"head" + grid.tobytes())
    got = regions.read_cells(spark, str(tmp_path / "a.raw"), 9, 11, 4, header=4).collect()
    assert {(r.cx, r.cy, r.y): r.data for r in got} == {(cx, y // 4, y): grid[y, 4 * cx : 4 * cx + 4].tolist() for cx in range(3) for y in range(11)}


@pytest.mark.parametrize("band", [1, 3, 100])
def test_blocks_over_bands(spark, band):
    a = np.random.default_rng(2).integers(0, 9, (13, 11)).astype(float)
    df = spark.createDataFrame([(x, y, float(a[y, x])) for y in range(13) for x in range(11)], "x long, y long, v double")
    blocks = {"_a": (-2, 1, -3, 0), "_b": (1, 3, 2, 4), "_c": (0, 0, 0, 0), "_d": (-9, -5, -9, 9)}
    for r in filter_bank.with_blocks(df, blocks, "x", "y", "v", band=band).collect():
        for name, (x0, x1, y0, y1) in blocks.items():
            assert r[name] == a[max(0, r.y + y0) : max(0, r.y + y1 + 1), max(0, r.x + x0) : max(0, r.x + x1 + 1)].sum()


def test_patches_and_kernels(spark):
    a = np.random.default_rng(3).integers(0, 9, (6, 5)).astype(float)
    df = spark.createDataFrame([(x, y, float(a[y, x])) for y in range(6) for x in range(5)], "x long, y long, v double")
    around = np.pad(a, 2, mode="edge")
    got = {(r.x, r.y): r.patch for r in filter_bank.patch(df, "x", "y", "v", 5, 6, 2).collect()}
    assert got == {(x, y): around[y : y + 5, x : x + 5].ravel().tolist() for x in range(5) for y in range(6)}
    with pytest.raises(ValueError):
        filter_bank.kernel(df, [1.0, 2.0], "k", "v")


def test_features_over_angles(spark):
    """A flat image stays flat, and so do its features; an image turned and turned back is near itself in the middle."""
    flat = images.functional(spark, 12, 10, lambda x, y: F.lit(3.0))
    bank = lambda df: df.withColumn("twice", F.col("v") * 2)
    got = filter_bank.over_angles(flat, "x", "y", "v", 12, 10, [0, 27, 45], bank, ["twice"]).collect()
    assert len(got) == 120 and all(abs(r[c] - 6) < 1e-6 for r in got for c in ("twice_0", "twice_27", "twice_45"))
    slope = images.functional(spark, 16, 16, lambda x, y: (x + 2 * y).cast("double"))
    got = filter_bank.over_angles(slope, "x", "y", "v", 16, 16, [9, 36], bank, ["twice"]).where("x BETWEEN 5 AND 10 AND y BETWEEN 5 AND 10").collect()
    assert len(got) == 36 and all(abs(r[c] - 2 * (r.x + 2 * r.y)) < 4 for r in got for c in ("twice_9", "twice_36"))


def test_elastic_maps(spark):
    r = np.random.default_rng(6)
    p, q = r.uniform(0, 50, (12, 2)), r.uniform(0, 50, (12, 2))
    matches = spark.createDataFrame([("a", x.tolist(), y.tolist()) for x, y in zip(p, q, strict=True)], "g string, p1 array<double>, p2 array<double>")
    points = spark.createDataFrame([("a", i, x.tolist()) for i, x in enumerate(p)] + [("b", 99, [1.0, 2.0])], "g string, pid long, p array<double>")
    got = {r.pid: r.place for r in registration.elastic(matches, points, ["g"]).collect()}
    assert got.pop(99) == [1.0, 2.0] and all(np.allclose(got[i], q[i], atol=1e-5) for i in range(12))


@pytest.mark.parametrize("radii", [[2.0], [2.0, 3.0], [1.0, 2.5, 2.0], [0.5, 3.0]])
def test_voxels_of_an_ellipsoid(spark, radii):
    from itertools import product

    inside = [p for p in product(*[range(-int(r), int(r) + 1) for r in radii]) if sum((x / r) ** 2 for x, r in zip(p, radii, strict=True)) <= 1 + 1e-9]
    assert spatial.ball_size(radii) == len(inside)
    axes = ["x", "y", "z"][: len(radii)]
    peaks = spark.createDataFrame([(0, *[5] * len(radii))], "pid int, " + ", ".join(f"{a} int" for a in axes))
    voxels = spark.createDataFrame([(0, *p, 1.0) for p in product(range(11), repeat=len(radii))], "t int, " + ", ".join(f"{a} int" for a in axes) + ", v double")
    assert spatial.region_means(peaks, voxels, axes, radii, "pid", ["t"], "v").first()["mean"] == 1.0


def test_smoothed_positions_equal_a_plain_walk(spark):
    """A root, a branch with two arms, an end, and a chain whose parent isn't there."""
    parent = {0: None, 1: 0, 2: 1, 3: 2, 4: 3, 5: 3, 6: 5, 7: 6, 8: 4, 9: 8, 20: 99, 21: 20, 22: 21, 30: None}
    place = {n: (float(n * n % 11), float(n * 3 % 7)) for n in parent}
    sigma = 3.0
    up = {n: p if p in parent else None for n, p in parent.items()}
    children = {n: [m for m in up if up[m] == n] for n in up}
    fixed = {n for n in up if up[n] is None or len(children[n]) != 1}
    want = {n: place[n] for n in fixed}
    for n in set(up) - fixed:
        near = [(0.0, n)]
        for step in (lambda m: up[m], lambda m: children[m][0]):
            at, d = n, 0.0
            while at == n or at not in fixed:
                d, at = d + math.dist(place[at], place[step(at)]), step(at)
                near.append((d, at))
        weights = [(math.exp(-d * d / (2 * sigma * sigma)), m) for d, m in near if d <= 3 * sigma]
        want[n] = tuple(sum(w * place[m][i] for w, m in weights) / sum(w for w, _ in weights) for i in range(2))
    df = spark.createDataFrame([(n, parent[n], *place[n]) for n in parent], "node long, parent long, x double, y double")
    got = {r.node: (r.x, r.y) for r in graph.smoothed_positions(df, ["x", "y"], sigma).collect()}
    assert got.keys() == want.keys()
    assert all(math.dist(got[n], want[n]) < 1e-9 for n in want)
