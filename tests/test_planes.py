"""Joint maps, exact distances, block matches and contrast against plain versions."""

import numpy as np
import pytest

from veldmark.operators import blocks, distance, filter_bank, mosaics, registration


def frame(spark, m):
    rows = [(c, r, None if np.isnan(m[r, c]) else float(m[r, c])) for r in range(m.shape[0]) for c in range(m.shape[1])]
    return spark.createDataFrame(rows, "x int, y int, v double")


# Joint maps


def mosaic(n, model, noise, seed, span=3, d=2):
    """Matches of noisy points between near tiles, and the tiles' true maps."""
    rng = np.random.default_rng(seed)
    maps = [np.hstack([np.eye(d), np.zeros((d, 1))])]
    for _ in range(1, n):
        turn = 0.2 * rng.normal()
        own = np.eye(d) + 0.1 * rng.normal(size=(d, d)) if model == "affine" else np.eye(d) if model == "translation" else np.array([[np.cos(turn), -np.sin(turn)], [np.sin(turn), np.cos(turn)]])
        maps.append(np.hstack([own, 5 * rng.normal(size=(d, 1))]))
    back = lambda m, p: np.linalg.solve(m[:, :d], (p - m[:, d]).T).T + noise * rng.normal(size=p.shape)
    places = [(i, j, 10 * rng.normal(size=(8, d))) for i in range(n) for j in range(i + 1, min(n, i + span))]
    return [(i, j, back(maps[i], w), back(maps[j], w)) for i, j, w in places], maps


def least_squares(matches, n, model, d=2):
    m, rows, right = mosaics.UNKNOWNS[model](d), [], []
    for i, j, p, q in matches:
        for k, (a, b) in enumerate(zip(mosaics.slopes(p, model), mosaics.slopes(q, model), strict=True)):
            row = np.zeros((d, n * m))
            row[:, i * m : (i + 1) * m], row[:, j * m : (j + 1) * m] = a, -b
            rows.append(row[:, m:])
            right.append(q[k] - p[k])
    x = np.linalg.lstsq(np.vstack(rows), np.concatenate(right), rcond=None)[0].reshape(n - 1, m)
    same = np.hstack([np.eye(d), np.zeros((d, 1))])
    return [same, *(mosaics.step(same, v, model) for v in x)]


def table(spark, mosaics_):
    rows = [(name, i, j, a.tolist(), b.tolist()) for name, matches in mosaics_.items() for i, j, p, q in matches for a, b in zip(p, q, strict=True)]
    return spark.createDataFrame(rows, "g string, i int, j int, p1 array<double>, p2 array<double>").repartition(5)


@pytest.mark.parametrize(("model", "n", "noise"), [("translation", 10, 0.5), ("affine", 5, 0.1)])
def test_joint_maps_are_least_squares(spark, model, n, noise):
    """Two mosaics at once, noise in all points: equal to a dense solution and to tile-by-tile relaxation; a row without tile plays no part."""
    both = {name: mosaic(size, model, noise, seed)[0] for name, size, seed in (("a", n, 1), ("b", n - 2, 2))}
    df = table(spark, both).union(spark.createDataFrame([("a", None, 1, [0.0, 0.0], [9.0, 9.0])], "g string, i int, j int, p1 array<double>, p2 array<double>"))
    got = {(r.g, r.tile): np.array(r.matrix).reshape(2, 3) for r in mosaics.joint_maps(df, "g", [0], model).collect()}
    assert len(got) == 2 * n - 2
    for name, size in (("a", n), ("b", n - 2)):
        dense = least_squares(both[name], size, model)
        relaxed = registration.relax(size, [0], both[name], model, max_iterations=4000, tolerance=1e-12)
        for t in range(size):
            assert np.abs(got[name, t] - dense[t]).max() < 1e-5 and np.abs(got[name, t] - relaxed[t]).max() < 1e-3


def test_rigid_maps(spark):
    matches, true = mosaic(3, "rigid", 0.02, 3)
    got = {r.tile: np.array(r.matrix).reshape(2, 3) for r in mosaics.joint_maps(table(spark, {"a": matches}), "g", [0], "rigid").collect()}
    relaxed = registration.relax(3, [0], matches, "rigid", max_iterations=4000, tolerance=1e-12)
    for t in range(3):
        assert np.allclose(got[t][:, :2] @ got[t][:, :2].T, np.eye(2)) and np.abs(got[t] - true[t]).max() < 0.1
        assert np.abs(got[t] - relaxed[t]).max() < 1e-3


def test_start_and_no_matches(spark):
    """A fixed tile keeps its start; the other follows it. Without matches there are no rows."""
    df = table(spark, {"a": [(0, 1, np.array([[0.0, 0.0], [1.0, 2.0]]), np.array([[3.0, 0.0], [4.0, 2.0]]))]})
    start = spark.createDataFrame([("a", 0, [1.0, 0.0, 10.0, 0.0, 1.0, 20.0])], "g string, tile int, matrix array<double>")
    got = {r.tile: r.matrix for r in mosaics.joint_maps(df, "g", [0], "translation", start=start).collect()}
    assert got[0] == [1, 0, 10, 0, 1, 20] and got[1] == pytest.approx([1, 0, 7, 0, 1, 20])
    assert mosaics.joint_maps(df.limit(0), "g", [0], "translation").count() == 0


# Distances


def plain_distance(m):
    out = np.full(m.shape, np.nan)
    for own, sign in ((m, 1), (~m, -1)):
        a, b = np.argwhere(own), np.argwhere(~own)
        if len(a) and len(b):
            out[own] = sign * np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1).min(1))
    return out


@pytest.mark.parametrize(("share", "shape", "band"), [(0.5, (40, 30), 8), (0.01, (60, 50), 8), (None, (70, 40), 4), (0.0, (20, 10), 8), (1.0, (8, 8), 4)])
def test_exact_distance(spark, share, shape, band):
    """However far: a single pixel, many bands away, and masks of one kind, which have none."""
    m = np.random.default_rng(7).random(shape) < (share or 0.0)
    if share is None:
        m[3, 5] = True
    got = np.full(shape, np.nan)
    for r in distance.signed_distance(frame(spark, m.astype(float)), "x", "y", "v", band=band).collect():
        got[r.y, r.x] = np.nan if r.distance is None else r.distance
    assert np.array_equal(got, plain_distance(m), equal_nan=True)


def test_envelopes():
    rng, y = np.random.default_rng(0), np.arange(60)
    for _ in range(300):
        at = np.sort(rng.choice(60, int(rng.integers(1, 30)), replace=False))
        height = rng.integers(0, 20, len(at)) ** 2
        value = lambda t, k: ((t[:, None] - at[k]) ** 2 + height[k]).min(1)
        assert (distance.lowest(y, at, height) == value(y, slice(None))).all()
        own = np.flatnonzero((at >= 20) & (at <= 40))
        beyond = np.r_[np.arange(20), np.arange(41, 60)]
        if len(own):
            assert (value(beyond, own) == value(beyond, own[distance.outer(20, 40, at[own], height[own])])).all()


def test_mask_between(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random((30, 25)) < 0.03, rng.random((30, 25)) < 0.1
    want = plain_distance(a) * 0.7 + plain_distance(b) * 0.3 > 0
    rows = distance.masks_between(frame(spark, a.astype(float)), frame(spark, b.astype(float)), "x", "y", "v", 0.3).collect()
    assert len(rows) == a.size and all(bool(r.v) == want[r.y, r.x] for r in rows)
    full = distance.masks_between(frame(spark, np.ones((3, 3))), frame(spark, np.zeros((3, 3))), "x", "y", "v", 0.3).collect()
    assert [r.v for r in full] == [0] * 9


# Block matches


def plain_correlations(block, area):
    h, w = block.shape
    out = np.full((area.shape[0] - h + 1, area.shape[1] - w + 1), np.nan)
    for i in range(out.shape[0]):
        for j in range(out.shape[1]):
            a = area[i : i + h, j : j + w]
            if not np.isnan(a).any() and a.std() > 0:
                out[i, j] = np.corrcoef(block.ravel(), a.ravel())[0, 1]
    return out


def test_blocks_of_whole_planes(spark):
    """A planted shift is found in all blocks that have no gap, and every match equals the plain one, at the planes' edges too."""
    rng = np.random.default_rng(9)
    big = rng.normal(size=(100, 90))
    big = sum(np.roll(big, (i, j), (0, 1)) for i in range(3) for j in range(3))
    one, two = big[10:80, 10:75], big[13:83, 8:73] + 0.05 * rng.normal(size=(70, 65))
    points = spark.createDataFrame([(x, y) for x in range(5, 65, 12) for y in range(5, 70, 12)], "px int, py int")
    rows = blocks.block_matches(frame(spark, one), frame(spark, two), points, "x", "y", "v", block=6, search=5, side=32).collect()
    whole, planted = 0, 0
    for r in rows:
        padded = lambda m, n: np.pad(m, n, constant_values=np.nan)
        own, area = padded(one, 6)[r.py : r.py + 13, r.px : r.px + 13], padded(two, 11)[r.py : r.py + 23, r.px : r.px + 23]
        if np.isnan(own).any():
            assert r.dx is None and r.r is None and not r.accepted
            continue
        c = plain_correlations(own, area)
        i, j = np.unravel_index(np.nanargmax(c), c.shape)
        assert (r.dx, r.dy) == (j - 5, i - 5) and r.r == pytest.approx(c[i, j])
        whole, planted = whole + 1, planted + ((r.dx, r.dy) == (2, -3) and r.accepted and abs(r.fx - 2) < 0.3 and abs(r.fy + 3) < 0.3)
    assert len(rows) == points.count() and planted >= 0.9 * whole > 0


def test_ridges_and_flat_blocks_are_not_accepted(spark):
    x = np.arange(60)[None, :] + np.zeros((60, 1))
    points = spark.createDataFrame([(30, 30)], "px int, py int")
    ridge = frame(spark, np.sin(x / 3))
    (r,) = blocks.block_matches(ridge, ridge, points, "x", "y", "v", block=5, search=4).collect()
    assert r.r == pytest.approx(1) and not r.accepted
    flat = frame(spark, np.ones((60, 60)))
    (r,) = blocks.block_matches(flat, flat, points, "x", "y", "v", block=5, search=4).collect()
    assert r.dx is None and not r.accepted


# Contrast and turned planes


@pytest.mark.parametrize(("tile", "bins", "slope"), [(16, 32, 3.0), (7, 256, 1.5), (100, 16, 3.0)])
def test_equalised(spark, tile, bins, slope):
    m = np.random.default_rng(10).normal(size=(40, 33))
    m[5, 6] = np.nan
    b = np.clip(np.floor((np.nan_to_num(m) + 2) / 4 * bins), 0, bins - 1).astype(int)
    tables = {}
    for ty in range(-(-40 // tile)):
        for tx in range(-(-33 // tile)):
            some = (slice(ty * tile, (ty + 1) * tile), slice(tx * tile, (tx + 1) * tile))
            count = np.bincount(b[some][~np.isnan(m[some])], minlength=bins).astype(float)
            held = np.minimum(count, max(1, count.sum() * slope / bins))
            tables[tx, ty] = (held.cumsum() + np.arange(1, bins + 1) * (count.sum() - held.sum()) / bins) / count.sum()
    rows = blocks.equalised(frame(spark, m), "x", "y", "v", -2.0, 2.0, tile, bins, slope).collect()
    assert len(rows) == m.size
    for r in rows:
        if r.v is None:
            assert r.contrast is None
            continue
        gx, gy = (r.x - (tile - 1) / 2) / tile, (r.y - (tile - 1) / 2) / tile
        total = weight = 0.0
        for i in (0, 1):
            for j in (0, 1):
                near = tables.get((int(np.floor(gx)) + i, int(np.floor(gy)) + j))
                w = (gx % 1 if i else 1 - gx % 1) * (gy % 1 if j else 1 - gy % 1)
                if near is not None:
                    total, weight = total + w * near[b[r.y, r.x]], weight + w
        assert r.contrast == pytest.approx(total / weight)


@pytest.mark.parametrize("height", [4, 5])
def test_turned_planes_of_both_parities(spark, height):
    m = np.random.default_rng(11).integers(0, 99, (height, 6)).astype(float)
    turned, w, h, _, _ = filter_bank.turned(frame(spark, m), "x", "y", "v", 6, height, 90.0)
    rows = turned.collect()
    assert len(rows) == w * h
    low = (int(np.floor(3 - (height - 1) + height / 2)), int(np.floor(height / 2 - 3)))
    at = lambda r, c: m[min(max(r, 0), height - 1), min(max(c, 0), 5)]
    for r in rows:
        c, row = r.y + low[1] + 3 - height / 2, 3 + height / 2 - r.x - low[0]
        want = sum((1 - abs(c - a)) * (1 - abs(row - b)) * at(b, a) for a in {int(np.floor(c)), int(np.ceil(c))} for b in {int(np.floor(row)), int(np.ceil(row))})
        assert r.v == pytest.approx(want)
