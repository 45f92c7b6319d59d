"""Peaks of blocks against the whole array."""

import numpy as np
import pytest

from veldmark.operators import images, peaks


def rows_of(spark, a, names, origin=None):
    origin = origin or [0] * a.ndim
    rows = [(*(int(i + o) for i, o in zip(at, origin, strict=True)), float(a[at])) for at in np.ndindex(*a.shape)]
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", v double").repartition(3)


def plain(a, small, large, least):
    """Loops over the mirrored array, which has at least two pixels along each axis."""
    out = []
    smooth = []
    for sigma in (small, large):
        s, kernel = a, images.gaussian_kernel(sigma)
        half = len(kernel) // 2
        for axis in range(a.ndim):
            at = peaks.mirrored(np.arange(-half, a.shape[axis] + half), 0, a.shape[axis] - 1)
            s = np.apply_along_axis(lambda v, at=at, kernel=kernel: np.convolve(v[at], kernel, "valid"), axis, s)
        smooth.append(s)
    d = smooth[0] - smooth[1]
    for at in np.ndindex(*a.shape):
        near = [d[to] for step in np.ndindex(*[3] * a.ndim) if (to := tuple(i + s - 1 for i, s in zip(at, step, strict=True))) != at and all(0 <= t < n for t, n in zip(to, a.shape, strict=True))]
        if d[at] > least and d[at] > max(near):
            out.append(at)
    return out, d


@pytest.mark.parametrize("shape", [(70, 45), (9, 130), (2, 40), (20, 17, 23)])
def test_blocks_find_what_the_whole_array_has(spark, shape):
    a = np.random.default_rng(len(shape)).normal(size=shape)
    names = ["x", "y", "z"][: a.ndim]
    df = rows_of(spark, a, names)
    get = lambda block: sorted(map(tuple, peaks.gaussian_peaks(df, names, "v", 1.0, 2.0, 0.05, block=block).collect()))
    small, whole = get(8), get(256)
    assert small == whole and len(small) > 3
    known, d = plain(a, 1.0, 2.0, 0.05)
    assert sorted(tuple(int(round(v)) for v in p[:-1]) for p in small) == sorted(known)
    assert np.allclose(sorted(p[-1] for p in small), sorted(d[at] for at in known))
    inner = {p for p in small if all(0 < round(v) < n - 1 for v, n in zip(p[:-1], shape, strict=True))}
    if min(shape) > 7:  # the older whole-image version looks inside only and mirrors smaller arrays otherwise
        older = images.difference_of_gaussians(a, 1.0, 2.0, 0.05)
        assert np.allclose(np.array(sorted(inner)), np.array(sorted(older)))


def test_images_apart_calibration_and_odd_rows(spark):
    """Images of a key, null among them, with own intervals, one of one pixel and one of one row; null and nan values and places, repeated pixels."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(30, 41)), rng.normal(size=(1, 50))
    rows = [(g, int(x) - 7, int(y) + 100, float(m[x, y])) for g, m in (("a", a), (None, a), ("b", b)) for x, y in np.ndindex(*m.shape)]
    rows += [("one", 3, 3, 1.0), ("a", None, 3, 9.0), ("a", -7, 100, None), ("a", -7, 100, float("nan")), ("a", 0, 110, float(a[7, 10]) - 1)]
    df = spark.createDataFrame(rows, "g string, x long, y long, v double").repartition(4)
    got = peaks.gaussian_peaks(df, ["x", "y"], "v", 0.5, 1.0, 0.02, by=("g",), calibration=[0.5, 0.5], block=9).collect()
    of = lambda g: sorted((r.x, r.y, r.value) for r in got if r.g == g)
    assert of("a") == of(None) and not of("one")
    known, _ = plain(a, 1.0, 2.0, 0.02)
    assert sorted((round(2 * x) + 7, round(2 * y) - 100) for x, y, _ in of("a")) == sorted(known)
    line, _ = plain(b[0], 1.0, 2.0, 0.02)
    assert sorted(round(2 * y) - 100 for _, y, _ in of("b")) == [p for (p,) in line] and {x for x, _, _ in of("b")} == {-3.5}


def test_empty(spark):
    assert peaks.gaussian_peaks(spark.createDataFrame([], "x int, y int, v float"), ["x", "y"], "v", 1.0, 2.0, 0.0).count() == 0
