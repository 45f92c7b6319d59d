"""Stripes: against a whole transform, and planted ones."""

import numpy as np

from veldmark.operators import stripes


def frame(spark, planes):
    rows = [(g, int(x) + 5, int(y) - 3, None if np.isnan(m[y, x]) else float(m[y, x])) for g, m in planes.items() for y, x in np.ndindex(*m.shape)]
    return spark.createDataFrame(rows, "g string, x int, y int, v double").repartition(5)


def planes_of(rows, planes, x="x", y="y"):
    out = {g: np.full(m.shape, np.nan) for g, m in planes.items()}
    for r in rows:
        assert np.isnan(out[r.g][r.y + 3, r.x - 5])  # each pixel once
        out[r.g][r.y + 3, r.x - 5] = r.clean
    return out


def whole(m, least, width):
    """One transform of the whole plane."""
    ky, kx = (np.minimum(np.arange(n), n - np.arange(n)) for n in m.shape)
    weight = 1 - (kx >= least)[None, :] * np.exp(-0.5 * (ky / width) ** 2)[:, None]
    return np.fft.ifft2(np.fft.fft2(m) * weight).real


def test_equal_to_a_whole_transform(spark):
    """Planes of odd and even sides, of one row and of one column, null among their keys; either direction; strips that don't divide the plane."""
    rng = np.random.default_rng(1)
    planes = {"a": rng.normal(size=(31, 44)), None: rng.normal(size=(20, 37)), "row": rng.normal(size=(1, 12)), "column": rng.normal(size=(9, 1))}
    df = frame(spark, planes)
    down = planes_of(stripes.stripes_removed(df, "x", "y", "v", 2, 1.5, ("g",), columns=7).collect(), planes)
    along = planes_of(stripes.stripes_removed(df, "y", "x", "v", 3, 0.7, ("g",)).collect(), planes)
    for g, m in planes.items():
        assert np.allclose(down[g], whole(m, 2, 1.5)) and np.allclose(along[g], whole(m.T, 3, 0.7).T)


def test_planted_stripes_go_and_the_rest_stays(spark):
    """Smooth spots with stripes over them: 0.9 of the stripes' energy goes, no pixel of the rest changes by 0.02; so where stripes aren't there."""
    y, x = np.mgrid[0:120, 0:96]
    rest = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / (2 * s * s)) for a, b, s in ((20, 30, 6), (60, 80, 8), (75, 25, 5)))
    planted = 0.3 * np.sin(2 * np.pi * 24 * x / 96) + 0.2 * np.cos(2 * np.pi * 31 * x / 96)
    got = planes_of(stripes.stripes_removed(frame(spark, {"s": rest + planted, "r": rest}), "x", "y", "v", 12, 1.0, ("g",)).collect(), {"s": rest, "r": rest})
    assert ((got["s"] - rest) ** 2).sum() < 0.1 * (planted**2).sum()
    assert np.abs(got["r"] - rest).max() < 0.02 and np.abs(got["s"] - rest).max() < 0.02


def test_gaps_repeats_and_empty(spark):
    m = np.random.default_rng(2).normal(size=(8, 10))
    gaps = m.copy()
    gaps[2, 3] = np.nan
    df = frame(spark, {"g": gaps})
    more = spark.createDataFrame([("g", 5, -3, float(m[0, 0]) - 1), ("g", None, 0, 5.0), ("g", 6, None, 5.0)], df.schema)
    filled = np.nan_to_num(gaps)
    got = planes_of(stripes.stripes_removed(df.union(more), "x", "y", "v", by=("g",)).collect(), {"g": m})["g"]
    assert np.allclose(got, whole(filled, 1, 1.0))
    absent = stripes.stripes_removed(df.where("v IS NOT NULL"), "x", "y", "v", by=("g",)).collect()
    assert len(absent) == 79 and np.allclose([r.clean for r in absent], [got[r.y + 3, r.x - 5] for r in absent])
    assert stripes.stripes_removed(df.limit(0), "x", "y", "v").count() == 0
