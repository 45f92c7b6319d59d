"""Consensus of matches in blocks equals that of their rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.operators import consensus, nearby, registration, spatial
from veldmark.plans import points

AXES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def found(spark):
    """Features of three times; those of times 1 and 2 are those of 0, moved, with some at odds, and time 9 has none that match."""
    rng = np.random.default_rng(8)
    rows = []
    for k in range(70):
        at, angle, one, two = rng.integers(0, 200, 3), rng.uniform(0.3, 3), *rng.integers(10, 900, 2)
        for t in range(3):
            to = at + t * np.array([7, -3, 11]) if k % 3 else rng.integers(0, 200, 3)
            rows.append((t, float(angle), float(one), float(two), *map(float, to + rng.integers(-1, 2, 3))))
    rows.append((9, 1.0, 500.0, 500.0, 1.0, 2.0, 3.0))
    return spark.createDataFrame(rows + rows[:9], "i int, angle double, len1 double, len2 double, x double, y double, z double").cache()


def maps(df):
    return {r.i: (None if r.matrix is None else list(r.matrix), r.inliers) for r in df.collect()}


@pytest.mark.parametrize("model,options", [("translation", {"least": 3}), ("rigid", {}), ("affine", {}), ("translation", {"least_share": 0.9}), ("translation", {"least": 4000})])
def test_equal_to_rows(spark, found, model, options):
    """n6_consensus has no row for a match; samples, votes and fits are those of fit_pairs."""
    options = {"iterations": 40, "epsilon": 4.0, **options}
    b = found.withColumn("i", F.col("i") - 1)
    place = lambda f: F.array(*[F.col(f"{f}.{a}") for a in AXES])
    matched = spatial.match_features(found, b, 0.05, 300.0, by=["i"]).select("i", place("f1").alias("p1"), place("f2").alias("p2"))
    want = maps(registration.fit_pairs(matched, ["i"], model, **options))
    got = maps(consensus.fit_features(found, b, AXES, ["i"], 0.05, 300.0, model, **options))
    assert set(want) == {0, 1} and got.keys() == want.keys()
    for i, (m, n) in want.items():
        assert got[i][1] == n and (m is None) == (got[i][0] is None)
        assert m is None or (got[i][0] == m if model == "translation" else np.allclose(got[i][0], m, atol=1e-6))
    assert any(m for m, _ in want.values()) or "least_share" in options or options["least"] == 4000


def test_blocks_of_few_rows(spark, found, monkeypatch):
    """Counts and sums go together over blocks."""
    b = found.withColumn("i", F.col("i") - 1)
    run = lambda: maps(consensus.fit_features(found, b, AXES, ["i"], 0.05, 300.0, "translation", iterations=20, epsilon=4.0))
    want, own = run(), nearby.dealt
    monkeypatch.setattr(nearby, "dealt", lambda left, right, keys: own(left, right, keys, 2))
    monkeypatch.setattr(consensus, "MATCHES", 3)
    monkeypatch.setattr(consensus, "FEW", 2)
    assert run() == want


def test_query_makes_no_matches(spark, monkeypatch):
    """n6_consensus gathers no group's matches."""
    monkeypatch.setattr(registration, "fit_pairs", None)
    monkeypatch.setattr(spatial, "match_features", None)
    assert points.n6_consensus(spark, "/root/testdata/sf0.001").count() == 9


def test_votes_on_the_edge():
    """Moves whose distance is epsilon but for rounding are counted as the plain formula does."""
    rng = np.random.default_rng(1)
    p = rng.uniform(-9e3, 9e3, (400, 2))
    way = rng.uniform(0, 2 * np.pi, 400)
    q = p + 0.3 + 0.1 * np.stack([np.cos(way), np.sin(way)], 1)
    maps_ = np.array([[[1, 0, 0.3], [0, 1, 0.3]], [[1, 0, 0.35], [0, 1, 0.3]]])
    assert consensus.votes(p, q, maps_, 0.1).tolist() == [consensus._near(m, p, q, 0.1).sum() for m in maps_]
