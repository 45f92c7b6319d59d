import hashlib

import numpy as np
import pytest

from veldmark.llm import clustering


def plain(rows, centroids, rounds, dimensions, scale=64):
    kept = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return []
    text = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    c = [q for _, q in sorted(kept, key=lambda r: (text(r[0]), r[1]))[:centroids]]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(q, own, strict=True)) for own in c] for _, q in kept]
        near = [d.index(min(d)) for d in far]
        if turn < rounds:
            for k in range(len(c)):
                own = [q for (_, q), n in zip(kept, near, strict=True) if n == k]
                c[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else c[k]
    least = [min(d) for d in far]
    total = {k: sum(d for d, n in zip(least, near, strict=True) if n == k) for k in set(near)}
    return [(i, k, d, total[k], sum(least), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for (i, _), k, d in zip(kept, near, least, strict=True)]


def same(spark, rows, dimensions, centroids=16, rounds=3):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in clustering.cluster(df, centroids=centroids, rounds=rounds, dimensions=dimensions).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows, centroids, rounds, dimensions), key=repr)
    return got


def test_same_as_plain_rounds(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(9, 8))
    same(spark, [(i, (centres[i % 9] + 0.2 * rng.normal(size=8)).tolist()) for i in range(400)], 8)


def test_ties_and_repeated_vectors(spark):
    """Points of a small grid: many are equally near to several centroids, some of which are equal."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(-2, 3, 3) / 64).tolist()) for i in range(200)]
    rows += [(7, rows[7][1])] * 100  # a third of all rows
    same(spark, rows, 3)
    same(spark, rows, 3, centroids=40, rounds=5)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, -inf]), (7, [1.0, 2.0, 3.0]), (8, [0.5, -0.01]), (None, [0.25, 3.0]), (None, [-1.0, 3.0]), (8, [0.5, -0.01])]
    assert len(same(spark, rows, 2)) == 4
    assert same(spark, rows[:7], 2) == [] and same(spark, [], 2) == []


def test_one_centroid_and_clashing_columns(spark):
    rows = [(i, [i / 10, -i / 7]) for i in range(30)]
    same(spark, rows, 2, centroids=1)
    df = spark.createDataFrame([(1, 5, "x", 0.5, [0.1, 0.2])], "vec_id long, cluster int, q string, upper double, embedding array<double>")
    assert clustering.cluster(df, dimensions=2).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert clustering.cluster(df, dimensions=2).count() == 1


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clustering.cluster(df, dimensions=2)
    with pytest.raises(ValueError, match="numbers of centroids"):
        clustering.cluster(df, centroids=1 << 20)


def test_search_is_exact_and_spares_distances():
    rng = np.random.default_rng(5)
    for trial in range(200):
        n, d, k = int(rng.integers(1, 150)), int(rng.integers(1, 5)), int(rng.integers(1, 12))
        x = rng.integers(-4, 5, (n, d))
        c = x[rng.integers(0, n, k)]
        own = None
        for turn in range(5):
            search = clustering.Exponion(c)
            if own is None:
                own, upper, lower = search.first(x)
            else:
                most = moves.argmax()  # noqa: F821
                far = np.full(k, moves[most])  # noqa: F821
                far[most] = max(np.delete(moves, most), default=0.0)  # noqa: F821
                own, upper, lower = search.next(x, own, upper + moves[own], lower - far[own])  # noqa: F821
            assert (own == ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)).all(), (trial, turn)
            new = np.array([x[own == j].sum(0) // (own == j).sum() if (own == j).any() else c[j] for j in range(k)])
            moves, c = np.sqrt(((new - c) ** 2).sum(1)), new
    centres = rng.integers(-1000, 1000, (64, 4))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    own, upper, lower = clustering.Exponion(centres).first(x)
    search = clustering.Exponion(centres + rng.integers(-15, 15, (64, 4)))
    moves = np.sqrt(((search.c - centres) ** 2).sum(1))
    now, _, _ = search.next(x, own, upper + moves[own], lower - moves.max())
    assert (now == clustering.squares(x, search.c).argmin(1)).all()
    assert search.scanned < 0.1 * 5000 * 64
