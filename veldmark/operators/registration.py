"""Fits of maps to point matches: seeded consensus, chains, and joint relaxation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_affine(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least squares map of p onto q, as d x (d + 1)."""
    a = np.hstack([p, np.ones((len(p), 1))])
    return np.linalg.lstsq(a, q, rcond=None)[0].T


def fit_rigid(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Rotation and translation of p onto q by singular values."""
    cp, cq = p.mean(axis=0), q.mean(axis=0)
    u, _, vt = np.linalg.svd((p - cp).T @ (q - cq))
    sign = np.eye(p.shape[1])
    sign[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T))
    r = vt.T @ sign @ u.T
    return np.hstack([r, (cq - r @ cp)[:, None]])


def fit_translation(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.hstack([np.eye(p.shape[1]), (q - p).mean(axis=0)[:, None]])


MODELS = {"affine": (fit_affine, lambda d: d + 1), "rigid": (fit_rigid, lambda d: d), "translation": (fit_translation, lambda d: 1)}


def consensus(p: np.ndarray, q: np.ndarray, model: str = "affine", iterations: int = 1000, epsilon: float = 5.0, least_share: float = 0.0, least: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray] | None:
    """The map with most matches within epsilon over random least samples, fitted again to them until they stay; None below the least."""
    fit, needs = MODELS[model]
    d, rng, best = p.shape[1], np.random.default_rng(seed), None
    if len(p) < max(needs(d), least):
        return None
    for _ in range(iterations):
        some = rng.choice(len(p), needs(d), replace=False)
        m = fit(p[some], q[some])
        near = np.linalg.norm(p @ m[:, :d].T + m[:, d] - q, axis=1) <= epsilon
        if best is None or near.sum() > best.sum():
            best = near
    for _ in range(20):
        if best.sum() < max(needs(d), least, least_share * len(p)):
            return None
        m = fit(p[best], q[best])
        near = np.linalg.norm(p @ m[:, :d].T + m[:, d] - q, axis=1) <= epsilon
        if (near == best).all():
            return m, best
        best = near
    return m, best


def fit_pairs(matches: DataFrame, by: list[str], model: str = "affine", **options) -> DataFrame:
    """A map for each group of matches (p1, p2 arrays): by, matrix (row order; null without consensus), inliers. A group's matches fit in a task."""
    types = dict(matches.dtypes)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["p1", "p2"], key=lambda c: c.map(tuple))
        found = consensus(np.stack(pdf["p1"].map(np.asarray)), np.stack(pdf["p2"].map(np.asarray)), model, **options)
        return pd.DataFrame([[*key, found[0].ravel().tolist() if found else None, int(found[1].sum()) if found else 0]], columns=[*by, "matrix", "inliers"])

    return matches.select(*by, "p1", "p2").groupBy(*by).applyInPandas(one, ", ".join(f"{c} {types[c]}" for c in by) + ", matrix array<double>, inliers int")


def relax(n: int, fixed: list[int], matches: list[tuple[int, int, np.ndarray, np.ndarray]], model: str = "rigid", max_iterations: int = 2000, plateau: int = 200, tolerance: float = 1e-6) -> np.ndarray:
    """A map for each of n tiles that brings matches (i, j, points of i, points of j) together: each tile in turn is fitted to where its partners put their points."""
    fit, _ = MODELS[model]
    d = matches[0][2].shape[1] if matches else 3
    maps = np.tile(np.hstack([np.eye(d), np.zeros((d, 1))]), (n, 1, 1))
    put = lambda i, p: p @ maps[i][:, :d].T + maps[i][:, d]
    errors: list[float] = []
    for _ in range(max_iterations if matches else 0):
        for t in range(n):
            own = [(a, b, j) for i, j, a, b in matches if i == t] + [(b, a, i) for i, j, a, b in matches if j == t]
            if t not in fixed and own:
                maps[t] = fit(np.vstack([a for a, _, _ in own]), np.vstack([put(k, b) for _, b, k in own]))
        errors.append(float(np.mean([np.linalg.norm(put(i, a) - put(j, b), axis=1).mean() for i, j, a, b in matches])))
        if len(errors) > plateau and abs(errors[-plateau] - errors[-1]) < tolerance:
            break
    return maps


def relax_groups(matches: DataFrame, by: str, fixed: list[int], model: str = "rigid", **options) -> DataFrame:
    """relax for each group of rows (i, j, p1, p2): by, tile, matrix. One mosaic fits in a task."""
    kind = dict(matches.dtypes)[by]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(int(i), int(j), np.stack(g["p1"].map(np.asarray)), np.stack(g["p2"].map(np.asarray))) for (i, j), g in pdf.groupby(["i", "j"])]
        maps = relax(int(max(pdf["i"].max(), pdf["j"].max())) + 1, fixed, parts, model, **options)
        return pd.DataFrame([(key[0], t, m.ravel().tolist()) for t, m in enumerate(maps)], columns=[by, "tile", "matrix"])

    return matches.select(by, "i", "j", "p1", "p2").groupBy(by).applyInPandas(one, f"{by} {kind}, tile int, matrix array<double>")


def thin_plate(p: np.ndarray, q: np.ndarray):
    """The thin-plate spline through the matches, as a function of points."""

    def bend(a, b):
        r2 = ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        return np.where(r2 > 0, 0.5 * r2 * np.log(np.maximum(r2, 1e-300)), 0.0)

    n, d = p.shape
    flat = np.hstack([np.ones((n, 1)), p])
    system = np.zeros((n + d + 1, n + d + 1))
    system[:n, :n], system[:n, n:], system[n:, :n] = bend(p, p), flat, flat.T
    weights = np.linalg.lstsq(system, np.vstack([q, np.zeros((d + 1, q.shape[1]))]), rcond=None)[0]
    return lambda x: bend(x, p) @ weights[:n] + np.hstack([np.ones((len(x), 1)), x]) @ weights[n:]


def elastic(matches: DataFrame, points: DataFrame, by: list[str], id_col: str = "pid") -> DataFrame:
    """Points moved by the thin-plate spline of their group's matches: by, id_col, place.

    matches: by, p1, p2 (arrays); points: by, id_col, p. A group's matches fit in a
    task; its points come in batches. Groups without matches keep their points.
    """
    types = dict(points.dtypes)
    packed = matches.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("p1", "p2"))).alias("_matches"))
    keyed = points.select(*by, id_col, "p").join(packed, by, "left").repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, spline = object(), None
        for pdf in batches:
            for key, own in pdf.groupby(by, sort=False, dropna=False):
                rows = own["_matches"].iloc[0]
                if key != last:
                    last, spline = key, None if rows is None else thin_plate(np.array([list(r["p1"]) for r in rows], float), np.array([list(r["p2"]) for r in rows], float))
                p = np.stack(own["p"].map(np.asarray))
                yield pd.DataFrame({**{c: own[c] for c in [*by, id_col]}, "place": list(p if spline is None else spline(p))})

    return keyed.mapInPandas(run, ", ".join(f"`{c}` {types[c]}" for c in [*by, id_col]) + ", place array<double>")
