"""Consensus of the matches of features, of which no row is made: samples, counts and sums come from blocks of features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from veldmark.operators import nearby
from veldmark.operators.registration import MODELS
from veldmark.session import cut

#: Matches that a task holds at once, features that look for theirs together, and fits at most.
MATCHES, FEW, FITS = 1 << 12, 256, 20


def _near(m: np.ndarray, p: np.ndarray, q: np.ndarray, epsilon: float) -> np.ndarray:
    d = p.shape[1]
    return np.linalg.norm(p @ m[:, :d].T + m[:, d] - q, axis=1) <= epsilon


def votes(p: np.ndarray, q: np.ndarray, maps: np.ndarray, epsilon: float) -> np.ndarray:
    """How many matches each map brings within epsilon."""
    d = p.shape[1]
    if not (maps[:, :, :d] == np.eye(d)).all():
        return np.array([np.count_nonzero(_near(m, p, q, epsilon)) for m in maps])
    # squared distances of moves by one product; those that its rounding leaves open are computed as such
    s, t, limit = q - p, maps[:, :, d], epsilon * epsilon
    long, far = (s * s).sum(axis=1), (t * t).sum(axis=1)
    d2 = t @ (-2 * s.T)
    d2 += far[:, None]
    d2 += long
    slack = 1e-12 * (long.max() + far.max() + limit)
    low, high = (np.array([np.count_nonzero(row) for row in d2 <= edge]) for edge in (limit - slack, limit + slack))
    for k in np.flatnonzero(low != high):
        at = np.flatnonzero((d2[k] > limit - slack) & (d2[k] <= limit + slack))
        low[k] += np.count_nonzero(_near(maps[k], p[at], q[at], epsilon))
    return low


def moments(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sums of products of p and 1 with themselves and with q, row by row."""
    one = np.hstack([p, np.ones((len(p), 1))])
    return np.concatenate([(one.T @ one).ravel(), (one.T @ q).ravel()])


def fit_moments(sums: np.ndarray, d: int, model: str) -> np.ndarray:
    """The map that MODELS[model] fits to the matches with these sums."""
    own, to = sums[: (d + 1) ** 2].reshape(d + 1, d + 1), sums[(d + 1) ** 2 :].reshape(d + 1, d)
    n = own[d, d]
    if model == "affine":
        return np.linalg.lstsq(own, to, rcond=None)[0].T
    if model == "translation":
        return np.hstack([np.eye(d), ((to[d] - own[d, :d]) / n)[:, None]])
    cp, cq = own[d, :d] / n, to[d] / n
    u, _, vt = np.linalg.svd(to[:d] - n * np.outer(cp, cq))
    sign = np.eye(d)
    sign[-1, -1] = np.sign(np.linalg.det(vt.T @ u.T))
    r = vt.T @ sign @ u.T
    return np.hstack([r, (cq - r @ cp)[:, None]])


def _columns(rows: pa.Table, d: int) -> tuple[list[np.ndarray], np.ndarray]:
    return [rows.column(c).to_numpy() for c in ("_angle", "_len1", "_len2")], np.stack([rows.column(f"_p{i}").to_numpy() for i in range(d)], axis=1)


def _placed(counts: DataFrame, by: list[str], places: list[str]) -> DataFrame:
    """counts (by, places, n) with _end, the sum of n up to each row within by, in order of places. Ranges are summed by themselves, and each begins after those before."""
    ranged = cut(counts.repartitionByRange(*by, *places).withColumn("_part", F.spark_partition_id()))
    sums = ranged.groupBy(*by, "_part").agg(F.sum("n").alias("_sum"))
    # a row for each range of a group
    begun = sums.withColumn("_begin", F.sum("_sum").over(W.partitionBy(*by).orderBy("_part")) - F.col("_sum")).drop("_sum")
    within = F.sum("n").over(W.partitionBy(*by, "_part").orderBy(*places).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn("_own", within).join(begun, [*by, "_part"]).withColumn("_end", F.col("_begin") + F.col("_own"))


def fit_features(a: DataFrame, b: DataFrame, axes: list[str], by: list[str], angle_epsilon: float, len_epsilon_sq: float, model: str = "affine", iterations: int = 1000, epsilon: float = 5.0, least_share: float = 0.0, least: int = 5, seed: int = 42, scale_invariant: bool = False) -> DataFrame:
    """registration.fit_pairs of the matches of a's features with b's (spatial.match_features): by, matrix, inliers, with the same samples.

    Matches are found anew in blocks in every turn: to count those of each place, so
    that a sample's numbers lead to its matches; for the votes for all samples; and for the
    sums that a fit needs. What leaves a task are counts and sums. The features (by,
    angle, len1, len2, axes) are stored with their blocks. Fits that aren't
    translations come from sums of products, and differ by rounding.
    """
    fit, needs = MODELS[model][0], MODELS[model][1](len(axes))
    d, kinds, by = len(axes), nearby._kinds(a, by), list(by)
    types = ", ".join(f"`{k}` {a.schema[k].dataType.simpleString()}" for k in by)
    places, ends = [f"_p{i}" for i in range(d)], [f"_q{i}" for i in range(d)]
    doubles = lambda names: ", ".join(f"{c} double" for c in names)
    size = d * (d + 1)
    columns = [*by, "angle", "len1", "len2", *axes]
    flat = lambda df: df.select(*by, "_band", "_angle", "_len1", "_len2", *[F.col(f"_f.{x}").cast("double").alias(p) for x, p in zip(axes, places, strict=True)])
    left, right = map(flat, nearby._features(a.select(*columns), b.select(*columns), angle_epsilon, by))
    keys = [*by, "_band"]
    ours, theirs, sizes = map(cut, nearby.dealt(left, right, keys))
    blocks = lambda settle, names, told=None, some=ours: nearby.settled(some, theirs, keys, settle, f"{types}, {names}", told, sizes)
    batch = lambda key, values: nearby._batch(key, by, values, kinds)
    named = lambda names, at: dict(zip(names, np.ascontiguousarray(at.T), strict=True))

    def counted(key: dict, ours: pa.Table, theirs: pa.Table) -> Iterator[pa.RecordBatch]:
        (f, p), (g, _) = _columns(ours, d), _columns(theirs, d)
        for s, ok in nearby.agreeing(f, g, angle_epsilon, len_epsilon_sq, scale_invariant):
            n = np.count_nonzero(ok, axis=1)
            at = np.flatnonzero(n)
            if len(at):
                yield batch(key, {**named(places, p[at + s]), "n": n[at].astype(np.int64)})

    counts = cut(blocks(counted, f"{doubles(places)}, n long").groupBy(*by, *places).agg(F.sum("n").alias("n")))
    totals = cut(counts.groupBy(*by).agg(F.sum("n").alias("_total")))
    enough = max(needs, least)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                rng = np.random.default_rng(seed)
                ranks = np.array([rng.choice(int(row[-1]), needs, replace=False) for _ in range(iterations)])
                own = pd.DataFrame({"_draw": np.repeat(np.arange(iterations), needs), "_k": np.tile(np.arange(needs), iterations), "_rank": ranks.ravel()})
                for c, v in zip(by, row, strict=False):
                    own[c] = v
                yield own[[*by, "_draw", "_k", "_rank"]]

    draws = cut(totals.where(F.col("_total") >= enough).select(*by, "_total").mapInPandas(drawn, f"{types}, _draw int, _k int, _rank long"))
    placed = cut(_placed(counts, by, places).select(*by, *places, "n", "_end"))
    here = (F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("n"))
    chosen = cut(draws.join(placed, by).where(here).select(*by, "_draw", "_k", *places, (F.col("_rank") - F.col("_end") + F.col("n")).alias("_at")))

    def partners(key: dict, ours: pa.Table, theirs: pa.Table) -> Iterator[pa.RecordBatch]:
        (f, p), (g, q) = _columns(ours, d), _columns(theirs, d)
        for s, ok in nearby.agreeing(f, g, angle_epsilon, len_epsilon_sq, scale_invariant):
            i, j = np.nonzero(ok)
            if len(i):
                yield batch(key, {**named(places, p[i + s]), **named(ends, q[j]), "n": np.ones(len(i), np.int64)})

    sampled = ours.join(chosen.select(*by, *places).distinct(), [*by, *places], "left_semi").select(*ours.columns)
    met = blocks(partners, f"{doubles([*places, *ends])}, n long", some=sampled).groupBy(*by, *places, *ends).agg(F.sum("n").alias("n"))
    met = cut(met.withColumn("_upto", F.sum("n").over(W.partitionBy(*by, *places).orderBy(*ends))))
    pairs = chosen.join(met, [*by, *places]).where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("n")))
    packed = pairs.groupBy(*by, "_draw").agg(F.array_sort(F.collect_list(F.struct("_k", F.array(*places).alias("p"), F.array(*ends).alias("q")))).alias("_s"))

    def fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["_map"] = [fit(*(np.array([list(r[c]) for r in rows], float) for c in "pq")).ravel().tolist() for rows in pdf["_s"]]
            yield pdf[[*by, "_draw", "_map"]]

    maps = cut(packed.mapInPandas(fitted, f"{types}, _draw int, _map array<double>"))
    every = maps.groupBy(*by).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_draw", "_map"))), lambda r: r["_map"])).alias("_told"))

    def scored(key: dict, ours: pa.Table, theirs: pa.Table, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        (f, p), (g, q) = _columns(ours, d), _columns(theirs, d)
        models = told.reshape(-1, d, d + 1)
        n = np.zeros(len(models), np.int64)
        for s, ok in nearby.agreeing(f, g, angle_epsilon, len_epsilon_sq, scale_invariant):
            i, j = np.nonzero(ok)
            for lo in range(0, len(i), MATCHES):
                n += votes(p[i[lo : lo + MATCHES] + s], q[j[lo : lo + MATCHES]], models, epsilon)
        yield batch(key, {"_draw": np.arange(len(models), dtype=np.int32), "n": n})

    scores = blocks(scored, "_draw int, n long", every).groupBy(*by, "_draw").agg(F.sum("n").alias("n"))
    best = scores.groupBy(*by).agg(F.max(F.struct("n", (-F.col("_draw")).alias("_draw"))).alias("_b")).select(*by, (-F.col("_b._draw")).alias("_draw"))
    state = cut(best.join(maps, [*by, "_draw"]).join(totals, by).select(*by, "_total", F.col("_map").alias("_told")))
    sums = [f"_m{i}" for i in range((d + 1) * (2 * d + 1))]

    def summed(key: dict, ours: pa.Table, theirs: pa.Table, told: np.ndarray) -> Iterator[pa.RecordBatch]:
        (f, p), (g, q) = _columns(ours, d), _columns(theirs, d)
        models = told.reshape(-1, d, d + 1)
        reach = epsilon * (1 + 1e-9) + 1e-9 * (1 + np.abs(q).max())
        moved = [p @ m[:, :d].T + m[:, d] for m in models]
        low, high = np.min([m[:, 0] for m in moved], axis=0) - reach, np.max([m[:, 0] for m in moved], axis=0) + reach
        order, along = np.argsort(low), np.argsort(q[:, 0])
        g, q = [v[along] for v in g], q[along]
        found, changed = np.zeros(len(sums)), 0
        for at in range(0, len(order), FEW):
            some = order[at : at + FEW]
            own = slice(np.searchsorted(q[:, 0], low[some].min()), np.searchsorted(q[:, 0], high[some].max(), "right"))
            for s, ok in nearby.agreeing([v[some] for v in f], [v[own] for v in g], angle_epsilon, len_epsilon_sq, scale_invariant):
                rows = some[s : s + len(ok)]
                for k in range(d):
                    close = np.zeros(ok.shape, bool)
                    for m in moved:
                        close |= np.abs(m[rows, k, None] - q[own, k]) <= reach
                    ok &= close
                i, j = np.nonzero(ok)
                u, v = p[rows[i]], q[own][j]
                near = [_near(m, u, v, epsilon) for m in models]
                changed += np.count_nonzero(near[0] != near[-1])
                found += moments(u[near[-1]], v[near[-1]])
        yield batch(key, {**{c: np.array([x]) for c, x in zip(sums, found, strict=True)}, "_changed": np.array([changed], np.int64)})

    def judged(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for row in pdf[["_total", "_told", *sums, "_changed"]].itertuples(index=False):
                    total, told, found, changed = row[0], list(row[1]), np.array(row[2:-1], float), row[-1]
                    n, last = round(found[(d + 1) ** 2 - 1]), told[-size:]
                    if turn and (not changed or turn == FITS):
                        out.append((last, n, True))
                    elif n < max(enough, least_share * total):
                        out.append((None, 0, True))
                    else:
                        out.append((last + fit_moments(found, d, model).ravel().tolist(), n, False))
                yield pd.concat([pdf[[*by, "_total"]].reset_index(drop=True), pd.DataFrame(out, columns=["_told", "inliers", "_done"])], axis=1)

        return run

    done = [totals.where(F.col("_total") < enough).select(*by, F.lit(None).cast("array<double>").alias("matrix"), F.lit(0).alias("inliers"))]
    for turn in range(FITS + 1):
        found = blocks(summed, f"{doubles(sums)}, _changed long", state.select(*by, "_told"))
        grouped = found.groupBy(*by).agg(*[F.sum(c).alias(c) for c in [*sums, "_changed"]])
        judged_ = cut(state.join(grouped, by).mapInPandas(judged(turn), f"{types}, _total long, _told array<double>, inliers int, _done boolean"))
        done.append(judged_.where("_done").select(*by, F.col("_told").alias("matrix"), "inliers"))
        state = judged_.where("NOT _done").select(*by, "_total", "_told")
        if state.isEmpty():
            break
    out = done[0]
    for part in done[1:]:
        out = out.union(part)
    return out
