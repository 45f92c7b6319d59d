"""Centroid clustering by Exponion search: bounds spare most distances, the rest stay within a ball around the own centroid."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common

DIMENSIONS, CENTROIDS, ROUNDS, SCALE = 64, 16, 3, 64
#: Components up to here have squared distances that fit in 64 bits, in 64 dimensions.
LARGEST = 1 << 27
#: Bytes of differences that are held at once.
HELD = 8 << 20
#: Numbers of all centroids, which go through the driver and to each task.
MOST_NUMBERS = 1 << 22
#: Bounds are real numbers near whole squares; they count as wider by this share.
SLACK = 1e-9


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x to those of c, whole numbers."""
    out = np.empty((len(x), len(c)), np.int64)
    step = max(1, HELD // max(1, c.size * 8))
    for a in range(0, len(x), step):
        d = x[a : a + step, None, :] - c[None]
        out[a : a + step] = np.einsum("nkd,nkd->nk", d, d)
    return out


class Exponion:
    """Nearest centroids of vectors that carry bounds from round to round.

    For each centroid all centroids are listed by their distance from it. A
    vector whose upper bound (to its centroid) is below its lower bound (to all
    others) or below half the way to the nearest other centroid stays. Else the
    upper bound becomes the distance, and if neither holds yet, the centroids
    within 2 upper bounds and the way to the nearest other centroid of its own
    one are scanned: they hold its nearest and its second nearest. Tests are strict
    and the ball's edge belongs to it, so equally near centroids are scanned and
    the smaller number wins.
    """

    def __init__(self, centroids: np.ndarray):
        self.c = centroids
        between = squares(centroids, centroids)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.ways = np.sqrt(np.take_along_axis(between, self.order, 1).astype(np.float64))
        #: To the nearest other one: the first of the list is at distance 0.
        self.gap = self.ways[:, 1] if len(centroids) > 1 else np.full(1, np.inf)
        self.scanned = 0

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without bounds: all centroids."""
        d = squares(x, self.c)
        own = d.argmin(axis=1)
        return own, *self._bounds(d, own)

    def _bounds(self, d: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.arange(len(d))
        upper = np.sqrt(d[rows, place].astype(np.float64))
        if d.shape[1] == 1:
            return upper, np.full(len(d), np.inf)
        rest = d.copy()
        rest[rows, place] = np.iinfo(np.int64).max
        return upper, np.sqrt(rest.min(axis=1).astype(np.float64))

    def next(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        near = lambda i: upper[i] * (1 + SLACK) + SLACK < np.maximum(lower[i] * (1 - SLACK), self.gap[own[i]] / 2)
        open_ = np.flatnonzero(~near(slice(None)))
        if len(open_):
            d = x[open_] - self.c[own[open_]]
            upper[open_] = np.sqrt(np.einsum("nd,nd->n", d, d).astype(np.float64))
            open_ = open_[~near(open_)]
        for a in np.unique(own[open_]):
            rows = open_[own[open_] == a]
            radius = (2 * upper[rows] + self.gap[a]) * (1 + SLACK) + SLACK
            within = np.searchsorted(self.ways[a], radius, side="right")
            # rows whose balls hold about as many centroids, up to a power of two, are scanned together
            group = np.ceil(np.log2(within)).astype(int)
            for g in np.unique(group):
                some = rows[group == g]
                listed = np.sort(self.order[a][: min(1 << int(g), len(self.c))])
                d = squares(x[some], self.c[listed])
                self.scanned += d.size
                place = d.argmin(axis=1)  # the list ascends, so the first of equals has the smaller number
                own[some] = listed[place]
                upper[some], lower[some] = self._bounds(d, place)
        return own, upper, lower


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


STATE = "q array<int>, cluster int, upper double, lower double"


def _assigned(state: DataFrame, centroids: np.ndarray, moves: np.ndarray | None) -> DataFrame:
    """The next turn: vectors with their centroid and bounds. moves: how far each centroid went since the last turn; none before the first."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType([*(f for f in state.schema if f.name not in ("q", "cluster", "upper", "lower")), *StructType.fromDDL(STATE)])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(centroids)
        far = None
        if moves is not None:
            # a lower bound sinks by the farthest way that any other centroid went
            most = int(moves.argmax())
            far = np.full(len(moves), moves[most])
            far[most] = max(np.delete(moves, most), default=0.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            x = _matrix(col["q"])
            if far is None:
                own, upper, lower = search.first(x)
            else:
                own = col["cluster"].to_numpy(zero_copy_only=False).astype(np.int64)
                upper = (col["upper"].to_numpy(zero_copy_only=False) + moves[own]) * (1 + SLACK)
                lower = (col["lower"].to_numpy(zero_copy_only=False) - far[own]) * (1 - SLACK)
                own, upper, lower = search.next(x, own, upper, lower)
            new = {"q": col["q"], "cluster": own, "upper": upper, "lower": lower}
            yield pa.RecordBatch.from_arrays([new[f.name].cast(f.type) if f.name == "q" else pa.array(new[f.name], type=f.type) if f.name in new else col[f.name] for f in target], schema=target)

    return state.mapInArrow(run, kind)


def _sums(state: DataFrame, clusters: int) -> tuple[np.ndarray, list[list[int]]]:
    """Vectors and sums of components by centroid: each task adds up its own vectors, so a full cluster is many small rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = None, np.zeros(clusters, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, own = _matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            total = np.zeros((clusters, x.shape[1]), np.int64) if total is None else total
            np.add.at(total, own, x)
            count += np.bincount(own, minlength=clusters)
        if total is not None:
            parts = [(k, -1, int(count[k])) for k in range(clusters) if count[k]] + [(k, i, int(v)) for k in range(clusters) if count[k] for i, v in enumerate(total[k])]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts], pa.int64())], names=["cluster", "at", "total"])

    rows = state.select("q", "cluster").mapInArrow(run, "cluster int, at int, total long").groupBy("cluster", "at").agg(F.sum("total").alias("total")).collect()
    counts, sums = np.zeros(clusters, np.int64), [[] for _ in range(clusters)]
    for cluster, at, total in sorted(tuple(r) for r in rows):
        if at < 0:
            counts[cluster] = total
        else:
            sums[cluster].append(total)
    return counts, sums


def kept(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and q, floor(scale x) of each component: of vectors with as many components as dimensions, none of them null or not finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.when(F.abs(x) * scale <= LARGEST, F.floor(x * scale).cast("int")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: squared distances don't fit in 64 bits")).cast("int")))
    return vectors.where((F.size(v) == dimensions) & sound).select(F.col(f"`{id_col}`").alias("id"), whole.alias("q"))


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", centroids: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = 1) -> DataFrame:
    """One row per kept vector: id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors are kept as in kept(); a component whose whole number is beyond 2^27
    is an error, as distances would not fit in 64 bits. Centroids begin as the
    vectors with the smallest sha256 of "seed:id" (a null id is empty text; equal
    ids by their components), fewer if there are fewer vectors. Each round puts
    every vector to the nearest centroid, the smaller number of equally near
    ones, and moves each centroid that has vectors to the floor of their mean;
    then vectors are put once more. Repeated vectors count as often as they
    occur. Without kept vectors the result is empty; other columns play no part.

    Vectors and their bounds are a table in the shared folder, written anew each
    round, so a lost executor costs its part of one round. Only centroids, sums
    and counts go through the driver: their number is bounded.
    """
    if centroids * dimensions > MOST_NUMBERS:
        raise ValueError(f"more than {MOST_NUMBERS} numbers of centroids")
    spark, folder = vectors.sparkSession, common.scratch(vectors.sparkSession)
    state = common.stored(kept(vectors, id_col, vector_col, dimensions, scale), folder, "vectors")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    first = state.select(F.sha2(text.cast("binary"), 256).alias("by"), "q").orderBy("by", "q").limit(centroids).collect()
    c = np.array([list(r["q"]) for r in first], np.int64).reshape(len(first), dimensions)
    if not len(c):
        c = np.zeros((1, dimensions), np.int64)
    moves = None
    for turn in range(rounds + 1):
        state = common.stored(_assigned(state, c, moves), folder, f"round{turn}")
        if turn == rounds:
            break
        counts, sums = _sums(state, len(c))
        new = np.array([[t // int(n) for t in s] if n else list(old) for n, s, old in zip(counts, sums, c, strict=True)], np.int64)
        moves = np.sqrt(((new - c) ** 2).sum(axis=1).astype(np.float64))
        c = new
    rows = [(k, [int(v) for v in own], hashlib.sha256(",".join(str(int(v)) for v in own).encode()).hexdigest()) for k, own in enumerate(c)]
    final = spark.createDataFrame(rows, "cluster int, c array<int>, centroid_sha256 string")
    d = lambda a, b: (a.cast("long") - b.cast("long")) * (a.cast("long") - b.cast("long"))
    far = state.join(F.broadcast(final), "cluster").select("id", "cluster", F.aggregate(F.zip_with("q", "c", d), F.lit(0).cast("long"), lambda a, b: a + b).alias("distance"), "centroid_sha256")
    inertia = {r["cluster"]: r["s"] for r in far.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    sums = spark.createDataFrame([(k, s) for k, s in inertia.items()], "cluster int, cluster_inertia long")
    done = far.join(F.broadcast(sums), "cluster").withColumn("inertia", F.lit(sum(inertia.values())).cast("long"))
    return done.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
