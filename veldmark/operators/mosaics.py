"""Joint maps of all tiles of a mosaic: normal equations as tables, conjugate gradients as joins and sums over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veldmark.session import cut

UNKNOWNS = {"translation": lambda d: d, "rigid": lambda d: d + d * (d - 1) // 2, "affine": lambda d: d * (d + 1)}


def slopes(p: np.ndarray, model: str) -> np.ndarray:
    """How the place of each point moves with the unknowns of its tile: n x d x unknowns, at the identity."""
    n, d = p.shape
    if model == "translation":
        return np.broadcast_to(np.eye(d), (n, d, d)).copy()
    if model == "affine":
        out = np.zeros((n, d, d, d + 1))
        for k in range(d):
            out[:, k, k, :d], out[:, k, k, d] = p, 1
        return out.reshape(n, d, d * (d + 1))
    turns = [(a, b) for a in range(d) for b in range(a + 1, d)]
    out = np.zeros((n, d, len(turns) + d))
    for k, (a, b) in enumerate(turns):
        out[:, a, k], out[:, b, k] = -p[:, b], p[:, a]
    out[:, :, len(turns) :] = np.eye(d)
    return out


def step(matrix: np.ndarray, x: np.ndarray, model: str) -> np.ndarray:
    """A map d x (d + 1) followed by the map of the unknowns x."""
    d = len(matrix)
    if model == "translation":
        more = np.hstack([np.eye(d), x[:, None]])
    elif model == "affine":
        more = np.hstack([np.eye(d), np.zeros((d, 1))]) + x.reshape(d, d + 1)
    else:
        skew, k = np.zeros((d, d)), 0
        for a in range(d):
            for b in range(a + 1, d):
                skew[a, b], skew[b, a] = -x[k], x[k]
                k += 1
        # the turn nearest to 1 + skew is orthogonal, so maps stay rigid
        u, _, vt = np.linalg.svd(np.eye(d) + skew + skew @ skew / 2)
        more = np.hstack([u @ vt, x[k:, None]])
    return np.hstack([more[:, :d] @ matrix[:, :d], (more[:, :d] @ matrix[:, d] + more[:, d])[:, None]])


def _lists(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _parts(matches: DataFrame, by: str, d: int, model: str) -> DataFrame:
    """Products of slopes by pair of tiles, for each tile of the pair, added up in each batch: by, tile, other, part (own block, other's block, right side)."""
    m = UNKNOWNS[model](d)
    kind = StructType([matches.schema[by], *StructType.fromDDL("tile long, other long, part array<double>")])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                keys = pd.DataFrame({"g": batch.column(0).to_pylist(), "i": batch.column(1).to_numpy(), "j": batch.column(2).to_numpy()})
                group = keys.groupby(["g", "i", "j"], sort=False).ngroup().to_numpy()
                first = np.unique(group, return_index=True)[1]
                p, q = _lists(batch.column(3), d), _lists(batch.column(4), d)
                a, b, r = slopes(p, model), slopes(q, model), p - q
                for own, other, mine, theirs, sign in (("i", "j", a, b, -1.0), ("j", "i", b, a, 1.0)):
                    out = np.zeros((len(first), 2 * m * m + m))
                    products = (np.einsum("ndm,ndk->nmk", mine, mine), -np.einsum("ndm,ndk->nmk", mine, theirs), sign * np.einsum("ndm,nd->nm", mine, r))
                    np.add.at(out, group, np.concatenate([x.reshape(len(group), -1) for x in products], axis=1))
                    columns = {by: batch.column(0).take(pa.array(first)), "tile": pa.array(keys[own].to_numpy()[first], pa.int64()), "other": pa.array(keys[other].to_numpy()[first], pa.int64()), "part": pa.array(list(out), pa.list_(pa.float64()))}
                    yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in target], schema=target)

    return matches.select(by, F.col("i").cast("long"), F.col("j").cast("long"), "p1", "p2").mapInArrow(run, kind)


def _added(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arrays of equal length added up by keys: rows of a key follow each other in a task, which holds one sum."""
    kind = StructType([*(df.schema[k] for k in keys), df.schema[value]])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            rows, sums = [], []
            names = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
            for key, part in zip(names, batch.column(len(keys)), strict=True):
                part = np.asarray(part.values)
                if key != last:
                    if last is not None:
                        rows.append(last)
                        sums.append(total)
                    last, total = key, part.copy()
                else:
                    total += part
            if rows:
                yield made(rows, sums)
        if last is not None:
            yield made([last], [total])

    def made(rows: list[tuple], sums: list[np.ndarray]) -> pa.RecordBatch:
        columns = [*(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=False)), pa.array(sums, target.field(value).type)]
        return pa.RecordBatch.from_arrays(columns, schema=target)

    return df.select(*keys, value).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def _tiles(parts: DataFrame, by: str, m: int) -> DataFrame:
    """Each tile's own block, its inverse and its right side."""
    sums = _added(parts.select(by, "tile", F.concat(F.slice("part", 1, m * m), F.slice("part", 2 * m * m + 1, m)).alias("part")), [by, "tile"], "part")
    kind = StructType([sums.schema[by], *StructType.fromDDL("tile long, own array<double>, inverse array<double>, r array<double>")])
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = _lists(batch.column(2), m * m + m)
                own = part[:, : m * m].reshape(-1, m, m)
                flat = lambda a: pa.array(list(a.reshape(len(a), -1)), pa.list_(pa.float64()))
                # a tile with few matches has no inverse: the least squares one leaves what they don't say as it is
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat(own), flat(np.linalg.pinv(own, rcond=1e-12, hermitian=True)), flat(part[:, m * m :])], schema=target)

    return sums.mapInArrow(run, kind)


def _times(matrix: str, vector: str, m: int) -> Column:
    """A matrix in row order times a vector."""
    row = lambda i: F.zip_with(F.slice(matrix, i * m + 1, m), vector, lambda a, b: a * b)
    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.aggregate(row(i), F.lit(0.0), lambda a, b: a + b))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _plus(a: str, b: str, factor: Column) -> Column:
    """a + factor b."""
    return F.transform(F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b")), lambda r: r["a"] + factor * r["b"])


def _solved(parts: DataFrame, by: str, m: int, fixed: list[int], tolerance: float, iterations: int) -> DataFrame:
    """by, tile, x: the unknowns that make the matches' squared distances least, by preconditioned conjugate gradients for all mosaics at once.

    The form with one sum a turn: a join of the pairs' blocks with the tiles at
    their other end, a sum by tile, and both sums by mosaic together. Each turn's
    tiles are written, so a lost executor costs a part of one turn. A mosaic that
    is done stays as it is.
    """
    free = lambda c: ~F.col(c).isin(fixed) if fixed else F.lit(True)
    tiles = _tiles(parts.where(free("tile")), by, m)
    pairs = cut(_added(parts.where(free("tile") & free("other")).select(by, "tile", "other", F.slice("part", m * m + 1, m * m).alias("off")), [by, "tile", "other"], "off"))
    zero = lambda: F.transform("r", lambda _: F.lit(0.0))
    state = cut(tiles).withColumns({"x": zero(), "p": zero(), "s": zero(), "_old": F.lit(0.0), "_step": F.lit(0.0), "_first": F.lit(-1.0)})
    for _ in range(iterations):
        ahead = state.withColumn("u", _times("inverse", "r", m))
        pushed = pairs.join(ahead.select(by, F.col("tile").alias("other"), "u"), [by, "other"]).select(by, "tile", _times("off", "u", m).alias("o"))
        pushed = pushed.groupBy(by, "tile").agg(F.array(*[F.sum(F.get("o", F.lit(k))) for k in range(m)]).alias("o"))
        one = ahead.join(pushed, [by, "tile"], "left").withColumn("o", F.coalesce("o", zero())).withColumn("w", _times("own", "u", m))
        one = cut(one.withColumn("w", _plus("w", "o", F.lit(1.0))).drop("o"))
        sums = one.groupBy(by).agg(F.sum(_dot("r", "u")).alias("_now"), F.sum(_dot("w", "u")).alias("_curve"), *[F.max(c).alias(c) for c in ("_old", "_step", "_first")])
        sums = sums.withColumn("_first", F.when(F.col("_first") < 0, F.col("_now")).otherwise(F.col("_first"))).withColumn("_open", F.col("_now") > F.col("_first") * tolerance**2)
        if not sums.where("_open").limit(1).count():
            return one.select(by, "tile", "x")
        back = F.when(F.col("_old") > 0, F.col("_now") / F.col("_old")).otherwise(0.0)
        curve = F.col("_curve") - F.when(F.col("_step") > 0, F.col("_back") * F.col("_now") / F.col("_step")).otherwise(0.0)
        sums = sums.withColumn("_back", back).withColumn("_along", F.when(F.col("_open") & (curve > 0), F.col("_now") / curve).otherwise(0.0))
        sums = sums.select(by, "_now", "_first", "_back", "_along")
        two = one.drop("_old", "_step", "_first").join(sums, by)
        two = two.withColumns({"p": _plus("u", "p", F.col("_back")), "s": _plus("w", "s", F.col("_back"))})
        two = two.withColumns({"x": _plus("x", "p", F.col("_along")), "r": _plus("r", "s", -F.col("_along"))})
        state = two.select(by, "tile", "own", "inverse", "r", "x", "p", "s", F.col("_now").alias("_old"), F.col("_along").alias("_step"), "_first")
    return state.select(by, "tile", "x")


def joint_maps(matches: DataFrame, by: str, fixed: list[int] | tuple[int, ...] = (0,), model: str = "affine", dimensions: int = 2, start: DataFrame | None = None, tolerance: float = 1e-8, iterations: int = 500, turns: int = 20) -> DataFrame:
    """The maps of all tiles that bring their matches together, for each mosaic: by, tile, matrix (row order).

    matches: by, i, j (tiles), p1, p2 (the point in each); rows with a null key
    play no part. The sum of squared distances between both places of all matches
    is least; fixed tiles keep their start (the identity, or the rows by, tile,
    matrix of start). Tiles without a match have no row. translation and affine
    are linear: one solution. rigid is solved in turns round the last maps, until
    no unknown moves by more than 1e-7, so its start must be near.

    Matches are added up by pair of tiles in each batch before they are shuffled.
    After that only the blocks of pairs and tiles matter: a mosaic lies in as many
    tasks as it needs. The number of gradient turns grows with the tiles across a
    mosaic, not with its matches. A mosaic without a fixed tile keeps what its
    matches don't say near its start.
    """
    d = dimensions
    m = UNKNOWNS[model](d)
    used = matches.where(F.col(by).isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull()).select(by, F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("p1").cast("array<double>").alias("p1"), F.col("p2").cast("array<double>").alias("p2"))
    same = F.array(*[F.lit(float(a == b)) for a in range(d) for b in range(d + 1)])
    ids = used.select(by, F.explode(F.array("i", "j")).alias("tile")).distinct()
    maps = ids.withColumn("matrix", same)
    if start is not None:
        maps = ids.join(start.select(by, F.col("tile").cast("long").alias("tile"), F.col("matrix").alias("_m")), [by, "tile"], "left").select(by, "tile", F.coalesce("_m", same).alias("matrix"))
    maps = cut(maps)
    moved = start is not None
    kind = maps.schema
    target = to_arrow_schema(kind)

    def stepped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = batch.column(3).to_pylist()
            out = [(np.array(a) if x is None else step(np.array(a).reshape(d, d + 1), np.array(x), model)).ravel().tolist() for a, x in zip(batch.column(2).to_pylist(), xs, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, target.field("matrix").type)], schema=target)

    for _ in range(turns if model == "rigid" else 1):
        placed = used
        if moved:
            end = lambda c, a: maps.select(by, F.col("tile").alias(c), F.col("matrix").alias(a))
            put = lambda a, p: F.array(*[sum((F.get(a, F.lit(k * (d + 1) + e)) * F.get(p, F.lit(e)) for e in range(d)), F.get(a, F.lit(k * (d + 1) + d))) for k in range(d)])
            both = used.join(end("i", "_a"), [by, "i"]).join(end("j", "_b"), [by, "j"])
            placed = both.select(by, "i", "j", put("_a", "p1").alias("p1"), put("_b", "p2").alias("p2"))
        parts = cut(_parts(placed, by, d, model))
        found = _solved(parts, by, m, list(fixed), tolerance, iterations)
        maps = cut(maps.join(found, [by, "tile"], "left").select(by, "tile", "matrix", "x").mapInArrow(stepped, kind))
        moved = True
        if model == "rigid" and not found.where(F.exists("x", lambda v: F.abs(v) > 1e-7)).limit(1).count():
            break
    return maps
