"""Exact distances of masks of any size: nearest along rows by windows, then lower envelopes of parabolas along columns, band by band."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veldmark.session import cut

#: Rows of a band.
BAND = 256


def envelope(at: np.ndarray, height: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parabolas (y - at)^2 + height that are least somewhere, at ascending, and where each but the first takes over."""
    kept: list[int] = []
    starts: list[float] = []
    tops = (height + at * at).tolist()
    places = at.tolist()
    for i, (top, y) in enumerate(zip(tops, places, strict=True)):
        while kept:
            j = kept[-1]
            begin = (top - tops[j]) / (2 * (y - places[j]))
            if starts and begin <= starts[-1]:
                kept.pop()
                starts.pop()
            else:
                starts.append(begin)
                break
        kept.append(i)
    return np.array(kept, np.int64), np.array(starts, np.float64)


def lowest(y: np.ndarray, at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """The least of (y - at)^2 + height at each y, a whole number; the largest one where there is no parabola."""
    if not len(at):
        return np.full(len(y), np.iinfo(np.int64).max)
    kept, starts = envelope(at, height)
    # where two parabolas meet both give the least value, so a rounded start costs nothing on whole places
    i = np.searchsorted(starts, y, side="right")
    near = [np.clip(i + k, 0, len(kept) - 1) for k in (-1, 0, 1)]
    return np.min([(y - at[kept[k]]) ** 2 + height[kept[k]] for k in near], axis=0)


def outer(first: int, last: int, at: np.ndarray, height: np.ndarray) -> np.ndarray:
    """Which parabolas of a band are least somewhere before or after it."""
    if not len(at):
        return np.zeros(0, np.int64)
    kept, starts = envelope(at, height)
    begins, ends = np.concatenate([[-np.inf], starts]), np.concatenate([starts, [np.inf]])
    return kept[(begins <= first) | (ends >= last)]


def _beside(mask: DataFrame, by: list[str], x: str, y: str, other: Column) -> Column:
    """How far it is along the row to the nearest pixel where other holds; null if the row has none."""
    row = W.partitionBy(*by, y).orderBy(x)
    place = F.when(other, F.col(x))
    before = F.last(place, ignorenulls=True).over(row.rowsBetween(W.unboundedPreceding, 0))
    after = F.first(place, ignorenulls=True).over(row.rowsBetween(0, W.unboundedFollowing))
    return F.least(F.col(x) - before, after - F.col(x))


COLUMN = "ys array<long>, inside array<boolean>, to_in array<long>, to_out array<long>"


#: Columns of a band that become Python objects together.
FEW = 32


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, FEW):
            yield batch.slice(at, FEW)


def _known(g: list) -> tuple[np.ndarray, np.ndarray]:
    some = np.array([v is not None for v in g], bool)
    return some, np.array([v for v in g if v is not None], np.int64) ** 2


def signed_distance(mask: DataFrame, x: str, y: str, value: str, name: str = "distance", by: tuple[str, ...] = (), band: int = BAND) -> DataFrame:
    """Each pixel of a mask with its exact distance to the nearest pixel of the other kind, positive where value isn't 0, else negative: by, x, y, name.

    x and y are whole numbers; null values count as 0. Where all pixels of a mask
    are of one kind the distance is null. Rows are settled by windows, so a row
    fits in a task. A column is dealt out in bands. Within a band the lower
    envelope of its rows' parabolas gives a first answer, and how far it can
    still be wrong; beyond the band only those of its parabolas matter that are
    least somewhere outside, and they go to the bands within that reach.
    """
    keys = list(by)
    rows = mask.select(*keys, F.col(x).cast("long").alias(x), F.col(y).cast("long").alias(y), F.coalesce(F.col(value) != 0, F.lit(False)).alias("_in"))
    beside = rows.withColumns({"_to_in": _beside(rows, keys, x, y, F.col("_in")), "_to_out": _beside(rows, keys, x, y, ~F.col("_in"))})
    packed = F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col("_in").alias("i"), F.col("_to_in").alias("a"), F.col("_to_out").alias("b"))))
    columns = beside.groupBy(*keys, x, F.floor(F.col(y) / band).alias("_band")).agg(packed.alias("_rows"))
    pick = lambda f: F.transform("_rows", lambda r: r[f])
    columns = cut(columns.select(*keys, x, "_band", pick("y").alias("ys"), pick("i").alias("inside"), pick("a").alias("to_in"), pick("b").alias("to_out")))
    place = [*keys, x, "_band"]

    kind = StructType([*(columns.schema[k] for k in place), *StructType.fromDDL("_reach double, _sent array<struct<kind: boolean, y: long, h: long>>")])
    target = to_arrow_schema(kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            reach, sent = [], []
            for r in batch.select(["ys", "inside", "to_in", "to_out"]).to_pylist():
                ys, inside = np.array(r["ys"], np.int64), np.array(r["inside"], bool)
                far, out = 0.0, []
                for own, g in ((False, r["to_in"]), (True, r["to_out"])):
                    some, height = _known(g)
                    at = ys[some]
                    asked = ys[inside == own]
                    if len(asked):
                        far = max(far, float(np.sqrt(lowest(asked, at, height).max())) if len(at) else np.inf)
                    out += [(own, int(at[k]), int(height[k])) for k in outer(int(ys[0]), int(ys[-1]), at, height)]
                reach.append(far)
                sent.append([{"kind": o, "y": p, "h": h} for o, p, h in out])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in place), pa.array(reach, pa.float64()), pa.array(sent, target.field("_sent").type)], schema=target)

    edges = cut(columns.mapInArrow(first, kind))
    # a band that knows no pixel of the other kind looks as far as the nearest band that does, and how far that one's least parabola may be
    least = lambda own: F.array_min(F.transform(F.filter("_sent", lambda s: s["kind"] == own), lambda s: s["h"]))
    both = edges.withColumns({"_a": least(False), "_b": least(True)})
    along = W.partitionBy(*keys, x).orderBy("_band")
    bounds = {}
    for c in ("_a", "_b"):
        known = F.when(F.col(c).isNotNull(), F.struct("_band", F.col(c).alias("h")))
        last, next_ = F.last(known, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)), F.first(known, ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing))
        way = lambda s: (F.abs(s["_band"] - F.col("_band")) + 1) * band + F.sqrt(s["h"])
        bounds[f"{c}way"] = F.coalesce(F.least(way(last), way(next_)), F.lit(-1.0))
    asking = both.withColumns(bounds).withColumn("_look", F.least("_reach", F.greatest("_away", "_bway")))
    steps = F.ceil(F.col("_look") / band).cast("int")
    wanted = asking.where(F.col("_reach") > 0).select(*place, F.explode(F.sequence(-steps, steps)).alias("_step")).where("_step <> 0").withColumn("_from", F.col("_band") + F.col("_step"))
    source = edges.where(F.size("_sent") > 0).select(*keys, x, F.col("_band").alias("_from"), "_sent")
    gained = wanted.join(source, [*keys, x, "_from"]).groupBy(*place).agg(F.flatten(F.collect_list("_sent")).alias("_more"))

    done = StructType([*(columns.schema[k] for k in [*keys, x]), *StructType.fromDDL("ys array<long>, ds array<double>")])
    made = to_arrow_schema(done)

    def last_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            ds = []
            for r in batch.select(["ys", "inside", "to_in", "to_out", "_more"]).to_pylist():
                ys, inside = np.array(r["ys"], np.int64), np.array(r["inside"], bool)
                d = np.full(len(ys), np.nan)
                for own, g in ((False, r["to_in"]), (True, r["to_out"])):
                    some, height = _known(g)
                    more = [(m["y"], m["h"]) for m in r["_more"] or () if m["kind"] == own]
                    at = np.concatenate([ys[some], np.array([m[0] for m in more], np.int64)])
                    height = np.concatenate([height, np.array([m[1] for m in more], np.int64)])
                    if not len(at):
                        continue
                    order = np.argsort(at)
                    asked = inside == own
                    d[asked] = np.sqrt(lowest(ys[asked], at[order], height[order])) * (1 if own else -1)
                ds.append([None if np.isnan(v) else float(v) for v in d])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in [*keys, x]), batch.column("ys"), pa.array(ds, pa.list_(pa.float64()))], schema=made)

    settled = columns.join(gained, place, "left").mapInArrow(last_, done)
    return settled.select(*keys, x, F.explode(F.arrays_zip("ys", "ds")).alias("_r")).select(*keys, x, F.col("_r.ys").alias(y), F.col("_r.ds").alias(name))


def masks_between(lower: DataFrame, upper: DataFrame, x: str, y: str, value: str, weight: float, by: tuple[str, ...] = ()) -> DataFrame:
    """A mask between two masks of the same pixels: 1 where the weighted sum of their exact signed distances is positive. A mask of one kind only counts as infinitely deep in it."""
    one_kind = lambda m: F.when(F.col(m).isNull(), F.when(F.col(f"{m}in"), F.lit(float("inf"))).otherwise(F.lit(float("-inf")))).otherwise(F.col(m))
    keys = [*by, x, y]
    with_kind = lambda m, n: signed_distance(m, x, y, value, n, by).join(m.select(*[F.col(k).cast("long").alias(k) if k in (x, y) else F.col(k) for k in keys], F.coalesce(F.col(value) != 0, F.lit(False)).alias(f"{n}in")), keys)
    both = with_kind(lower, "_a").join(with_kind(upper, "_b"), keys)
    total = one_kind("_a") * (1 - weight) + one_kind("_b") * weight
    return both.select(*keys, (F.coalesce(total > 0, F.lit(False)) & ~F.isnan(total)).cast("int").alias(value))
