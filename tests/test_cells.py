"""Peaks held by cells against one ordered loop over each series."""

import os

import numpy as np
import pytest

from veldmark.streaming import cells, streams

SF = "/root/testdata/sf0.01"
KIND = "series string, t int, x double, y double, z double"


def made(seed, times=7, n=60, wide=30.0):
    """Peaks that move about fixed places, some of them alone, some repeated, on a grid so that ties occur."""
    r = np.random.default_rng(seed)
    homes = r.uniform(-wide, wide, (n, 3))
    rows = []
    for t in range(times):
        for h in homes[r.random(n) < 0.7]:
            rows.append((t, *np.round(h + r.normal(0, 1.0, 3), 0).tolist()))
        rows += [(t, *np.round(r.uniform(-wide, wide, 3)).tolist()) for _ in range(5)]
    return rows + rows[:20]


def plain(rows, radius):
    by_time = [np.array(sorted(r[1:] for r in rows if r[0] == t)) for t in sorted({r[0] for r in rows})]
    place, count = streams.merged_peaks(by_time, radius)
    return sorted((*p, int(n)) for p, n in zip(place.tolist(), count, strict=True))


def of(df, series):
    return sorted((r.x, r.y, r.z, r.n) for r in df.collect() if r.series == series)


@pytest.mark.parametrize(("steps", "side"), [(1, 17.0), (3, 31.0), (20, None)])
def test_cells_end_with_what_the_loop_has(spark, steps, side):
    """Bit for bit, over cells narrower than their rims too, for several series, null among them; rows without a place or time play no part."""
    a, b = made(1), made(2, n=20)
    rows = [("a", *r) for r in a] + [(None, *r) for r in b] + [("a", None, 1.0, 1.0, 1.0), ("a", 1, None, 1.0, 1.0), ("a", 1, float("nan"), 1.0, 1.0), ("a", 1, 1.0, float("inf"), 1.0)]
    done = cells.peaks_by_cell(spark.createDataFrame(rows, KIND).repartition(3), "series", 3.0, steps=steps, side=side)
    assert of(done, "a") == plain(a, 3.0) and of(done, None) == plain(b, 3.0)
    assert max(n for *_, n in of(done, "a")) > 4


def test_many_copies_of_a_peak(spark):
    rows = [(t, 1.0, 2.0, 3.0) for t in range(3) for _ in range(300)] + [(2, 2.0, 2.0, 3.0)]
    done = cells.peaks_by_cell(spark.createDataFrame([("a", *r) for r in rows], KIND), "series", 2.0, steps=1)
    assert of(done, "a") == plain(rows, 2.0) and len(of(done, "a")) == 300


def test_query_is_the_loop(spark):
    from veldmark.plans import catalogue, points

    found = points.points(spark, SF)
    rows = [(r.pid % 5, r.label, r.x, r.y, r.z) for r in found.collect()]
    got = catalogue.queries()["st4_peaks_by_cell"](spark, SF)
    for series in range(5):
        assert of(got, series) == plain([r[1:] for r in rows if r[0] == series], 20.0)


def test_empty(spark):
    assert cells.peaks_by_cell(spark.createDataFrame([], KIND), "series", 2.0).count() == 0


def test_a_stream_in_batches_goes_on_after_a_stop_and_a_lost_commit(spark, tmp_path):
    rows = made(3, times=8, n=30)
    files, out, mark = (str(tmp_path / p) for p in ("in", "out", "mark"))

    def come(times):
        for t in times:
            spark.createDataFrame([("a", *r) for r in rows if r[0] == t], KIND).coalesce(1).write.mode("append").parquet(files)

    def run():
        stream = streams.files(spark, files, KIND, per_trigger=1)
        cells.keep_peaks(stream, out, mark, "series", 3.0, steps=1, side=40.0).awaitTermination()
        return of(cells.kept_peaks(spark, out), "a")

    come(range(5))
    assert run() == plain([r for r in rows if r[0] < 5], 3.0)
    come(range(5, 8))
    assert run() == plain(rows, 3.0)
    # the last batch was written but not committed: it runs again, from the set before it
    for name in ("7", ".7.crc"):
        if os.path.exists(f"{mark}/commits/{name}"):
            os.remove(f"{mark}/commits/{name}")
    assert run() == plain(rows, 3.0)
