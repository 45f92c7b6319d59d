"""Queries that must cover their whole table: as many rows as it has, and all of them right (test_queries holds them against SQL)."""

import numpy as np
import pytest

from veldmark.functions import numeric
from veldmark.operators import flows, images
from veldmark.plans import catalogue
from veldmark.sources import sinks, tables

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.mark.parametrize("name, source, each", [("sc8_matrices_csv", "customer", 1), ("sc9_series_csv", "embeddings", 64), ("sk8_json", "events", 1), ("sc32_bibliography", "part", 1)])
def test_round_trips_keep_all_rows(spark, name, source, each):
    assert catalogue.queries()[name](spark, SF).count() == each * rows(spark, source).count()


def test_parts_are_one_table(spark, tmp_path, monkeypatch):
    """Rows keep their places over many files, of which only the first has the heading."""
    monkeypatch.setattr(sinks, "PART_ROWS", 7)
    df = spark.range(100).repartition(5).selectExpr("id", "array(double(id), 0D, 1D, 0D, 1D, 2D) AS m")
    sinks.matrices_csv(df, str(tmp_path / "m"), "m", "id", 2, one_file=False)
    assert len(list((tmp_path / "m").glob("part-*"))) >= 15
    assert sorted((r["at"], r.matrix[0]) for r in tables.matrices(spark, str(tmp_path / "m"), parts=True).collect()) == [(i, float(i)) for i in range(100)]
    series = spark.range(30).selectExpr("id AS t", "explode(sequence(0, 2)) AS peak").selectExpr("t", "peak", "peak + 1D AS x", "2D AS y", "3D AS z", "float(t * 10 + peak) AS f")
    sinks.series_csv(series, str(tmp_path / "s"), "t", "f", one_file=False)
    assert sorted((r.t, r.peak, r.f) for r in tables.fluorescence(spark, str(tmp_path / "s"), parts=True).collect()) == [(t, p, float(t * 10 + p)) for t in range(30) for p in range(3)]
    sinks.bibliography_text(spark.range(50).selectExpr("concat('K', id) AS key", "concat('@book{K', id, ',\n}') AS body"), str(tmp_path / "b"), one_file=False)
    assert {r.key for r in tables.bibliography(spark, str(tmp_path / "b")).collect()} == {f"K{i}" for i in range(50)}


def test_all_bytes_are_reversed(spark):
    assert catalogue.queries()["f21_reversed_bytes"](spark, SF).count() == rows(spark, "part").count()
    keys = [0, 1, -1, 127, 128, 255, 256, 200_000_000, 1 << 56, 128 << 56 - 1, -(1 << 63), (1 << 63) - 1, 0x0102030405060708, -0x0102030405060708]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", numeric.reverse_bytes("k").alias("flipped")).collect()
    assert {r.k: r.flipped for r in got} == {k: int.from_bytes(k.to_bytes(8, "little", signed=True), "big", signed=True) for k in keys}


def test_reports_list_everything_in_order(spark):
    report = [(r.n, r.o_custkey) for r in catalogue.queries()["o1_report"](spark, SF).collect()]
    assert report == sorted(report, key=lambda r: (-r[0], r[1])) and len(report) == rows(spark, "orders").select("o_custkey").distinct().count() > 50
    suffixes = [r.suffix for r in catalogue.queries()["o3_integer_suffix"](spark, SF).collect()]
    assert suffixes == sorted(suffixes) and len(suffixes) == rows(spark, "nation").count() == 25


def test_images_keep_all_rows(spark):
    n = rows(spark, "embeddings").count()
    turned = catalogue.queries()["v6_rotate"](spark, SF)
    assert turned.count() == 64 * n and turned.agg({"x": "min"}).first()[0] == 0 and turned.agg({"x": "max"}).first()[0] == n - 1
    assert catalogue.queries()["w6_block_sums"](spark, SF).count() == 61 * (n - 2)
    assert catalogue.queries()["n18_window_mean"](spark, SF).count() == 64 * n


@pytest.mark.parametrize("band", [1, 2, 3, 5, 100])
def test_block_sums_over_bands(spark, band):
    """Blocks across the edges of bands, even over several bands, against brute force."""
    value = lambda x, y: (7 * x + 13 * y + x * y) % 11
    df = spark.createDataFrame([(x, y, float(value(x, y))) for x in range(6) for y in range(11)], "x long, y long, v double")
    got = {(r.x, r.y): r["sum"] for r in images.block_sums_in_bands(df, "x", "y", "v", 3, 4, band).collect()}
    assert got == {(x, y): sum(value(x + i, y + j) for i in range(3) for j in range(4)) for x in range(4) for y in range(8)}


def test_split_graph_has_six_tables(spark, tmp_path):
    counts = spark.createDataFrame([(1, "axon", 2, "dendrite", 5)], "pre int, pre_part string, post int, post_part string, n int")
    inputs = spark.createDataFrame([(2, "dendrite", 9), (2, "axon", 1), (2, "dendrite", 1), (7, "axon", 4)], "skeleton_id int, part string, n int")
    names = spark.createDataFrame([(2, "b, left"), (1, 'a "x"'), (3, "c")], "skeleton_id int, neuron_name string")
    sinks.split_graph_csvs(counts, inputs, names, str(tmp_path))
    read = lambda name: next((tmp_path / name).glob("part-*")).read_text().splitlines()
    assert {p.name for p in tmp_path.iterdir()} == {"axon-axon", "axon-dendrite", "dendrite-axon", "dendrite-dendrite", "input_counts", "skeleton_id_vs_neuron_name"}
    assert read("axon-dendrite") == ['"pre","1","2","3"', "1,0,5,0", "2,0,0,0", "3,0,0,0"]
    assert read("input_counts") == ['"skeleton_id","axon_inputs","dendrite_inputs"', "1,0,0", "2,1,10", "3,0,0"]
    assert read("skeleton_id_vs_neuron_name") == ['"skeleton_id","neuron_name"', '1,"a ""x"""', '2,"b, left"', '3,"c"']


@pytest.mark.parametrize("bits, inverted", [(8, True), (16, False), (16, True)])
def test_export_crops_inverts_moves_and_writes(spark, tmp_path, bits, inverted):
    rng = np.random.default_rng(3)
    volume = rng.integers(0, 65536, (2, 9, 8))
    voxels = spark.createDataFrame([(s, x, y, int(volume[s, y, x])) for s in range(2) for y in range(9) for x in range(8)], "section int, x long, y long, v int")
    maps = {0: [1.0, 0.0, 0.5, 0.0, 1.0, -1.25], 1: [0.0, -1.0, 4.0, 1.0, 0.0, 0.0]}
    flows.exported(voxels, spark.createDataFrame(list(maps.items()), "section int, matrix array<double>"), str(tmp_path / "n5"), {"x": 1, "y": 2}, {"x": 6, "y": 8}, bits=bits, display=(1000.0, 60000.0), inverted=inverted, block=4)
    crop = volume[:, 2:9, 1:7].astype(float)
    crop = 65535 - crop if inverted else crop
    want = np.zeros(crop.shape)
    for s, m in maps.items():
        back = np.linalg.inv(np.vstack([np.reshape(m, (2, 3)), [0, 0, 1]]))
        for y in range(7):
            for x in range(6):
                px, py, _ = back @ [x, y, 1]
                for cx in (np.floor(px), np.floor(px) + 1):
                    for cy in (np.floor(py), np.floor(py) + 1):
                        if 0 <= cx < 6 and 0 <= cy < 7:
                            want[s, y, x] += (1 - abs(px - cx)) * (1 - abs(py - cy)) * crop[s, int(cy), int(cx)]
    want = np.clip(np.floor((want - 1000) * 255 / 59000 + 0.5), 0, 255) if bits == 8 else np.clip(np.floor(want + 0.5), 0, 65535)
    got = np.full(crop.shape, -1.0)
    for r in spark.read.parquet(str(tmp_path / "n5")).collect():
        got[r.section, 4 * r.by : 4 * r.by + r.height, 4 * r.bx : 4 * r.bx + r.width] = np.reshape(r.v, (r.height, r.width))
    assert np.abs(got - want).max() <= 1 and (got == want).mean() > 0.95
