import bz2
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.sources import binary, sinks, tables
from veldmark.streaming import streams


def test_parameter_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("radius,levels,name\n10,\"[1, 2.0000001]\",dog\nangle,len1,len2,x,y,z\n0.5,1,2,3,4,5\n0.6,1,2,3,4,5\n")
    (tmp_path / "b.csv").write_text("radius,levels,name\n11,\"[1, 2]\",dog\nangle,len1,len2,x,y,z\n0.5,1,2,3,4,5\n")
    (tmp_path / "c.csv").write_text("radius,other\n10,1\n")
    every = tables.with_parameters(spark, f"{tmp_path}/*.csv")
    assert every.count() == 3
    want = {"radius": "10.0", "levels": "[1, 2]", "name": "dog"}
    got = tables.with_parameters(spark, f"{tmp_path}/*.csv", want).orderBy("at").collect()
    assert [r.row["angle"] for r in got] == [0.5, 0.6] and got[0].params["name"] == "dog"
    assert tables.with_parameters(spark, f"{tmp_path}/*.csv", {"radius": "10"}).count() == 0


def test_series_and_matrices(spark, tmp_path):
    (tmp_path / "f.csv").write_text('timepoint,"1.00::2.00::3.00","4::5::6"\n0,1.5,2.5\n1,3.5,4.5\n')
    got = tables.fluorescence(spark, str(tmp_path / "f.csv")).orderBy("t", "peak").collect()
    assert [(r.t, r.peak, r.x, r.f) for r in got] == [(0, 0, 1.0, 1.5), (0, 1, 4.0, 2.5), (1, 0, 1.0, 3.5), (1, 1, 4.0, 4.5)]
    sinks.series_csv(tables.fluorescence(spark, str(tmp_path / "f.csv")), str(tmp_path / "out"), "t", "f")
    assert next((tmp_path / "out").glob("part-*")).read_text().splitlines()[0] == '"timepoint","1.00::2.00::3.00","4.00::5.00::6.00"'
    m = spark.createDataFrame([(0, [1.0, 0.0, 5.0, 0.0, 1.0, 6.0]), (1, [2.0, 0.0, 0.0, 0.0, 2.0, 0.0])], "at int, matrix array<double>")
    sinks.matrices_csv(m, str(tmp_path / "m"), "matrix", "at", 2)
    assert [r.matrix for r in tables.matrices(spark, str(tmp_path / "m")).orderBy("at").collect()] == [r.matrix for r in m.collect()]
    assert [tuple(r)[1:] for r in tables.points_in_header(spark, str(tmp_path / "f.csv")).collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    (tmp_path / "p.csv").write_text("i,x,y,z\n0,1,2,3\n1,4,5,6\n")
    assert [tuple(r)[1:] for r in tables.points(spark, str(tmp_path / "p.csv")).collect()] == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    (tmp_path / "q.csv").write_text('one\ntwo\n1,"a, ""b""",x\n')
    assert tables.table_after(spark, str(tmp_path / "q.csv"), 2).first().fields[0] == "1"


def test_schema_tables(spark, tmp_path):
    (tmp_path / "s.csv").write_text("skeleton_id, treenode_id, parent_id, x, y, z\n1, 2, , 0.5, 1, 2\n1, 3, 2, 1, 1, 1\n")
    rows = tables.skeletons(spark, str(tmp_path / "s.csv")).collect()
    assert rows[0].parent_id is None and rows[1].parent_id == 2
    (tmp_path / "y.csv").write_text("a,b,c,d\n1,2,3,4\n")
    assert tuple(tables.synapses(spark, str(tmp_path / "y.csv")).first()) == (1, 2, 3, 4)
    (tmp_path / "bad.csv").write_text("a,b,c,d\n1,x,3,4\n")
    with pytest.raises(Exception):
        tables.synapses(spark, str(tmp_path / "bad.csv")).collect()


def test_skeleton_json(spark, tmp_path):
    (tmp_path / "1.json").write_text('[[[1,null,9,0.5,1,2,-1,5],[2,1,9,3,4,5,-1,5]],[[2,70,0],[1,71,1],[1,72,2]],{"soma":[1],"cut":[2]}]')
    (tmp_path / "2.json").write_text('[[[1,null,9,0,0,0,-1,5]],[],{"soma":[1,2]}]')
    found = tables.compact_skeletons(spark, f"{tmp_path}/*.json")
    good, bad = tables.accepted_skeletons(found, "cut")
    assert good.count() == 1 and bad.first().reason == "2 soma tags"
    assert [(r.node, r.parent, r.x) for r in tables.skeleton_nodes(good).collect()] == [(1, None, 0.5), (2, 1, 3.0)]
    assert [(r.connector, r.relation) for r in tables.connector_halves(good).collect()] == [(70, 0), (71, 1)]


def test_bibliography_and_sections(spark, tmp_path):
    (tmp_path / "a.bib").write_text("junk\n@article{Key1, x,\n title={A}\n}\n@book{Key2,\n}\n@book{Key1, later,\n}\n")
    got = {r.key: r.body for r in tables.bibliography(spark, str(tmp_path / "a.bib")).collect()}
    assert set(got) == {"Key1, x", "Key2", "Key1, later"}
    (tmp_path / "b.tex").write_text("a\n\\begin{x}\nb\n\\end{x}\nc\n")
    assert [r.inside for r in tables.sections(spark, str(tmp_path / "b.tex"), r"^\\begin", r"^\\end").orderBy("at").collect()][:5] == [False, True, True, False, False]


def test_listings(spark, tmp_path):
    for t in (1, 2, 3):
        d = tmp_path / f"TM{t:05d}"
        d.mkdir()
        for c in (0, 1):
            (d / f"SPM00_TM{t:05d}_CM0{c}_CHN00.klb").write_bytes(b"x" * (10 + t))
    found = tables.listing(spark, str(tmp_path), ".klb")
    assert found.count() == 6 and tables.listing(spark, str(tmp_path), ".klb", size=12).count() == 2
    assert tables.listing(spark, str(tmp_path), pattern=".*CM01.*").count() == 3
    points = tables.time_points(found, first=2)
    assert sorted((r.t, r.camera) for r in points.collect()) == [(2, "00"), (2, "01"), (3, "00"), (3, "01")]
    assert [len(r.paths) for r in tables.by_camera(points).collect()] == [2, 2]
    ok, odd = tables.expected_size(found, 11)
    assert (ok.count(), odd.count()) == (2, 4)


def tiff(pixels, order="<", compression=1, pack=bytes):
    """A small file of one 8-bit strip per slice."""
    out, at = bytearray(), 8
    head = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 8)
    body, links = bytearray(), []
    for p in pixels:
        data = pack(p.astype(np.uint8).tobytes())
        tags = [(256, 4, 1, p.shape[1]), (257, 4, 1, p.shape[0]), (258, 4, 1, 8), (259, 4, 1, compression), (273, 4, 1, at + 2 + 12 * 7 + 4), (278, 4, 1, p.shape[0]), (279, 4, 1, len(data))]
        part = struct.pack(f"{order}H", len(tags)) + b"".join(struct.pack(f"{order}HHII", *t) for t in tags)
        links.append(len(body) + len(part))
        body += part + b"\0\0\0\0" + data
        at = 8 + len(body)
        if len(links) < len(pixels):
            struct.pack_into(f"{order}I", body, links[-1], at)
    out += head + body
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    """Each byte as its own code, with clears before codes would grow."""
    bits = ""
    for i, b in enumerate(data):
        if i % 200 == 0:
            bits += f"{256:09b}"
        bits += f"{b:09b}"
    bits += f"{257:09b}"
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))


def test_image_files(spark, tmp_path):
    assert binary.unpack_bits(bytes.fromhex("FEAA0280002A")) == bytes.fromhex("AAAAAA80002A")
    assert binary.unpack_lzw(pack_lzw(bytes(range(256)) * 3)) == bytes(range(256)) * 3
    rng = np.random.default_rng(2)
    planes = [rng.integers(0, 255, (3, 4)) for _ in range(2)]
    packs = {1: bytes, 8: zlib.compress, 5: pack_lzw, 32773: lambda b: bytes([len(b) - 1]) + b}
    for order in "<>":
        for compression, pack in packs.items():
            (tmp_path / f"{'le' if order == '<' else 'be'}{compression}.tif").write_bytes(tiff(planes, order, compression, pack))
    rows = binary.read_slices(spark, f"{tmp_path}/*.tif").collect()
    assert len(rows) == 16 and all(np.array_equal(np.array(r.data).reshape(3, 4), planes[r.slice]) for r in rows)
    heads = binary.read_directories(spark, f"{tmp_path}/be5.tif").collect()
    assert [(r.width, r.height, r.compression, r.big_endian) for r in heads] == [(4, 3, 5, True)] * 2
    (tmp_path / "j.tiff").write_bytes(tiff(planes, compression=7))
    with pytest.raises(Exception):
        binary.read_slices(spark, f"{tmp_path}/j.tiff").collect()


def test_raw_files(spark, tmp_path):
    head = bytearray(1024)
    struct.pack_into(">I", head, 0, binary.MAGIC)
    head[32] = 2
    struct.pack_into(">i", head, 100, 3)
    struct.pack_into(">i", head, 104, 2)
    values = np.array([[-5, 10], [0, 20], [7, 30], [1, 40], [2, 50], [3, 60]], ">i2")
    (tmp_path / "a.dat").write_bytes(bytes(head) + values.tobytes())
    rows = binary.read_sections(spark, str(tmp_path / "a.dat")).orderBy("channel").collect()
    assert rows[0].data == [0, 5, 12, 6, 7, 8] and rows[1].data == [10, 20, 30, 40, 50, 60]
    assert tuple(binary.read_section_headers(spark, str(tmp_path / "a.dat")).first())[2:] == (2, 3, 2)
    grid = np.arange(20, dtype=">u2").reshape(4, 5)
    (tmp_path / "r.raw").write_bytes(b"head" + grid.tobytes())
    got = binary.read_region(spark, str(tmp_path / "r.raw"), 5, (1, 1), (3, 2), header=4).orderBy("y").collect()
    assert [r.data for r in got] == grid[1:3, 1:4].tolist()
    assert binary.read_raw(spark, str(tmp_path / "r.raw"), header=-4).first().data == [18.0, 19.0]
    micro = bytearray(1024)
    struct.pack_into(">2i", micro, 0, 2, 2)
    (tmp_path / "m.bz2").write_bytes(bz2.compress(bytes(micro) + np.array([1, -2, 3, 4], ">i2").tobytes()))
    assert binary.read_compressed_micrograph(spark, str(tmp_path / "m.bz2")).first().data == [1, -2, 3, 4]
    assert binary.cells(binary.read_sections(spark, str(tmp_path / "a.dat"), 1), 2).where("cx = 1").orderBy("y").first().data == [30]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ('b"c', 2)], "name string, n int")
    sinks.csv(df, str(tmp_path / "c"), one_file=True)
    sinks.csv(df, str(tmp_path / "parts"))
    parts = [p.read_text() for p in sorted((tmp_path / "parts").glob("part-*"))]
    assert "".join(parts).splitlines() == ['"name","n"', '"a",1', '"b""c",2']
    assert next((tmp_path / "c").glob("part-*")).read_text().splitlines() == ['"name","n"', '"a",1', '"b""c",2']
    assert sinks.first_unused(spark, str(tmp_path / "c")) == f"{tmp_path / 'c'}-1"
    counts = spark.createDataFrame([(1, "axon", 2, "dendrite", 5)], "pre int, pre_part string, post int, post_part string, n int")
    sinks.dense_csvs(counts, str(tmp_path / "d"), [2, 1, 3])
    assert next((tmp_path / "d/axon-dendrite").glob("part-*")).read_text().splitlines() == ['"pre","1","2","3"', "1,0,5,0", "2,0,0,0", "3,0,0,0"]
    calls = []
    make = lambda: calls.append(1) or df
    for _ in range(2):
        assert tables.parquet_by_parameters(spark, str(tmp_path), "x", {"r": 1}, make).count() == 2
    assert len(calls) == 1
    tiles = spark.createDataFrame([(0, [0, 0]), (1, [0, 3]), (2, [1, 1])], "k int, v array<int>")
    assert [r.k for r in sinks.missing_tiles(tiles, tiles.where("k = 2"), ["k"], "v").collect()] == [1]


def test_streams(spark, tmp_path):
    schema = "path string, at timestamp"
    rows = [("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 01:00:00"), ("a", "2024-01-02 00:00:00"), ("c", "2024-01-03 00:00:00")]
    df = spark.createDataFrame(rows, "path string, at string").withColumn("at", F.to_timestamp("at"))
    for i, part in enumerate((df.limit(2), df.where("at > '2024-01-01 02:00:00'"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = streams.files(spark, str(tmp_path / "in"), schema)
    streams.upsert_into(source, str(tmp_path / "out"), "path", "at", str(tmp_path / "ck")).awaitTermination()
    got = {r.path: (str(r.first), str(r["last"])) for r in streams.upserted(spark, str(tmp_path / "out"), "path").collect()}
    assert got["a"] == ("2024-01-01 00:00:00", "2024-01-02 00:00:00") and set(got) == {"a", "b", "c"}
    streams.append_files(streams.files(spark, str(tmp_path / "in"), schema), str(tmp_path / "csv"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 4


def test_running_peaks(spark, tmp_path):
    schema = "series string, t int, x double, y double, z double"
    for t, xs in enumerate(([0.0, 10.0], [1.0], [2.5])):
        spark.createDataFrame([("s", t, x, 0.0, 0.0) for x in xs], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.running_peaks(streams.files(spark, str(tmp_path / "in"), schema, per_trigger=9), "series", 3.0)
    query = stream.writeStream.format("memory").queryName("peaks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.x, r.n) for r in spark.table("peaks").collect()) == [(pytest.approx(3.5 / 3), 3), (10.0, 1)]


def test_region_source(spark, tmp_path):
    from veldmark.sources.regions import read_region

    grid = np.arange(60, dtype=">u2").reshape(10, 6)
    for name in ("a.raw", "b.raw"):
        (tmp_path / name).write_bytes(b"headhead" + grid.tobytes())
    paths = [f"file://{tmp_path}/a.raw", str(tmp_path / "b.raw")]
    df = read_region(spark, paths, 6, 10, header=8, x0=1, x1=3, y0=2, y1=8, rows=3)
    assert df.rdd.getNumPartitions() == 6
    got = df.orderBy("path", "y").collect()
    assert [r.data for r in got] == grid[2:9, 1:4].tolist() * 2 and got[0].x == 1
    few = read_region(spark, paths[0], 6, 10, header=8, rows=3).where("y >= 4 AND y < 7")
    assert few.rdd.getNumPartitions() == 1 and sorted(r.y for r in few.collect()) == [4, 5, 6]
    with pytest.raises(Exception, match="within the image"):
        read_region(spark, paths, 6, 10, x1=6).collect()
