"""The N5 source and writer: exact bytes, pruning, and writes that appear as a whole or not at all."""

import gzip
import json
import os
import struct

import numpy as np
import pytest

from veldmark.sources import n5


def pixels(spark, m):
    rows = [(x, y, z, float(m[z, y, x])) for z in range(m.shape[0]) for y in range(m.shape[1]) for x in range(m.shape[2])]
    return spark.createDataFrame(rows, "x int, y int, z int, v double").repartition(4)


@pytest.mark.parametrize("compression", [{"type": "raw"}, {"type": "gzip", "level": -1}, {"type": "bzip2"}, {"type": "xz"}])
def test_round_trip(spark, tmp_path, compression):
    """Blocks at the far ends are smaller; data are big-endian, x fastest."""
    m = np.random.default_rng(0).integers(0, 60_000, (3, 5, 7))
    path = f"file://{tmp_path}/set"
    n5.write_pixels(pixels(spark, m), path, ["x", "y", "z"], "v", [7, 5, 3], [4, 2, 2], "uint16", compression)
    assert json.loads((tmp_path / "set/attributes.json").read_text()) == {"dimensions": [7, 5, 3], "blockSize": [4, 2, 2], "dataType": "uint16", "compression": compression}
    data = (tmp_path / "set/1/2/1").read_bytes()
    assert struct.unpack_from(">HHIII", data) == (0, 3, 3, 1, 1)
    if compression["type"] == "gzip":
        assert np.frombuffer(gzip.decompress(data[16:]), ">u2").tolist() == m[2, 4, 4:].tolist()
    got = {(r.x, r.y, r.z): r.v for r in n5.read_pixels(spark, path, ["x", "y", "z"], "v").collect()}
    assert got == {(x, y, z): m[z, y, x] for z in range(3) for y in range(5) for x in range(7)}


@pytest.mark.parametrize("kind", ["int8", "float32", "float64", "uint32"])
def test_types(spark, tmp_path, kind):
    m = np.array([[[1.5, -2.0, 3.0]]]) if kind.startswith("float") else np.array([[[1, -2 if kind == "int8" else 4_000_000_000, 3]]])
    path = f"{tmp_path}/set"
    n5.write_pixels(pixels(spark, m), path, ["x", "y", "z"], "v", [3, 1, 1], [2, 1, 1], kind)
    assert sorted((r.x, r.v) for r in n5.read_pixels(spark, path, ["x", "y", "z"], "v").collect()) == list(enumerate(m.ravel().tolist()))


def test_only_needed_blocks_are_read(spark, tmp_path):
    m = np.arange(64).reshape(1, 8, 8)
    path = f"file://{tmp_path}/set"
    n5.write_pixels(pixels(spark, m), path, ["x", "y", "z"], "v", [8, 8, 1], [2, 2, 1])
    assert n5.read_blocks(spark, path, blocks=4).rdd.getNumPartitions() == 4
    few = n5.read_blocks(spark, path, blocks=1).where("g0 >= 1 AND g0 < 3 AND g1 = 2")
    assert few.rdd.getNumPartitions() == 2 and sorted(r.g0 for r in few.collect()) == [1, 2]
    assert n5.read_blocks(spark, path).where("g0 > 7").count() == 0
    for name in os.listdir(tmp_path / "set"):  # blocks that aren't asked for may be gone or broken
        if name.isdigit() and name != "1":
            (tmp_path / "set" / name / "0" / "0").write_bytes(b"broken")
    got = n5.read_pixels(spark, path, ["x", "y", "z"], "v", [2, 1, 0], [3, 1, 0]).collect()
    assert sorted((r.x, r.y, r.v) for r in got) == [(2, 1, 10.0), (3, 1, 11.0)]
    with pytest.raises(Exception, match="block|unpack|mode"):
        n5.read_pixels(spark, path, ["x", "y", "z"], "v").collect()


def test_missing_pixels_and_blocks(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 5.0), (9, 9, None)], "x int, y int, v double")
    n5.write_pixels(df, f"{tmp_path}/set", ["x", "y"], "v", [10, 10], [3, 3])
    rows = n5.read_blocks(spark, f"{tmp_path}/set").orderBy("g0").collect()
    assert [(r.g0, r.g1, r["size"], r.data) for r in rows] == [(0, 0, [3, 3], [5.0] + [0.0] * 8), (3, 3, [1, 1], [0.0])]
    n5.write_pixels(df.limit(0), f"{tmp_path}/none", ["x", "y"], "v", [10, 10], [3, 3])
    assert n5.read_pixels(spark, f"{tmp_path}/none", ["x", "y"], "v").count() == 0


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 5.0), (12, 0, 1.0)], "x int, y int, v double")
    with pytest.raises(Exception, match="outside the array"):
        n5.write_pixels(df, f"{tmp_path}/set", ["x", "y"], "v", [10, 10], [3, 3])
    assert os.listdir(tmp_path) == []


def test_overwrite(spark, tmp_path):
    write = lambda v, **o: n5.write_pixels(spark.createDataFrame([(0, 0, v)], "x int, y int, v double"), f"{tmp_path}/set", ["x", "y"], "v", [1, 1], [3, 3], **o)
    write(1.0)
    with pytest.raises(Exception, match="there already"):
        write(2.0)
    assert [r.v for r in n5.read_pixels(spark, f"{tmp_path}/set", ["x", "y"], "v").collect()] == [1.0] and os.listdir(tmp_path) == ["set"]
    write(3.0, overwrite=True)
    assert [r.v for r in n5.read_pixels(spark, f"{tmp_path}/set", ["x", "y"], "v").collect()] == [3.0] and os.listdir(tmp_path) == ["set"]
