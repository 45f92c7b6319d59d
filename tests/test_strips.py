"""Image files by strip: the same pixels as from whole files, and large files in small pieces."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.sources import binary, strips


@pytest.mark.parametrize("compression", [1, 32773, 8])
@pytest.mark.parametrize("big_endian", [True, False])
def test_rows_equal_whole_planes(spark, tmp_path, compression, big_endian):
    rng = np.random.default_rng(1)
    kinds = [np.uint8, np.uint16, np.float32]
    files = {f"{k}.tif": [rng.integers(0, 200, (7 + k, 5)).astype(kinds[k]) for _ in range(3)] for k in range(3)}
    for name, planes in files.items():
        (tmp_path / name).write_bytes(binary.tagged_image(planes, compression, big_endian, 3))
    whole = {(r.path, r.slice): np.array(r.data).reshape(r.height, r.width) for r in binary.read_slices(spark, f"{tmp_path}/*.tif").collect()}
    rows = strips.read_rows(spark, f"{tmp_path}/*.tif").collect()
    assert len(rows) == sum(p.shape[0] for p in whole.values())
    assert all(r.data == whole[r.path, r.slice][r.y].tolist() for r in rows)
    few = strips.read_rows(spark, f"{tmp_path}/*.tif", slices=(1, 1), ys=(2, 4)).collect()
    assert sorted((r.slice, r.y) for r in few) == sorted([(1, y) for y in (2, 3, 4)] * 3) and all(r.data == whole[r.path, r.slice][r.y].tolist() for r in few)
    assert strips.read_rows(spark, f"{tmp_path}/*.tif", ys=(50, 60)).count() == 0


def test_sections_equal_whole_files(spark, tmp_path):
    planes = np.random.default_rng(2).integers(-300, 300, (3, 9, 4))
    planes[1] = abs(planes[1])
    (tmp_path / "a.dat").write_bytes(binary.section_file(planes))
    whole = {r.channel: np.array(r.data).reshape(9, 4) for r in binary.read_sections(spark, f"{tmp_path}/a.dat").collect()}
    rows = strips.read_section_rows(spark, f"{tmp_path}/a.dat").collect()
    assert len(rows) == 27 and all(r.data == whole[r.channel][r.y].tolist() for r in rows)
    few = strips.read_section_rows(spark, f"{tmp_path}/a.dat", channel=2, ys=(3, 5)).collect()
    assert sorted(r.y for r in few) == [3, 4, 5] and all(r.data == whole[2][r.y].tolist() for r in few)


def test_a_file_of_two_gigabytes(spark, tmp_path):
    """One strip of over two gigabytes, most of it a hole: it is cut to bands, which many tasks get, and a few of its rows are read alone."""
    width, height, start = 30_000, 36_000, 8
    size = width * height * 2
    path = tmp_path / "large.tif"
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HI", 42, start + size))
        f.seek(start + 35_990 * width * 2)
        f.write(np.arange(width, dtype="<u2").tobytes())
        f.seek(start + size)
        tags = {256: width, 257: height, 258: 16, 259: 1, 262: 1, 273: start, 277: 1, 278: height, 279: size}
        f.write(struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags.items()) + struct.pack("<I", 0))
    planned = strips._planned(spark, str(path), strips._strips, None, None)
    assert planned.rdd.getNumPartitions() == -(-(size + 130) // strips.TASK_BYTES) > 60
    assert planned.agg(F.max("count"), F.sum("rows")).first() == (17 * width * 2, height)
    rows = strips.read_rows(spark, str(path), ys=(35_989, 35_991)).collect()
    assert sorted((r.y, sum(r.data)) for r in rows) == [(35_989, 0.0), (35_990, float(sum(range(width)))), (35_991, 0.0)]


def test_broken_files(spark, tmp_path):
    data = binary.tagged_image([np.ones((4, 4), np.uint8)], 1, False, 2)
    (tmp_path / "jpeg.tif").write_bytes(data.replace(struct.pack("<HHII", 259, 4, 1, 1), struct.pack("<HHII", 259, 4, 1, 7)))
    with pytest.raises(Exception, match="compression 7"):
        strips.read_rows(spark, f"{tmp_path}/jpeg.tif").collect()
    (tmp_path / "short.tif").write_bytes(data[:40])
    with pytest.raises(Exception, match="ends before"):
        strips.read_rows(spark, f"{tmp_path}/short.tif").collect()
