"""Files of every format of the inventory: written in the shared folder, and read again."""

from __future__ import annotations

import bz2
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions.text import quoted_labels
from veldmark.operators import filters, flows, sets
from veldmark.plans.files import _place
from veldmark.plans.graphs import TREE, tree
from veldmark.plans.registry import query
from veldmark.session import table
from veldmark.sources import binary, kept, regions, sinks, strips, tables
from veldmark.streaming import streams

#: Vectors of a file.
PER_FILE = 100
PIXEL = "CAST(trunc(abs(CAST(embedding[i] AS DOUBLE)) * 10000) AS BIGINT)"
PIXELS = f"px AS (SELECT vec_id, vec_id // {PER_FILE} AS file, vec_id % {PER_FILE} AS y, i - 1 AS x, {PIXEL} AS v FROM embeddings, range(1, 65) r(i))"


def _name(pattern: str = r"([^/]+)$") -> Column:
    return F.regexp_extract("path", pattern, 1)


# Text tables


@query("SELECT p_partkey, [p_name, p_brand || ', ' || p_type] AS labels FROM part")
def sc1_quoted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('"'), "p_name", F.lit('", 7,"'), "p_brand", F.lit(", "), "p_type", F.lit('" 1.5'))
    return table(spark, sf_dir, "part").select("p_partkey", quoted_labels(line).alias("labels"))


@query(f"WITH {TREE} SELECT node % 10 AS skeleton_id, node AS treenode_id, parent AS parent_id, size + 0.25::DOUBLE AS x, size * 2.0::DOUBLE AS y, 0.5::DOUBLE AS z FROM tree")
def sc3_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, size = _place(spark), F.col("p_size")
    nodes = tree(spark, sf_dir).select(F.col("node") % 10, "node", "parent", size + 0.25, size * 2.0, F.lit(0.5)).toDF("skeleton_id", "treenode_id", "parent_id", "x", "y", "z")
    nodes.write.option("header", True).csv(path)
    return tables.skeletons(spark, path)


@query("SELECT l_suppkey AS pre_skeleton_id, l_orderkey AS pre_treenode_id, l_partkey AS post_skeleton_id, CAST(l_linenumber AS BIGINT) AS post_treenode_id FROM lineitem")
def sc4_synapses(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber").write.option("header", True).csv(path)
    return tables.synapses(spark, path)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", at(0).alias("angle"), at(1).alias("len1"), at(2).alias("len2"))


FEATURES = "SELECT label, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding[1] AS DOUBLE) AS angle, CAST(embedding[2] AS DOUBLE) AS len1, CAST(embedding[3] AS DOUBLE) AS len2 FROM embeddings"


@query(FEATURES)
def sc5_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature file for each label, under two lines of parameters."""
    path = _place(spark)
    sinks.parameter_csv(_features(spark, sf_dir), path, "label", "vec_id", {"radius": 10.5, "levels": [1, 2], "label": F.col("label")}, ["vec_id", "angle", "len1", "len2"])
    read = tables.with_parameters(spark, path)
    row = lambda c: F.element_at("row", c)
    return read.select(F.element_at("params", "label").cast("int").alias("label"), row("vec_id").cast("long").alias("vec_id"), *[row(c).alias(c) for c in ("angle", "len1", "len2")])


@query(f"{FEATURES} WHERE label % 3 = 0")
def sc6_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only files whose parameters agree with those asked for: a number by size, a list element by element, a name as text."""
    path, rest = _place(spark), F.col("label") % 3
    params = {"radius": 10, "levels": F.when(rest == 1, '"[1, 2.5]"').otherwise('"[1, 2.000001]"'), "kind": F.when(rest == 2, '"other"').otherwise('"peaks"')}
    sinks.parameter_csv(_features(spark, sf_dir).withColumn("own", F.col("label")), path, "label", "vec_id", params, ["own", "vec_id", "angle", "len1", "len2"])
    read = tables.with_parameters(spark, path, {"radius": "10.0", "levels": "[1, 2]", "kind": "peaks"})
    row = lambda c: F.element_at("row", c)
    return read.select(row("own").cast("int").alias("label"), row("vec_id").cast("long").alias("vec_id"), *[row(c).alias(c) for c in ("angle", "len1", "len2")])


@query("SELECT label, [CAST(embedding[i] AS DOUBLE) FOR i IN [1, 2, 3]] AS p1, [CAST(embedding[i] AS DOUBLE) FOR i IN [4, 5, 6]] AS p2 FROM embeddings WHERE label % 2 = 0")
def sc7_point_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match files with a heading; those without one have no rows."""
    path = _place(spark)
    names = ["x1", "y1", "z1", "x2", "y2", "z2"]
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    sinks.parameter_csv(rows.where("label % 2 = 0"), f"{path}/with", "label", "vec_id", {"angle_epsilon": 0.02, "label": F.col("label")}, names)
    sinks.parameter_csv(rows.where("label % 2 = 1"), f"{path}/without", "label", "vec_id", {"angle_epsilon": 0.02, "label": F.col("label")}, [])
    read = tables.with_parameters(spark, f"{path}/*/*/part-*")
    point = lambda own: F.array(*[F.element_at("row", n) for n in own])
    return read.select(F.element_at("params", "label").cast("int").alias("label"), point(names[:3]).alias("p1"), point(names[3:]).alias("p2"))


def _part_files(spark: SparkSession, sf_dir: str, line: Column, heads: list[Column]) -> str:
    """Text files of the parts of each size, under some lines."""
    path = _place(spark)
    parts = table(spark, sf_dir, "part")
    body = parts.select("p_size", F.col("p_partkey").alias("at"), line.alias("line"))
    above = parts.select("p_size").distinct().select("p_size", F.explode(F.array(*[F.struct(F.lit(i - len(heads)).cast("long").alias("at"), h.alias("line")) for i, h in enumerate(heads)])).alias("h")).select("p_size", "h.at", "h.line") if heads else body.limit(0)
    sinks.texts(above.union(body), path, "p_size", "at", "line")
    return path


@query("SELECT CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS at, [CAST(p_partkey AS VARCHAR), p_brand || ', ' || p_size, p_name] AS fields FROM part")
def sc10_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables under three lines that don't count; a field in quotes holds a comma."""
    line = F.concat(F.col("p_partkey"), F.lit(',"'), "p_brand", F.lit(", "), "p_size", F.lit('", '), "p_name")
    path = _part_files(spark, sf_dir, line, [F.lit("made by hand"), F.lit("key,brand,name"), F.lit("-")])
    return tables.table_after(spark, path, 3).select("at", "fields")


@query("SELECT CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS pid, p_retailprice AS x, p_size + 0.5::DOUBLE AS y, CAST(p_partkey AS DOUBLE) AS z FROM part")
def sc11_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beside an index that is dropped."""
    line = F.concat_ws(",", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string"), (F.col("p_size") + 0.5).cast("string"), F.col("p_partkey").cast("string"))
    return tables.points(spark, _part_files(spark, sf_dir, line, [F.lit("i,x,y,z")])).drop("file")


@query("SELECT CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS pid, round(p_retailprice, 2) AS x, CAST(p_size AS DOUBLE) AS y, 2.5::DOUBLE AS z FROM part")
def sc12_points_in_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heading of peaks for each size of part."""
    from veldmark.functions.text import coordinates_label

    path, parts = _place(spark), table(spark, sf_dir, "part")
    label = F.concat(F.lit('"'), coordinates_label("p_retailprice", F.col("p_size").cast("double"), F.lit(2.5)), F.lit('"'))
    heads = parts.groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct("p_partkey", label.alias("l")))).alias("ls")).select("p_size", F.lit(0).alias("at"), F.concat(F.lit('"timepoint",'), F.array_join(F.transform("ls", lambda x: x["l"]), ",")).alias("line"))
    sinks.texts(heads.union(parts.select("p_size", F.lit(1), F.lit("0,1.5")).distinct()), path, "p_size", "at", "line")
    return tables.points_in_header(spark, path).drop("file")


@query("SELECT CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT) AS at, '/data/' || p_brand || '/' || p_partkey || '.tif' AS path FROM part")
def sc13_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), F.col("p_partkey"), F.lit(".tif"))
    return tables.path_list(spark, _part_files(spark, sf_dir, line, []))


@query("SELECT 'https://x.org/' || page_id AS path FROM pages WHERE page_id % 3 = 0")
def sk15_visible_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    sinks.visible_paths(table(spark, sf_dir, "pages").select(F.concat(F.lit("https://x.org/"), F.col("page_id")).alias("path"), (F.col("page_id") % 3 == 0).alias("visible")), path)
    return tables.path_list(spark, path).select("path")


@query("SELECT p_partkey, p_name || ' \"' || p_brand || '\", x' AS name, p_retailprice AS price FROM part")
def sk1_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in quotes, numbers plain, the heading a part of its own."""
    path = _place(spark)
    sinks.csv(table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(' "'), "p_brand", F.lit('", x')).alias("name"), F.col("p_retailprice").alias("price")), path)
    read = spark.read.schema("p_partkey string, name string, price string").option("escape", '"').csv(path)
    return read.where("p_partkey <> 'p_partkey'").select(F.col("p_partkey").cast("long").alias("p_partkey"), "name", F.col("price").cast("double").alias("price"))


@query("SELECT 's' || l_suppkey AS row, 'p' || l_partkey % 50 AS col, count(*) AS v FROM lineitem GROUP BY ALL HAVING count(*) >= 12")
def sk2_edges_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.operators.matrix import over_threshold

    path = _place(spark)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("s"), F.col("l_suppkey")).alias("row"), F.concat(F.lit("p"), F.col("l_partkey") % 50).alias("col")).agg(F.count(F.lit(1)).alias("v"))
    sinks.edges_csv(over_threshold(rows, 12), path)
    return spark.read.schema("row string, col string, v long").csv(path)


@query(FEATURES)
def sk3_parameter_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other writer of features: Parquet with the parameters beside the rows."""
    path = _place(spark)
    sinks.with_parameters(_features(spark, sf_dir), path, {"radius": 10.5, "min_angle": 1.57})
    read = spark.read.parquet(path).where((F.element_at("params", "radius") == "10.5") & (F.element_at("params", "min_angle") == "1.57"))
    return read.drop("params")


@query("SELECT CAST(i - 1 AS INT) AS place, name FROM (SELECT unnest(['m00', 'm01', 'm02', 'm10', 'm11', 'm12']) AS name, unnest(range(1, 7)) AS i)")
def sk4_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading of a table of maps."""
    path = _place(spark)
    maps = table(spark, sf_dir, "nation").select("n_nationkey", F.array(*[F.col("n_nationkey").cast("double") + i for i in range(6)]).alias("m"))
    sinks.matrices_csv(maps, path, "m", "n_nationkey", 2)
    head = tables.filled_lines(spark, path).where("at = 0").select(F.posexplode(quoted_labels("line")).alias("place", "name"))
    return head


@query("SELECT event_id, user_id, event_type FROM events")
def sk7_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a stream appends as files, a few input files at a time (SK7, ST3, ST6)."""
    path = _place(spark)
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").withColumn("part", F.col("user_id") % 4).write.partitionBy("part").parquet(f"{path}/in")
    source = streams.files(spark, f"{path}/in/*", "event_id long, user_id long, event_type string", per_trigger=2)
    streams.append_files(source, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long, user_id long, event_type string").option("header", True).csv(f"{path}/out")


@query("SELECT user_id, min(ts) AS first, max(ts) AS last FROM events GROUP BY user_id")
def st2_flushed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last time of each user from a stream of files whose batches each leave their own (ST1, ST2)."""
    path = _place(spark)
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    rows.withColumn("part", F.col("event_id") % 3).write.partitionBy("part").parquet(f"{path}/in")
    source = streams.files(spark, f"{path}/in/*", rows.schema, per_trigger=1)
    streams.upsert_into(source, f"{path}/out", "user_id", "ts", f"{path}/checkpoint").awaitTermination()
    return streams.upserted(spark, f"{path}/out", "user_id")


@query("SELECT vec_id FROM embeddings WHERE label >= 3 AND embedding[1] > 0")
def sk11_missing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that are neither done (label below 3) nor empty."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array(F.greatest(F.get("embedding", F.lit(0)), F.lit(0.0))).alias("tile"))
    return sinks.missing_tiles(rows, rows.where("label < 3"), ["vec_id"], "tile").select("vec_id")


@query("""
    WITH every AS (SELECT 'Key' || p_partkey % 300 AS key, p_partkey, p_size % 2 AS file, '@article{Key' || p_partkey % 300 || ',' || chr(10) || ' title={' || p_name || '}' || chr(10) || '}' AS body FROM part),
    within AS (SELECT key, file, arg_min(body, p_partkey) AS body FROM every GROUP BY key, file)
    SELECT key, arg_max(body, file) AS body FROM within GROUP BY key""")
def sk12_merged_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two bibliographies as one, the second file winning, and in a file the first entry; written under the first name that is free."""
    path = _place(spark)
    body = F.concat(F.lit("@article{Key"), F.col("p_partkey") % 300, F.lit(",\n title={"), "p_name", F.lit("}\n}"))
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("Key"), F.col("p_partkey") % 300).alias("key"), body.alias("body"), (F.col("p_size") % 2).alias("file"), "p_partkey")
    merged = sets.last_wins([parts.where("file = 0"), parts.where("file = 1")], "key", "body", "p_partkey")
    for _ in range(2):
        free = sinks.first_unused(spark, f"{path}/merged")
        sinks.bibliography_text(merged, free)
    return tables.bibliography(spark, f"{path}/merged-1").select("key", F.rtrim(F.regexp_replace("body", "\n+$", "")).alias("body"))


# Listings


def _camera_files(spark: SparkSession, sf_dir: str) -> str:
    """Files named by time point and camera, of 1 to 50 bytes."""
    path, t = _place(spark), F.format_string("%05d", "s_suppkey")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("camera"))
    own = F.concat(F.lit("TM"), t, F.lit("/SPM00_TM"), t, F.lit("_CM0"), F.col("camera"), F.lit("_CHN00.klb"))
    fused = F.concat(F.lit("TM"), t, F.lit("/TM"), t, F.lit("_CM00-CM0"), F.col("camera"), F.lit("_deconvolved.tif"))
    size = (F.col("s_suppkey") * 7 % 50 + 1).cast("int")
    sinks.files(rows.select(own.alias("name"), F.repeat(F.lit("x"), size).cast("binary").alias("content")).union(rows.select(fused, F.repeat(F.lit("y"), size).cast("binary"))), path)
    return path


FILES = """f AS (SELECT s_suppkey AS t, camera, s_suppkey * 7 % 50 + 1 AS length, 'SPM00_TM' || printf('%05d', s_suppkey) || '_CM0' || camera || '_CHN00.klb' AS name,
    'TM' || printf('%05d', s_suppkey) || '_CM00-CM0' || camera || '_deconvolved.tif' AS fused FROM supplier, range(2) c(camera))"""


@query(f"WITH {FILES} SELECT name, CAST(length AS BIGINT) AS length FROM f")
def sc14_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.listing(spark, _camera_files(spark, sf_dir), ".klb").select(_name().alias("name"), "length")


@query(f"WITH {FILES} SELECT name FROM f WHERE camera = 1 AND t % 10 IN (3, 7)")
def sc15_listing_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.listing(spark, _camera_files(spark, sf_dir), pattern=r".*/SPM00_TM\d+[37]_CM01_CHN00\.klb").select(_name().alias("name"))


@query(f"WITH {FILES} SELECT CAST(t AS INT) AS t, '0' || camera AS camera FROM f WHERE t BETWEEN 3 AND 900")
def sc16_time_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time point and camera from file names, a range of time points."""
    return tables.time_points(tables.listing(spark, _camera_files(spark, sf_dir)), first=3, last=900).select("t", "camera")


@query(f"WITH {FILES} SELECT CAST(t AS INT) AS t, 'CM00-CM0' || camera AS camera, fused AS name FROM f")
def sc17_fused_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.listing(spark, _camera_files(spark, sf_dir), ".tif")
    return tables.time_points(found, r"TM(\d+)_(CM0\d-CM0\d)_deconvolved\.tif$").select("t", "camera", _name().alias("name"))


@query(f"WITH {FILES} SELECT name FROM f WHERE length > 30")
def pf10_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.large_files(tables.listing(spark, _camera_files(spark, sf_dir)), ".klb", 30).select(_name().alias("name"))


@query(f"WITH {FILES} SELECT name, length = 22 AS expected FROM f")
def pf22_expected_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, odd = tables.expected_size(tables.listing(spark, _camera_files(spark, sf_dir), ".klb"), 22)
    return good.select(_name().alias("name"), F.lit(True).alias("expected")).union(odd.select(_name(), F.lit(False)))


@query(f"WITH {FILES} SELECT '0' || camera AS camera, list(name ORDER BY name) AS names FROM f GROUP BY camera")
def a35_by_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tables.by_camera(tables.time_points(tables.listing(spark, _camera_files(spark, sf_dir), ".klb")))
    return found.select("camera", F.transform("paths", lambda p: F.regexp_extract(p, r"([^/]+)$", 1)).alias("names"))


# Binary files


def _vector_files(spark: SparkSession, sf_dir: str, suffix: str, pack) -> str:
    """A file of each hundred vectors: pack(vectors as whole numbers, one in a row) gives its bytes."""
    path = _place(spark)

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("vec_id")["embedding"].map(lambda e: np.trunc(np.abs(np.asarray(e, float)) * 10000).astype(np.int64))
        return pd.DataFrame({"name": [f"{key[0]}.{suffix}"], "content": [pack(np.stack(list(rows)))]})

    groups = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / PER_FILE).alias("file")).groupBy("file")
    sinks.files(groups.applyInPandas(one, "name string, content binary"), path)
    return path


def _file() -> Column:
    return _name(r"(\d+)\.[a-z0-9]+$").cast("long").alias("file")


@query(f"WITH {PIXELS} SELECT file, CAST(y * 64 + x AS INT) AS at, CAST(v AS DOUBLE) AS v FROM px")
def sc18_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsigned 16-bit numbers after a header of eight bytes."""
    path = _vector_files(spark, sf_dir, "raw", lambda a: b"8 bytes!" + a.astype(">u2").tobytes())
    return binary.read_raw(spark, f"{path}/*.raw", header=8).select(_file(), F.posexplode("data").alias("at", "v"))


def _sections(a: np.ndarray) -> bytes:
    """Channels: the vectors, and what they have over 500, which may be negative."""
    return binary.section_file(np.stack([a, a - 500]))


@query(f"WITH {PIXELS}, low AS (SELECT file, least(0, min(v - 500)) AS least FROM px GROUP BY file) SELECT file, c AS channel, CAST(y * 64 + x AS INT) AS at, CAST(CASE WHEN c = 0 THEN v ELSE v - 500 - least END AS INT) AS v FROM px JOIN low USING (file), (VALUES (0), (1)) t(c)")
def sc19_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that are interleaved, each moved so that none of its values is negative."""
    path = _vector_files(spark, sf_dir, "dat", _sections)
    return binary.read_sections(spark, f"{path}/*.dat").select(_file(), "channel", F.posexplode("data").alias("at", "v"))


@query("SELECT vec_id // 100 AS file, 3555587570 AS magic, 2 AS channels, 64 AS width, CAST(count(*) AS INT) AS height FROM embeddings GROUP BY 1")
def sc20_section_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vector_files(spark, sf_dir, "dat", _sections)
    return binary.read_section_headers(spark, f"{path}/*.dat").select(_file(), "magic", "channels", "width", "height")


@query(f"WITH {PIXELS} SELECT file, CAST((63 - x) + 64 * y AS INT) AS at, CAST(v AS INT) AS v FROM px")
def sc24_filtered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections whose planes are mirrored as they are read."""
    path = _vector_files(spark, sf_dir, "dat", _sections)
    return binary.read_sections(spark, f"{path}/*.dat", 0, lambda plane: plane[:, ::-1]).select(_file(), F.posexplode("data").alias("at", "v"))


def _planes(a: np.ndarray) -> list[np.ndarray]:
    return [row.reshape(8, 8) for row in a]


@query("SELECT vec_id // 100 AS file, CAST(vec_id % 100 AS INT) AS slice, 8 AS width, 8 AS height, 16 AS bits, 8 AS compression, 3 AS rows_per_strip, 3 AS strips, TRUE AS big_endian FROM embeddings")
def sc21_directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directories of tagged image files: a slice for each vector, strips of three rows."""
    path = _vector_files(spark, sf_dir, "tif", lambda a: binary.tagged_image([p.astype(np.uint16) for p in _planes(a)], 8, True, 3))
    return binary.read_directories(spark, f"{path}/*.tif").select(_file(), "slice", "width", "height", "bits", "compression", "rows_per_strip", F.size("offsets").alias("strips"), "big_endian")


SLICES = f"WITH {PIXELS} SELECT file, CAST(y AS INT) AS slice, CAST(x AS INT) AS at, CAST({{v}} AS DOUBLE) AS v FROM px"


@query(SLICES.format(v="v % 251 // 4"))
def sc22_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in strips packed by runs."""
    path = _vector_files(spark, sf_dir, "tif", lambda a: binary.tagged_image([(p % 251 // 4).astype(np.uint8) for p in _planes(a)], 32773, False, 3))
    return binary.read_slices(spark, f"{path}/*.tif").select(_file(), "slice", F.posexplode("data").alias("at", "v"))


@query(SLICES.format(v="v / 8"))
def sc23_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume of 32-bit numbers, a row for each slice."""
    path = _vector_files(spark, sf_dir, "tif", lambda a: binary.tagged_image([(p / 8).astype(np.float32) for p in _planes(a)], 1, True))
    return binary.read_slices(spark, f"{path}/*.tif").select(_file(), "slice", F.posexplode("data").alias("at", "v"))


@query(f"WITH {PIXELS} SELECT file, CAST(y AS INT) AS slice, CAST(x // 8 AS BIGINT) AS y, CAST(x % 8 AS INT) AS at, CAST(v % 251 // 4 AS DOUBLE) AS v FROM px WHERE x // 8 BETWEEN 2 AND 6")
def sc22_strip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows 2 to 6 of every slice of files of packed strips, read strip by strip."""
    path = _vector_files(spark, sf_dir, "tif", lambda a: binary.tagged_image([(p % 251 // 4).astype(np.uint8) for p in _planes(a)], 32773, False, 3))
    return strips.read_rows(spark, f"{path}/*.tif", ys=(2, 6)).select(_file(), "slice", "y", F.posexplode("data").alias("at", "v"))


def _raw_paths(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """Raw files of the vectors and their heights: as many as there are files go through the driver."""
    path = _vector_files(spark, sf_dir, "raw", lambda a: a.astype(">u2").tobytes())
    return [(r["path"], r["length"] // 128) for r in tables.listing(spark, path, ".raw").orderBy("path").collect()]


def _by_height(spark: SparkSession, sf_dir: str, read) -> DataFrame:
    """read(paths, height) of the files of each height; only the last file is shorter."""
    found: dict[int, list[str]] = {}
    for path, height in _raw_paths(spark, sf_dir):
        found.setdefault(height, []).append(path.replace("file:/", "file:///") if path.startswith("file:/") and not path.startswith("file://") else path)
    return sets.all_of([read(paths, height) for height, paths in found.items()])


@query(f"WITH {PIXELS} SELECT file, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(v AS DOUBLE) AS v FROM px WHERE x BETWEEN 10 AND 29 AND y > 4")
def sc25_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some columns of raw images, read by seeking to each row; the filter on y keeps other rows from being read."""
    rows = _by_height(spark, sf_dir, lambda paths, height: regions.read_region(spark, paths, 64, height, x0=10, x1=29).where("y > 4"))
    return rows.select(_file(), "y", "x", F.posexplode("data").alias("i", "v")).select("file", "y", (F.col("x") + F.col("i")).alias("x"), "v")


@query(f"WITH {PIXELS} SELECT file, CAST(x // 24 AS INT) AS cx, CAST(y // 24 AS BIGINT) AS cy, CAST(y AS INT) AS y, list(CAST(v AS DOUBLE) ORDER BY x) AS data FROM px GROUP BY file, x // 24, y")
def sc29_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw images cut to cells of 24 as they are read."""
    return _by_height(spark, sf_dir, lambda paths, height: regions.read_cells(spark, paths, 64, height, 24)).select(_file(), "cx", F.col("cy").cast("long").alias("cy"), "y", "data")


@query(f"WITH {PIXELS} SELECT file, CAST(x // 24 AS INT) AS cx, CAST(y // 24 AS BIGINT) AS cy, CAST(y AS INT) AS y, list(CAST(v AS INT) ORDER BY x) AS data FROM px GROUP BY file, x // 24, y")
def sc27_cells_of_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes that are in memory already, cut to cells."""
    path = _vector_files(spark, sf_dir, "dat", lambda a: binary.section_file(a[None]))
    return binary.cells(binary.read_sections(spark, f"{path}/*.dat", 0), 24).select(_file(), "cx", F.col("cy").cast("long").alias("cy"), "y", "data")


@query(f"WITH {PIXELS} SELECT file, CAST(y * 64 + x AS INT) AS at, CAST(v - 300 AS INT) AS v FROM px")
def sc30_micrographs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed micrographs of both byte orders."""

    def pack(a: np.ndarray) -> bytes:
        order = "<" if len(a) % 2 else ">"
        head = bytearray(1024)
        struct.pack_into(f"{order}2i", head, 0, 64, len(a))
        return bz2.compress(bytes(head) + (a - 300).astype(f"{order}i2").tobytes())

    path = _vector_files(spark, sf_dir, "bz2", pack)
    return binary.read_compressed_micrograph(spark, f"{path}/*.bz2").select(_file(), F.posexplode("data").alias("at", "v"))


# JSON skeletons, sections of texts, kept results


def _skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file for each supplier: its lines are nodes and contacts; tags by its key."""
    path = _place(spark)
    node = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    nodes = F.concat(F.lit("["), node, F.lit(",null,0,"), F.col("l_quantity"), F.lit(","), F.col("l_tax"), F.lit(","), F.col("l_discount"), F.lit(",-1,5]"))
    contacts = F.concat(F.lit("["), node, F.lit(","), F.col("l_partkey"), F.lit(","), F.col("l_linenumber") % 3, F.lit("]"))
    joined = lambda c: F.array_join(F.collect_list(c), ",")
    soma = F.when(F.col("l_suppkey") % 4 == 0, "[1,2]").otherwise("[1]")
    tags = F.concat(F.lit('{"soma":'), soma, F.when(F.col("l_suppkey") % 5 == 0, "").otherwise(',"cut":[7]'), F.lit("}"))
    files = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(joined(nodes).alias("n"), joined(contacts).alias("c")).select(F.concat(F.col("l_suppkey"), F.lit(".json")).alias("name"), F.concat(F.lit("[["), "n", F.lit("],["), "c", F.lit("],"), tags, F.lit("]")).cast("binary").alias("content"))
    sinks.files(files, path)
    return tables.compact_skeletons(spark, f"{path}/*.json").withColumn("file", F.regexp_extract("file", r"(\d+)\.json$", 1).cast("long"))


@query("SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS node, CAST(NULL AS BIGINT) AS parent, l_quantity AS x, l_tax AS y, l_discount AS z FROM lineitem")
def sc31_skeleton_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.skeleton_nodes(_skeletons(spark, sf_dir))


@query("SELECT l_suppkey AS file, l_orderkey * 8 + l_linenumber AS node, l_partkey AS connector, CAST(l_linenumber % 3 AS INT) AS relation FROM lineitem WHERE l_linenumber % 3 < 2")
def pf13_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.connector_halves(_skeletons(spark, sf_dir))


@query("SELECT DISTINCT l_suppkey AS file, CASE WHEN l_suppkey % 4 = 0 THEN '2 soma tags' WHEN l_suppkey % 5 = 0 AND l_suppkey NOT IN (5, 15) THEN 'no split tag' ELSE 'accepted' END AS verdict FROM lineitem")
def pf14_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One soma and a split tag, or listed as unsplittable; the others with the reason."""
    good, bad = tables.accepted_skeletons(_skeletons(spark, sf_dir), "cut", [5, 15])
    return good.select("file", F.lit("accepted").alias("verdict")).union(bad.select("file", "reason"))


@query(r"""
    WITH l AS (SELECT p_size, p_partkey, CASE p_partkey % 7 WHEN 0 THEN '\begin{abstract}' WHEN 4 THEN '\end{abstract}' ELSE p_name END AS line FROM part),
    m AS (SELECT p_size, p_partkey, line, max(CASE WHEN line LIKE '\begin%' THEN p_partkey END) OVER w AS b, max(CASE WHEN line LIKE '\end%' THEN p_partkey END) OVER w AS e FROM l WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey))
    SELECT line, b IS NOT NULL AND (e IS NULL OR e < b) AS inside FROM m""")
def sc33_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines within a section of a text: it begins and ends at marks."""
    mark = F.when(F.col("p_partkey") % 7 == 0, "\\begin{abstract}").when(F.col("p_partkey") % 7 == 4, "\\end{abstract}").otherwise(F.col("p_name"))
    found = tables.sections(spark, _part_files(spark, sf_dir, mark, []), r"^\\begin", r"^\\end")
    return found.where("line <> ''").select("line", "inside")


@query("SELECT o_custkey, sum(o_totalprice) AS total, 1 AS computed FROM orders GROUP BY o_custkey")
def sc34_kept_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result kept by its parameters: computed the first time, read the second (SC34, N5)."""
    path, times = _place(spark), []

    def compute() -> DataFrame:
        times.append(1)
        return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))

    for _ in range(3):
        found = tables.parquet_by_parameters(spark, path, "totals", {"by": "customer", "least": 0}, compute)
    return found.withColumn("computed", F.lit(len(times)))


@query("""
    WITH v AS (SELECT vec_id, i - 1 AS place, CAST(embedding[i] AS DOUBLE) AS v, CAST(embedding[i - 1] AS DOUBLE) AS before, CAST(embedding[i + 1] AS DOUBLE) AS after FROM embeddings, range(2, 64) r(i))
    SELECT vec_id, place, v - (before + after) / 2 AS height, 1 AS computed FROM v WHERE v > before AND v > after""")
def n5_found_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each vector, its inner peaks: the first call computes all, the others find all and compute none."""
    folder, times = _place(spark), []
    items = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))

    def compute(missing: DataFrame) -> DataFrame:
        if not missing.isEmpty():
            times.append(1)
        near = lambda k: F.get("v", F.col("place") + k)
        long = missing.where(F.size("v") > 2).select("_item", "v", F.explode(F.sequence(F.lit(1), F.size("v") - 2)).alias("place"))
        return long.where((near(0) > near(-1)) & (near(0) > near(1))).select("_item", F.col("place").cast("long").alias("place"), (near(0) - (near(-1) + near(1)) / 2).alias("height"))

    for _ in range(2):
        found = kept.find_or_compute_each(items, ["vec_id"], folder, "peaks", {"reach": 1}, compute)
    return found.withColumn("computed", F.lit(len(times)))


@query("""
    WITH img AS (SELECT vec_id AS y, i - 1 AS x, 65535 - CAST(trunc(abs(CAST(embedding[i] AS DOUBLE)) * 65535) AS BIGINT) AS v FROM embeddings, range(1, 65) r(i)), c AS (SELECT x - 8 AS x, y, v FROM img WHERE x BETWEEN 8 AND 39)
    SELECT a.x, a.y, CAST(least(255, greatest(0, floor((coalesce(b.v, 0) - 1000) * 255 / 59000 + 0.5))) AS INT) AS v FROM c a LEFT JOIN c b ON b.x = a.x - 2 AND b.y = a.y - 1""")
def sk10_exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section cropped, inverted, moved by (2, 1), as bytes in blocks of 16."""
    path = _place(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("section"), F.col("vec_id").alias("y"), F.posexplode(F.transform("embedding", lambda v: (F.abs(v.cast("double")) * 65535).cast("int"))).alias("x", "v")).select("section", F.col("x").cast("long").alias("x"), "y", "v")
    maps = spark.createDataFrame([(0, [1.0, 0.0, 2.0, 0.0, 1.0, 1.0])], "section int, matrix array<double>")
    flows.exported(rows, maps, path, {"x": 8, "y": 0}, {"x": 39, "y": 1 << 40}, bits=8, display=(1000.0, 60000.0), inverted=True, block=16)
    pixels = spark.read.parquet(path).select("bx", "by", "width", F.posexplode("v").alias("at", "v"))
    return pixels.select((F.col("bx") * 16 + F.col("at") % F.col("width")).alias("x"), (F.col("by") * 16 + F.floor(F.col("at") / F.col("width"))).alias("y"), F.col("v").cast("int").alias("v"))
