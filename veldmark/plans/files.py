"""Round trips through files in the shared folder: what a writer leaves, a reader finds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.plans.matrices import CELLS, cells
from veldmark.plans.registry import query
from veldmark.session import shared_folder, table
from veldmark.sources import n5, sinks, tables


def _place(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/veldmark-files-{uuid.uuid4().hex}"


@query(f"WITH {CELLS} SELECT CAST(dense_rank() OVER (ORDER BY row_idx) - 1 AS INT) AS row_idx, row, CAST(col_idx AS INT) AS col_idx, col, CAST(v AS INT) AS v FROM cells")
def sc2_matrix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled matrix as text, with blanks after the commas, and read again."""
    found, path = cells(spark, sf_dir), _place(spark)
    ordered = F.array_sort(F.collect_list(F.struct("col_idx", "v")))
    rows = found.groupBy("row_idx", "row").agg(F.concat(F.lit('"'), F.first("row"), F.lit('", '), F.array_join(F.transform(ordered, lambda c: c["v"].cast("string")), ", ")).alias("value"))
    names = found.select("col_idx", "col").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "col"))), lambda c: F.concat(F.lit('"'), c["col"], F.lit('"'))), ", ").alias("names"))
    head = names.select(F.lit(-1).alias("row_idx"), F.concat(F.lit('"", '), "names").alias("value"))
    head.union(rows.select("row_idx", "value")).coalesce(1).sortWithinPartitions("row_idx").select("value").write.text(path)
    return tables.labelled_matrix(spark, path).drop("file").select("row_idx", "row", F.col("col_idx").cast("int").alias("col_idx"), "col", "v")


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def sk9_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image chunks by partition folders."""
    path = _place(spark)
    sinks.chunks(table(spark, sf_dir, "embeddings"), path, ["label"], level=4)
    return spark.read.parquet(path).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS at, [CAST(c_custkey AS DOUBLE), 0, c_acctbal, 0, 1, 2] AS matrix FROM customer")
def sc8_matrices_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's map, in as many parts as the table needs."""
    path = _place(spark)
    cells = [F.col(c).cast("double") if isinstance(c, str) else F.lit(float(c)) for c in ("c_custkey", 0, "c_acctbal", 0, 1, 2)]
    sinks.matrices_csv(table(spark, sf_dir, "customer").select("c_custkey", F.array(*cells).alias("m")), path, "m", "c_custkey", 2, one_file=False)
    return tables.matrices(spark, path, parts=True).select("at", "matrix")


@query("SELECT row_number() OVER (PARTITION BY i ORDER BY vec_id) - 1 AS t, i - 1 AS peak, CAST(i AS DOUBLE) AS x, embedding[i] AS f FROM embeddings, range(1, 65) r(i)")
def sc9_series_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All elements of every vector, in as many parts as the table needs."""
    path = _place(spark)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.posexplode("embedding").alias("peak", "f"))
    sinks.series_csv(rows.withColumns({"x": F.col("peak") + 1.0, "y": F.lit(2.0), "z": F.lit(3.5)}), path, "t", "f", one_file=False)
    return tables.fluorescence(spark, path, parts=True).select("t", F.col("peak").cast("long").alias("peak"), "x", "f")


@query("SELECT event_id, event_type, value FROM events")
def sk8_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    sinks.json_rows(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path)
    return spark.read.schema("event_id long, event_type string, value double").json(path)


@query("SELECT 'Key' || p_partkey AS key, '@article{Key' || p_partkey || ',' || chr(10) || ' title={' || p_name || '}' || chr(10) || '}' AS body FROM part")
def sc32_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark)
    body = F.concat(F.lit("@article{Key"), F.col("p_partkey"), F.lit(",\n title={"), "p_name", F.lit("}\n}"))
    sinks.bibliography_text(table(spark, sf_dir, "part").select(F.concat(F.lit("Key"), F.col("p_partkey")).alias("key"), body.alias("body")), path, one_file=False)
    return tables.bibliography(spark, path).select("key", F.rtrim(F.regexp_replace("body", "\n+$", "")).alias("body"))


@query("SELECT i - 1 AS x, vec_id AS y, CAST(trunc(abs(CAST(embedding[i] AS DOUBLE)) * 65535) AS DOUBLE) AS v FROM embeddings, range(1, 65) r(i) WHERE i - 1 BETWEEN 8 AND 39")
def sc28_n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane of all vectors as an N5 data set of blocks of 16 x 128, and its columns 8 to 39 read from the blocks that have them."""
    path, vectors = _place(spark), table(spark, sf_dir, "embeddings")
    height = (vectors.agg(F.max("vec_id")).first()[0] or 0) + 1
    pixels = vectors.select(F.posexplode(F.transform("embedding", lambda v: (F.abs(v.cast("double")) * 65535).cast("int"))).alias("x", "v"), F.col("vec_id").alias("y"))
    n5.write_pixels(pixels, path, ["x", "y"], "v", [64, height], [16, 128])
    return n5.read_pixels(spark, path, ["x", "y"], "v", [8, 0], [39, height - 1])
