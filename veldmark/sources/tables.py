"""Text tables with positions that matter, as DataFrames."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.functions.text import quoted_labels

# File names of time points and cameras, and columns of skeletons and contacts.
TIME_POINTS = r"TM(\d+)/SPM00_TM\d+_CM(\d+)_CHN0[01]\.klb$"
SKELETONS = "skeleton_id long, treenode_id long, parent_id long, x double, y double, z double"
SYNAPSES = "pre_skeleton_id long, pre_treenode_id long, post_skeleton_id long, post_treenode_id long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, at (from 0) and line of each line of small text files; each file is read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))


def filled_lines(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """The same without blank lines, numbered anew. With parts, the files one after the other, by name, are one table, and file is the path."""
    found = lines(spark, path).where(F.trim("line") != "")
    own = found.withColumn("at", F.row_number().over(W.partitionBy("file").orderBy("at")) - 1)
    if not parts:
        return own
    before = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))  # a row per file
    starts = found.groupBy("file").agg(F.count(F.lit(1)).alias("n")).select("file", F.coalesce(before, F.lit(0)).alias("start"))
    return own.join(F.broadcast(starts), "file").select(F.lit(path).alias("file"), (F.col("at") + F.col("start")).alias("at"), "line")


def labelled_matrix(spark: SparkSession, path: str, separator: str = ",", kind: str = "int") -> DataFrame:
    """file, row_idx, row, col_idx, col, v. The first line has quoted column labels after an empty one, the others a quoted label and numbers.

    Labels may hold separators; names may repeat, so ordinals go along.
    """
    found = filled_lines(spark, path)
    heads = found.where("at = 0").select("file", F.posexplode(F.slice(quoted_labels("line"), 2, 1 << 20)).alias("col_idx", "col"))
    quote = F.length("line") - F.instr(F.reverse("line"), '"') + 2
    body = found.where("at > 0").select("file", (F.col("at") - 1).alias("row_idx"), F.get(quoted_labels("line"), F.lit(0)).alias("row"), F.substring(F.col("line"), quote, F.length("line")).alias("rest"))
    cells = body.select("file", "row_idx", "row", F.posexplode(F.slice(F.split("rest", _literal(separator)), 2, 1 << 20)).alias("col_idx", "text"))
    return cells.join(heads, ["file", "col_idx"]).select("file", "row_idx", "row", "col_idx", "col", F.trim("text").cast(kind).alias("v"))


def _literal(text: str) -> str:
    return "".join(f"[{c}]" if c != "\\" else "\\\\" for c in text)


def skeletons(spark: SparkSession, path: str) -> DataFrame:
    """Tree nodes; the root's parent is null."""
    return spark.read.schema(SKELETONS).option("header", True).option("ignoreLeadingWhiteSpace", True).csv(path)


def synapses(spark: SparkSession, path: str) -> DataFrame:
    """Contacts; a field that is no integer fails the read."""
    return spark.read.schema(SYNAPSES).option("header", True).option("mode", "FAILFAST").option("ignoreLeadingWhiteSpace", True).csv(path)


def with_parameters(spark: SparkSession, path: str, expected: dict[str, str] | None = None, epsilon: float = 1e-5) -> DataFrame:
    """Tables under a preamble of two lines, names and values of parameters: file, params map, at, row map<name, double>.

    With expected, only files whose parameters agree: numbers (and lists of them)
    within epsilon, others as text; a name that isn't expected disagrees. A file
    without a header has no rows.
    """
    found = filled_lines(spark, path)
    fields = lambda c: F.transform(F.split(c, r",(?![^\[]*\])"), lambda t: F.trim(t, F.lit(' "')))
    at = lambda n, name: found.where(F.col("at") == n).select("file", fields(F.col("line")).alias(name))
    params = at(0, "names").join(at(1, "values"), "file").select("file", F.map_from_arrays("names", "values").alias("params"))
    if expected is not None:
        params = params.where(parameters_agree(F.col("params"), expected, epsilon))
    heads = at(2, "header")
    body = found.where("at > 2").select("file", (F.col("at") - 3).alias("at"), F.transform(fields(F.col("line")), lambda t: t.cast("double")).alias("row"))
    return params.join(heads, "file").join(body, "file").select("file", "params", "at", F.map_from_arrays("header", "row").alias("row"))


def parameters_agree(params: Column, expected: dict[str, str], epsilon: float) -> Column:
    """All names known, and all values equal: numbers within epsilon, lists element by element, else as text."""
    known = F.create_map(*[F.lit(x) for pair in expected.items() for x in map(str, pair)]) if expected else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    numbers = lambda t: F.split(F.regexp_replace(t, r"[\[\]\s]", ""), ",")

    def close(x, y):
        a, b = x.try_cast("double"), y.try_cast("double")
        return F.coalesce(F.abs(a - b) <= epsilon, x == y, F.lit(False))

    def same(name, value):
        other = F.element_at(known, name)
        a, b = numbers(value), numbers(F.coalesce(other, F.lit("")))
        return other.isNotNull() & (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, close), lambda ok: ok)

    return F.forall(F.map_entries(params), lambda e: same(e["key"], e["value"]))


def matrices(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """at and matrix (array<double>) of a table with one header line; blank rows don't count. With parts, the files are one table."""
    found = filled_lines(spark, path, parts).where("at > 0")
    return found.select("file", (F.col("at") - 1).alias("at"), F.transform(F.split("line", ","), lambda t: F.trim(t).cast("double")).alias("matrix"))


def fluorescence(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """file, t, peak, x, y, z, f (float): the header of the column of each peak is x::y::z, the first column the time point. With parts, the files are one table."""
    found = filled_lines(spark, path, parts)
    heads = found.where("at = 0").select("file", F.posexplode(F.slice(F.split("line", ","), 2, 1 << 20)).alias("peak", "label"))
    part = lambda i: F.trim(F.get(F.split(F.trim("label", F.lit(' "')), "::"), F.lit(i))).cast("double")
    peaks = heads.select("file", "peak", part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))
    body = found.where("at > 0").select("file", (F.col("at") - 1).alias("t"), F.posexplode(F.slice(F.split("line", ","), 2, 1 << 20)).alias("peak", "text"))
    return body.join(peaks, ["file", "peak"]).select("file", "t", "peak", "x", "y", "z", F.trim("text").cast("float").alias("f"))


def table_after(spark: SparkSession, path: str, header_lines: int = 1) -> DataFrame:
    """file, at and fields (array<string>) of the rows after so many header lines; quotes around fields go."""
    found = filled_lines(spark, path).where(F.col("at") >= header_lines)
    return found.select("file", (F.col("at") - header_lines).alias("at"), F.transform(F.split("line", r",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda t: F.trim(t, F.lit(' "'))).alias("fields"))


def points(spark: SparkSession, path: str, first: int = 1, dimensions: int = 3, header_lines: int = 1) -> DataFrame:
    """Points from consecutive columns of a table, from the column first on (0: the index stays)."""
    axes = ("x", "y", "z")[:dimensions]
    rows = table_after(spark, path, header_lines)
    return rows.select("file", F.col("at").alias("pid"), *[F.get("fields", F.lit(first + i)).cast("double").alias(a) for i, a in enumerate(axes)])


def points_in_header(spark: SparkSession, path: str, skip: int = 1) -> DataFrame:
    """Points that are the column names x::y::z of a table."""
    heads = filled_lines(spark, path).where("at = 0").select("file", F.posexplode(F.slice(F.split("line", ","), skip + 1, 1 << 20)).alias("pid", "label"))
    part = lambda i: F.trim(F.get(F.split(F.trim("label", F.lit(' "')), "::"), F.lit(i))).cast("double")
    return heads.select("file", "pid", part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line."""
    return filled_lines(spark, path).select("at", F.col("line").alias("path"))


def compact_skeletons(spark: SparkSession, path: str) -> DataFrame:
    """JSON files [nodes, connectors, tags]: file, nodes, connectors, tags."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.select("file", *parsed_skeleton(F.col("value")))


def parsed_skeleton(text: Column) -> list[Column]:
    part = lambda i: F.get_json_object(text, f"$[{i}]")
    node = "array<array<double>>"
    return [F.from_json(part(0), node).alias("nodes"), F.from_json(part(1), "array<array<long>>").alias("connectors"), F.from_json(part(2), "map<string,array<long>>").alias("tags")]


def skeleton_nodes(compact: DataFrame) -> DataFrame:
    """file, node, parent, x, y, z: fields 0, 1, 3, 4 and 5 of each node."""
    n = compact.select("file", F.explode("nodes").alias("n"))
    get = lambda i: F.get("n", F.lit(i))
    return n.select("file", get(0).cast("long").alias("node"), get(1).cast("long").alias("parent"), get(3).alias("x"), get(4).alias("y"), get(5).alias("z"))


def connector_halves(compact: DataFrame) -> DataFrame:
    """file, node, connector, relation: 0 pre, 1 post; other relations don't count."""
    c = compact.select("file", F.explode("connectors").alias("c"))
    get = lambda i: F.get("c", F.lit(i))
    return c.select("file", get(0).alias("node"), get(1).alias("connector"), get(2).cast("int").alias("relation")).where(F.col("relation").isin(0, 1))


def accepted_skeletons(compact: DataFrame, split_tag: str, unsplittable: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Skeletons with one soma and a split tag (or listed as unsplittable), and the rejected with the reason."""
    somas = F.size(F.coalesce(F.element_at("tags", "soma"), F.array().cast("array<long>")))
    splits = F.size(F.coalesce(F.element_at("tags", split_tag), F.array().cast("array<long>")))
    free = F.col("file").isin(list(unsplittable)) if unsplittable else F.lit(False)
    reason = F.when(somas != 1, F.concat(somas.cast("string"), F.lit(" soma tags"))).when((splits == 0) & ~free, F.lit("no split tag"))
    judged = compact.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").select("file", "reason")


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """file, key, body, at: an entry begins at @ in the first column; its key is between { and the last comma of that line."""
    found = lines(spark, path)
    entry = F.sum(F.startswith("line", F.lit("@")).cast("int")).over(W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    rows = found.withColumn("entry", entry).where("entry > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda r: r["line"]), "\n")
    grouped = rows.groupBy("file", "entry").agg(body.alias("body"), F.min("at").alias("at"))
    head = F.substring_index("body", "\n", 1)
    return grouped.select("file", F.trim(F.regexp_extract(head, r"\{(.*),[^,]*$", 1)).alias("key"), "body", "at").groupBy("file", "key").agg(F.min_by("body", "at").alias("body"), F.min("at").alias("at"))


def sections(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """file, at, line, inside: whether a line is between one that matches begin and one that matches end."""
    found = lines(spark, path)
    w = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    starts, ends = F.max(F.when(F.rlike("line", F.lit(begin)), F.col("at"))).over(w), F.max(F.when(F.rlike("line", F.lit(end)), F.col("at"))).over(w)
    return found.select("file", "at", "line", (starts.isNotNull() & (ends.isNull() | (ends < starts))).alias("inside"))


def listing(spark: SparkSession, folder: str, suffix: str = "", pattern: str | None = None, size: int | None = None) -> DataFrame:
    """path and length of all files below a folder, by suffix, by a pattern for the whole path, and by exact size; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (reader.option("pathGlobFilter", f"*{suffix}") if suffix else reader).load(folder).select("path", "length")
    if pattern is not None:
        found = found.where(F.rlike("path", F.lit(f"^(?:{pattern})$")))
    return found if size is None else found.where(F.col("length") == size)


def time_points(found: DataFrame, pattern: str = TIME_POINTS, first: int | None = None, last: int | None = None) -> DataFrame:
    """path, t and camera of the files of a listing that match; a range of t prunes."""
    rows = found.where(F.rlike("path", F.lit(pattern))).select("path", F.regexp_extract("path", pattern, 1).cast("int").alias("t"), F.regexp_extract("path", pattern, 2).alias("camera"))
    return rows.where((F.col("t") >= first if first is not None else F.lit(True)) & (F.col("t") <= last if last is not None else F.lit(True)))


def by_camera(rows: DataFrame) -> DataFrame:
    """Sorted paths of each camera."""
    return rows.groupBy("camera").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def expected_size(found: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Files of the expected size, and the others."""
    return found.where(F.col("length") == size), found.where(F.col("length") != size)


def parquet_by_parameters(spark: SparkSession, folder: str, name: str, params: dict, compute) -> DataFrame:
    """The result of compute(), kept below a folder by a digest of its parameters: found there or computed and written."""
    import hashlib
    import json

    key = hashlib.sha256(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = os.path.join(folder, f"{name}-{key}")
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
