"""Writers. Spark's commit protocol makes each of them all or nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.functions.text import coordinates_label

#: Rows of a file of a table that is left in parts: readers of positions hold a file as a whole.
PART_ROWS = 20_000


def csv(df: DataFrame, path: str, header: bool = True, one_file: bool = False) -> None:
    """Comma-separated, text in quotes, numbers plain.

    The heading is a part of its own before the others, so the parts one after the
    other are the table; one_file makes one part of them, for small tables.
    """
    cell = lambda f: F.col(f"`{f.name}`")
    quoted = [F.concat(F.lit('"'), F.replace(cell(f), F.lit('"'), F.lit('""')), F.lit('"')) if f.dataType.simpleString() == "string" else cell(f).cast("string") for f in df.schema]
    line = F.array_join(F.array(*[F.coalesce(c, F.lit("")) for c in quoted]), ",")
    rows = df.select(line.alias("value"), F.monotonically_increasing_id().alias("at"))
    if header:
        head = df.sparkSession.createDataFrame([(",".join(f'"{c}"' for c in df.columns), -1)], "value string, at long")
        rows = head.coalesce(1).union(rows)
    _text(rows.coalesce(1).sortWithinPartitions("at") if one_file else rows, path, one_file)


def _text(rows: DataFrame, path: str, one_file: bool) -> None:
    writer = rows.select("value").write.mode("overwrite")
    (writer if one_file else writer.option("maxRecordsPerFile", PART_ROWS)).text(path)


def edges_csv(edges: DataFrame, path: str) -> None:
    """Thresholded edges, both names in quotes, no header: the parts one after the other are the table, so no task reads all edges."""
    csv(edges.select("row", "col", "v"), path, header=False)


def with_parameters(df: DataFrame, path: str, params: dict) -> None:
    """Parquet with the parameters that made it as a map column."""
    pairs = [F.lit(str(x)) for kv in params.items() for x in kv]
    df.withColumn("params", F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).write.mode("overwrite").parquet(path)


def files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """A file for each row (a path below the folder, and bytes), written by the tasks; how many. Each comes under another name first, so a task that runs again replaces whole files."""
    import uuid

    import pyarrow as pa

    def run(batches):
        import pyarrow.fs

        system, base = pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder else (pyarrow.fs.LocalFileSystem(), folder)
        for batch in batches:
            for path, data in zip(batch.column(name), batch.column(content), strict=True):
                target = f"{base}/{path.as_py()}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                held = f"{target}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(held) as out:
                    out.write(data.as_buffer() or b"")
                system.move(held, target)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    # several tasks of an executor hold some copies of a batch each: 1 MB or one file, while this job runs
    spark, size = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, str(1 << 20))
    try:
        return df.select(name, content).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
    finally:
        spark.conf.set(size, before)


def texts(lines: DataFrame, folder: str, by: str, at: str, line: str) -> None:
    """A text file in a folder of its own for each by, with its lines in order. A file's lines fit in a task, as they do for its readers."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(line).alias("line")))), lambda r: r["line"])
    lines.groupBy(by).agg(F.array_join(ordered, "\n").alias("value")).write.mode("overwrite").partitionBy(by).text(folder)


def parameter_csv(df: DataFrame, folder: str, by: str, order: str, params: dict, columns: list[str] | None = None) -> None:
    """A table for each by, under a preamble of two lines: names of parameters in quotes, and their values. A parameter is a value, a list, or a Column of by; without columns there is no heading."""
    plain = lambda v: F.lit(str(v)) if not isinstance(v, str) else F.lit(f'"{v}"')
    value = lambda v: v.cast("string") if isinstance(v, Column) else F.lit(f'"{list(v)}"') if isinstance(v, list | tuple) else plain(v)
    quoted = lambda names: ",".join(f'"{n}"' for n in names)
    keys = df.select(by).distinct()
    own = [c for c in df.columns if c != by] if columns is None else columns
    heads = [F.struct(F.lit(-3).cast("double").alias("at"), F.lit(quoted(params)).alias("line")), F.struct(F.lit(-2).cast("double").alias("at"), F.concat_ws(",", *map(value, params.values())).alias("line"))]
    if own:
        heads.append(F.struct(F.lit(-1).cast("double").alias("at"), F.lit(quoted(own)).alias("line")))
    preamble = keys.select(by, F.explode(F.array(*heads)).alias("h")).select(by, "h.at", "h.line")
    rows = df.select(by, F.col(order).cast("double").alias("at"), F.concat_ws(",", *[F.col(c).cast("string") for c in own]).alias("line")) if own else preamble.limit(0)
    texts(preamble.union(rows), folder, by, "at", "line")


def matrices_csv(df: DataFrame, path: str, matrix: str, order: str, d: int, one_file: bool = True) -> None:
    """Maps in row order under the heading m00, m01, ..."""
    cells = [F.get(matrix, F.lit(i * (d + 1) + j)).alias(f"m{i}{j}") for i in range(d) for j in range(d + 1)]
    csv(df.orderBy(order).select(*cells), path, one_file=one_file)


def series_csv(df: DataFrame, path: str, time: str, value: str, one_file: bool = True) -> None:
    """Wide series: a row per time point, a column x::y::z per peak. The peaks' names, as many as the table is wide, go through the driver."""
    labelled = df.withColumn("_label", coordinates_label("x", "y", "z"))
    names = [r["_label"] for r in labelled.groupBy("_label").agg(F.min("peak").alias("p")).orderBy("p").select("_label").collect()]
    wide = labelled.groupBy(time).pivot("_label", names).agg(F.first(value)).orderBy(time)
    csv(wide.select(F.col(time).alias("timepoint"), *[F.col(f"`{n}`") for n in names]), path, one_file=one_file)


def dense_csvs(counts: DataFrame, path: str, ids: list, parts: tuple[str, str] = ("axon", "dendrite")) -> None:
    """Four all-to-all matrices over the sorted ids, by the parts on both sides, absent pairs 0: rows and columns of every id."""
    frame = counts.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"pre {dict(counts.dtypes)['pre']}")
    for a in parts:
        for b in parts:
            own = counts.where((F.col("pre_part") == a) & (F.col("post_part") == b)).groupBy("pre").pivot("post", sorted(ids)).agg(F.sum("n"))
            csv(frame.join(own, "pre", "left").na.fill(0).orderBy("pre"), f"{path}/{a}-{b}", one_file=True)


def split_graph_csvs(counts: DataFrame, inputs: DataFrame, names: DataFrame, path: str, parts: tuple[str, str] = ("axon", "dendrite")) -> None:
    """The six tables of a split graph: the four of dense_csvs, input_counts and skeleton_id_vs_neuron_name.

    names (skeleton_id, neuron_name) has the ids to include. inputs (skeleton_id,
    part, n) counts all their inputs, also those from outside; absent ones are 0.
    """
    ids = [r["skeleton_id"] for r in names.select("skeleton_id").distinct().collect()]
    dense_csvs(counts, path, ids, parts)
    own = inputs.groupBy("skeleton_id").pivot("part", list(parts)).agg(F.sum("n"))
    known = names.select("skeleton_id").distinct().join(own, "skeleton_id", "left").na.fill(0, list(parts)).orderBy("skeleton_id")
    csv(known.select("skeleton_id", *[F.col(p).alias(f"{p}_inputs") for p in parts]), f"{path}/input_counts", one_file=True)
    csv(names.select("skeleton_id", "neuron_name").orderBy("skeleton_id"), f"{path}/skeleton_id_vs_neuron_name", one_file=True)


def json_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def chunks(df: DataFrame, path: str, by: list[str], level: int | None = None) -> None:
    """Image chunks as Parquet by partition folders; a compression level means gzip, none means snappy."""
    writer = df.write.mode("overwrite").partitionBy(*by)
    (writer.option("compression", "gzip") if level else writer.option("compression", "snappy")).parquet(path)


def missing_tiles(tiles: DataFrame, done: DataFrame, key: list[str], value: str) -> DataFrame:
    """Tiles that are neither done nor empty."""
    return tiles.join(done.select(*key), key, "left_anti").where(F.exists(value, lambda v: v != 0))


def visible_paths(df: DataFrame, path: str) -> None:
    df.where("visible").select("path").write.mode("overwrite").text(path)


def bibliography_text(entries: DataFrame, path: str, one_file: bool = True) -> None:
    """Entries (key, body) by key, as text; in parts, an entry is in one of them."""
    rows = entries.orderBy("key").select(F.col("body").alias("value"))
    _text(rows.coalesce(1) if one_file else rows, path, one_file)


def first_unused(spark, path: str) -> str:
    """path, or path-1, path-2, ... : the first that isn't there."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    n = 0
    while True:
        name = f"{path}-{n}" if n else path
        at = fs_path(name)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return name
        n += 1


def pixels(matrix: DataFrame) -> DataFrame:
    """A matrix as pixels x, y, v, the data behind a rendered image."""
    return matrix.select(F.col("col_idx").alias("x"), F.col("row_idx").alias("y"), F.col("v").cast("int").alias("v"))
