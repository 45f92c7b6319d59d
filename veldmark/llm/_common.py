"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows and bytes that are turned into Python objects together. Arrow batches themselves are bounded in bytes by Spark.
PART_ROWS, PART_BYTES = 512, 4 << 20
#: Bytes of an Arrow batch of a job that runs here.
BATCH_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only a local master, as in tests, gets a temporary folder where the setting is
    missing: on a cluster each executor would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='veldmark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/veldmark-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within use Arrow batches of BATCH_BYTES: several tasks of an executor hold some copies of a batch each. The session's own setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it: lineage ends here."""
    path = f"{folder}/{name}"
    with small_batches(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that gathers neither side in the driver, however small Spark takes it to be: loops of joins would leave a broadcast each there."""
    return left.join(right.hint("merge"), on, how)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def parts(batch: pa.RecordBatch, rows: int = PART_ROWS, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and about so many bytes each, one row at least."""
    lengths = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type)]
    total = np.cumsum(sum(lengths, np.zeros(batch.num_rows, np.int64)))
    start = 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        stop = min(start + rows, max(start + 1, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(start, stop - start)
        start = stop


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """mapInArrow with column lists. make() runs once in each task and returns batch -> columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch):
                out = work({name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    return df.mapInArrow(run, kind)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with columns c0, c1, ..., so that no name of theirs meets one of ours."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def at(docs: DataFrame, column: str) -> str:
    """The name that a column of docs has in numbered(docs)."""
    return f"c{docs.columns.index(column)}"


def add_columns(df: DataFrame, reads: dict[str, str], make: Callable[[], Callable[[dict], dict]], added: str, drops: tuple[str, ...] = ()) -> DataFrame:
    """df without drops, its columns passed on as they are, and the added ones. make() gives batch -> added columns; reads names the lists that it gets."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(added)
    target, passed = to_arrow_schema(new), [f.name for f in df.schema if f.name not in drops]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in parts(batch):
                place = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                out = work({key: place[name].to_pylist() for key, name in reads.items()})
                yield pa.RecordBatch.from_arrays([*(place[name] for name in passed), *(pa.array(out[f.name], type=f.type) for f in target)], names=[*passed, *target.names])

    return df.mapInArrow(run, StructType([*(f for f in df.schema if f.name in passed), *new]))


def renamed(df: DataFrame, docs: DataFrame, added: list[str]) -> DataFrame:
    """df, whose columns are those of docs and then the added ones, under their names; an added name that docs has gets an underscore."""
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in added:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return df.toDF(*docs.columns, *names)


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 4):
    """crc32 of the id as text, modulo folds, is fold; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def kept_rows(docs: DataFrame, kept: DataFrame, id_col: str, digest) -> DataFrame:
    """The rows of docs that are in kept (columns id, digest, reps): of rows equal in both, reps stay.

    Join and window have the same keys, so the rows' texts are shuffled once.
    """
    keys = ["key", "none", "digest"]
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    wanted = kept.select(text(F.col("id")).alias("key"), F.col("id").isNull().alias("none"), "digest", "reps")
    own = F.col(f"`{id_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text(own).alias("key"), own.isNull().alias("none"), digest.alias("digest"))
    rows = joined(rows, wanted, keys)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.lit(1))))
    return ranked.where("rank <= reps").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def slices(texts: list[str], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Index ranges whose texts have about limit characters together, one text at least."""
    start, total = 0, 0
    for i, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield start, i
            start, total = i, 0
        total += len(text)
    if start < len(texts):
        yield start, len(texts)
