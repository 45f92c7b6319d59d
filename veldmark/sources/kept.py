"""Results kept by their parameters and inputs: found, or computed and published whole."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What a result was made of and its schema, beside its files; Spark's readers pass over names that begin so.
RECORD = "_record.json"


class Folder:
    """Files of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        conf, gateway = spark._jsc.hadoopConfiguration(), spark._sc._gateway
        at = self.at("")
        self.system = at.getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.makeQualified(at).toUri(), conf)
        self.plain = gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def read(self, name: str) -> dict | None:
        if not self.system.exists(self.at(name)):
            return None
        stream = self.system.open(self.at(name))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, record: dict) -> None:
        stream = self.system.create(self.at(name), False)
        try:
            stream.write(bytearray(json.dumps(record, sort_keys=True, default=str).encode()))
        finally:
            stream.close()

    def publish(self, held: str, name: str) -> bool:
        """held gets a name that nothing has; False if something has it by now."""
        try:
            self.context.rename(self.at(held), self.at(name), self.plain)
        except Exception:
            if not self.system.exists(self.at(name)):
                raise
            return False
        return True

    def remove(self, name: str) -> None:
        self.system.delete(self.at(name), True)

    def names(self) -> list[str]:
        if not self.system.exists(self.at("")):
            return []
        return sorted(s.getPath().getName() for s in self.system.listStatus(self.at("")))


def state(spark: SparkSession, paths: list[str]) -> list[list]:
    """Path, bytes and time of change of each file below some paths: what tells without a job whether an input has changed."""
    out = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(at, True)
        while files.hasNext():
            f = files.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def digest(parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


def find_or_compute(spark: SparkSession, folder: str, name: str, params: dict, compute: Callable[[], DataFrame], inputs: list[str] | None = None) -> DataFrame:
    """The result of compute(), kept in a folder under a digest of its name, parameters and the state of its input files.

    Where it is there, no job runs. Otherwise it is written beside and renamed:
    a reader sees all of it or nothing, and a writer that fails leaves only a
    folder _held-. Of two writers at once the later one drops its result and reads the other's
    (where renames are atomic, as on HDFS).
    """
    made_of = {"name": name, "params": params, "inputs": state(spark, inputs or [])}
    place, key = Folder(spark, folder), f"{name}-{digest(made_of)}"

    def found() -> DataFrame | None:
        record = place.read(f"{key}/{RECORD}")
        return None if record is None else spark.read.schema(StructType.fromJson(record["schema"])).parquet(f"{place.path}/{key}")

    known = found()
    if known is not None:
        return known
    held = f"_held-{uuid.uuid4().hex}"
    result = compute()
    result.write.parquet(f"{place.path}/{held}")
    place.write(f"{held}/{RECORD}", {**made_of, "schema": result.schema.jsonValue()})
    if not place.publish(held, key):
        place.remove(held)
    return found()


def find_or_compute_each(items: DataFrame, item: list[str], folder: str, name: str, params: dict, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """compute() of each item, computed only for items that no earlier call with these parameters had: the rows of compute(), and the item columns first.

    items has the columns that tell an item apart and what is computed from; two
    items are the same if all their columns are equal, and rows that repeat
    count once. compute gets items with a further column _item and gives any number
    of rows for each, none too, with its _item. What is new is published as one
    batch, a folder with the items and their rows, by a rename, so calls at the
    same time don't meet; where both had an item, the batch whose name is less
    gives its rows. A call that has everything only reads.
    """
    spark = items.sparkSession
    place = Folder(spark, f"{folder.rstrip('/')}/{name}-{digest({'name': name, 'params': params, 'item': item, 'columns': items.dtypes})}")
    own = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(items.columns)]), {"ignoreNullFields": "false"}), 256)
    asked = items.withColumn("_item", own).dropDuplicates(["_item"])

    def batches() -> tuple[DataFrame, list[str]]:
        names = [n for n in place.names() if not n.startswith("_")]
        paths = [f"{place.path}/{n}/items" for n in names]
        return (spark.read.schema("_item string, _batch string").parquet(*paths) if paths else spark.createDataFrame([], "_item string, _batch string")), names

    done, _ = batches()
    batch = uuid.uuid4().hex
    held = f"_held-{batch}"
    asked.join(done, "_item", "left_anti").select("_item", F.lit(batch).alias("_batch")).write.parquet(f"{place.path}/{held}/items")
    # what is missing is settled now, whatever others publish meanwhile
    missing = spark.read.schema("_item string, _batch string").parquet(f"{place.path}/{held}/items")
    result = compute(asked.join(missing.select("_item"), "_item", "left_semi"))
    schema = StructType(result.withColumn("_batch", F.lit("")).schema.fields)
    if missing.isEmpty():
        place.remove(held)
    else:
        result.withColumn("_batch", F.lit(batch)).write.parquet(f"{place.path}/{held}/rows")
        place.write(f"{held}/{RECORD}", {"name": name, "params": params})
        place.publish(held, batch)
    done, names = batches()
    chosen = done.groupBy("_item").agg(F.min("_batch").alias("_batch"))
    rows = [f"{place.path}/{n}/rows" for n in names]
    kept = spark.read.schema(schema).parquet(*rows) if rows else spark.createDataFrame([], schema)
    wanted = asked.select("_item", *item).join(chosen, "_item")
    return wanted.join(kept.select("_item", "_batch", *[c for c in kept.columns if c not in {"_item", "_batch", *item}]), ["_item", "_batch"]).drop("_item", "_batch")
