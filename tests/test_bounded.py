"""What a task or an executor's Python holds doesn't grow with the table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldmark.operators import distance, ml
from veldmark.sources import sinks


def test_edges_are_written_in_parts(spark, tmp_path):
    """F16: edges_csv leaves the parts to the tasks that have them."""
    edges = spark.range(400).repartition(4).select(F.concat(F.lit("s"), "id").alias("row"), F.lit("p").alias("col"), F.col("id").alias("v"))
    sinks.edges_csv(edges, str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("part-*"))) == 4
    assert sorted(r.v for r in spark.read.schema("row string, col string, v long").csv(str(tmp_path / "out")).collect()) == list(range(400))


def test_files_come_in_small_batches(spark, tmp_path):
    """a batch holds a megabyte or a file; the session's setting comes back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, own = spark.conf.get(name), [], sinks.DataFrame.mapInArrow

    def watched(self, *args):
        seen.append(spark.conf.get(name))
        return own(self, *args)

    rows = spark.range(40).select(F.concat("id", F.lit("/a.bin")).alias("name"), F.repeat(F.chr(F.col("id") + 65), 300_000).cast("binary").alias("content"))
    kind = type(rows)
    own, kind.mapInArrow = kind.mapInArrow, watched
    try:
        assert sinks.files(rows, str(tmp_path)) == 40
    finally:
        kind.mapInArrow = own
    assert seen == [str(1 << 20)] and spark.conf.get(name) == before
    assert all((tmp_path / f"{i}/a.bin").read_bytes() == bytes([i + 65]) * 300_000 for i in range(40))


def test_columns_become_objects_a_few_at_a_time():
    """masks_between turns few columns of a band into lists at once."""
    batch = pa.RecordBatch.from_pydict({"x": np.arange(100)})
    parts = list(distance._few([batch]))
    assert max(p.num_rows for p in parts) == distance.FEW and [v for p in parts for v in p.column("x").to_pylist()] == list(range(100))


@pytest.mark.parametrize("learner", [ml.support_vectors, lambda rows, names: ml.perceptron(rows, names, 2)])
def test_learners_of_many_turns_have_few_tasks(spark, monkeypatch, learner):
    """every task of every turn reports to the driver, so their number goes by rows."""
    seen = []
    monkeypatch.setattr(ml, "_fitted", lambda rows, attributes, learner: seen.append(rows))
    rows = spark.range(3 * ml.ROWS // 2).repartition(16).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).alias("label"))
    learner(rows, ["a"])
    assert seen[0].rdd.getNumPartitions() <= 2 and seen[0].count() == rows.count()
