"""Find or compute: what runs, what is published, and two writers at once."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from veldmark.sources import kept


def jobs_of(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_second_run_starts_no_job(spark, tmp_path):
    folder, source = f"file://{tmp_path}/kept", f"{tmp_path}/in"
    spark.range(10).write.parquet(source)
    calls = []

    def compute():
        calls.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("v"), F.array(F.struct("id")).alias("more"))

    get = lambda params: kept.find_or_compute(spark, folder, "twice", params, compute, [source])
    first, n = jobs_of(spark, "a", lambda: get({"r": 1.5, "s": [1, 2]}))
    assert n > 0 and calls == [1]
    again, n = jobs_of(spark, "b", lambda: get({"s": [1, 2], "r": 1.5}))
    assert n == 0 and calls == [1] and sorted(again.collect()) == sorted(first.collect()) and again.schema == first.schema and again.count() == 10
    get({"r": 2, "s": [1, 2]})
    assert calls == [1, 1]
    spark.range(3).write.mode("append").parquet(source)  # another input
    assert get({"r": 1.5, "s": [1, 2]}).count() == 13 and calls == [1, 1, 1]
    assert len(os.listdir(f"{tmp_path}/kept")) == 3


def test_a_failure_publishes_nothing(spark, tmp_path):
    bad = lambda: spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="no"):
        kept.find_or_compute(spark, str(tmp_path), "x", {}, bad)
    assert all(n.startswith("_") for n in os.listdir(tmp_path))
    assert kept.find_or_compute(spark, str(tmp_path), "x", {}, lambda: spark.range(4).toDF("v")).count() == 4


def test_two_writers_leave_one_result(spark, tmp_path):
    meet, out = threading.Barrier(2), {}

    def work(k):
        def compute():
            meet.wait(60)  # neither has found anything
            return spark.createDataFrame([(k,)], "who int")

        out[k] = kept.find_or_compute(spark, str(tmp_path), "x", {"p": 1}, compute).collect()

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert out[1] == out[2] and len(out[1]) == 1 and len(os.listdir(tmp_path)) == 1


def test_each_item_is_computed_once(spark, tmp_path):
    """Only new items are computed, those without rows are known too; a changed item is another one; null columns differ from absent ones; repeated rows count once."""
    seen = []

    def compute(missing):
        seen.append(sorted((r.name or "", r.data) for r in missing.collect()))
        return missing.select("_item", F.explode("data").alias("v"), F.lit("x").alias("name")).where("v > 0")

    def get(rows, params=1):
        df = spark.createDataFrame(rows, "name string, data array<int>")
        return sorted(kept.find_or_compute_each(df, ["name"], str(tmp_path), "pos", {"p": params}, compute).collect(), key=str)

    a = get([("a", [1, 2]), ("a", [1, 2]), ("none", [-1]), (None, [7])])
    assert [tuple(r) for r in a] == [("a", 1), ("a", 2), (None, 7)] and seen == [[("", [7]), ("a", [1, 2]), ("none", [-1])]]
    assert get([("none", [-1]), ("a", [1, 2])]) == a[:2] and seen[1] == []
    assert [tuple(r) for r in get([("a", [1, 2]), ("a", [5]), ("b", [3])])] == [("a", 1), ("a", 2), ("a", 5), ("b", 3)] and seen[2] == [("a", [5]), ("b", [3])]
    get([("b", [3])], 2)
    assert seen[3] == [("b", [3])] and get([]) == []


def test_items_of_two_writers(spark, tmp_path):
    meet, out = threading.Barrier(2), {}

    def work(k):
        def compute(missing):
            meet.wait(60)
            return missing.select("_item", F.lit(k).alias("who"))

        out[k] = sorted(map(tuple, kept.find_or_compute_each(spark.createDataFrame([(i,) for i in (1, 2, 2 + k)], "i int"), ["i"], str(tmp_path), "x", {}, compute).collect()))

    threads = [threading.Thread(target=work, args=(k,)) for k in (1, 2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [len(out[k]) for k in (1, 2)] == [3, 3]  # each item once, whoever computed it
    late = kept.find_or_compute_each(spark.range(1, 5).select(F.col("id").cast("int").alias("i")), ["i"], str(tmp_path), "x", {}, lambda m: m.select("_item", F.lit(3).alias("who")))
    assert sorted(r.i for r in late.collect()) == [1, 2, 3, 4] and late.where("who = 3").isEmpty()
