"""Ordered computations on events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators import sets, windows
from veldmark.plans.registry import query
from veldmark.session import table

ORDER = "PARTITION BY user_id ORDER BY ts, event_id"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


@query(f"SELECT event_id, min(value) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS baseline FROM events")
def w1_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.baseline(events(spark, sf_dir), "value", ["user_id"], ["ts", "event_id"], 41).select("event_id", "baseline")


@query(f"WITH b AS (SELECT event_id, value, min(value) OVER ({ORDER} ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS b FROM events) SELECT event_id, round((value - b) / (b - 2 + 4 / 0.04), 6) AS dff FROM b")
def w14_delta_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.delta_f_over_f(events(spark, sf_dir), "value", ["user_id"], ["ts", "event_id"], 41, noise=2.0, sigma=4.0).select("event_id", F.round("dff", 6).alias("dff"))


@query("""
    WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2)
    SELECT event_type, CAST(day AS VARCHAR) AS day, CAST(total AS BIGINT) AS total FROM (SELECT event_type, day, sum(n) OVER w AS total, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE i >= 3""")
def w2_moving_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return windows.moving_sum(daily, "n", ["event_type"], ["day"], 3).select("event_type", F.col("day").cast("string").alias("day"), "total")


@query(f"SELECT event_id, round(-sum(value) OVER ({ORDER} ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM events")
def w3_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.cumulative(events(spark, sf_dir), "value", ["user_id"], ["ts", "event_id"]).select("event_id", F.round("cumulative", 4).alias("cumulative"))


@query(f"""
    WITH g AS (SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER ({ORDER})) > 21600000000 THEN 1 ELSE 0 END AS new FROM events)
    SELECT event_id, CAST(sum(new) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM g""")
def w8_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    timed = events(spark, sf_dir).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return windows.sessions(timed, "at", ["user_id"], ["ts", "event_id"], 6 * 3600 * 1_000_000).select("event_id", "session")


@query("WITH o AS (SELECT DISTINCT o_orderpriority AS part, CAST(floor(o_totalprice / 100) AS BIGINT) AS k FROM orders), l AS (SELECT part, k, lag(k) OVER (PARTITION BY part ORDER BY k) AS last FROM o) SELECT part, last + 1 AS gap_from, k - 1 AS gap_to FROM l WHERE k - last > 1")
def w9_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.floor(F.col("o_totalprice") / 100).alias("k"))
    return windows.gaps(keys, "k", ["part"])


@query("WITH o AS (SELECT DISTINCT o_orderpriority AS part, CAST(floor(o_totalprice / 100) AS BIGINT) AS k FROM orders), l AS (SELECT part, k, lag(k) OVER (PARTITION BY part ORDER BY k) AS last FROM o) SELECT part, unnest(range(last + 1, k)) AS k FROM l WHERE k - last > 1")
def w9_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("part"), F.floor(F.col("o_totalprice") / 100).alias("k"))
    return windows.missing(keys, "k", ["part"])


@query(f"SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER ({ORDER}) - 1 AS i FROM events) WHERE i % 2 = 1")
def w13_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.every_nth(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 2, 1).select("event_id", "user_id")


@query(f"SELECT event_id, CAST((row_number() OVER ({ORDER}) - 1) // 7 AS BIGINT) AS chunk FROM events")
def w15_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.chunks(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], 7).select("event_id", "chunk")


@query(f"SELECT event_id, CAST(row_number() OVER ({ORDER}) AS INT) AS row FROM events")
def w12_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.row_index(events(spark, sf_dir), ["user_id"], ["ts", "event_id"]).select("event_id", "row")


@query(f"SELECT event_id, next FROM (SELECT event_id, lead(event_id) OVER ({ORDER}) AS next FROM events) WHERE next IS NOT NULL")
def j15_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.consecutive(events(spark, sf_dir), "event_id", ["user_id"], ["ts", "event_id"]).select("event_id", "next")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def o5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.top_k(events(spark, sf_dir), ["user_id"], [F.desc("value"), "event_id"], 3).select("event_id", "user_id")


@query("SELECT user_id, event_type, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2")
def st1_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.struct("user_id", "event_type").alias("key"), F.col("ts").alias("first"), F.col("ts").alias("last"))
    early, late = rows.where("first < timestamp'2024-01-10'"), rows.where("first >= timestamp'2024-01-10'")
    known = sets.upsert(early.limit(0), early, "key", "first", "last")
    return sets.upsert(known, late, "key", "first", "last").select("key.user_id", "key.event_type", "first", "last")


@query("SELECT n_nationkey, list_transform([-2, -1, 0, 1, 2], lambda s: (i + s + 2) % 25) AS window FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) - 1 + 25 AS i FROM nation)")
def w11_centred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.centred_slices(table(spark, sf_dir, "nation").withColumn("all", F.lit(0)), ["all"], ["n_nationkey"], 5, turn=2).select("n_nationkey", F.transform("window", lambda x: x.cast("long")).alias("window"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def o8_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 10, 20)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'HOUSEHOLD' THEN 1 END AS place FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')")
def o4_given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.in_given_order(table(spark, sf_dir, "customer"), "c_mktsegment", ["MACHINERY", "HOUSEHOLD"]).select("c_custkey", "place")


@query("""
    WITH m AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS tx FROM events)
    SELECT user_id, event_id, round(-(sum(tx) OVER (PARTITION BY user_id ORDER BY i) - first_value(tx) OVER (PARTITION BY user_id ORDER BY i)), 4) AS tx FROM m""")
def w4_cumulative_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations: A_i moves by less the sum of all but the first."""

    one, none = F.lit(1.0), F.lit(0.0)
    rows = events(spark, sf_dir).select("user_id", F.struct("ts", "event_id").alias("at"), F.array(one, none, F.col("value"), none, one, none).alias("m"))
    folded = windows.cumulative_affine(rows, "m", ["user_id"], "at", 2)
    return folded.select("user_id", F.col("at.event_id").alias("event_id"), F.round(F.element_at("m", 3), 4).alias("tx"))
