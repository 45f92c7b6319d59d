"""Labelled matrices: counts of orders by nation of the customer and priority."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators import aggregates, matrix, sets
from veldmark.plans.registry import query
from veldmark.session import table

CELLS = """
    cells AS (SELECT c_nationkey AS row_idx, n_name AS row, CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 AS col_idx, o_orderpriority AS col, count(*) AS v
              FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_nationkey").alias("row_idx"), F.col("n_name").alias("row"), (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("col_idx"), F.col("o_orderpriority").alias("col")).agg(F.count(F.lit(1)).alias("v"))


@query(f"""
    WITH {CELLS}, b AS (
        SELECT row_idx // 2 AS row_idx, col_idx // 2 AS col_idx, max(v) AS v, arg_min(row, row_idx) AS r1, arg_max(row, row_idx) AS r2, arg_min(col, col_idx) AS c1, arg_max(col, col_idx) AS c2
        FROM cells GROUP BY row_idx // 2, col_idx // 2)
    SELECT CAST(row_idx AS BIGINT) AS row_idx, CAST(col_idx AS BIGINT) AS col_idx, v,
           substr(r1, 1, list_max(list_filter(range(0, least(length(r1), length(r2)) + 1), lambda n: substr(r1, 1, n) = substr(r2, 1, n)))) AS row,
           substr(c1, 1, list_max(list_filter(range(0, least(length(c1), length(c2)) + 1), lambda n: substr(c1, 1, n) = substr(c2, 1, n)))) AS col
    FROM b""")
def a3_block_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.combine_pairs(cells(spark, sf_dir))


@query(f"""
    WITH {CELLS}, g AS (SELECT substr(row, 1, 8) AS row, substr(col, 1, 1) AS col, sum(v) AS v, min(row_idx) AS r, min(col_idx) AS c FROM cells GROUP BY 1, 2),
         rs AS (SELECT row, CAST(row_number() OVER (ORDER BY min(r)) - 1 AS INT) AS row_idx FROM g GROUP BY row), cs AS (SELECT col, CAST(row_number() OVER (ORDER BY min(c)) - 1 AS INT) AS col_idx FROM g GROUP BY col)
    SELECT row_idx, row, col_idx, col, CAST(v AS BIGINT) AS v FROM g JOIN rs USING (row) JOIN cs USING (col)""")
def a4_named_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = cells(spark, sf_dir).withColumn("row", F.substring("row", 1, 8)).withColumn("col", F.substring("col", 1, 1))
    return matrix.combine_named(short)


@query(f"""
    WITH {CELLS}, n AS (SELECT col, sum(v) AS n_inputs FROM cells GROUP BY col),
    s AS (SELECT cells.*, v / n_inputs AS share FROM cells JOIN n USING (col)),
    b AS (SELECT row_idx // 2 AS row_idx, col_idx // 2 AS col_idx, bool_or(v >= 100 AND row_idx % 2 = 0) AS one, bool_or(v >= 100 AND row_idx % 2 = 1) AS two, sum(v) AS total,
                 avg(share) FILTER (v >= 100) AS mean, arg_min(row, row_idx) AS row, arg_min(col, col_idx) AS col
          FROM s GROUP BY row_idx // 2, col_idx // 2)
    SELECT CAST(row_idx AS BIGINT) AS row_idx, CASE WHEN contains(row, ' ') THEN regexp_replace(row, ' [^ ]*$', '') ELSE substr(row, 1, length(row) - 1) END AS row, CAST(col_idx AS BIGINT) AS col_idx,
           CASE WHEN contains(col, ' ') THEN regexp_replace(col, ' [^ ]*$', '') ELSE substr(col, 1, length(col) - 1) END AS col,
           round(CASE WHEN one AND two AND total >= 250 THEN 100 * mean ELSE 0 END, 6) AS v
    FROM b""")
def a5_homolog(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir)
    inputs = found.groupBy("col").agg(F.sum("v").alias("n_inputs"))
    return matrix.merge_normalised(found, inputs, 100, 250).withColumn("v", F.round("v", 6))


@query(f"WITH {CELLS} SELECT row_idx, row, col_idx, col, v, round(v / sum(v) OVER (PARTITION BY col), 9) AS share FROM cells")
def j1_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cells(spark, sf_dir)
    return matrix.normalise(found, found.groupBy("col").agg(F.sum("v").alias("n_inputs"))).withColumn("share", F.round("share", 9))


@query(f"WITH {CELLS} SELECT row, col, v FROM cells WHERE v >= 120")
def pf1_over_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.over_threshold(cells(spark, sf_dir), 120)


@query(f"WITH {CELLS} SELECT row, CAST(coalesce(sum(v) FILTER (col = '1-URGENT'), 0) AS BIGINT) AS \"1-URGENT\", CAST(coalesce(sum(v) FILTER (col = '5-LOW'), 0) AS BIGINT) AS \"5-LOW\", CAST(coalesce(sum(v) FILTER (col = 'none'), 0) AS BIGINT) AS \"none\" FROM cells GROUP BY row")
def sk6_dense_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.dense(cells(spark, sf_dir), ["1-URGENT", "5-LOW", "none"])


@query(f"WITH {CELLS} SELECT col_idx AS x, row_idx AS y, CAST(v AS INT) AS v FROM cells")
def sk13_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.sources.sinks import pixels

    return pixels(cells(spark, sf_dir))


@query(f"WITH {CELLS} SELECT col_idx AS row_idx, col AS row, row_idx AS col_idx, row AS col, v FROM cells")
def f25_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.transposed(cells(spark, sf_dir))


BIN = "CAST((greatest(1, least(50, l_quantity)) - 1) / 49 * 19 AS DOUBLE)"


@query(f"SELECT CAST(trunc({BIN}) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def a20_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 20, 1.0, 50.0)


@query("""
    WITH b AS (SELECT least(CAST(floor((l_quantity - 1) / 49 * 7) AS INT) + 1, 7) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 50 GROUP BY 1)
    SELECT CAST(bin AS BIGINT) AS bin, round(n / sum(n) OVER (), 9) AS share FROM b""")
def a21_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.frequencies(table(spark, sf_dir, "lineitem"), "l_quantity", 1, 50, 7).select(F.col("bin").cast("long").alias("bin"), F.round("share", 9).alias("share"))


@query("""
    WITH b AS (SELECT CAST(trunc((greatest(0, least(110000, l_extendedprice)) - 0) / 110000 * 255) AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS total FROM b)
    SELECT min(bin) AS lo_bin, max(bin) AS hi_bin FROM b, t WHERE n <= floor(total / 10) AND n > floor(total / 2500)""")
def a22_display_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.display_range(table(spark, sf_dir, "lineitem"), "l_extendedprice", 0.0, 110000.0)


@query("WITH s AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT o_totalprice AS median FROM s WHERE i = n // 2")
def a16_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.upper_median_of(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""
    WITH s AS (SELECT user_id, round(sum(value), 6) AS total FROM events GROUP BY user_id), m AS (SELECT list_sort(list(total))[count(*) // 2 + 1] AS median FROM s)
    SELECT user_id, total FROM s, m WHERE total < 1.5 * median""")
def pf9_below_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total"))
    median = aggregates.upper_median_of(totals, "total")
    return totals.join(F.broadcast(median), F.col("total") < 1.5 * F.col("median")).select("user_id", "total")  # one row


@query("SELECT min(o_totalprice) AS min_o_totalprice, max(o_totalprice) AS max_o_totalprice, max(o_totalprice) - min(o_totalprice) AS extent_o_totalprice FROM orders")
def a9_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(*aggregates.bounds(["o_totalprice"]))


@query("SELECT least(0, min(c_acctbal)) AS min_c_acctbal, greatest(0, max(c_acctbal)) AS max_c_acctbal FROM customer")
def a10_bounds_from_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(*aggregates.bounds_from_zero(["c_acctbal"]))


@query("SELECT o_orderpriority, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS largest FROM orders GROUP BY o_orderpriority")
def a11_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("largest"))


@query("SELECT event_type, count(*) FILTER (value > 10) AS strong, count(*) FILTER (value <= 10) AS weak FROM events GROUP BY event_type")
def a6_conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 10).alias("strong"), F.count_if(F.col("value") <= 10).alias("weak"))


@query("SELECT l_shipdate, round(sum(l_quantity), 4) AS total FROM lineitem GROUP BY l_shipdate")
def a15_sum_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.round(F.sum("l_quantity"), 4).alias("total"))


@query("SELECT c_mktsegment AS name, list_sort(list_distinct(list(c_nationkey))) AS members FROM customer GROUP BY c_mktsegment")
def a30_named_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.named_groups(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), "c_nationkey")


@query("""
    SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 6) AS std, round(var_pop(value) OVER w, 6) AS variance, round(var_samp(value) OVER w, 6) AS sample_variance
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def a31_block_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = aggregates.block_statistics(table(spark, sf_dir, "events"), "value", ["user_id"], "event_id", 2)
    return done.select("event_id", *[F.round(c, 6).alias(c) for c in ("mean", "std", "variance", "sample_variance")])


@query("SELECT round(sum(abs(l_discount - l_tax)), 4) AS difference FROM lineitem")
def a33_absolute_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.round(aggregates.absolute_difference("l_discount", "l_tax"), 4).alias("difference"))


@query("SELECT o_orderpriority, min(o_totalprice) AS least, max(o_totalprice) AS most, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1")
def a29_min_max_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT c_custkey, coalesce(o.n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def j19_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return sets.with_default(table(spark, sf_dir, "customer").select("c_custkey"), counts, "c_custkey", {"n": 0})
