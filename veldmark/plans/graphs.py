"""Graphs of suppliers and parts, and the tree of parts by halving keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.operators import graph, sets
from veldmark.plans.registry import query
from veldmark.session import table

FOLDED = "SELECT l_suppkey AS src, l_partkey % 100 + 1 AS dst, count(*) AS weight FROM lineitem GROUP BY ALL"
TREE = "tree AS (SELECT p_partkey AS node, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent, p_size AS size FROM part)"
PATHS = f"""{TREE}, paths AS (
        SELECT node, node AS root, CAST(0 AS DOUBLE) AS distance, CAST(0 AS BIGINT) AS depth FROM tree WHERE parent IS NULL
        UNION ALL SELECT t.node, p.root, p.distance + t.size, p.depth + 1 FROM tree t JOIN paths p ON t.parent = p.node)"""
CHOSEN = "chosen AS (SELECT p_partkey AS node FROM part WHERE p_partkey IN (37, 150, 151, 301))"
UP = f"{TREE}, {CHOSEN}, up AS (SELECT node AS origin, node AS ancestor, CAST(0 AS BIGINT) AS steps FROM chosen UNION ALL SELECT u.origin, t.parent, u.steps + 1 FROM up u JOIN tree t ON u.ancestor = t.node WHERE t.parent IS NOT NULL)"


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_weights(table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") % 100 + 1).alias("part")), "l_suppkey", "part")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("parent"), "p_size")


def chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_partkey").isin(37, 150, 151, 301)).select(F.col("p_partkey").alias("node"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL HAVING count(*) >= 2")
def g1_edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edge_weights(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", 2)


@query(f"WITH e AS ({FOLDED}) SELECT (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS nodes, (SELECT count(*) FROM e) AS edges")
def g1_graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_size(folded(spark, sf_dir))


@query(f"WITH e AS ({FOLDED} HAVING count(*) >= 3) SELECT a.src, a.dst, a.weight, b.weight AS back_weight FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src <= a.dst")
def g2_reciprocal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reciprocal(folded(spark, sf_dir), 3)


@query(f"WITH e AS ({FOLDED} HAVING count(*) >= 12) SELECT s_suppkey AS node FROM supplier WHERE s_suppkey NOT IN (SELECT src FROM e) AND s_suppkey NOT IN (SELECT dst FROM e)")
def j17_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_edges(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node")), folded(spark, sf_dir).where("weight >= 12"))


@query("""
    SELECT CAST(r_regionkey AS BIGINT) AS node, 0 AS layer FROM region WHERE r_regionkey = 1
    UNION ALL SELECT DISTINCT CAST(n_nationkey AS BIGINT), 1 FROM nation WHERE n_regionkey = 1
    UNION ALL SELECT DISTINCT c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1
    UNION ALL SELECT DISTINCT o_orderkey, 3 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1""")
def g3_layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    hop = lambda name, src, dst: table(spark, sf_dir, name).select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
    start = table(spark, sf_dir, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("long").alias("node"))
    return graph.layered(start, [hop("nation", "n_regionkey", "n_nationkey"), hop("customer", "c_nationkey", "c_custkey"), hop("orders", "o_custkey", "o_orderkey")])


@query(f"WITH RECURSIVE {PATHS} SELECT node, root, distance, depth FROM paths")
def g6_path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.path_to_root(tree(spark, sf_dir), length=F.col("p_size"))


@query(f"WITH RECURSIVE {UP} SELECT origin, ancestor, steps FROM up")
def g5_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ancestors(tree(spark, sf_dir), chosen(spark, sf_dir))


@query(f"WITH RECURSIVE {UP} SELECT ancestor AS nca FROM up GROUP BY ancestor HAVING count(*) = (SELECT count(*) FROM chosen) ORDER BY sum(steps), ancestor LIMIT 1")
def g5_nearest_common_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_common_ancestor(tree(spark, sf_dir), chosen(spark, sf_dir))


@query(f"""
    WITH RECURSIVE {PATHS}, {CHOSEN}, up AS (SELECT node AS origin, node AS ancestor, CAST(0 AS BIGINT) AS steps FROM chosen UNION ALL SELECT u.origin, t.parent, u.steps + 1 FROM up u JOIN tree t ON u.ancestor = t.node WHERE t.parent IS NOT NULL),
    nca AS (SELECT ancestor AS node FROM up GROUP BY ancestor HAVING count(*) = (SELECT count(*) FROM chosen) ORDER BY sum(steps), ancestor LIMIT 1)
    SELECT c.node, p.distance - (SELECT distance FROM paths JOIN nca USING (node)) AS distance FROM chosen c LEFT JOIN paths p USING (node)""")
def g8_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.distances_from_common_ancestor(tree(spark, sf_dir), chosen(spark, sf_dir), F.col("p_size"))


@query(f"""
    WITH RECURSIVE {TREE}, below AS (SELECT node, CASE WHEN node IN (5, 44, 90) THEN TRUE ELSE FALSE END AS cut, FALSE AS axon FROM tree WHERE parent IS NULL
        UNION ALL SELECT t.node, t.node IN (5, 44, 90), b.cut OR b.axon FROM tree t JOIN below b ON t.parent = b.node)
    SELECT node, CASE WHEN axon THEN 'axon' ELSE 'dendrite' END AS part FROM below""")
def g4_compartments(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = table(spark, sf_dir, "part").where(F.col("p_partkey").isin(5, 44, 90)).select(F.col("p_partkey").alias("node"))
    return graph.compartments(tree(spark, sf_dir), cuts)


@query(f"""
    WITH RECURSIVE {TREE}, way AS (SELECT CAST(100 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS new UNION ALL SELECT t.parent, t.node FROM way w JOIN tree t ON w.node = t.node WHERE t.parent IS NOT NULL)
    SELECT t.node, CASE WHEN w.node IS NULL THEN t.parent ELSE w.new END AS parent FROM tree t LEFT JOIN way w ON t.node = w.node""")
def g4_rerooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.rerooted(tree(spark, sf_dir), 100)


HALVES = """halves AS (SELECT pre.l_suppkey AS pre, pre.l_returnflag AS pre_part, post.l_suppkey AS post, post.l_returnflag AS post_part, pre.l_orderkey AS connector
    FROM lineitem pre JOIN lineitem post USING (l_orderkey) WHERE pre.l_linenumber = 1 AND post.l_linenumber > 1)"""


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("connector"), F.col("l_suppkey").alias("neuron"), F.col("l_returnflag").alias("part"), "l_linenumber")
    return graph.connector_edges(rows.where("l_linenumber = 1"), rows.where("l_linenumber > 1"), "connector")


@query(f"WITH {HALVES} SELECT connector, pre, pre_part, post, post_part FROM halves")
def j2_connectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return halves(spark, sf_dir)


@query(f"WITH {HALVES} SELECT pre, pre_part, post, post_part, count(*) AS n FROM halves GROUP BY pre, pre_part, post, post_part")
def a8_coloured_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.coloured_edges(halves(spark, sf_dir))


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def a1_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, CAST(50.0 + n_regionkey * 200.0 AS DOUBLE) AS x, CAST(50.0 + coalesce((row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) / nullif(count(*) OVER (PARTITION BY n_regionkey) - 1, 0), 0) * 600.0 AS DOUBLE) AS y FROM nation")
def g10_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("n_regionkey")
    nations = table(spark, sf_dir, "nation").withColumns({"i": F.row_number().over(w.orderBy("n_nationkey")) - 1, "n": F.count(F.lit(1)).over(w)})
    placed = graph.column_layout(nations, F.col("n_regionkey"), F.col("i"), F.col("n"), 50.0, 200.0, 600.0)
    return placed.select("n_nationkey", "x", "y")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j17_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.missing_from(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j16_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.present_in(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT n_nationkey, coalesce(r_name, n_name) AS n_name FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
def j23_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return sets.replaced(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), regions, "n_nationkey", "n_name")


#: Chains of 20 parts, each of which begins at a part of half its number; places by size, brand and price.
CHAINS = """n AS (SELECT p_partkey AS node, CASE WHEN p_partkey <= 1 THEN NULL WHEN p_partkey % 20 = 1 THEN (p_partkey - 1) // 2 ELSE p_partkey - 1 END AS parent,
    CAST(p_size AS DOUBLE) AS x, CAST(p_partkey % 7 AS DOUBLE) AS y, CAST(p_retailprice AS DOUBLE) / 10 AS z FROM part)"""


@query(f"""
    WITH RECURSIVE {CHAINS}, c AS (SELECT parent AS node, count(*) AS n FROM n WHERE parent IS NOT NULL GROUP BY parent),
    k AS (SELECT n.*, n.parent IS NULL OR coalesce(c.n, 0) <> 1 AS fixed FROM n LEFT JOIN c USING (node)),
    w AS (
        SELECT node, parent, x, y, z, fixed, CAST(0 AS DOUBLE) AS d, node AS stretch FROM k WHERE parent IS NULL
        UNION ALL SELECT k.node, k.parent, k.x, k.y, k.z, k.fixed, w.d + sqrt((k.x - w.x) ** 2 + (k.y - w.y) ** 2 + (k.z - w.z) ** 2), CASE WHEN w.fixed THEN k.node ELSE w.stretch END
        FROM k JOIN w ON k.parent = w.node),
    m AS (SELECT stretch, node, d, fixed, x, y, z FROM w WHERE parent IS NOT NULL
        UNION ALL SELECT a.stretch, b.node, b.d, true, b.x, b.y, b.z FROM w a JOIN w b ON a.parent = b.node WHERE a.stretch = a.node),
    p AS (SELECT a.node, exp(-((b.d - a.d) ** 2) / (2 * 7.3 * 7.3)) AS g, b.x, b.y, b.z FROM m a JOIN m b ON a.stretch = b.stretch WHERE NOT a.fixed AND abs(b.d - a.d) <= 3.0 * 7.3)
    SELECT node, round(sum(g * x) / sum(g), 6) AS x, round(sum(g * y) / sum(g), 6) AS y, round(sum(g * z) / sum(g), 6) AS z FROM p GROUP BY node
    UNION ALL SELECT node, round(x, 6), round(y, 6), round(z, 6) FROM w WHERE fixed""")
def g7_smoothed_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of parts smoothed along their chains."""
    key = F.col("p_partkey")
    parent = F.when(key == 1, F.lit(None)).when(key % 20 == 1, F.floor((key - 1) / 2)).otherwise(key - 1)
    nodes = table(spark, sf_dir, "part").select(key.alias("node"), parent.alias("parent"), F.col("p_size").cast("double").alias("x"), (key % 7).cast("double").alias("y"), (F.col("p_retailprice").cast("double") / 10).alias("z"))
    smooth = graph.smoothed_positions(nodes, ["x", "y", "z"], 7.3)
    return smooth.withColumns({a: F.round(a, 6) for a in "xyz"})
