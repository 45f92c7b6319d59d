"""Text functions on pages, documents, parts and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.functions import text
from veldmark.operators import sets
from veldmark.plans.registry import query
from veldmark.session import table


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, 'example[.]com/(fr|de)/')")
def pf4_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(text.search("url", "/example[.]com/(fr|de)/")).select("page_id", "url")


@query("SELECT page_id FROM pages WHERE contains(url, 'page=2')")
def pf4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where(text.search("url", "page=2")).select("page_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(lang, '^f|1$') OR regexp_matches(source, '^f|1$')")
def pf5_search_either(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(text.search_either("lang", "source", "^f|1$")).select("doc_id")


@query("SELECT a.p_partkey AS k, b.p_partkey AS k2, substr(a.p_name, 1, list_max(list_filter(range(0, least(length(a.p_name), length(b.p_name)) + 1), lambda n: substr(a.p_name, 1, n) = substr(b.p_name, 1, n)))) AS common FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def f1_common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    after = parts.select((F.col("p_partkey") - 1).alias("k"), F.col("p_partkey").alias("k2"), F.col("p_name").alias("b"))
    return parts.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a")).join(after, "k").select("k", "k2", text.common_prefix("a", "b").alias("common"))


@query("SELECT p_partkey, CASE WHEN contains(p_name, ' ') THEN regexp_replace(p_name, ' [^ ]*$', '') ELSE substr(p_name, 1, length(p_name) - 1) END AS name FROM part")
def f2_strip_last_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.strip_last_word("p_name").alias("name"))


@query("SELECT p_partkey, CAST([p_size] || range(p_size + 2, p_size + 5) AS INT[]) AS expanded FROM part")
def f3_expand_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.format_string("%d,%d-%d", "p_size", F.col("p_size") + 2, F.col("p_size") + 4)
    return table(spark, sf_dir, "part").select("p_partkey", text.expand_ints(made).alias("expanded"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a href=\"[^\"]*\">')) AS links FROM pages")
def f4_find_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.size(text.find_all("html", '<a href="[^"]*">')).cast("long").alias("links"))


@query("SELECT p_partkey, replace(replace(replace(p_name, 'red', '<RED>'), 'small', '<SMALL>'), 'large', 'large') AS p_name FROM part")
def f4_replace_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapping = spark.createDataFrame([("red", "<RED>"), ("small", "<SMALL>")], "key string, value string")
    return text.replace_matches(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", "p_name", "red|small|large", mapping)


@query("SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[aeiou]', '_', 'g'), '_+', '-', 'g') AS code FROM part")
def f6_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.rewrite("p_name", [("[aeiou]", "_"), ("_+", "-")]).alias("code"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN trim(p_brand) ELSE p_name END AS token FROM part")
def f7_first_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat_ws(", ", F.lit("x"), F.col("p_brand"), F.lit("Brand#0"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", text.first_token(name, "^ *Brand").alias("token"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red') THEN 'tee' WHEN regexp_matches(p_type, '^ECO') THEN 'triangle' ELSE 'circle' END AS shape FROM part")
def f8_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = text.first_match("p_name", [("red", "tee")], "")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(shape != "", shape).otherwise(text.first_match("p_type", [("^ECO", "triangle")], "circle")).alias("shape"))


@query("SELECT p_partkey, CAST(p_size * 60 + 24 AS VARCHAR) || '.56' AS clock FROM part")
def f10_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.clock_seconds(F.format_string("%d.24.56", "p_size")).alias("clock"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def f23_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS INT), -1) AS k, json_extract(props, '$.absent') IS NOT NULL AS found FROM events")
def f24_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.from_json("props", "map<string,int>")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.element_at(m, "k"), F.lit(-1)).alias("k"), F.map_contains_key(m, "absent").alias("found"))


@query("SELECT source, arg_max(doc_id, (lang = 'fr', -doc_id)) AS doc_id FROM documents WHERE lang IN ('en', 'fr') GROUP BY source")
def u1_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "lang")
    return sets.last_wins([docs.where("lang = 'en'"), docs.where("lang = 'fr'")], "source", "doc_id", "doc_id")


@query("SELECT vec_id, 0 AS layer FROM embeddings WHERE label = 0 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label = 1")
def u4_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return sets.stacked([rows.where("label = 0").select("vec_id"), rows.where("label = 1").select("vec_id")])


@query("SELECT p_size AS k FROM part UNION SELECT CAST(l_linenumber AS INT) FROM lineitem")
def u5_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.distinct_union([table(spark, sf_dir, "part").select(F.col("p_size").alias("k")), table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("k"))])


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def u6_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    sold = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    return sets.missing_from(table(spark, sf_dir, "part").select("p_partkey"), sold, "p_partkey")


@query("SELECT p_name, min(p_partkey) AS p_partkey, arg_min(p_brand, p_partkey) AS p_brand FROM part GROUP BY p_name")
def a23_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.deduplicated(table(spark, sf_dir, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def a25_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.duplicates(table(spark, sf_dir, "documents").select("text"), "text")
