"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veldmark.llm import _common as common


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(common.documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.decontaminate import contaminated

    return contaminated(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.quality import quality

    return quality(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.langid import language_id

    return language_id(common.documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.secret_scan import secrets

    return secrets(common.documents(spark, sf_dir))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.pii import personal_data

    return personal_data(common.documents(spark, sf_dir))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.near_dedup import near_dedup

    return near_dedup(common.documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.exact_dedup import exact_dedup

    return exact_dedup(common.documents(spark, sf_dir))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from veldmark.llm.bpe import digests

    return digests(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.licenses import license_scan

    return license_scan(common.documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.clustering import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from veldmark.llm.mixing import allotted

    done = allotted(common.documents(spark, sf_dir).select("doc_id", "text", "source"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from veldmark.llm.merkle import merkle

    return merkle(common.documents(spark, sf_dir))


#: The crc32 of an id as text: one turn of its 8 bits for each digit.
CRC32 = "list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')], lambda a, b: list_reduce([xor(a, b)] || [CAST(i AS BIGINT) FOR i IN range(8)], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"


def _rounds(rounds: int = 3) -> str:
    """Each round's assignment (a0, a1, ...) and the centroids after it."""
    parts = []
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS MATERIALIZED (SELECT v.vec_id, v.q, c.k, list_sum([(p[1] - p[2]) * (p[1] - p[2]) FOR p IN list_zip(v.q, c.q)])::BIGINT AS d FROM v, c{r} c),
            a{r} AS MATERIALIZED (SELECT vec_id, any_value(q) AS q, arg_min(k, d * 16 + k) AS k, min(d) AS d FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            parts.append(f"""s{r} AS (SELECT k, i, sum(q[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY k, i),
            m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS q FROM s{r} GROUP BY k),
            c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.q, c.q) AS q FROM c{r} c LEFT JOIN m{r} m USING (k))""")
    return ",\n            ".join(parts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {
        "op8_exact_dedup": """
            SELECT doc_id,
                   max(doc_id) OVER same AS keep_id,
                   count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents
            WINDOW same AS (PARTITION BY coalesce(text, ''))
        """,
        "op11_centroids": f"""
            WITH v AS MATERIALIZED (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE))::BIGINT FOR x IN embedding] AS q FROM embeddings WHERE len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64),
            c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, q FROM v ORDER BY k LIMIT 16),
            {_rounds()}
            SELECT vec_id, CAST(k AS INT) AS cluster, a3.d AS distance, CAST(sum(a3.d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(a3.d) OVER () AS BIGINT) AS inertia,
                sha256(array_to_string(c3.q, ',')) AS centroid_sha256
            FROM a3 JOIN c3 USING (k)
        """,
        "op12_mixture": """
            WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, md5('0:' || doc_id)[:13] AS draw FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
            l AS (SELECT *, sum(ss) OVER () AS total, coalesce(sum(2 * ss) OVER (ORDER BY 12 * ss // w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                sum(w) OVER (ORDER BY 12 * ss // w, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws, row_number() OVER (ORDER BY 12 * ss // w, source NULLS FIRST) AS i FROM s),
            f AS (SELECT min(i) AS first FROM l WHERE (150 * total - 100 * before) * w <= 100 * 2 * ss * ws),
            t AS (SELECT l.source, l.ss, CASE WHEN l.i < f.first OR f.first IS NULL THEN CAST(2 * l.ss AS DOUBLE) ELSE CAST((150 * e.total - 100 * e.before) * l.w AS DOUBLE) / CAST(100 * e.ws AS DOUBLE) END AS target FROM l, f LEFT JOIN l e ON e.i = f.first),
            r AS (SELECT *, CASE WHEN ss = 0 THEN 0 ELSE target / ss END AS rate FROM t)
            SELECT doc_id, CAST(size AS BIGINT) AS size, ss AS source_size, target,
                CAST(size * (floor(rate) + CASE WHEN CAST(('0x' || draw) AS BIGINT) / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
            FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
        """,
        "op13_merkle": """
            WITH RECURSIVE e AS (
                SELECT doc_id, source, 'x' AS x, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
                    CASE WHEN (4294967295 - CRC) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
                FROM (SELECT *, SQLCRC AS CRC FROM documents)),
            h AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS changed FROM e),
            p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM h),
            t AS (
                SELECT tree, 0 AS level, pos, leaf AS node, n FROM p
                UNION ALL
                SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM t WHERE n > 1 GROUP BY tree, level, pos // 3),
            sub AS MATERIALIZED (SELECT tree, node, tree - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
            u AS (
                SELECT 0 AS level, pos, node, n FROM sub
                UNION ALL
                SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), any_value((n + 2) // 3) FROM u WHERE n > 1 GROUP BY level, pos // 3),
            way AS MATERIALIZED (
                SELECT p.doc_id, p.leaf, p.tree, t.level, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < POW), '') AS before, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > POW), '') AS after
                FROM p JOIN t ON t.tree = p.tree AND t.n > 1 AND t.pos // 3 = POW // 3 GROUP BY ALL
                UNION ALL
                SELECT p.doc_id, p.leaf, p.tree, 100 + u.level, coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos < UPOW), ''), coalesce(string_agg(u.node, '' ORDER BY u.pos) FILTER (u.pos > UPOW), '')
                FROM p JOIN u ON u.n > 1 AND u.pos // 3 = UPOW // 3 GROUP BY ALL),
            steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, leaf ORDER BY level) AS step FROM way),
            f AS (
                SELECT doc_id, leaf, 0 AS step, changed AS at FROM p
                UNION ALL
                SELECT f.doc_id, f.leaf, s.step, sha256(s.before || f.at || s.after) FROM f JOIN steps s ON s.doc_id = f.doc_id AND s.leaf = f.leaf AND s.step = f.step + 1),
            proof AS (SELECT doc_id, leaf, sha256(string_agg(before || after, '' ORDER BY step)) AS proof_sha256, max(step) AS last FROM steps GROUP BY doc_id, leaf),
            top AS (SELECT node AS root FROM u WHERE n = 1)
            SELECT p.doc_id, p.leaf, sub.node AS subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.at AS folded_root, f.at = root AS verified
            FROM p JOIN sub USING (tree) CROSS JOIN top LEFT JOIN proof ON proof.doc_id = p.doc_id AND proof.leaf = p.leaf JOIN f ON f.doc_id = p.doc_id AND f.leaf = p.leaf AND f.step = coalesce(proof.last, 0)
        """.replace("UPOW", "((p.tree - 1) // CAST(pow(3, u.level) AS BIGINT))").replace("POW", "(p.pos // CAST(pow(3, t.level) AS BIGINT))").replace("SQLCRC", CRC32),
    }
