"""From raw documents to token ids: language, exact copies, near copies, benchmark leaks, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldmark.llm import _common as common
from veldmark.llm import bpe, decontaminate, exact_dedup, langid, near_dedup

#: Least posterior probability of a language that a document is kept with.
LEAST_LANG_SCORE = 0.5
TOKENIZER = "word_bpe_49k.json"


#: Spark's setting of the bytes of an Arrow batch, and its own value.
BATCHES, DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20


def _settled(spark: SparkSession) -> None:
    """The pipeline's session passes texts to Python in batches of 1 MB, unless somebody has chosen a size: executors of three gigabytes hold several copies of each task's. Operators leave the session as it is."""
    if spark.conf.get(BATCHES).rstrip("b") == str(DEFAULT):
        spark.conf.set(BATCHES, str(common.BATCH_BYTES))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with the columns of docs: those without a letter, null and empty texts among them, and those with a doubtful language go.

    Repeated rows are judged alike; without a row that teaches a language none is kept.
    """
    _settled(spark)
    model = langid.fit(docs, ~common.held_out(), "doc_id", "text", "lang")
    return langid.told(docs, model, LEAST_LANG_SCORE)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null counting as empty, the row with the largest id, with the columns of docs; of rows that repeat id and text, one. An empty table stays empty."""
    _settled(spark)
    return exact_dedup.distinct_documents(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, the row with the least id, with the columns of docs; texts without words are no copies of each other. An empty table stays empty."""
    _settled(spark)
    return near_dedup.distinct_documents(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, with the columns of docs; null and empty texts contain none, an empty benchmark is in no text."""
    _settled(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and the digest of the decoded text. Other columns of docs go; null and empty texts have no tokens."""
    _settled(spark)
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER), decode=True)
    return done.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", encoding_stage),
]

#: Shingles, signatures and merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents; each one's rows are written to the shared folder and read by the next."""
    docs, folder = common.documents(spark, sf_dir), common.scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
