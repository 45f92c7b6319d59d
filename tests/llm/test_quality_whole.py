"""What the quality model learns from: words of all documents, and labelled texts behind an overlong one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldmark.llm import quality
from veldmark.llm._text import words


def ids(text):
    return (words([text]).hashes >> np.uint64(64 - quality.BITS)).astype(int)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, f"good plain words number {i}" if i % 2 else f"BAD!! *** {i}") for i in range(40)]
    docs = spark.createDataFrame([*rows, (1000, "unseen rare vocabulary here"), (1001, None), (None, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")


def test_words_outside_the_sample_have_vectors(corpus):
    vectors = quality.fit(*corpus).word_vectors
    assert np.allclose(np.linalg.norm(vectors[ids("unseen rare vocabulary here")], axis=1), 1)


def test_vectors_are_sums_over_all_texts(spark):
    """Whatever the partitions; against brute force."""
    texts = ["a b c a", "", "b b d", "e", "c a b " * 300]
    dims, signs = quality._index_vectors(1 << quality.BITS, quality.WORD_DIM, 11)
    want = np.zeros((1 << quality.BITS, quality.WORD_DIM))
    for own in map(ids, texts):
        for i, here in enumerate(own):
            for k in range(max(0, i - quality.WINDOW), min(len(own), i + quality.WINDOW + 1)):
                if k != i:
                    np.add.at(want[here], dims[own[k]], signs[own[k]])
    length = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, length, out=np.zeros_like(want), where=length > 0)
    for parts in (1, 3):
        got = quality.random_indexing(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts))
        assert np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("place", [0, 1, 5])
def test_overlong_text_is_passed_over(corpus, monkeypatch, place):
    docs, labels = corpus
    chosen = labels.where(~quality.common.held_out()).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    long = chosen[place]["doc_id"]
    seen = []
    monkeypatch.setattr(quality, "train", lambda texts, y, *_: seen.append((len(texts), set(y.tolist()), max(map(len, texts)))))
    quality.fit(docs.withColumn("text", F.when(F.col("doc_id") == long, F.repeat(F.lit("x "), 3000)).otherwise(F.col("text"))), labels, chars=5000)
    assert seen == [(len(chosen) - 1, {0, 1}, seen[0][2])] and seen[0][2] < 100
    quality.fit(docs.withColumn("text", F.repeat(F.lit("x "), 3000)), labels, chars=5000)
    assert seen[1][0] == 1
