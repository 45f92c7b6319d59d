"""Texts of over a megabyte, ties and repeats, through operators whose other tests have short ones."""

import hashlib
import random

import numpy as np

from veldmark.llm import exact_dedup, near_dedup, quality, suffix_dedup

rng = random.Random(21)
WORDS = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(3000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


LONG = prose(220_000)
COPY = LONG.split()
COPY[500], COPY[90_000] = "changed", "words"
COPY = " ".join(COPY) + " end."
OTHER = prose(200_000)
ROWS = [(1, LONG), (2, COPY), (3, OTHER), (3, OTHER), (None, LONG), (4, None), (5, "")]


def table(spark):
    return spark.createDataFrame([(i, t, "own", 1.5, "x") for i, t in ROWS], "doc_id long, text string, kept string, score double, spans string")


def test_repeated_substrings(spark):
    assert len(LONG) > 1 << 20
    data = [(t or "").encode() for _, t in ROWS]
    seen, again = set(), set()
    for d in data:
        for i in range(len(d) - 399):
            h = hash(d[i : i + 400])
            (again if h in seen else seen).add(h)
    want = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - 399):
            if hash(d[i : i + 400]) in again:
                gone[i] += 1
                gone[i + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        want.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.suffix_dedup(table(spark)).collect()
    assert sorted(tuple(r)[1:5] for r in got) == sorted(want)
    assert suffix_dedup.without_repeats(table(spark)).columns == ["doc_id", "text", "kept", "score", "spans"]


def test_copies(spark):
    near = {(r.doc_id, r.class_id, r.class_size, r.kept) for r in near_dedup.near_dedup(table(spark)).collect()}
    assert near == {(1, 1, 3, True), (2, 1, 3, False), (None, 1, 3, False), (3, 3, 2, True), (3, 3, 2, False), (4, 4, 1, True), (5, 5, 1, True)}
    exact = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(table(spark)).collect())
    assert exact == [("1", 1, 2, True), ("2", 2, 1, True), ("3", 3, 2, False), ("3", 3, 2, True), ("4", 5, 2, False), ("5", 5, 2, True), ("None", 1, 2, False)]


def test_quality_of_long_and_repeated_texts(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, 0), (5, None)], "doc_id long, quality int")
    got = quality.quality(table(spark), labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    by_text = {}
    for r in got:
        text = next(t or "" for i, t in ROWS if i == r.doc_id)
        by_text.setdefault(text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
