import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from veldmark.llm import suffix_dedup as sd

rng = random.Random(8)


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def noise(n):
    return "".join(rng.choice("abcdefg é\n") for _ in range(n))


def sample():
    texts = []
    pool = [noise(rng.randint(30, 300)) for _ in range(8)]
    for _ in range(40):
        texts.append("".join(noise(rng.randint(0, 60)) if rng.random() < 0.5 else rng.choice(pool)[rng.randint(0, 20) :] for _ in range(rng.randint(1, 6))))
    texts += [texts[3], texts[3], texts[5] + "x", "x" + texts[5], "a" * 700, "b" * 90, "ab" * 200, "abc" * 50, None, "", "q" * 41, "q" * 40]
    return texts


def test_least_in_window():
    keys = np.array([rng.randrange(1000) for _ in range(100)], np.uint64)
    for width in (1, 2, 7, 100):
        assert sd.least_in_window(keys, width).tolist() == [min(keys[i : i + width].tolist()) for i in range(100 - width + 1)]


def test_equal_windows_have_equal_anchors():
    texts = [t.encode() for t in sample() if t and len(t.encode()) >= 40]
    found = sd.Anchored(texts, 40, 8)
    offset = {}
    covered = 0
    for lo, hi, at in zip(found.lo, found.hi, found.at, strict=True):
        for p in range(lo, hi + 1):
            covered += 1
            assert 0 <= at - p <= 32
            assert offset.setdefault(found.data[p : p + 40], at - p) == at - p
    assert covered == sum(len(t) - 39 for t in texts)


@pytest.mark.parametrize("length", [8, 11, 40, 64, 100])
def test_refined_buckets(length):
    contexts = [c for t in sample() if t and len(c := t.encode()) >= length]
    seen = Counter(c[i : i + length] for c in contexts for i in range(len(c) - length + 1))
    got = sd.refine(contexts, length)
    assert [g.tolist() for g in got] == [[seen[c[i : i + length]] > 1 for i in range(len(c) - length + 1)] for c in contexts]
    assert sd.refine([], length) == []


@pytest.mark.parametrize("hot", [8000, 2])
def test_equal_to_brute_force(spark, hot):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sorted(sd.suffix_dedup(docs, length=40, q=8, hot=hot).collect())
    assert [tuple(r)[1:5] for r in rows] == brute(texts, 40)
    for r, text in zip(rows, texts, strict=True):
        runs = [tuple(map(int, x.split(":"))) for x in r.spans.split(",") if x]
        data, at, kept = (text or "").encode(), 0, []
        for a, b in runs:
            assert at <= a < b
            kept.append(data[at:a])
            at = b
        assert len(runs) == r.n_spans and hashlib.sha256(b"".join(kept) + data[at:]).hexdigest() == r.kept_sha256
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("veldmark")]


def test_production_length_and_pieces(spark, monkeypatch):
    base = noise(3000)
    texts = [base, noise(500) + base[700:1400] + noise(300), base[100:499], base[:200] + base[600:1100], noise(450)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [tuple(r)[1:5] for r in sorted(sd.suffix_dedup(docs).collect())] == brute(texts, 400)
    data = [t.encode() for t in texts]
    whole = sd.Anchored(data)
    monkeypatch.setattr(sd, "PIECE", 333)
    pieces = sd.Anchored(data)
    spread = lambda f: {(p, a) for lo, hi, a in zip(f.lo.tolist(), f.hi.tolist(), f.at.tolist(), strict=True) for p in range(lo, hi + 1)}
    assert spread(whole) == spread(pieces)


def test_odd_rows(spark, odd_docs):
    rows = sd.suffix_dedup(odd_docs).collect()
    assert sorted(tuple(r)[1:5] for r in rows) == sorted(brute([r.text for r in odd_docs.collect()], 400))
    assert sd.suffix_dedup(odd_docs.limit(0)).count() == 0
    kept = sd.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 6").first().text == "some words here to read" and kept.where("doc_id = 4").first().text == ""
