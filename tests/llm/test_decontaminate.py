import math
import pickle
import random
from collections import Counter

import numpy as np

from veldmark.llm import decontaminate as dc
from veldmark.llm.decontaminate import clean, contaminated, leaks, wand
from veldmark.llm._text import shingles, words

rng = random.Random(9)
VOCAB = [a + b for a in ("ba", "do", "ki", "mu", "re", "sa") for b in ("", "n", "lo", "tri", "va")]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


def build(items):
    """A shard whose items are the whole benchmark."""
    parts = [(i, *own) for i, q, a in items for own in dc.pieces(q, a)]
    counted = [np.unique(np.concatenate([q, a]), return_counts=True) for _, q, a in parts]
    df = Counter(int(t) for terms, _ in counted for t in terms)
    entries = [dc.Entry(i, q, a, terms, n, np.array([df[int(t)] for t in terms])) for (i, q, a), (terms, n) in zip(parts, counted, strict=True) if len(terms)]
    return dc.build(entries, len(entries), float(np.mean([e.size for e in entries])))


def test_wand_is_exhaustive():
    items = [(i, prose(rng.randint(3, 15)), prose(4)) for i in range(70)] + [(100 + i, prose(rng.randint(70, 90)), prose(4)) for i in range(9)]
    shard = build(items)
    assert [c.most for c in shard.classes] == [64, 256]
    for index in shard.classes:
        for _ in range(200):
            terms = np.unique(shard.lookup(words([prose(rng.randint(1, 25))]).hashes))
            terms = terms[terms >= 0]
            want = np.zeros(len(index.item_ids))
            for t in terms:
                for p in range(index.posting_at[t], index.posting_at[t + 1]):
                    want[index.posting_item[p]] += index.posting_impact[p]
            for least in (0.05, 0.2, 0.5):
                got = wand(index, terms, least)
                assert [i for i, _ in got] == np.flatnonzero(want >= least - 1e-6).tolist()
                assert np.allclose([s for _, s in got], want[[i for i, _ in got]])
                assert not got or list(dc._over(index, terms, np.array([0]), least)) == [0]


def test_leaks_are_found_in_any_place():
    items = [(i, prose(12), prose(5)) for i in range(50)]
    shard = build(items)
    texts, want = [], []
    for _ in range(300):
        i = rng.randrange(50)
        leak = rng.random() < 0.5
        texts.append(prose(rng.randint(0, 320)) + " " + (f"{items[i][1]} {items[i][2]}" if leak else "") + " " + prose(rng.randint(0, 120)))
        want.append([i] if leak else [])
    assert [[r["item_id"] for r in x] for x in leaks(shard, texts)] == want
    # every other word replaced: retrieved perhaps, but not verified
    q = items[0][1].split()
    q[::2] = ["zzz"] * len(q[::2])
    assert leaks(shard, [" ".join(q)]) == [[]]


def plain_leaks(items, text):
    """Every passage scored against every item, every stretch of it looked at, with dictionaries alone."""
    own = lambda t: words([t]).hashes.tolist()
    docs = [(i, own(q), own(a)) for i, q, a in items]
    docs = [d for d in docs if d[1] + d[2]]
    df = Counter(t for _, q, a in docs for t in {*q, *a})
    mean = sum(len(q + a) for _, q, a in docs) / len(docs)
    hashes, best = own(text), {}
    grams = lambda h, k: [tuple(h[i : i + k]) for i in range(len(h) - k + 1)] if k else []
    for i, q, a in docs:
        counts, n = Counter(q + a), len(q + a)
        impact = {t: math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) for t, c in counts.items()}
        most = 64
        while most < n:
            most *= 4
        step, width = -(-most * 5 // 4), -(-n * 5 // 4)
        for start in range(0, len(hashes), step):
            here = hashes[start : start + 2 * step]
            score = sum(impact[t] for t in set(here) & set(impact)) / sum(impact.values())
            if score < 0.6:
                continue
            sets = [set(grams(part, min(5, len(part)))) for part in (q, a)]
            for s in range(len(here)):
                shares = [len(whole & set(grams(here[s : s + width], min(5, len(part))))) / len(whole) if whole else 1.0 for whole, part in zip(sets, (q, a), strict=True)]
                if min(shares) >= 0.8:
                    best[i] = max(best.get(i, 0), score)
    return best


def test_equal_to_scoring_every_passage():
    items = [(i, prose(rng.randint(2, 30)), prose(rng.randint(1, 8))) for i in range(25)] + [(50 + i, prose(rng.randint(60, 100)), prose(9)) for i in range(4)]
    shard, found = build(items), 0
    for _ in range(150):
        text = prose(rng.randint(0, 90)).split()
        for _ in range(rng.randint(0, 3)):
            _, q, a = rng.choice(items)
            part = f"{q} {prose(rng.randint(1, 6)) if rng.random() < 0.3 else ''} {a}".split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(VOCAB)
            text += part + prose(rng.randint(0, 90)).split()
        got, want = {r["item_id"]: r["score"] for r in leaks(shard, [" ".join(text)])[0]}, plain_leaks(items, " ".join(text))
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)
        found += len(want)
    assert found > 50


def test_other_items_change_nothing(spark, monkeypatch):
    items = [(i, f"{prose(14)} {prose(5)}") for i in range(12)]
    other = lambda n, size: [(1000 + i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(size)) + ".") for i in range(n)]
    texts = [(k, prose(40) + " " + items[k][1] + " " + prose(70)) for k in range(12)]
    q, a = dc.question_and_answer(items[3][1])
    texts.append((20, f"{q} {prose(80)} {a}"))
    docs = spark.createDataFrame([*texts, (30, prose(200))], "doc_id long, text string")
    results = []
    for more, limit in ((other(0, 0), 2048), (other(1, 400), 2048), (other(7, 30), 3), (other(600, 12), 2048), (other(5000, 12), 2048)):
        monkeypatch.setattr(dc, "SHARD_ITEMS", limit)
        bench = spark.createDataFrame(items + more, "item_id long, text string")
        results.append(sorted((r.doc_id, r.item_id, r.question_overlap, r.answer_overlap, r.from_word, r.to_word) for r in contaminated(docs, bench).collect()))
    assert [r[:2] for r in results[0]] == [(k, k) for k in range(12)]
    assert all(r == results[0] for r in results)


def test_size_of_an_index():
    vocabulary = [f"t{i}" for i in range(80_000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(90)), " ".join(rng.choice(vocabulary) for _ in range(6))) for i in range(2048)]
    assert len(pickle.dumps(build(items))) < 20 << 20


def test_long_items_are_found_by_a_piece(monkeypatch):
    monkeypatch.setattr(dc, "PIECE", 50)
    long = [prose(40) for _ in range(4)]
    shard = build([(1, " ".join(long), prose(4)), (2, prose(10), prose(3))])
    assert [r["item_id"] for r in leaks(shard, [prose(30) + " " + " ".join(long[:3])])[0]] == [1]
    assert leaks(shard, [prose(30) + " " + long[0][:60]]) == [[]]


def test_contaminated(spark, odd_docs):
    bench = spark.createDataFrame([(7, "Some words here to read"), (8, None), (9, ""), (7, "zzz")], "item_id long, text string")
    rows = contaminated(odd_docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == [("6", 7), ("None", 7)]
    kept = clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
    assert clean(odd_docs, bench.limit(0)).count() == odd_docs.count()
    assert contaminated(odd_docs.limit(0), bench).count() == 0


def test_clashing_names_and_long_texts(spark):
    bench = spark.createDataFrame([(7, "Some words here to read")], "item_id long, text string")
    rows = [(1, "Some words here to read", "own", [1.5], 3), (2, "x " * 700_000, "own", None, 4), (3, "y " * 700_000 + "some words here to read", None, [2.5], 5), (2, None, "own", [0.5], 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, leaks string, `item.id` array<double>, c0 int")
    kept = clean(docs, bench)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    assert sorted((r[4], r[0], r[2], r[3]) for r in kept.collect()) == [(4, 2, "own", None), (6, 2, "own", [0.5])]
    marked = dc.annotate(docs, bench)
    assert marked.columns == [*docs.columns, "leaks_"]
    assert {r.c0: ([x.item_id for x in r.leaks_], r.leaks) for r in marked.collect()} == {3: ([7], "own"), 4: ([], "own"), 5: ([7], None), 6: ([], "own")}


def test_shingles():
    h = words(["a b c d e f"]).hashes
    assert len(shingles(h, 5)) == 2 and (shingles(words(["x a b c d e f"]).hashes, 5)[1:] == shingles(h, 5)).all()
