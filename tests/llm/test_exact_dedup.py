import hashlib
import random
from collections import defaultdict

from veldmark.llm.exact_dedup import CuckooIndex, distinct_documents, exact_dedup


def test_index_is_a_map():
    rng = random.Random(1)
    index, plain = CuckooIndex(2), {}
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for step in range(20_000):
        key = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(key) == (plain.pop(key, None) is not None)
        else:
            index.put(key, step)
            plain[key] = step
        assert index.size == len(plain)
    assert dict(index.items()) == plain
    assert all(index.get(k) == plain.get(k) for k in keys)


def test_equal_fingerprints_need_equal_keys():
    index = CuckooIndex(1)
    keys = [bytes([i]) * 16 + b"xx" + bytes(14) for i in range(8)]  # one fingerprint, one bucket: as many as its two buckets hold
    for i, k in enumerate(keys):
        index.put(k, i)
    assert [index.get(k) for k in keys] == list(range(8)) and index.get(b"y" * 16 + b"xx" + bytes(14)) is None
    more = [bytes([i]) * 16 + b"xx" + bytes([i] * 14) for i in range(100)]  # one fingerprint, many buckets
    for i, k in enumerate(more):
        index.put(k, i)
    assert [index.get(k) for k in more] == list(range(100))


def test_fingerprints_set_most_misses_aside():
    """Among digests of one sorting prefix, as in the second index, few absent ones meet an equal fingerprint."""
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(40_000)]
    digests = [b"\x12\x34" + d[2:] for d in digests]
    index, hits = CuckooIndex(), 0
    for d in digests[:20_000]:
        index.put(d, 0)
    assert len(set(index.prints)) > 10_000
    for d in digests[20_000:]:
        mark, one = index._print(d), index._first(d)
        slots = {b * 4 + k for b in (one, index._other(one, mark)) for k in range(4)}
        hits += any(index.prints[s] == mark for s in slots)
        assert index.get(d) is None
    assert hits / 20_000 < 0.001


def test_groups(spark, odd_docs):
    rows = exact_dedup(odd_docs).collect()
    by = defaultdict(list)
    for r in odd_docs.collect():
        by[r.text or ""].append(r.doc_id)
    assert len(rows) == odd_docs.count()
    for text, ids in by.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [r for r in rows if r.text_sha256 == sha]
        keep = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in own)
        assert all(r.keep_id == keep and r.group_size == len(ids) for r in own)
        assert [r.doc_id for r in own if r.kept] == [keep]
    kept = distinct_documents(odd_docs)
    assert kept.count() == len(by) and kept.columns == odd_docs.columns
    assert exact_dedup(odd_docs.limit(0)).count() == 0


def test_clashing_names(spark):
    from veldmark.llm.near_dedup import distinct_documents as near_distinct
    from veldmark.llm.suffix_dedup import without_repeats

    rows = [(1, "a b c d e f", "k", 1.5, None, 7), (2, "a b c d e f", "k", 1.5, None, 7), (2, "a b c d e f", "k", 1.5, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, digest double, none string, rank int")
    for run, n in ((distinct_documents, 1), (near_distinct, 1), (without_repeats, 3)):
        out = run(docs)
        assert out.columns == docs.columns and out.count() == n
