import random

import numpy as np
import pytest

from veldmark.llm import near_dedup as nd

rng = random.Random(4)
VOCAB = [a + b for a in ("ba", "do", "ki", "mu", "re", "sa", "tu") for b in ("", "n", "lo", "tri", "va", "x")]


def prose(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def counted(text):
    grams, count, _ = nd.weighted_shingles([text])
    return grams, count


def plain(a, b):
    a, b = dict(zip(*map(np.ndarray.tolist, a), strict=True)), dict(zip(*map(np.ndarray.tolist, b), strict=True))
    every = {*a, *b}
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in every) for i in a if i in b)


def sample():
    texts = []
    for _ in range(25):
        base = prose(rng.randint(3, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCAB)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else " ".join(copy) + "!")
    texts += ["a b c", "A, b; c.", "the the the the the the the", "", None, "  "]
    return texts


def test_probability_jaccard():
    for _ in range(200):
        a, b = prose(rng.randint(1, 30)), prose(rng.randint(1, 30))
        b = (a[: rng.randint(0, len(a))] + b) * rng.randint(1, 2)
        x, y = counted(" ".join(a)), counted(" ".join(b))
        assert abs(nd.probability_jaccard(x, y) - plain(x, y)) < 1e-9


def test_signatures_estimate_it():
    base = prose(200)
    other = base[:150] + prose(60) + base[:20]
    texts = [" ".join(base), " ".join(other), "ba do ki"]
    grams, count, first = nd.weighted_shingles(texts)
    signature = nd.prob_min_hash(grams, count, first, 4000)
    want = plain(counted(texts[0]), counted(texts[1]))
    assert abs((signature[0] == signature[1]).mean() - want) < 0.04
    alone = nd.prob_min_hash(*counted(texts[1]), np.array([0, len(counted(texts[1])[0])]), 4000)
    assert (alone[0] == signature[1]).all()


def classes(texts, least=0.8):
    sets = [counted(t or "") for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and plain(sets[i], sets[j]) >= least - 1e-12:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_classes_equal_brute_force(spark):
    texts = sample()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = sorted(nd.near_dedup(docs).collect())
    want = classes(texts)
    assert [r.class_id for r in rows] == want
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == want.count(r.class_id) for r in rows)
    kept = nd.distinct_documents(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_chain_of_links(spark):
    """Neighbours are alike, the ends are not; and buckets whose least node is like none of the others."""
    base = prose(120)
    texts = []
    for i in range(12):
        texts.append(" ".join(prose(i * 4) + base[i * 4 :]))
    for i in range(40):
        texts.append(" ".join(base[:90] + prose(5) + prose(i % 3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = classes(texts)
    assert [r.class_id for r in sorted(nd.near_dedup(docs).collect())] == want
    assert [r.class_id for r in nd.near_groups(docs, block=900).orderBy("id").collect()] == want


def test_across_components():
    base = prose(60)
    texts = [" ".join(base[: i % 50] + [f"x{i}", f"y{i % 7}"] + base[i % 50 + i % 3 :]) for i in range(90)] + ["ba do ki ba do ki ba do ki ba do ki " * 3, "ba do ki ba do ki ba do ki ba do ki " * 4]
    roots = [i if i % 4 else 0 for i in range(len(texts))]
    rows = [(i, False, roots[i], t) for i, t in enumerate(texts)] + [(i, True, roots[i], t) for i, t in enumerate(texts) if roots[i]]
    sets = [counted(t) for t in texts]
    merged = list(roots)
    for a, b in nd.across_components(rows):
        assert plain(sets[a], sets[b]) >= 0.8 - 1e-9
        x, y = sorted((merged[a], merged[b]))
        merged = [x if r == y else r for r in merged]
    for i in range(len(texts)):
        for j in range(i):
            if merged[i] != merged[j]:
                assert plain(sets[i], sets[j]) < 0.8


def test_a_repeated_line_is_no_copy(spark):
    line = " Is onhe." * 300
    texts = [" ".join(prose(60)) + line, " ".join(prose(60)) + line]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.class_id for r in nd.near_dedup(docs).collect()) == [0, 1]


def test_odd_rows(spark, odd_docs):
    rows = nd.near_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[6][0].kept and not by[None][0].kept and by[None][0].class_id == 6 and by[6][0].class_size == 2
    assert all(r.kept for r in by[2]) and by[1][0].kept
    assert nd.distinct_documents(odd_docs).count() == odd_docs.count() - 1
    assert nd.near_dedup(odd_docs.limit(0)).count() == 0
    twice = odd_docs.where("doc_id = 5").union(odd_docs.where("doc_id = 5"))
    assert sorted(r.kept for r in nd.near_dedup(twice).collect()) == [False, True]
    assert nd.distinct_documents(twice).count() == 1


@pytest.mark.parametrize("step", ["op7_near_dedup", "near_stage"])
def test_no_table_goes_through_the_driver(spark, monkeypatch, step):
    """no join of a loop leaves a broadcast in the driver."""
    import corpus_pipeline
    from veldmark.llm import _common as common
    from veldmark.llm import near_dedup as module

    plans, stored = [], common.stored

    def watched(df, folder, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, folder, name)

    monkeypatch.setattr(common, "stored", watched)
    docs = common.documents(spark, "/root/testdata/sf0.001")
    done = module.near_dedup(docs) if step == "op7_near_dedup" else corpus_pipeline.near_stage(spark, docs, "")
    plans.append(done._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
