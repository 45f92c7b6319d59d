import math
import random
import zlib
from collections import Counter

import numpy as np

from veldmark.llm import _common as common
from veldmark.llm import langid, quality

rng = random.Random(6)
SYLLABLES = {"aa": ["ka", "lo", "mi", "sha"], "bb": ["rü", "ße", "ön", "tch"], "cc": ["ção", "ñe", "que", "ia"]}


def word(lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3)))


def test_language_of_held_out_rows(spark):
    rows = [(i, " ".join(word(k) for _ in range(rng.randint(3, 40))), k) for i in range(300) for k in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # the label of held-out rows is never read
    hidden = docs.withColumn("lang", common.F.when(common.held_out(), "zz").otherwise(common.F.col("lang")))
    got = {r.doc_id: r for r in langid.language_id(hidden).collect()}
    truth = {i: k for i, _, k in rows}
    held = [i for i, r in got.items() if r.held_out]
    assert 40 < len(held) < 110 and all(got[i].lang_pred == truth[i] and 0 <= got[i].score <= 1 for i in held)


def test_batches_do_not_matter():
    texts = ["Ab c", "", "ünï", "a" * 50, "1 2"]
    ids, starts = langid.features(texts)
    for i, t in enumerate(texts):
        alone, _ = langid.features([t])
        stop = starts[i + 1] if i + 1 < len(starts) else ids.shape[1]
        own = [x[x < 1 << langid.BITS].tolist() for x in ids[:, starts[i] : stop]]
        assert own == [x[x < 1 << langid.BITS].tolist() for x in alone]


def test_odd_languages(spark, odd_docs):
    rows = langid.language_id(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 5, 7))
    assert all(r.lang_pred == "und" for r in langid.language_id(odd_docs.withColumn("lang", common.F.lit(None).cast("string"))).collect())
    assert langid.language_id(odd_docs.limit(0)).count() == 0
    assert [bool(langid.LETTER.search(t)) for t in ("½ ² Ⅷ 5 _", "1é", "日")] == [False, True, True]


def test_posterior_is_that_of_plain_counts(spark):
    """Naive Bayes by dictionaries over the same hashed n-grams, with every row taught."""
    rows = [(i, " ".join(word(k) for _ in range(rng.randint(1, 6))), k) for i in range(60) for k in [rng.choice(list(SYLLABLES))]]
    rows += [(100, rows[0][1], rows[0][2]), (100, rows[0][1], rows[0][2]), (101, "?!", "aa"), (102, None, "bb"), (None, "ka lo", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.language_id(docs).collect()
    taught = [(r.text, r.lang, not common_crc(r.doc_id)) for r in docs.collect()]
    grams = lambda t: [int(g) for g in langid.features([t])[0].ravel() if g < 1 << langid.BITS]
    counts = {k: Counter() for k in SYLLABLES}
    n = Counter()
    for text, lang, teaches in taught:
        if teaches and text is not None:
            counts[lang].update(grams(text))
            n[lang] += 1
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id)
        if not text or text == "?!":
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        total = {k: sum(c.values()) + 0.5 * (1 << langid.BITS) for k, c in counts.items()}
        like = {k: math.log(n[k] / sum(n.values())) + sum(math.log((counts[k][g] + 0.5) / total[k]) for g in grams(text)) for k in counts}
        top = max(like.values())
        share = {k: math.exp(v - top) for k, v in like.items()}
        best = max(sorted(share), key=share.get)
        assert r.lang_pred == best and abs(r.score - share[best] / sum(share.values())) < 1e-4


def common_crc(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_clashing_names_and_ties(spark):
    rows = [(1, "ka ka ka", "aa", 0.25, "own"), (2, "rü ße", "bb", None, None), (3, "ka " * 500_000, "aa", 1.5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    model = langid.fit(docs, common.F.lit(True), "doc_id", "text", "lang")
    out = langid.identify(docs, model)
    assert out.columns == [*docs.columns, "lang_pred_", "score_"]
    assert [tuple(r)[:5] for r in sorted(out.collect())] == rows and [r.lang_pred_ for r in sorted(out.collect())] == ["aa", "bb", "aa"]
    kept = langid.told(docs, model, 0.5)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect())) == rows
    # one text, two languages, as often: the first by name
    same = spark.createDataFrame([(i, "ka lo", k) for i, k in ((1, "bb"), (3, "aa"))], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(same, langid.fit(same, common.F.lit(True), "doc_id", "text", "lang")).collect()} == {"aa"}


def test_quality_of_held_out_rows(spark):
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        words = [word("aa") for _ in range(rng.randint(5, 60))]
        if not good:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.quality(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == dict(labels)[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    wrong = marks.withColumn("quality", common.F.when(common.held_out(), 1 - common.F.col("quality")).otherwise(common.F.col("quality")))
    assert sorted(got) == sorted(quality.quality(docs, wrong).collect())


def test_odd_quality(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(odd_docs, none).collect()} == {0.5}
    few = spark.createDataFrame([(4, 1), (5, 0), (5, 1), (None, 1), (6, None), (6, 0), (99, 1)], "doc_id long, quality int")
    rows = quality.quality(odd_docs, few).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(odd_docs.limit(0), few).count() == 0
