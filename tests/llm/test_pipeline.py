import random

import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_near_dedup import classes

rng = random.Random(12)
WORDS = {"en": ["the", "and", "with", "house", "thing", "over", "night", "which"], "fr": ["le", "être", "avec", "maison", "où", "pour", "nuit", "garçon"]}


def prose(lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "al", "er"]) for _ in range(n)) + "."


def test_run_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    items = [(i, prose("en", 12) + " " + prose("en", 6)) for i in range(5)]
    texts = []
    for i in range(120):
        lang = rng.choice(["en", "fr"])
        kind = rng.random()
        text = prose(lang, rng.randint(60, 120))
        if kind < 0.2 and texts:
            text = rng.choice(texts)[0]
        elif kind < 0.4 and texts:
            text = (rng.choice(texts)[0] or "") + " " + prose(lang, 2)
        elif kind < 0.5:
            text += "\n" + rng.choice(items)[1]
        elif kind < 0.55:
            text = rng.choice(["12345 678", "", None, "?!"])
        texts.append((text, lang))
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    kept = {i: t for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    kept = {i: t for i, t in kept.items() if i == max(j for j, u in kept.items() if u == t)}
    ids = sorted(kept)
    kept = {i: kept[i] for k, i in enumerate(ids) if classes([kept[j] for j in ids])[k] == k}
    kept = {i: t for i, t in kept.items() if not any(item in t for _, item in items)}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(out) == sorted(kept)
    for i, t in kept.items():
        assert [int.from_bytes(out[i].ids[k : k + 4], "little") for k in range(0, len(out[i].ids), 4)] == library.encode(t, add_special_tokens=False).ids

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name


def test_odd_rows_pass_every_stage(spark, tmp_path):
    import corpus_pipeline

    long = " ".join(prose("en", 40) for _ in range(200))
    rows = [(1, None, None, None, None), (None, prose("en", 30), "en", None, 1), (3, "", "en", "s", 0), (3, "", "en", "s", 0), (4, long, "en", "s", 1), (5, long + " x", None, "s", 1), (6, "12 34", "en", "s", 1), (7, prose("fr", 30), "fr", "s", 1), (7, prose("fr", 30), "fr", "s", 1), (8, prose("fr", 25), "fr", "s", 1)]
    rows.append(rows[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(0, None), (1, ""), (2, prose("en", 9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table, want in ((docs, ["4", "7", "7", "8", "None"]), (docs.limit(0), []), (docs.where("text IS NULL"), [])):
        stage = table
        for _, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, str(tmp_path))
            assert stage.columns == docs.columns
        out = corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path))
        assert sorted(str(r.doc_id) for r in out.collect()) == want


def test_clashing_columns_pass_every_stage(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, prose(lang, 30), lang, "s", 0.25 * i, "own", [i], i, 2 * i, None if i % 3 else "x") for i in range(40) for lang in ["en" if i % 2 else "fr"]]
    names = ["doc_id", "text", "lang", "source", "score", "lang_pred", "leaks", "n_tokens", "rank", "digest"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, lang_pred string, leaks array<int>, n_tokens int, rank long, digest string")
    spark.createDataFrame([(0, prose("en", 9))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert [(x.name, x.dataType) for x in stage.schema] == [(x.name, x.dataType) for x in docs.schema], name
    assert sorted(tuple(r) for r in stage.collect()) == sorted(rows) and stage.columns == names
    assert corpus_pipeline.STAGES[-1][1](spark, stage, str(tmp_path)).count() == 40
