import hashlib
import re
from fractions import Fraction

import pytest

from veldmark.llm import mixing


def shared(sizes, weights, share, most):
    """Targets by repeated sharing of what is above: sizes by name."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, open_, target = Fraction(share * sum(sizes.values()), 100), list(order), {}
    while open_:
        level = budget / sum(w[s] for s in open_)
        above = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not above:
            return target | {s: level * w[s] for s in open_}
        for s in above:
            target[s] = Fraction(most * sizes[s])
            budget -= target[s]
        open_ = [s for s in open_ if s not in above]
    return target


def plain(rows, weights=(3, 1, 2), share=150, most=2, seed=0):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sums = {}
    for _, text, source in rows:
        sums[source] = sums.get(source, 0) + size(text)
    targets, out = shared(sums, weights, share, most), []
    for i, text, source in rows:
        rate = float(targets[source]) / sums[source] if sums[source] else 0.0
        key = f"{seed}:{i}" if i is not None else f"{seed}:text:" + hashlib.md5((text or "").encode()).hexdigest()
        draw = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        out.append((i, size(text), sums[source], float(targets[source]), int(rate) + (draw < rate - int(rate))))
    return sorted(out, key=repr)


ROWS = [(i, "word " * (i % 17 + 1), f"s{i % 5}" if i % 3 else "hot") for i in range(300)]
ODD = [(None, "a\x0bb\x0cc d\x1ce 　", None), (None, "another text without id", None), (1, None, "s1"), (2, "", ""), (2, "", ""), (3, " \t\r\n", "nothing"), (4, "x " * 200_000, "long"), (5, "one", "Z"), (5, "one", "Z")]


@pytest.mark.parametrize("options", [{}, {"weights": (1,), "share": 100}, {"weights": (5, 2, 9, 1), "share": 60, "most": 1, "seed": 9}, {"share": 500}])
def test_same_as_repeated_sharing(spark, options):
    rows = ROWS + ODD
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = mixing.allotted(df, **options).select("doc_id", "size", "source_size", "target", "copies").collect()
    want = plain(rows, **options)
    got = sorted((tuple(r) for r in done), key=repr)
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], rel=1e-12)


def test_share_is_met_and_no_source_is_above(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 4}") for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    done = mixing.allotted(df).collect()
    total = sum(r["size"] for r in done)
    assert sum({r["source"]: r["target"] for r in done}.values()) == pytest.approx(1.5 * total)
    for s in {r["source"] for r in done}:
        own = [r for r in done if r["source"] == s]
        assert sum(r["size"] * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.05)
    assert max(r["copies"] for r in done) <= 2


def test_mix_repeats_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    copies = {r["doc_id"]: r["copies"] for r in mixing.allotted(df).collect()}
    mixed = [r["doc_id"] for r in mixing.mix(df).collect()]
    assert {i: mixed.count(i) for i in copies} == copies


def test_clashing_columns_empty_tables_and_no_python(spark):
    df = spark.createDataFrame([(1, "a b", "s", "own", 7)], "doc_id long, text string, source string, size string, copy int")
    assert mixing.allotted(df).columns == [*df.columns, "size_", "source_size", "target", "copies"]
    assert mixing.mix(df).columns == [*df.columns, "copy_"] and mixing.mix(df).count() in (1, 2)
    assert mixing.allotted(df.limit(0)).collect() == []
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
