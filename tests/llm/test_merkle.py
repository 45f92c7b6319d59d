import hashlib
import zlib
from collections import defaultdict

import pytest

from veldmark.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, way in enumerate(paths):
            start = at[i] // 3 * 3
            way.append((nodes[start : at[i]], nodes[at[i] + 1 : start + 3]))
            at[i] //= 3
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        text = r[4]
        if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        groups[r[1]].append(((r[0] is not None, r[0] or 0), digest(*map(value, r)), digest(*map(value, (*r[:4], text))), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        trees[name] = tree([x[1] for x in groups[name]])
    root, upper = tree([trees[n][0] for n in names])
    out = []
    for name, rest in zip(names, upper, strict=True):
        for (_, leaf, changed, i), way in zip(groups[name], trees[name][1], strict=True):
            at, way = changed, way + rest
            for before, after in way:
                at = digest(*before, at, *after)
            out.append((i, leaf, trees[name][0], root, digest(*[d for a, b in way for d in a + b]), at, at == root))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in merkle.merkle(df, **options).collect()), key=repr)


def documents():
    rows = [(i, f"s{i % 4}" if i % 3 else "hot", "en", i * 7, f"line {i}\nand {i % 5}\n") for i in range(200)]
    rows += [(7, "hot", None, None, None), (None, "hot", "en", 3, "a\nb"), (None, None, None, None, None), (5, None, "de", 1, ""), (5, "", "de", 1, "é\n" * 40_000)]
    return rows + [rows[3], rows[3], (3, "hot", "en", 21, "another text")]


@pytest.mark.parametrize("options", [{}, {"depth": 1, "top": 400}, {"depth": 1, "top": 3}, {"depth": 2, "top": 8}])
def test_same_as_a_plain_tree(spark, options):
    rows = documents()
    assert found(spark.createDataFrame(rows, COLUMNS), **options) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_small_trees(spark, n):
    rows = [(i, "one", None, i, "x\n" * (i % 2)) for i in range(n)]
    assert found(spark.createDataFrame(rows, COLUMNS), depth=2) == plain(rows)


def test_many_sources(spark):
    """More roots of sources than the driver takes: they are reduced by tasks too."""
    rows = [(i, f"source {i % 50}", "en", i, f"t{i}\n") for i in range(120)]
    assert found(spark.createDataFrame(rows, COLUMNS), depth=1, top=6) == plain(rows)


def test_empty_table_and_other_columns(spark):
    assert found(spark.createDataFrame([], COLUMNS)) == []
    rows = [(1, "a", "en", 3, "x\ny"), (2, "a", "en", 3, "xy")]
    clash = spark.createDataFrame([(*r, "q", 1.0) for r in rows], COLUMNS + ", root string, leaf double")
    assert found(clash) == plain(rows)


def test_only_line_feeds_are_tampered_with(spark):
    rows = [(i, "a", "en", 3, f"text {i}" + "\n" * (i % 3)) for i in range(60)]
    for r in found(spark.createDataFrame(rows, COLUMNS)):
        assert r[6] == (zlib.crc32(str(r[0]).encode()) % 2 == 1 or r[0] % 3 == 0)
