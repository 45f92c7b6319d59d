"""Licenses against plain searches: every position of every notice, every cell of every alignment."""

import random

import numpy as np
import pytest

from veldmark.llm import licenses as li
from veldmark.llm._text import words

rng = random.Random(9)
VOCAB = [a + b for a in ("ba", "do", "ki", "mu", "re", "sa") for b in ("", "n", "lo", "tri", "va")]


def prose(n):
    return " ".join(rng.choice(VOCAB) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def index():
    return li.Index(li.common_templates())


def found(index, text):
    return li.matches(index, [text])[0]


def names(index, text):
    return {r["license"] for r in found(index, text) if r["coverage"] >= li.LEAST_COVERAGE}


def test_winnow_covers_every_window():
    for _ in range(200):
        n = rng.randint(0, 30)
        grams = np.array([rng.randrange(6) for _ in range(n)], np.uint64)
        picked = set(li.winnow(grams, np.array([0, n])).tolist())
        for i in range(n - 1):
            assert {i, i + 1} & picked


def best_score(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def score_of(a, b, first, last):
    """The score of the best alignment of all of b[first : last + 1] with some part of a."""
    part = b[first : last + 1]
    h = np.zeros((len(a) + 1, len(part) + 1), int)
    h[:, 1:] = -np.arange(1, len(part) + 1)
    for i in range(len(a)):
        for j in range(len(part)):
            h[i + 1, j + 1] = max(h[i, j] + (2 if a[i] == part[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h[:, -1].max())


def test_alignment_equals_full_matrix():
    for _ in range(400):
        a = np.array([rng.randrange(4) for _ in range(rng.randint(1, 9))])
        b = np.array([rng.randrange(4) for _ in range(rng.randint(1, 9))])
        score, n, first, last = li.align(a, b, 0)
        assert score == best_score(a, b)
        if n:
            assert score_of(a, b, first, last) == score and b[first] in a and b[last] in a and (score + 1) // 2 <= n <= min(len(a), last - first + 1)
        else:
            assert score == 0


def plain(index, text):
    """Notices by comparing at every word; other templates by a full alignment of the whole text, whose score is given."""
    own = words([text]).hashes
    exact, scores = set(), {}
    for k, template in enumerate(index.words):
        if index.notice[k]:
            exact |= {(k, i) for i in range(len(own) - len(template) + 1) if own[i] == template[0] and np.array_equal(own[i : i + len(template)], template)}
        elif len(set(own.tolist()) & set(template.tolist())) > 3:
            scores[k] = best_score(template, own)
    return exact, scores


def edited(text):
    out = text.split()
    for _ in range(rng.randint(0, len(out) // 25)):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [rng.choice(VOCAB)], [out[i], rng.choice(VOCAB)]])
    return " ".join(out)


def test_equal_to_plain_search(index):
    short = [k for k, own in enumerate(index.words) if not index.notice[k] and len(own) <= 90]
    notices = [k for k in range(len(index.words)) if index.notice[k]]
    for _ in range(25):
        picked = rng.sample(notices, rng.randint(0, 3))
        one = rng.choice(short)
        text = " ".join([prose(rng.randint(1, 9)), *(f"{rng.choice(['Licensed', 'Released', ''])} {index.templates[k].text} {prose(rng.randint(1, 9))}" for k in picked), edited(index.templates[one].text), prose(5)])
        exact, scores = plain(index, text)
        got = list(li._aligned(index, words([text]).hashes))
        assert {(m.template, m.first) for m in got if index.notice[m.template]} == exact and len(exact) >= len(picked)
        # the copy is found with the score that the full matrix has
        own = words([text]).hashes
        mine = [m for m in got if m.template == one]
        assert mine and max(score_of(index.words[one], own, m.first, m.last) for m in mine) == scores[one]
        # and whatever a full alignment would report as whole is reported, or lies in what stays
        kept = li.settled(index, got)
        for k, score in scores.items():
            if score >= 2 * li.LEAST_COVERAGE * len(index.words[k]):
                assert any(m.template == k for m in got), index.templates[k]
        assert any(m.template == one or index.templates[m.template].license == index.templates[one].license for m in kept)


def test_texts_are_whole(index):
    for k, t in enumerate(index.templates):
        if t.notice:
            continue
        body = f"É {prose(30)}\n# {t.text}\n{prose(30)}"
        rows = found(index, body)
        assert [(r["license"], r["coverage"]) for r in rows] == [(t.license, 1.0)]
        assert words([body[rows[0]["start"] : rows[0]["end"]]]).hashes.tolist() == index.words[k].tolist()
    assert found(index, prose(50)) == []


@pytest.mark.parametrize(
    ("text", "license"),
    [
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("distributed under the terms of the GNU Lesser General Public License v2.1", "LGPL-2.1"),
        ("is available under the 3-clause BSD license", "BSD-3-Clause"),
        ("under the GNU GPL v2", "GPL-2.0"),
    ],
)
def test_notices_by_name(index, text, license):
    assert names(index, f"{prose(20)} {text} {prose(20)}") == {license}
    assert names(index, f"{prose(20)} {text.replace('under', 'over')} {prose(20)}") == set()


def test_families_and_parts(index):
    texts = {t.license: t.text for t in index.templates if not t.notice and len(t.text) > 600 and t.license != "Apache-2.0"}
    three, two = texts["BSD-3-Clause"], texts["BSD-2-Clause"]
    assert names(index, three.replace("the copyright holder nor", "Foo Corporation nor")) == {"BSD-3-Clause"} and names(index, two) == {"BSD-2-Clause"}
    assert names(index, "MIT License\n\n" + texts["MIT"].replace("free of charge", "at no cost").replace("merge, ", "")) == {"MIT"}
    for license in ("GPL-2.0", "LGPL-2.1", "AGPL-3.0"):
        text = next(t.text for t in index.templates if t.license == license and not t.notice and "WARRANTY" in t.text)
        assert names(index, "\n * ".join(text.split(". "))) == {license}
    part = " ".join(texts["Zlib"].split()[:60])
    rows = found(index, f"{prose(9)} {part} {prose(9)}")
    assert [r["license"] for r in rows] == ["Zlib"] and rows[0]["matched_words"] == len(words([part]).hashes) and 0.3 < rows[0]["coverage"] < 0.6
    both = f"{texts['Zlib']} {prose(40)} {texts['ISC']} {prose(3)} {texts['ISC']}"
    assert [r["license"] for r in found(index, both)] == ["Zlib", "ISC", "ISC"]


def test_scan_of_odd_rows(spark, odd_docs):
    assert li.license_scan(odd_docs).where("n_licenses > 0").count() == 0 and li.license_scan(odd_docs).count() == odd_docs.count()
    assert li.license_scan(odd_docs.limit(0)).count() == 0
    text = "x " * 600_000 + "Released under the MIT License. " + "y " * 600_000
    docs = spark.createDataFrame([(1, text, "own", 3), (1, text, None, 4), (None, "Released under the MIT License", "own", 5)], "doc_id long, text string, licenses string, found int")
    rows = li.license_scan(docs).collect()
    assert sorted((str(r.doc_id), r.licenses, r.partial, r.spans) for r in rows) == [("1", "MIT", "", "MIT:1200009:1200030")] * 2 + [("None", "MIT", "", "MIT:9:30")]
