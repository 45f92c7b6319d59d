"""License scans: winnowed fingerprints pick templates, banded alignment measures them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common
from veldmark.llm._text import Lookup, characters, shingles, words
from veldmark.llm.license_texts import CREATIVE, CREATIVE_VERSIONS, FORMS, GNU, GNU_NOTICE, NAMES, TEXTS

GRAM, WINDOW = 3, 2
BAND = 8
#: Share of a text's words that makes it whole, words of a part that is reported, and the fewest common fingerprints about a diagonal.
LEAST_COVERAGE, LEAST_PART, LEAST_SEEDS = 0.8, 24, 2
#: Words of the shortest notice: two fingerprints' worth.
LEAST_NOTICE = GRAM + WINDOW - 1


class Template(NamedTuple):
    """A notice has to be there word for word; of other texts a part or a changed copy counts as well."""

    license: str
    text: str
    notice: bool


def known_names() -> Iterator[tuple[str, str]]:
    """(license, name) of all licenses that have names."""
    for license, names in NAMES.items():
        yield from ((license, n) for n in names)
    for short, full, abbreviation, versions in GNU:
        for v in versions:
            license = f"{short}-{v if '.' in v else v + '.0'}"
            for name in (f"GNU {full}", f"GNU {abbreviation}", abbreviation):
                for form in dict.fromkeys((f"version {v}", f"v{v}", v, license[len(short) + 1 :], f"v{license[len(short) + 1 :]}", f"version {license[len(short) + 1 :]}")):
                    yield license, f"{name} {form}"
    for terms, full in CREATIVE.items():
        for version, places in CREATIVE_VERSIONS.items():
            license = f"CC-{terms}-{version}"
            yield license, f"CC {terms} {version}"
            for place in places:
                yield license, f"Creative Commons {full} {version} {place}"
                yield license, f"Creative Commons {full} {place} {version}"


def common_templates() -> list[Template]:
    """Texts of common licenses, opening sentences of the GNU notices, and every name in every form of a notice."""
    out = [Template(license, text, False) for license, text in TEXTS]
    opening = GNU_NOTICE[: GNU_NOTICE.index("This {thing} is distributed")]
    for short, full, _, versions in GNU:
        for v in versions:
            for thing in ("program", "library"):
                out.append(Template(f"{short}-{v if '.' in v else v + '.0'}", opening.format(thing=thing, colon=":", comma=",", name=full, version=v), False))
    seen = set()
    for license, name in known_names():
        for form in FORMS:
            text = form.format(name)
            key = tuple(words([text]).hashes.tolist())
            if len(key) >= LEAST_NOTICE and key not in seen:
                seen.add(key)
                out.append(Template(license, text, True))
    return out


def winnow(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Positions of the least hash of each WINDOW hashes in a row, texts apart; the rightmost of equals.

    first: where each text begins among the grams, and the end of the last.
    """
    n = len(grams)
    if not n:
        return np.zeros(0, np.int64)
    best, at = grams.copy(), np.arange(n)
    for shift in range(1, WINDOW):
        later = np.arange(n) + shift
        inside = later < n
        inside[inside] = np.searchsorted(first, later[inside], side="right") == np.searchsorted(first, np.flatnonzero(inside), side="right")
        rows = np.flatnonzero(inside)
        lower = rows[grams[rows + shift] <= best[rows]]
        best[lower], at[lower] = grams[lower + shift], lower + shift
    return np.unique(at)


def prints(grams: np.ndarray) -> np.ndarray:
    """The winnowed positions of a template that any text with a copy of it has, whatever stands around: those of full windows."""
    picked = winnow(grams, np.array([0, len(grams)]))
    if len(grams) < WINDOW:
        return picked
    inside = [lo + WINDOW - 1 - int(np.argmin(grams[lo : lo + WINDOW][::-1])) for lo in range(len(grams) - WINDOW + 1)]
    return np.intersect1d(picked, inside)


class Index:
    """Words of the templates, and an inverted index of their fingerprints."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.words = [words([t.text]).hashes for t in templates]
        grams = [shingles(own, GRAM) for own in self.words]
        picked = [prints(g) for g in grams]
        self.prints = np.array([len(x) for x in picked], np.int64)
        self.notice = np.array([t.notice for t in templates], bool)
        every = np.concatenate([g[x] for g, x in zip(grams, picked, strict=True)] or [np.zeros(0, np.uint64)])
        of = np.repeat(np.arange(len(templates)), self.prints)
        at = np.concatenate([*picked, np.zeros(0, np.int64)])
        order = np.argsort(every, kind="stable")
        keys, first = np.unique(every[order], return_index=True)
        self.lookup = Lookup(keys)
        self.template, self.place, self.begin = of[order], at[order], np.append(first, len(order))


def align(template: np.ndarray, text: np.ndarray, diagonal: int) -> tuple[int, int, int, int]:
    """Best local alignment within BAND of a diagonal: score, matched words, first and last matched word of the text.

    Matches count 2, mismatches and gaps -1 each.
    """
    width = 2 * BAND + 1
    # a cell: score, matched words, first and last of them
    none = (0, 0, -1, -1)
    above, best = [none] * (width + 2), none
    for j, word in enumerate(template):
        row = [none] * (width + 2)
        for b in range(1, width + 1):
            i = j + diagonal + b - 1 - BAND
            if not 0 <= i < len(text):
                continue
            s, n, first, last = above[b]
            if text[i] == word:
                cell = (s + 2, n + 1, i if first < 0 else first, i)
            else:
                cell = (s - 1, n, first, last)
            for s, n, first, last in (above[b + 1], row[b - 1]):
                if s - 1 > cell[0]:
                    cell = (s - 1, n, first, last)
            row[b] = cell if cell[0] > 0 else none
            if row[b][0] > best[0]:
                best = row[b]
        above = row
    return best


class Match(NamedTuple):
    template: int
    words: int
    first: int
    last: int


def _candidates(index: Index, own: np.ndarray) -> Iterator[tuple[int, int]]:
    """(template, diagonal) with enough common fingerprints: all of a notice's on one diagonal, two of a text's within BAND diagonals.

    One diagonal stands for all that an alignment about it covers.
    """
    grams = shingles(own, GRAM)
    picked = winnow(grams, np.array([0, len(grams)]))
    key = index.lookup(grams[picked])
    picked, key = picked[key >= 0], key[key >= 0]
    n = index.begin[key + 1] - index.begin[key]
    listed = np.repeat(index.begin[key] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    template, diagonal = index.template[listed], np.repeat(picked, n) - index.place[listed]
    order = np.lexsort((diagonal, template))
    template, diagonal = template[order], diagonal[order]
    new = np.flatnonzero(np.concatenate([[True], (template[1:] != template[:-1]) | (diagonal[1:] != diagonal[:-1])])) if len(order) else order
    times = np.diff(np.append(new, len(template)))
    template, diagonal = template[new], diagonal[new]
    exact = index.notice[template]
    for i in np.flatnonzero(exact & (times >= index.prints[template])):
        yield int(template[i]), int(diagonal[i])
    held: list[tuple[int, int]] = []
    last = None
    for k, d, n in [*zip(template[~exact].tolist(), diagonal[~exact].tolist(), times[~exact].tolist(), strict=True), (-1, 0, 0)]:
        if held and (k != last or d - held[0][0] > BAND):
            if sum(x for _, x in held) >= LEAST_SEEDS:
                yield last, max(held, key=lambda x: (x[1], -x[0]))[0]
            held = []
        last = k
        held.append((d, n))


def _aligned(index: Index, own: np.ndarray) -> Iterator[Match]:
    """What the candidates come to: notices that are there word for word, and alignments of other templates, one for each diagonal."""
    for k, d in _candidates(index, own):
        template = index.words[k]
        if index.notice[k]:
            if d >= 0 and np.array_equal(own[d : d + len(template)], template):
                yield Match(k, len(template), d, d + len(template) - 1)
        else:
            base = max(0, d - BAND)
            _, n, first, last = align(template, own[base : d + len(template) + BAND + 1], d - base)
            if n >= min(LEAST_PART, LEAST_COVERAGE * len(template)):
                yield Match(k, n, base + first, base + last)


def settled(index: Index, found: list[Match], least: float = LEAST_COVERAGE) -> list[Match]:
    """Whole matches before parts, then more words first, then the larger share; a match goes if more than half of it lies in one that stays."""
    share = lambda m: m.words / len(index.words[m.template])
    out: list[Match] = []
    for m in sorted(set(found), key=lambda m: (share(m) < least, -m.words, -share(m), m.first, index.templates[m.template].license, m.template)):
        inside = sum(max(0, min(m.last, o.last) - max(m.first, o.first) + 1) for o in out)
        if 2 * inside <= m.last - m.first + 1:
            out.append(m)
    return sorted(out, key=lambda m: (m.first, m.last))


def matches(index: Index, texts: list[str], least: float = LEAST_COVERAGE) -> list[list[dict]]:
    """Of each text: license, coverage, matched words, and the span in code points, by their place in the text."""
    out: list[list[dict]] = [[] for _ in texts]
    for a, b in common.slices(texts):
        found = words(texts[a:b])
        known = np.flatnonzero(index.lookup(shingles(found.hashes, GRAM)) >= 0)  # cheap; the rest only looks at texts with a known gram
        for t in np.unique(np.searchsorted(found.first, known, side="right") - 1):
            lo, hi = found.first[t], found.first[t + 1]
            for m in settled(index, list(_aligned(index, found.hashes[lo:hi])), least):
                start, end = found.start[lo + m.first], found.end[lo + m.last]
                out[a + t].append({"license": index.templates[m.template].license, "coverage": m.words / len(index.words[m.template]), "matched_words": m.words, "start": characters(found, t, start), "end": characters(found, t, end)})
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row per row of docs: id_col, n_licenses, licenses, partial, spans, and found, an array of all matches.

    Templates with common winnowed fingerprints of three words are aligned with the
    text about the fingerprints' diagonal. A notice, which names a license in some
    form, counts word for word. Of other templates those with 80 % of their words
    are whole; parts of 24 words are reported with their coverage. Of matches that
    overlap by more than half the one with more words stays, of equals the one with
    the larger share, then the license that is first by name.

    licenses lists those of whole matches, partial those of which there are parts
    only. spans are license:start:end of whole matches in code points, end
    exclusive, with semicolons between. Texts without a match, null and empty ones
    have empty results; repeated rows have equal ones, an empty table gives an empty
    result. Other columns of docs play no part.
    """
    shared = docs.sparkSession.sparkContext.broadcast([tuple(t) for t in (templates if templates is not None else common_templates())])

    def make():
        own = Index([Template(*t) for t in shared.value])

        def work(batch: dict) -> dict:
            found = matches(own, [t or "" for t in batch["text"]], least)
            whole = [[r for r in x if r["coverage"] >= least] for x in found]
            names = [{r["license"] for r in x} for x in whole]
            return {
                "id": batch["id"],
                "n_licenses": list(map(len, whole)),
                "licenses": [",".join(sorted(x)) for x in names],
                "partial": [",".join(sorted({r["license"] for r in x} - own)) for x, own in zip(found, names, strict=True)],
                "spans": [";".join(f"{r['license']}:{r['start']}:{r['end']}" for r in x) for x in whole],
                "found": found,
            }

        return work

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_licenses long, licenses string, partial string, spans string, found array<struct<license: string, coverage: double, matched_words: long, start: long, end: long>>"
    return common.map_rows(rows, make, schema).withColumnRenamed("id", id_col)
