"""Benchmark decontamination: BM25 retrieval of test items for every passage, then overlap checks.

Nothing that is found of an item depends on which items share its index: counts of
items, documents per term and mean length are those of the whole benchmark, and the
passages in which an item is looked for follow from its own length.
"""

from __future__ import annotations

import pickle
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common
from veldmark.llm._text import Lookup, shingles, words

K1, B = 1.2, 0.75
BLOCK = 4
#: Cells of block maxima that are summed at once.
CELLS = 1 << 20
#: An item is retrieved if a passage reaches this share of the score that the item's own text has.
LEAST_SCORE = 0.6
SHINGLE, LEAST_OVERLAP = 5, 0.8
#: Items of up to 64, 256, 1024, ... words are classes of their own; longer ones than PIECE words are looked for in pieces.
LEAST_CLASS, CLASS_STEP, PIECE = 64, 4, 65_536
#: Bounds of an index that is broadcast; a larger benchmark goes through the documents in several indexes.
SHARD_ITEMS, SHARD_WORDS, MOST_BYTES = 2048, 200_000, 64 << 20
SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer; of a single sentence, the last quarter of the words."""
    parts = SENTENCE_END.split(text.strip())
    if len(parts) > 1:
        return text.strip()[: -len(parts[-1])], parts[-1]
    tokens = text.split()
    cut = len(tokens) - len(tokens) // 4
    return " ".join(tokens[:cut]), " ".join(tokens[cut:])


def _shingle_set(hashes: np.ndarray) -> np.ndarray:
    return np.unique(shingles(hashes, min(SHINGLE, len(hashes)))) if len(hashes) else np.zeros(0, np.uint64)


def stretch(n: int) -> int:
    """Words of the stretch in which an item of n words is verified: room for the share of other words that the overlap allows."""
    return -(-n * 5 // 4)


def class_of(n: int) -> int:
    """The most words of an item's class."""
    most = LEAST_CLASS
    while most < n:
        most *= CLASS_STEP
    return most


class Entry(NamedTuple):
    """An item, or a piece of a long one: hashes of its words, its distinct terms, their counts, and the items that have each term."""

    item_id: object
    question: np.ndarray
    answer: np.ndarray
    terms: np.ndarray
    counts: np.ndarray
    df: np.ndarray

    @property
    def size(self) -> int:
        return int(self.counts.sum())


def pieces(question: str, answer: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of question and answer; of an item beyond PIECE words, of each piece, as a question."""
    q, a = words([question]).hashes, words([answer]).hashes
    if len(q) + len(a) <= PIECE:
        yield q, a
    else:
        every = np.concatenate([q, a])
        for at in range(0, len(every), PIECE):
            yield every[at : at + PIECE], every[:0]


@dataclass
class Index:
    """Postings of the items of one class. Impacts are shares of the item's own score, so one threshold serves all items.

    Items have ordinals; a block is BLOCK ordinals in a row. Postings and, for each
    term, the blocks that it is in with the largest impact there, are sparse rows.
    """

    most: int
    item_ids: list
    question: list[np.ndarray]
    answer: list[np.ndarray]
    sizes: list[tuple[int, int]]
    posting_at: np.ndarray
    posting_item: np.ndarray
    posting_impact: np.ndarray
    block_at: np.ndarray
    block_no: np.ndarray
    block_max: np.ndarray
    term_max: np.ndarray


class Shard:
    """Terms of some items, and an index for each length class among them."""

    def __init__(self, terms: np.ndarray, classes: list[Index]):
        self.terms, self.classes = terms, classes
        self.lookup = Lookup(terms)

    def __reduce__(self):
        return Shard, (self.terms, self.classes)


def build(entries: list[Entry], items: int, mean: float) -> Shard:
    """An inverted index; items and mean are those of the whole benchmark."""
    terms = np.unique(np.concatenate([e.terms for e in entries])) if entries else np.zeros(0, np.uint64)
    by_class: dict[int, list[Entry]] = {}
    for e in entries:
        by_class.setdefault(class_of(e.size), []).append(e)
    classes = []
    for most, own in sorted(by_class.items()):
        term_of, impact_of = [], []
        for e in own:
            idf = np.log1p((items - e.df + 0.5) / (e.df + 0.5))
            impact = idf * e.counts * (K1 + 1) / (e.counts + K1 * (1 - B + B * e.size / max(1.0, mean)))
            term_of.append(np.searchsorted(terms, e.terms))
            impact_of.append(impact / impact.sum())
        term, impact = np.concatenate(term_of), np.concatenate(impact_of).astype(np.float32)
        item = np.repeat(np.arange(len(own)), [len(t) for t in term_of])
        order = np.lexsort((item, term))
        term, item, impact = term[order], item[order], impact[order]
        at = np.searchsorted(term, np.arange(len(terms) + 1))
        block = item // BLOCK
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])]))
        block_max = np.maximum.reduceat(impact, first)
        block_at = np.searchsorted(term[first], np.arange(len(terms) + 1))
        term_max = np.zeros(len(terms), np.float32)
        np.maximum.at(term_max, term, impact)
        sizes = [(len(e.question), len(e.answer)) for e in own]
        classes.append(Index(most, [e.item_id for e in own], [_shingle_set(e.question) for e in own], [_shingle_set(e.answer) for e in own], sizes, at.astype(np.int32), item.astype(np.int32), impact, block_at.astype(np.int32), block[first].astype(np.int32), block_max, term_max))
    return Shard(terms, classes)


def wand(index: Index, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
    """All items whose score for the terms is least or more, by block-max WAND.

    Cursors are ordered by their next item; the pivot is the first item at which the
    terms' maxima reach the threshold. If the maxima of the pivot's block don't,
    all cursors before the block's end jump there; else cursors behind the pivot
    jump to it, and it is scored once all of them have come.
    """
    least -= 1e-6  # sums of the same parts in another order
    items, cursors = index.posting_item, []
    for t in terms.tolist():
        lo, hi = int(index.posting_at[t]), int(index.posting_at[t + 1])
        if lo < hi:
            cursors.append([int(items[lo]), lo, hi, float(index.term_max[t]), t])
    out = []
    while cursors:
        cursors.sort()
        bound, pivot = 0.0, None
        for c in cursors:
            bound += c[3]
            if bound >= least:
                pivot = c[0]
                break
        if pivot is None:
            break
        block = pivot // BLOCK
        stop, bound = (block + 1) * BLOCK, 0.0
        for c in cursors:
            if c[0] >= stop:
                break
            lo, hi = int(index.block_at[c[4]]), int(index.block_at[c[4] + 1])
            at = bisect_left(index.block_no, block, lo, hi)
            if at < hi and index.block_no[at] == block:
                bound += float(index.block_max[at])
        if bound < least:
            target = stop
        elif cursors[0][0] == pivot:
            score = sum(float(index.posting_impact[c[1]]) for c in cursors if c[0] == pivot)
            if score >= least:
                out.append((pivot, score))
            target = pivot + 1
        else:
            target = pivot
        for c in cursors:
            if c[0] >= target:
                break
            c[1] = bisect_left(items, target, c[1], c[2])
            c[0] = int(items[c[1]]) if c[1] < c[2] else -1
        cursors = [c for c in cursors if c[0] >= 0]
    return out


def _over(index: Index, term: np.ndarray, begins: np.ndarray, least: float) -> Iterator[int]:
    """Passages (by their place in begins) that have a block whose maxima together reach the threshold."""
    blocks = -(-len(index.item_ids) // BLOCK)
    lo, n = index.block_at[term].astype(np.int64), np.diff(index.block_at)[term].astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    begin = upto[begins]
    most, at = max(1, CELLS // blocks), 0
    ends = np.append(begins[1:], len(term))
    while at < len(begins):
        # so many passages that neither their cells nor their listed blocks are too many
        stop = max(at + 1, min(at + most, int(np.searchsorted(upto[ends], begin[at] + CELLS, side="right"))))
        a, b = begins[at], ends[stop - 1]
        own = n[a:b]
        listed = np.repeat(lo[a:b] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        row = np.repeat(np.repeat(np.arange(stop - at), ends[at:stop] - begins[at:stop]), own)
        bound = np.bincount(row * blocks + index.block_no[listed], weights=index.block_max[listed], minlength=(stop - at) * blocks)
        for found in np.flatnonzero((bound.reshape(-1, blocks) >= least - 1e-4).any(axis=1)).tolist():
            yield at + found
        at = stop


def _distinct(pos: np.ndarray, ids: np.ndarray, starts: list[int], width: int) -> list[int]:
    """Distinct ids at positions from each start on, up to start + width; starts rise."""
    held: dict[int, int] = {}
    out, lo, hi = [], 0, 0
    where, what = pos.tolist(), ids.tolist()
    for s in starts:
        while hi < len(where) and where[hi] <= s + width:
            held[what[hi]] = held.get(what[hi], 0) + 1
            hi += 1
        while lo < hi and where[lo] < s:
            held[what[lo]] -= 1
            if not held[what[lo]]:
                del held[what[lo]]
            lo += 1
        out.append(len(held))
    return out


def verified(here: np.ndarray, question: np.ndarray, answer: np.ndarray, sizes: tuple[int, int]) -> tuple[float, float, int]:
    """Shares of the question's and of the answer's shingles in one stretch of the words here, and where it begins: the best stretch, the first of equals.

    A part without words counts as contained. No stretch goes beyond the words.
    """
    width = stretch(sum(sizes))
    found = []
    for part, n in zip((question, answer), sizes, strict=True):
        own = shingles(here, min(SHINGLE, n)) if n else here[:0]
        at = np.searchsorted(part, own)
        hit = np.flatnonzero((at < len(part)) & (part[np.minimum(at, len(part) - 1)] == own)) if len(part) else np.zeros(0, np.int64)
        found.append((hit, at[hit], min(SHINGLE, n)))
    starts = sorted({int(x) for pos, *_ in found for x in pos})
    best = (0.0, 0.0, 0)
    counts = [_distinct(pos, ids, starts, width - k) if n else [] for (pos, ids, k), n in zip(found, sizes, strict=True)]
    for i, s in enumerate(starts):
        q, a = (counts[j][i] / len(part) if sizes[j] else 1.0 for j, part in enumerate((question, answer)))
        if (min(q, a), q + a) > (min(best[:2]), best[0] + best[1]):
            best = q, a, s
    return best


def leaks(shard: Shard, texts: list[str], least: float = LEAST_SCORE) -> list[list[dict]]:
    """Verified items of each text: id, best score, overlaps, and the words of the stretch."""
    out: list[list[dict]] = [[] for _ in texts]
    for a, b in common.slices(texts, 1 << 19):
        found = words(texts[a:b])
        ids = shard.lookup(found.hashes)
        hit = np.flatnonzero(ids >= 0)
        if not len(hit):
            continue
        text = np.searchsorted(found.first, hit, side="right") - 1
        for index in shard.classes:
            for i, p, item, score in _retrieved(index, found.first, hit, text, ids[hit], least):
                step = stretch(index.most)
                start = found.first[i] + p * step
                end = min(start + 2 * step, found.first[i + 1])
                q, w, at = verified(found.hashes[start:end], index.question[item], index.answer[item], index.sizes[item])
                if min(q, w) >= LEAST_OVERLAP:
                    begin = int(start - found.first[i]) + at
                    out[a + i].append({"item_id": index.item_ids[item], "score": score, "question_overlap": q, "answer_overlap": w, "from_word": begin, "to_word": min(begin + stretch(sum(index.sizes[item])), int(found.first[i + 1] - found.first[i]))})
    return [_best(x) if x else x for x in out]


def _retrieved(index: Index, first: np.ndarray, hit: np.ndarray, text: np.ndarray, term: np.ndarray, least: float) -> Iterator[tuple[int, int, int, float]]:
    """(text, passage of the text, item, score) at or over the threshold.

    Passages of two stretches of the class's longest item begin at every stretch;
    a word is in the passage that begins at its stretch and in the one before.
    """
    known = np.diff(index.posting_at)[term] > 0
    hit, text, term = hit[known], text[known], term[known]
    if not len(hit):
        return
    step, terms = stretch(index.most), len(index.term_max)
    first_passage = np.zeros(len(first), np.int64)
    np.cumsum(np.maximum(1, -(-np.diff(first) // step)), out=first_passage[1:])
    within = (hit - first[text]) // step
    key = (first_passage[text] + within) * terms + term
    key = np.unique(np.concatenate([key, key[within > 0] - terms]))
    passage, term = np.divmod(key, terms)
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    for row in _over(index, term, begins, least):
        stop = begins[row + 1] if row + 1 < len(begins) else len(term)
        p = passage[begins[row]]
        i = int(np.searchsorted(first_passage, p, side="right") - 1)
        for item, score in wand(index, term[begins[row] : stop], least):
            yield i, int(p - first_passage[i]), item, score


def _best(rows: list[dict]) -> list[dict]:
    """The highest-scored passage of each item, the first of equals."""
    best: dict = {}
    for r in rows:
        if r["item_id"] not in best or r["score"] > best[r["item_id"]]["score"]:
            best[r["item_id"]] = r
    return list(best.values())


def entries(benchmark: DataFrame, item_col: str, text_col: str, question_col: str | None, answer_col: str | None) -> DataFrame:
    """Items and pieces of items as rows: key, id, n, most, question and answer (word hashes), terms, counts. Items without words are left out."""
    parts = [F.col(f"`{item_col}`").alias("id"), F.col(f"`{question_col or text_col}`").alias("q"), F.col(f"`{answer_col or text_col}`").alias("a")]
    split = not question_col

    def make():
        def work(batch: dict) -> dict:
            out = {c: [] for c in ("id", "n", "most", "question", "answer", "terms", "counts")}
            for i, q, a in zip(batch["id"], batch["q"], batch["a"], strict=True):
                q, a = question_and_answer(q or "") if split else (q or "", a or "")
                for own in pieces(q, a):
                    terms, counts = np.unique(np.concatenate(own), return_counts=True)
                    if len(terms):
                        row = (i, int(counts.sum()), class_of(int(counts.sum())), own[0].tobytes(), own[1].tobytes(), terms.view(np.int64).tolist(), counts.tolist())
                        for c, v in zip(out, row, strict=True):
                            out[c].append(v)
            return out

        return work

    rows = benchmark.select(*parts)
    kind = rows.schema["id"].dataType.simpleString()
    return common.map_rows(rows, make, f"id {kind}, n long, most long, question binary, answer binary, terms array<long>, counts array<int>").withColumn("key", F.monotonically_increasing_id())


def shards(benchmark: DataFrame, item_col: str, text_col: str, question_col: str | None, answer_col: str | None) -> Iterator[Shard]:
    """Indexes of the benchmark in the order of class and id, each within the bounds.

    Items per term are counted by a shuffle over the whole benchmark and joined to
    the items, so the driver never has more than one index and two numbers.
    """
    found = common.stored(entries(benchmark, item_col, text_col, question_col, answer_col), common.scratch(benchmark.sparkSession), "items")
    total = found.agg(F.count(F.lit(1)).alias("items"), F.avg("n").alias("mean")).first()
    if not total["items"]:
        return
    pairs = found.select("key", F.explode(F.arrays_zip("terms", "counts")).alias("x")).select("key", F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
    df = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = pairs.join(df, "term").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("term", "n", "df"))).alias("weights"))
    held, n = [], 0
    for r in found.join(weighed, "key").select("id", "n", "most", "question", "answer", "weights", "key").orderBy("most", "id", "key").toLocalIterator():
        if held and (len(held) == SHARD_ITEMS or n + r["n"] > SHARD_WORDS):
            yield build(held, total["items"], total["mean"])
            held, n = [], 0
        weights = np.array([tuple(w) for w in r["weights"]], np.int64)
        weights = weights[np.argsort(weights[:, 0].view(np.uint64))]
        held.append(Entry(r["id"], np.frombuffer(r["question"], np.uint64), np.frombuffer(r["answer"], np.uint64), np.ascontiguousarray(weights[:, 0]).view(np.uint64), weights[:, 1], weights[:, 2]))
        n += r["n"]
    if held:
        yield build(held, total["items"], total["mean"])


_loaded: dict[str, Shard] = {}


def _shard(key: str, data: bytes) -> Shard:
    """One copy of an index in each worker process."""
    if key not in _loaded:
        while len(_loaded) >= 4:
            _loaded.pop(next(iter(_loaded)))
        _loaded[key] = pickle.loads(data)
    return _loaded[key]


def _annotated(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, question_col: str | None, answer_col: str | None) -> DataFrame:
    """numbered(docs) with a last column leaks."""
    spark, text = docs.sparkSession, common.at(docs, text_col)
    kind = f"array<struct<item_id: {benchmark.select(F.col(f'`{item_col}`')).schema[0].dataType.simpleString()}, score: double, question_overlap: double, answer_overlap: double, from_word: long, to_word: long>>"
    out = common.numbered(docs).withColumn("leaks", F.array().cast(kind))
    for shard in shards(benchmark, item_col, item_text_col, question_col, answer_col):
        data = pickle.dumps(shard)
        if len(data) > MOST_BYTES:
            raise ValueError(f"an index of {len(data)} bytes")
        shared = spark.sparkContext.broadcast(data)

        def make(shared=shared, key=uuid.uuid4().hex):
            own = _shard(key, shared.value)

            def work(batch: dict) -> dict:
                new = leaks(own, [t or "" for t in batch["text"]])
                return {"leaks": [_best(old + x) if old else x for old, x in zip(batch["old"], new, strict=True)]}

            return work

        out = common.add_columns(out, {"text": text, "old": "leaks"}, make, f"leaks {kind}", ("leaks",))
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None, answer_col: str | None = None) -> DataFrame:
    """docs with a column leaks: the benchmark items that each text contains, with score and overlaps.

    Items of up to 64, 256, 1024, ... words are classes; a passage is two stretches
    of a class's longest item, and one begins at every stretch. Items with 60 % of
    their own BM25 score in a passage are retrieved, and kept if there is a stretch
    of 5/4 of their words with 80 % of the five-word shingles of question and of
    answer (a part without words counts as contained). An item of more than 65,536
    words is contained if one of its pieces of that size is.

    Null and empty texts have no leaks; without benchmark rows no text has. An id
    that repeats in the benchmark is one item with several texts, found once, by its
    best score. Repeated documents have equal results. If docs has a column leaks
    it stays, and the new one is leaks_. Each index goes over all documents.
    """
    return common.renamed(_annotated(docs, benchmark, text_col, item_col, item_text_col, question_col, answer_col), docs, ["leaks"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """One row per document row and item it contains: id_col, item_id, score, overlaps, from_word, to_word. Clean documents have none."""
    rows = annotate(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), benchmark, **columns)
    return rows.select(F.col("id").alias(id_col), F.explode("leaks").alias("leak")).select(id_col, "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with the columns of docs, whatever their names."""
    rows = _annotated(docs, benchmark, text_col, "item_id", "text", None, None)
    return rows.where(F.size("leaks") == 0).drop("leaks").toDF(*docs.columns)
