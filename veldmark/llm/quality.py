"""Quality: random-indexing word vectors pooled per document, and a two-layer network."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common
from veldmark.llm._text import hash_runs, words

BITS = 15
WORD_DIM, MARK_DIM, NONZERO = 48, 48, 4
WINDOW = 2
#: Blocks of words in which tasks pass on their tables.
BLOCKS = 64
HIDDEN = 32
#: Bounds of the sample that trains the network: labelled rows, and characters together. Word vectors come from all documents.
FIT_ROWS, FIT_CHARS = 4000, 24_000_000
THRESHOLD = 0.7


def _index_vectors(n: int, dim: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: the few dimensions of each id and their signs."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.integers(0, dim, (n, NONZERO)), rng.choice([-1, 1], (n, NONZERO))])


@dataclass
class Tokens:
    """Ids of words and of marks (symbol runs and shapes of words), and where each text begins."""

    word: np.ndarray
    word_at: np.ndarray
    mark: np.ndarray
    mark_at: np.ndarray


SHAPES = 8  # ids of marks from 0: upper case, capitalised, with a digit, repeats the last word, longer than 14 bytes


def tokens(texts: list[str]) -> Tokens:
    found = words(texts)
    word = (found.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    low = np.frombuffer(found.joined, np.uint8)
    n_words = len(word)
    mark_id, mark_pos = [], []

    # shapes need the letters as written; where lower case changes lengths, only texts of equal length have them
    if len(data) == len(low) and n_words:
        upper = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data != low) & (data < 128), out=upper[1:])
        digit = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 48) & (data <= 57), out=digit[1:])
        size = found.end - found.start
        ups = upper[found.end] - upper[found.start]
        first = (data[found.start] != low[found.start]).astype(np.int64)
        for k, flag in enumerate(((ups >= 2) & (2 * ups > size), (first == 1) & (ups == 1), digit[found.end] > digit[found.start])):
            mark_id.append(np.full(int(flag.sum()), k))
            mark_pos.append(found.start[flag])
    if n_words > 1:
        again = np.flatnonzero(found.hashes[1:] == found.hashes[:-1]) + 1
        mark_id.append(np.full(len(again), 3))
        mark_pos.append(found.start[again])
    long = found.end - found.start > 14
    mark_id.append(np.full(int(long.sum()), 4))
    mark_pos.append(found.start[long])

    symbol = np.ones(len(low), np.int8)
    symbol[(low <= 32) | (low == 95) | (low >= 128) | ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | ((low >= 65) & (low <= 90))] = 0
    edge = np.flatnonzero(np.diff(symbol, prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    mark_id.append(SHAPES + (hash_runs(low, start, end) >> np.uint64(64 - BITS)).astype(np.int64))
    mark_pos.append(start)
    mark, pos = np.concatenate(mark_id).astype(np.int64), np.concatenate(mark_pos)
    order = np.argsort(pos, kind="stable")
    return Tokens(word, found.first, mark[order], np.searchsorted(pos[order], found.text_start))


def _pooled(table: np.ndarray, ids: np.ndarray, at: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sum of the rows of each text's ids over per."""
    out = np.zeros((len(at) - 1, table.shape[1]))
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        out[full] = np.add.reduceat(table[ids], at[full], axis=0, dtype=np.float64)
    return out / per[:, None]


@dataclass
class Model:
    word_vectors: np.ndarray
    mark_vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def pool(word_vectors: np.ndarray, mark_vectors: np.ndarray, texts: list[str]) -> np.ndarray:
    """Mean word vector, mark vectors per word, and both lengths of each text."""
    out = []
    for a, b in common.slices(texts, 1 << 18):
        t = tokens(texts[a:b])
        n = np.maximum(1, np.diff(t.word_at))
        extra = np.log1p(np.stack([np.diff(t.word_at), np.diff(t.mark_at)], axis=1))
        out.append(np.hstack([_pooled(word_vectors, t.word, t.word_at, n), _pooled(mark_vectors, t.mark, t.mark_at, n), extra]))
    return np.vstack(out) if out else np.zeros((0, WORD_DIM + MARK_DIM + 2))


def add_contexts(total: np.ndarray, texts: list[str], dims: np.ndarray, signs: np.ndarray) -> None:
    """Add to the flat table total, at each word, the index vectors of the words around it."""
    for a, b in common.slices(texts, 1 << 21):
        found = words(texts[a:b])
        word = (found.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        text_of = np.repeat(np.arange(b - a), np.diff(found.first))
        here, there = [], []
        for shift in range(1, WINDOW + 1):
            same = text_of[:-shift] == text_of[shift:]
            left, right = word[:-shift][same], word[shift:][same]
            here += [left, right]
            there += [right, left]
        at, other = np.concatenate(here) * WORD_DIM, np.concatenate(there)
        for k in range(NONZERO):
            total += np.bincount(at + dims[other, k], weights=signs[other, k], minlength=len(total))


def random_indexing(docs: DataFrame, text_col: str = "text", seed: int = 11) -> np.ndarray:
    """Word vectors over all texts: the sum of the index vectors of the words around each word, scaled to length one.

    Each task sums its texts into one table and passes it on in blocks of words,
    which are added up by block; only the final table comes to the driver. All
    sums are of integers, so their order doesn't matter.
    """
    n, size = 1 << BITS, (1 << BITS) * WORD_DIM // BLOCKS
    schema = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("counts", pa.binary())])

    def packed(k: int, counts: np.ndarray) -> pa.RecordBatch:
        whole = counts.astype(np.int64)
        kind = next(t for t in ("i1", "i2", "i4", "i8") if np.abs(whole).max(initial=0) <= np.iinfo(t).max)
        return pa.RecordBatch.from_pydict({"block": [k], "kind": [kind], "counts": [zlib.compress(whole.astype(kind).tobytes(), 1)]}, schema=schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = _index_vectors(n, WORD_DIM, seed)
        total = np.zeros(n * WORD_DIM)
        for batch in batches:
            for part in common.parts(batch):
                add_contexts(total, [t or "" for t in part.column(0).to_pylist()], dims, signs)
        for k, counts in enumerate(total.reshape(BLOCKS, size)):
            if counts.any():
                yield packed(k, counts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, kind, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sums.setdefault(k, np.zeros(size, np.int64))
                own += np.frombuffer(zlib.decompress(counts), kind)
        for k, own in sums.items():
            yield packed(k, own)

    kind = "block int, kind string, counts binary"
    with common.small_batches(docs.sparkSession):
        tables = docs.select(F.col(text_col)).mapInArrow(gather, kind).repartition("block").mapInArrow(add, kind).collect()
    total = np.zeros((BLOCKS, size))
    for r in tables:
        total[r["block"]] = np.frombuffer(zlib.decompress(r["counts"]), r["kind"])
    vectors = total.reshape(n, WORD_DIM)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0).astype(np.float32)


def mark_index(seed: int = 12) -> np.ndarray:
    """Marks keep their index vectors."""
    n = 1 << BITS
    marks = np.zeros((n + SHAPES, MARK_DIM))
    dims, signs = _index_vectors(n + SHAPES, MARK_DIM, seed)
    for j in range(NONZERO):
        np.add.at(marks, (np.arange(n + SHAPES), dims[:, j]), signs[:, j])
    return marks.astype(np.float32)


def _logits(x: np.ndarray, m: Model) -> np.ndarray:
    return np.tanh(((x - m.mean) / m.scale) @ m.w1 + m.b1) @ m.w2 + m.b2


def train(texts: list[str], labels: np.ndarray, word_vectors: np.ndarray, seed: int = 5, steps: int = 400, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Fit the network over given word vectors; every fifth text stays out of it and sets the temperature."""
    mark_vectors = mark_index()
    x = pool(word_vectors, mark_vectors, texts)
    apart = np.arange(len(texts)) % 5 == 4 if len(texts) >= 50 else np.zeros(len(texts), bool)
    rng = np.random.default_rng(seed)
    mean, scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-6
    m = Model(word_vectors, mark_vectors, mean, scale, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0)
    z, y = (x[~apart] - mean) / scale, labels[~apart].astype(float)
    weights = [m.w1, m.b1, m.w2, np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        hidden = np.tanh(z @ weights[0] + weights[1])
        p = 1 / (1 + np.exp(-np.clip(hidden @ weights[2] + weights[3], -30, 30)))
        off = (p - y) / len(y)
        back = np.outer(off, weights[2]) * (1 - hidden**2)
        slopes = [z.T @ back + decay * weights[0], back.sum(axis=0), hidden.T @ off + decay * weights[2], np.array([off.sum()])]
        for i, g in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g**2
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if apart.any():
        logit, y = _logits(x[apart], m), labels[apart]
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.mean(np.logaddexp(0, np.where(y == 1, -logit, logit) / t)) for t in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    return m


def score(model: Model | None, texts: list[str | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x = pool(model.word_vectors, model.mark_vectors, [t or "" for t in texts])
    return 1 / (1 + np.exp(-np.clip(_logits(x, model) / model.temperature, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Model | None:
    """Word vectors of all documents, and a network trained on labelled rows that aren't held out: the first by a hash of the id, up to both bounds.

    A text for which no characters are left is passed over; if all are too long, the shortest is taken. None without labels.
    """
    marked = labels.where(F.col(label_col).isNotNull() & ~common.held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(label_col).alias("label"))
    chosen = marked.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
    pairs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
    found, total = set(), 0
    sizes = pairs.select("id", F.length("text").alias("n")).orderBy(F.xxhash64("id"), "id", "n").limit(rows).collect()
    for r in sizes:
        if total + r["n"] <= chars:
            total += r["n"]
            found.add((r["id"], r["n"]))
    if not sizes:
        return None
    if not found:
        least = min(sizes, key=lambda r: r["n"])
        found.add((least["id"], least["n"]))
    keep = docs.sparkSession.createDataFrame(sorted(found), f"id {dict(pairs.dtypes)['id']}, n int")
    within = pairs.withColumn("n", F.length("text")).join(F.broadcast(keep), ["id", "n"], "left_semi")
    taken = sorted(((r["id"], r["text"], r["label"]) for r in within.select("id", "text", "label").toLocalIterator()), key=lambda r: (r[0], r[1]))
    rng = np.random.default_rng(1)
    taken = [taken[i] for i in rng.permutation(len(taken))]
    texts = [t for _, t, _ in taken]
    return train(texts, np.array([int(y) for *_, y in taken]), random_indexing(docs, text_col))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, held_out, score, predicted.

    Learns labels of rows whose crc32(id as text) mod 4 is not 2; of several labels
    of an id the largest counts. Null counts as the empty text, and empty texts are
    scored too. Without labels every score is 0.5. predicted is 1 from a score of 0.7.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, labels, id_col, text_col)))

    def make():
        model = pickle.loads(shared.value)

        def work(batch: dict) -> dict:
            return {"id": batch["id"], "held_out": batch["held_out"], "score": score(model, batch["text"]).tolist()}

        return work

    rows = docs.select(F.col(id_col).alias("id"), common.held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    done = common.map_rows(rows, make, f"id {dict(rows.dtypes)['id']}, held_out boolean, score double")
    return done.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
