"""Removal of long repeated substrings: a sparse suffix array refined by bucket pointers.

Every window of LENGTH bytes has one anchor, the position of its least Q-gram hash,
which depends on the window's bytes only. So equal windows have equal anchors at
equal offsets, and it is enough to group suffixes at anchors: first into buckets by
their Q-gram, then, within buckets of two or more, by sorting on the buckets that
suffixes at later offsets have, each refined bucket being looked up in the next turn.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common
from veldmark.llm._text import mix

LENGTH = 400
Q = 64
#: Window starts that are looked at together, and bits for a position among them.
PIECE, PLACE = 1 << 19, 24
#: Contexts of a bucket beyond which its windows are counted by a shuffle on their digests.
HOT = 8000
#: Bytes of contexts that are refined together; small ones stay in the cache.
CHUNK = 1 << 18


def identifiers(data: bytes, depth: int) -> np.ndarray:
    """An identifier of the depth bytes (8, 16, 32, ...) at each position; the last depth - 1 positions have none."""
    n = len(data) - depth + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    ids = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,)).astype(np.uint64)
    size = 8
    while size < depth:
        ids ^= ids >> np.uint64(29)
        ids *= np.uint64(0xBF58476D1CE4E5B9)
        later = ids[size:]
        ids = ids[: len(later)] + (later ^ (later >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        size *= 2
    return mix(ids)


def least_in_window(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width keys in a row: blocks of that width, least so far from both ends."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max)
    padded[: len(keys)] = keys
    padded = padded.reshape(blocks, width)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(data: bytes, starts: list[int], ends: list[int], length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts at starts..ends within data: text, anchor, and the first and last start of the windows with this anchor; and the Q-gram identifiers last.

    A text longer than PIECE window starts is looked at in pieces that overlap.
    """
    place = np.uint64((1 << PLACE) - 1)
    found = []
    for lo in range(0, max(1, len(data)), PIECE):
        hi = min(len(data), lo + PIECE + length - 1)
        if hi - lo < length:
            break
        grams = identifiers(data[lo:hi], q)
        keys = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        at = (least_in_window(keys, length - q + 1) & place).astype(np.int64) + lo
        window = np.arange(lo, lo + len(at))
        text = np.searchsorted(starts, window, side="right") - 1
        valid = window + length <= np.asarray(ends)[text]
        window, at, text = window[valid], at[valid], text[valid]
        if not len(window):
            continue
        new = np.ones(len(window), bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(window)) - 1
        found.append((text[first], at[first], window[first], window[last], grams[at[first] - lo]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Anchored:
    """Anchors of some texts, with a 128-bit digest of each anchor's context: the bytes of all its windows."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, q: int = Q):
        self.data = b"".join(texts)
        self.starts = np.zeros(len(texts), np.int64)
        np.cumsum([len(t) for t in texts[:-1]], out=self.starts[1:])
        self.text, self.at, self.lo, self.hi, self.gram = anchors(self.data, self.starts, self.starts + [len(t) for t in texts], length, q)
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(self.data[a : b + length], c) for a, b, c in zip(self.lo.tolist(), self.hi.tolist(), (self.at - self.lo).tolist(), strict=True)])
        self.digest = np.frombuffer(raw, "<i8").reshape(-1, 2)


def _batches(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    return common.slices(texts, limit)


def refine(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each context: which of its windows, of 8 bytes or more, occur more than once in all of them, first window first.

    Bucket-pointer refinement. Suffixes are sorted into buckets by their first 8
    bytes, and a suffix points to its bucket's place in that order. Then each bucket
    of two or more is sorted by the pointers at a later offset, and its parts get
    pointers of their own, which the next turn looks up in its stead: a pointer that
    tells n bytes apart and one n bytes later tell 2 n bytes apart. Buckets of one
    drop out. Only bytes are compared, so equal pointers mean equal bytes.
    """
    if not contexts:
        return []
    data = b"".join(contexts)
    size = np.array([len(c) for c in contexts])
    end = np.cumsum(size)
    rest = np.repeat(end, size) - np.arange(len(data))  # bytes from a position to the end of its context
    live = np.flatnonzero(rest >= 8)
    value = np.ndarray((max(0, len(data) - 7),), ">u8", data, 0, (1,)).astype(np.uint64)
    pointer = np.zeros(len(data), np.uint64)
    key, depth, old = value[live], 8, np.zeros(len(live), np.uint64)
    while len(live):
        order = np.argsort(key)
        sorted_key, place = key[order], live[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        many = np.diff(np.append(first, len(live)))
        # a part's pointer: that of its bucket, and the suffixes of the bucket before it
        bucket = old[order[first]]
        base = np.maximum.accumulate(np.where(np.concatenate([[True], bucket[1:] != bucket[:-1]]), first, 0))
        pointer[place] = np.repeat(bucket + (first - base).astype(np.uint64), many)
        live = place[np.repeat(many > 1, many)]
        if depth == length:
            break
        step = min(depth, length - depth)
        depth += step
        live.sort()
        live = live[rest[live] >= depth]
        old = pointer[live]
        key = old << np.uint64(32) | pointer[live + step]
    shared = np.zeros(len(data), bool)
    shared[live] = True
    begin = end - size
    return [shared[a : a + n - length + 1] for a, n in zip(begin.tolist(), size.tolist(), strict=True)]


def _intervals(flags: np.ndarray) -> list[int]:
    """Begin and end of each run of true, one after the other."""
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).tolist()


ANCHOR_SCHEMA = "h1 long, h2 long, gram long, c1 long, c2 long, n long"
CONTEXT_SCHEMA = "h1 long, h2 long, c1 long, c2 long, gram long, wanted boolean, hot boolean, context binary"
PART_SCHEMA = "h1 long, h2 long, c1 long, c2 long, parts array<int>"


def _find(length: int, q: int):
    def make():
        def work(batch: dict) -> dict:
            out = {c: [] for c in ("h1", "h2", "gram", "c1", "c2", "n")}
            for a, b in _batches(batch["text"]):
                found = Anchored(batch["text"][a:b], length, q)
                order = np.lexsort((found.digest[:, 1], found.digest[:, 0], found.text))
                rows = np.column_stack([found.text, found.digest])[order]
                new = np.ones(len(rows), bool)
                new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
                first = np.flatnonzero(new)
                times = np.diff(np.append(first, len(rows)))
                text = rows[first, 0]
                out["h1"] += np.array(batch["h1"][a:b])[text].tolist()
                out["h2"] += np.array(batch["h2"][a:b])[text].tolist()
                out["gram"] += found.gram.view(np.int64)[order][first].tolist()
                out["c1"] += rows[first, 1].tolist()
                out["c2"] += rows[first, 2].tolist()
                out["n"] += (times * np.array(batch["copies"][a:b])[text]).tolist()
            return out

        return work

    return make


def _contexts(length: int, q: int):
    def make():
        def work(batch: dict) -> dict:
            out = {c: [] for c in ("h1", "h2", "c1", "c2", "gram", "wanted", "hot", "context")}
            for a, b in _batches(batch["text"]):
                found = Anchored(batch["text"][a:b], length, q)
                asked = [{(r["c1"], r["c2"]): r for r in x} for x in batch["asked"][a:b]]
                for text, lo, hi, gram, key in zip(found.text.tolist(), found.lo.tolist(), found.hi.tolist(), found.gram.view(np.int64).tolist(), map(tuple, found.digest.tolist()), strict=True):
                    r = asked[text].pop(key, None)
                    if r:
                        for name, value in (("h1", batch["h1"][a + text]), ("h2", batch["h2"][a + text]), ("c1", key[0]), ("c2", key[1]), ("gram", gram), ("wanted", r["wanted"]), ("hot", r["hot"]), ("context", found.data[lo : hi + length])):
                            out[name].append(value)
            return out

        return work

    return make


def _refined(length: int):
    """Rows come sorted by gram; whole buckets are refined together, some megabytes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("h1", "h2", "c1", "c2", "gram", "wanted", "context")
        held: list[tuple] = []
        size = 0

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            shared = refine([r[6] for r in rows], length)
            kept = [(*r[:4], _intervals(s)) for r, s in zip(rows, shared, strict=True) if r[5] and s.any()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in kept], pa.int64() if i < 4 else pa.list_(pa.int32())) for i in range(5)], names=["h1", "h2", "c1", "c2", "parts"])

        for batch in batches:
            for row in zip(*(batch.column(batch.schema.names.index(n)).to_pylist() for n in names), strict=True):
                if size >= CHUNK and row[4] != held[-1][4]:
                    yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
        if held:
            yield flush(held)

    return run


def _windows(length: int):
    def make():
        def work(batch: dict) -> dict:
            out = {c: [] for c in ("h1", "h2", "c1", "c2", "wanted", "at", "k1", "k2")}
            for i, context in enumerate(batch["context"]):
                n = len(context) - length + 1
                raw = b"".join(xxhash.xxh3_128_digest(context[j : j + length]) for j in range(n))
                keys = np.frombuffer(raw, "<i8").reshape(-1, 2)
                for c in ("h1", "h2", "c1", "c2", "wanted"):
                    out[c] += [batch[c][i]] * n
                out["at"] += range(n)
                out["k1"] += keys[:, 0].tolist()
                out["k2"] += keys[:, 1].tolist()
            return out

        return work

    return make


def _cut(length: int, q: int):
    def make():
        def work(batch: dict) -> dict:
            out = {"h1": batch["h1"], "h2": batch["h2"], "n_removed": [], "n_spans": [], "spans": [], "kept_sha256": [], "kept": []}
            for a, b in _batches(batch["text"]):
                texts = batch["text"][a:b]
                found = Anchored(texts, length, q)
                known = [{(r["c1"], r["c2"]): r["parts"] for r in x} for x in batch["shared"][a:b]]
                change = np.zeros(len(found.data) + 1, np.int64)
                for text, lo, hi, key in zip(found.text.tolist(), found.lo.tolist(), found.hi.tolist(), map(tuple, found.digest.tolist()), strict=True):
                    if key in known[text]:
                        parts = known[text][key] or [0, hi - lo + 1]
                        for s, e in zip(parts[::2], parts[1::2], strict=True):
                            change[lo + s] += 1
                            change[lo + e - 1 + length] -= 1
                gone = np.cumsum(change[:-1]) > 0
                data = np.frombuffer(found.data, np.uint8)
                for i, text in enumerate(texts):
                    own = gone[found.starts[i] : found.starts[i] + len(text)]
                    rest = data[found.starts[i] : found.starts[i] + len(text)][~own].tobytes()
                    out["n_removed"].append(int(own.sum()))
                    runs = _intervals(own)
                    out["n_spans"].append(len(runs) // 2)
                    out["spans"].append(",".join(f"{x}:{y}" for x, y in zip(runs[::2], runs[1::2], strict=True)))
                    out["kept_sha256"].append(hashlib.sha256(rest).hexdigest())
                    out["kept"].append(rest)
            return out

        return work

    return make


def _half(column, at: int):
    return F.conv(F.substring(column, at, 16), 16, -10).cast("long")


def repeated_substrings(docs: DataFrame, text_col: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Docs with columns h1, h2 (128 bits of the text's SHA-256), and one row for each text with a repeat: h1, h2, n_removed, n_spans, kept_sha256, kept.

    A text is its UTF-8 bytes, null is empty. A byte goes if a string of length
    bytes that covers it also starts anywhere else in the table.

    Equal texts are one row with a count, bucketed by digest and written once; the
    lists of contexts that go to each text are no longer than the text. Digests of
    contexts, windows (of hot buckets) and texts have 128 bits; elsewhere bytes are
    compared.
    """
    spark, folder, n = docs.sparkSession, common.scratch(docs.sparkSession), common.partitions(docs.sparkSession)
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    keyed = docs.withColumn("_sha", F.sha2(content, 256)).withColumn("h1", _half("_sha", 1)).withColumn("h2", _half("_sha", 17))
    texts = keyed.where(F.octet_length(content) >= length).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.first(content).alias("text"))
    table = f"veldmark_{uuid.uuid4().hex}"
    texts.write.option("path", f"{folder}/texts").bucketBy(n, "h1", "h2").saveAsTable(table)
    texts = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay, and the plan knows them and their buckets

    found = common.stored(common.map_rows(texts, _find(length, q), ANCHOR_SCHEMA), folder, "anchors")
    shared_grams = found.groupBy("gram").agg(F.sum("n").alias("gram_n")).where("gram_n > 1").select("gram")
    found = common.stored(found.join(shared_grams, "gram").select("h1", "h2", "gram", "c1", "c2", "n"), folder, "shared")
    contexts = common.stored(found.groupBy("c1", "c2").agg(F.sum("n").alias("times"), F.min("h1").alias("first_h1"), F.min("gram").alias("gram")), folder, "contexts")
    mixed = contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")
    judged = contexts.join(mixed, "gram", "left").select("c1", "c2", "times", "first_h1", F.coalesce("variants", F.lit(1)).alias("variants"))
    judged = common.stored(found.select("h1", "h2", "c1", "c2").join(judged, ["c1", "c2"]).where("times > 1 OR variants > 1"), folder, "judged")

    asked = judged.where("variants > 1 AND h1 = first_h1").groupBy("h1", "h2").agg(F.collect_list(F.struct("c1", "c2", (F.col("times") == 1).alias("wanted"), (F.col("variants") > hot).alias("hot"))).alias("asked"))
    given = common.map_rows(texts.join(asked.hint("shuffle_hash"), ["h1", "h2"]).select("h1", "h2", "text", "asked"), _contexts(length, q), CONTEXT_SCHEMA)
    given = common.stored(given, folder, "given")
    parts = given.where("NOT hot").drop("hot").repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_refined(length), PART_SCHEMA)
    if not given.where("hot").isEmpty():
        windows = common.map_rows(given.where("hot").select("h1", "h2", "c1", "c2", "wanted", "context"), _windows(length), "h1 long, h2 long, c1 long, c2 long, wanted boolean, at int, k1 long, k2 long")
        windows = common.stored(windows, folder, "windows")
        again = windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("k1", "k2")
        ends = F.flatten(F.array_sort(F.collect_list(F.array("at", F.col("at") + 1))))
        parts = parts.union(windows.where("wanted").join(again, ["k1", "k2"]).groupBy("h1", "h2", "c1", "c2").agg(ends.alias("parts")))
    parts = common.stored(parts, folder, "parts")

    every = judged.where("times > 1").select("h1", "h2", "c1", "c2", F.lit(None).cast("array<int>").alias("parts")).union(parts)
    shared = every.groupBy("h1", "h2").agg(F.collect_list(F.struct("c1", "c2", "parts")).alias("shared"))
    cut = common.map_rows(texts.join(shared.hint("shuffle_hash"), ["h1", "h2"]).select("h1", "h2", "text", "shared"), _cut(length, q), "h1 long, h2 long, n_removed long, n_spans long, spans string, kept_sha256 string, kept binary")
    return keyed, cut


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = Q, hot: int = HOT) -> DataFrame:
    """One row per row of docs: id_col, n_bytes, n_removed, n_spans, kept_sha256, spans.

    spans lists the removed runs as start:end in bytes, end exclusive, with commas
    between. Null and empty texts have no bytes; repeated rows lose what they share;
    an empty table gives an empty result. Other columns of docs play no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed, cut = repeated_substrings(rows, "text", length, q, hot)
    joined = keyed.select("id", "h1", "h2", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "_sha").join(cut.drop("kept"), ["h1", "h2"], "left")
    none = F.lit(0).cast("long")
    return joined.select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", none).alias("n_removed"), F.coalesce("n_spans", none).alias("n_spans"), F.coalesce("kept_sha256", "_sha").alias("kept_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def without_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with repeated substrings cut from the text; bytes that are no UTF-8 any more become replacement characters."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    keyed, cut = repeated_substrings(rows)
    joined = keyed.join(cut.select("h1", "h2", F.col("kept").alias("rest")), ["h1", "h2"], "left")
    text = F.coalesce(F.make_valid_utf8(F.col("rest").cast("string")), F.col("text"))
    return joined.select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
