"""Exact deduplication through a cuckoo-filter index of live digests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common

WAYS = 4
KICKS = 200
#: Entries of a map-side index; beyond it, the partial groups go out and the index starts anew.
MAP_SIDE = 50_000


class CuckooIndex:
    """Cuckoo filter over digests, with the stored keys beside the fingerprints.

    A digest has two buckets of four fingerprints. A fingerprint hit is verified
    against the key stored in the same slot, so answers are exact. An insertion
    that finds no room after KICKS displacements doubles the table and refills it
    from the stored keys.
    """

    def __init__(self, buckets: int = 64):
        self.size = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * WAYS * buckets))
        self.keys: list[bytes | None] = [None] * (WAYS * buckets)
        self.values: list = [None] * (WAYS * buckets)

    def _print(self, key: bytes) -> int:
        """Two bytes that neither the sorting prefix nor the first bucket is taken from."""
        return int.from_bytes(key[16:18], "little") or 1

    def _first(self, key: bytes) -> int:
        return int.from_bytes(key[24:32], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995 >> 3)) & self.mask

    def _find(self, key: bytes) -> int:
        mark = self._print(key)
        one = self._first(key)
        for bucket in (one, self._other(one, mark)):
            for slot in range(bucket * WAYS, bucket * WAYS + WAYS):
                if self.prints[slot] == mark and self.keys[slot] == key:
                    return slot
        return -1

    def get(self, key: bytes):
        slot = self._find(key)
        return None if slot < 0 else self.values[slot]

    def put(self, key: bytes, value) -> None:
        slot = self._find(key)
        if slot >= 0:
            self.values[slot] = value
            return
        self.size += 1
        left = self._place(key, value)
        while left is not None:
            left = self._grow(left)

    def delete(self, key: bytes) -> bool:
        slot = self._find(key)
        if slot < 0:
            return False
        self.prints[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.size -= 1
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)

    def _place(self, key: bytes, value) -> tuple | None:
        mark = self._print(key)
        bucket = self._first(key)
        for kick in range(KICKS):
            for b in (bucket, self._other(bucket, mark)):
                for slot in range(b * WAYS, b * WAYS + WAYS):
                    if self.keys[slot] is None:
                        self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
                        return None
            slot = self._other(bucket, mark) * WAYS + kick % WAYS
            out = self.prints[slot], self.keys[slot], self.values[slot]
            self.prints[slot], self.keys[slot], self.values[slot] = mark, key, value
            bucket = slot // WAYS
            mark, key, value = out
        return key, value

    def _grow(self, left: tuple) -> tuple | None:
        """Twice the buckets, filled from the stored keys; gives back an entry that finds no room even so."""
        kept = [*self.items(), left]
        buckets = 2 * (self.mask + 1)
        while True:
            self._clear(buckets)
            for entry in kept:
                if self._place(*entry) is not None:
                    break
            else:
                return None
            buckets *= 2


def _larger(a, b):
    return b if a is None else a if b is None else max(a, b)


def _merge(index: CuckooIndex, digest: bytes, keep, n: int) -> None:
    old = index.get(digest)
    index.put(digest, (keep, n) if old is None else (_larger(old[0], keep), old[1] + n))


SCHEMA = "digest binary, keep_id long, n long"
OUT = pa.schema([("digest", pa.binary()), ("keep_id", pa.int64()), ("n", pa.int64())])


def _rows(groups: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in groups], pa.binary()), pa.array([v[0] for _, v in groups], pa.int64()), pa.array([v[1] for _, v in groups], pa.int64())], schema=OUT)


def _partial(batches):
    """Groups of one task's rows, so that a text with many copies leaves each task as one row."""
    index = CuckooIndex()
    for batch in batches:
        for digest, keep, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            _merge(index, digest, keep, n)
        if index.size > MAP_SIDE:
            yield _rows(list(index.items()))
            index = CuckooIndex()
    if index.size:
        yield _rows(list(index.items()))


def _final(batches):
    """Rows come in order of their prefix; digests of a prefix that is over leave the index."""
    index, prefix = CuckooIndex(), None
    for batch in batches:
        done = []
        for digest, keep, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (now := digest[0] << 4 | digest[1] >> 4) != prefix:
                over = list(index.items())
                for old, _ in over:
                    index.delete(old)
                done += over
                prefix = now
            _merge(index, digest, keep, n)
        if done:
            yield _rows(done)
    if index.size:
        yield _rows(list(index.items()))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col (an integer), keep_id, group_size, kept, text_sha256.

    Texts are equal when their characters are; null counts as the empty text. Of
    equal texts the row with the largest id stays. A null id is smaller than all
    others. Of rows that repeat both id and text, one is kept. An empty table gives
    an empty result; other columns of docs play no part.

    Text leaves the scan as a SHA-256 digest. Each task merges its digests in a
    cuckoo index, the partial groups meet by digest, and a second index merges
    them. Digests live in an index only until their prefix is over.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    base = docs.select(F.col(id_col).alias("id"), digest.alias("digest")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("reps"))
    partial = base.select("digest", F.col("id").cast("long").alias("keep_id"), F.col("reps").alias("n")).mapInArrow(_partial, SCHEMA)
    n = common.partitions(docs.sparkSession)
    groups = partial.repartition(n, "digest").sortWithinPartitions(F.substring("digest", 1, 2)).mapInArrow(_final, SCHEMA).withColumnRenamed("digest", "of")
    return base.join(groups, F.col("digest") == F.col("of")).select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.explode(F.sequence(F.lit(1).cast("long"), "reps")).alias("rep"), F.lower(F.hex("digest")).alias("text_sha256")
    ).select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("rep") == 1)).alias("kept"), "text_sha256")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with the columns of docs."""
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("id"), F.col("text_sha256").alias("digest"), F.lit(1).alias("reps"))
    return common.kept_rows(docs, kept, id_col, F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
