"""Words of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

from functools import cache
from typing import NamedTuple

import numpy as np

BLOCK = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1


class Words(NamedTuple):
    """hashes of all words; first: index of the first word of each text, and the total; start, end: bytes within joined."""

    hashes: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    joined: bytes
    text_start: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit with even odds."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@cache
def _word_byte() -> np.ndarray:
    """ASCII letters, digits and underscore, and all bytes of other characters."""
    table = np.zeros(256, bool)
    table[[b for b in range(128) if chr(b).isalnum() or chr(b) == "_"]] = True
    table[128:] = True
    return table


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, BLOCK * 2), _powers(pow(BASE, -1, 2**64), BLOCK * 2)


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(flag.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    return edge[::2], edge[1::2]


def hash_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte run; equal runs get equal hashes wherever they stand."""
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    up, down = _tables() if n <= BLOCK * 2 else (_powers(BASE, n), _powers(pow(BASE, -1, 2**64), n))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def fold(text: str) -> str:
    """Lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(texts: list[str]) -> Words:
    """Words are maximal runs of ASCII letters, digits, underscores and non-ASCII characters, in lower case."""
    parts = [fold(t).encode("utf-8", "replace") for t in texts]
    joined = b"\n".join(parts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    text_start = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=text_start[1:])
    hashes, starts, ends = [], [], []
    flag, at = _word_byte()[data], 0
    while at < len(data):
        stop = min(at + BLOCK, len(data))
        while stop < len(data) and flag[stop]:
            stop += 1
        s, e = _runs(flag[at:stop])
        hashes.append(hash_runs(data[at:stop], s, e))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    return Words(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.searchsorted(start, text_start), start, end, joined, text_start)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row; shingle i begins at word i."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += hashes[j : j + n]
    return mix(out)


def characters(found: Words, text: int, at: int) -> int:
    """The code point offset within its text of a byte offset within joined."""
    return len(found.joined[found.text_start[text] : at].decode("utf-8"))


class Lookup:
    """Ids of known 64-bit keys, -1 for others; a bitmap sets most others aside."""

    BITS = 20

    def __init__(self, keys: np.ndarray):
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.seen = np.zeros(1 << self.BITS, bool)
        self.seen[(self.keys >> np.uint64(64 - self.BITS)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        if not len(self.keys):
            return out
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(64 - self.BITS)).astype(np.int64)])
        at = np.searchsorted(self.keys, hashes[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[maybe]
        out[maybe[hit]] = self.order[at[hit]]
        return out
