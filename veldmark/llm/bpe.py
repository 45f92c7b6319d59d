"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common

END = "\n"  # stands for the end of a word; the byte alphabet has no such character
CACHED_WORDS = 400_000
CACHED_PAIRS = 1_000_000
NEVER = 1 << 60


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself if it is printable Latin-1, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@cache
def _class(kind: str) -> str:
    """Ranges of a regular expression class: the basic plane's characters of a category."""
    wanted = (lambda c: c in WHITE) if kind == "s" else (lambda c: unicodedata.category(c)[0] == kind)
    out, start = [], None
    for i in range(0x10001):
        inside = i < 0x10000 and not 0xD800 <= i < 0xE000 and wanted(chr(i))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{i - 1:04x}")
            start = None
    return "".join(out)


#: The characters with the Unicode property White_Space.
WHITE = {*map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))}


def merge_pairs(symbols: list[int], ranks: dict[tuple[int, int], int]) -> list[int]:
    """Plain merging: the lowest-ranked pair first, leftmost first."""
    symbols = list(symbols)
    while len(symbols) > 1:
        best = min(((ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False))), default=None)
        if best[0] == 1 << 60:
            break
        i = best[1]
        symbols[i : i + 2] = [best[0]]
    return symbols


class Codec:
    """Encoder and decoder of a tokenizers file of this kind: NFC, white space, lower case; a splitting pattern; byte-level BPE with word ends.

    Ids of merged tokens must rise with the rank of their merge, as they do in such files.
    """

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        splitter = spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splitter["behavior"] != "Removed" or not splitter["invert"] or model["ignore_merges"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("a tokenizer of another kind")
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        alphabet = byte_alphabet()
        self.table = {b: c for b, c in enumerate(alphabet)}
        self.text = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.text[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.text[i] = token

        forms: dict[int, str] = {}
        for c in alphabet:
            forms |= {vocab[c]: c, vocab[c + suffix]: c + END}
        self.split = {i: (i, i) for i in forms}
        self.base = {s: i for i, s in forms.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        last = max(forms)
        for merge in model["merges"]:
            a, b = (vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            i = vocab[self.text[a] + self.text[b]]
            if i <= last:
                raise ValueError("ids don't rise with the rank of merges")
            last = i
            self.pairs[a, b], self.split[i], forms[i] = i, (a, b), forms[a] + forms[b]
        self.size = {i: len(s) for i, s in forms.items()}
        own = {s: i for i, s in forms.items() if len(s) <= 2 or self.plain(s) == [i]}
        self.automaton = ahocorasick.Automaton()
        self.prefix: dict[int, int] = {}
        for s, i in own.items():
            self.automaton.add_word(s, i)
            self.prefix[i] = next((own[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in own), -1)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.edges: tuple[dict[int, list[int]], dict[int, list[int]]] = {}, {}
        self.known: dict[str, bytes] = {}

        pattern = splitter["pattern"]["Regex"]
        self.wide = regex.compile(pattern.replace("\\s", "".join(sorted(map(re.escape, WHITE)))))
        self.narrow = re.compile(pattern.replace("\\p{L}", _class("L")).replace("\\p{N}", _class("N")).replace("\\s", _class("s")))
        self.astral = re.compile("[\U00010000-\U0010ffff]")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pieces = [t.encode() + b" " for t in self.text]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offset = np.zeros(len(pieces) + 1, np.int64)
        np.cumsum([len(p) for p in pieces], out=self.offset[1:])

    def form(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.table) + END

    def plain(self, form: str) -> list[int]:
        last = [form[-2:]] if form.endswith(END) else []
        return merge_pairs([self.base[c] for c in [*form[: len(form) - 2 * len(last)], *last]], self.pairs)

    def _edge(self, token: int, side: int) -> list[int]:
        """The tokens that stand at a token's first (0) or last (1) place while it is merged: a single byte, then ever larger ones, then itself."""
        found = self.edges[side].get(token)
        if found is None:
            found = [token]
            while (part := self.split[found[-1]][side]) != found[-1]:
                found.append(part)
            found.reverse()
            self.edges[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging left + right gives these two tokens again.

        Merges happen in the order of their ids. Between two merges one token stands
        on each side of the seam; they merge if their pair's id comes before that of
        the merge that takes either away. With equal ids the merge further left is
        first: the left side's own before the seam's, the seam's before the right side's.
        """
        key = left << 32 | right
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        last, first = self._edge(left, 1), self._edge(right, 0)
        i, j, fits = 0, 0, None
        while fits is None:
            taken_left = last[i + 1] if i + 1 < len(last) else NEVER
            taken_right = first[j + 1] if j + 1 < len(first) else NEVER
            seam = self.pairs.get((last[i], first[j]), NEVER)
            if seam < taken_left and seam <= taken_right:
                fits = False
            elif taken_left == taken_right == NEVER:
                fits = True
            elif taken_left <= taken_right:
                i += 1
            else:
                j += 1
        self.fits[key] = fits
        return fits

    def _walk(self, at: int, stop: int, longest: list[int]) -> list[int]:
        """Tokens of one word: the longest match, else its longest prefix token, that fits the token before; dead ends are taken back once."""
        tokens: list[int] = []
        size, prefix, dead = self.size, self.prefix, set()
        token = longest[at]
        while at < stop:
            while token >= 0 and (at + size[token] in dead or tokens and not self.compatible(tokens[-1], token)):
                token = prefix[token]
            if token >= 0:
                tokens.append(token)
                at += size[token]
                token = longest[at] if at < stop else -1
            else:
                dead.add(at)
                token = tokens.pop()
                at -= size[token]
        return tokens

    def learn(self, words: list[str]) -> None:
        """Encode distinct words and keep their ids."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        forms = [self.form(w) for w in words]
        joined = "".join(forms)
        longest = [-1] * len(joined)
        for end, token in self.automaton.iter(joined):
            longest[end + 1 - self.size[token]] = token
        at = 0
        for word, form in zip(words, forms, strict=True):
            self.known[word] = np.array(self._walk(at, at + len(form), longest), "<u4").tobytes()
            at += len(form)

    def split_words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character by itself: no final sigma
        low = text.lower()
        return (self.wide if not low.isascii() and self.astral.search(low) else self.narrow).findall(low)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for part in self.marks.split(text) if self.marks and "<" in text else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            words = self.split_words(part)
            try:
                known = self.known
                out.append(b"".join([known[w] for w in words]))
            except KeyError:
                missing = [w for w in dict.fromkeys(words) if w not in self.known]
                held = {w: self.known[w] for w in set(words) if w in self.known} if len(self.known) + len(missing) > CACHED_WORDS else None
                self.learn(missing)
                if held:
                    self.known |= held
                out.append(b"".join([self.known[w] for w in words]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token texts with a space between them."""
        every, out = np.frombuffer(ids, "<u4").astype(np.int64), []
        for at in range(0, len(every), 1 << 18):
            part = every[at : at + (1 << 18)]
            begin, size = self.offset[part], self.offset[part + 1] - self.offset[part]
            shift = np.repeat(begin - (np.cumsum(size) - size), size)
            out.append(self.blob[shift + np.arange(len(shift))].tobytes())
        return b"".join(out)[:-1].decode()


_codecs: dict[int, Codec] = {}


def codec(source: str) -> Codec:
    """One codec for each worker process and tokenizer."""
    key = hash(source)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(sys.intern(source))
    return _codecs[key]


def _encoded(docs: DataFrame, tokenizer: str, text_col: str, decode: bool) -> DataFrame:
    """numbered(docs) without its text, then n_tokens, ids and, if asked for, decoded."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        own = codec(shared.value)

        def work(batch: dict) -> dict:
            ids = [own.encode(t) for t in batch["text"]]
            out = {"n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            return out | {"decoded": [own.decode(x) for x in ids]} if decode else out

        return work

    text = common.at(docs, text_col)
    return common.add_columns(common.numbered(docs), {"text": text}, make, "n_tokens long, ids binary" + ", decoded string" * decode, (text,))


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", decode: bool = False) -> DataFrame:
    """The columns of docs but the text, then n_tokens, ids (binary, little-endian unsigned 32-bit) and, if asked for, decoded.

    Equal to the tokenizers library without added tokens. Null and empty texts have
    no ids and decode to the empty text. Special tokens' strings within a text give
    their own ids. Repeated rows have equal results, an empty table an empty one.
    Columns of docs stay as they are: where one has the name of a new column, the
    new one gets an underscore. tokenizer is the path of a tokenizers file, read by
    the driver.
    """
    added = ["n_tokens", "ids", *(["decoded"] if decode else [])]
    return common.renamed(_encoded(docs, tokenizer, text_col, decode), docs.drop(text_col), added)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_tokens, and SHA-256 of the ids and of the decoded text, in lower-case hex.

    Null and empty texts have no tokens, and digests of no bytes; ids may be null or
    repeat. An empty table gives an empty result. Other columns play no part.
    """
    done = encode(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), tokenizer, decode=True)
    return done.select(F.col("id").alias(id_col), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
