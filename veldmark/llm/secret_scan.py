"""Secrets in texts: fixed patterns, and strings that a primed compressor can't shorten."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common

KINDS = ("assign", "access", "hex", "novel")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make a context sensitive, and the characters before or after a candidate in which they count.
SENSITIVE = re.compile(r"passw|pwd|secret|token|api.?key|access.?key|credential|auth|bearer|private|signature", re.IGNORECASE | re.ASCII)
REACH = 48
AROUND = 256
#: A string, or several with a dot between, as in web tokens.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{8,})*={0,2}(?![A-Za-z0-9+/_=-])")
#: Least marginal bits a character of a string that is reported; hexadecimal digits carry 4.
LEAST_BITS = 4.5

# Identifiers and code that prime the compressor, so that names are not novel.
DICTIONARY = """
import os import sys import json import requests from datetime import datetime return None True False self
def get_access_token(client_id, client_secret): def authenticate(username, password): def load_credentials(path):
const apiKey = process.env.API_KEY; const secret = process.env.SECRET_KEY; export AWS_SECRET_ACCESS_KEY= export AWS_ACCESS_KEY_ID=
config["database"]["password"] = os.environ["DATABASE_PASSWORD"] headers = {"Authorization": "Bearer " + token, "Content-Type": "application/json"}
private static final String SECRET_TOKEN = "your_secret_token_here"; public void setPassword(String password) { this.password = password; }
SELECT user_id, password_hash, created_at, updated_at FROM accounts WHERE username = example placeholder changeme default_value_for_testing
https://www.example.com/api/v1/authentication/sessions localhost connection_string secret_key_base token_type refresh_token access_token id_token
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx 0000000000000000 aaaaaaaaaaaaaaaa
"""


class Novelty:
    """Marginal compressed bits a character of a string between its surroundings."""

    def __init__(self, dictionary: str = DICTIONARY):
        data = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=12, dict_data=data).compress

    def bits(self, before: str, text: str, after: str) -> float:
        without = len(self.compress((before + after).encode("utf-8", "replace")))
        return 8 * (len(self.compress((before + text + after).encode("utf-8", "replace"))) - without) / max(1, len(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if "=" in text or ":" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _classes(text: str) -> int:
    return any(c.islower() for c in text) + any(c.isupper() for c in text) + any(c.isdigit() for c in text)


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int, int]]:
    """Strings near sensitive words, of two character classes at least, outside base spans, that stay incompressible."""
    found = list(SENSITIVE.finditer(text))
    begin, end = [m.start() for m in found], [m.end() for m in found]
    out = []
    for m in CANDIDATE.finditer(text) if found else ():
        before, after = bisect_right(end, m.start()), bisect_left(begin, m.end())
        near = before and m.start() - end[before - 1] <= REACH or after < len(begin) and begin[after] - m.end() <= REACH
        if not near or _classes(m[0]) < 2 or any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        if novelty.bits(text[max(0, m.start() - AROUND) : m.start()], m[0], text[m.end() : m.end() + AROUND]) >= LEAST_BITS:
            out.append((m.start(), 3, m.end()))
    return out


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_assign, n_access, n_hex, n_novel, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and kind; a
    span is the whole match. Null and empty texts have none; repeated rows have equal
    results, an empty table an empty one. A candidate for novelty is 16 characters or
    longer, stands within 48 characters after or before a sensitive word, overlaps no
    base span, and is reported if it adds 4.5 bits a character to the compressed size
    of its surroundings. Letters of patterns are ASCII only. Other columns of docs
    play no part.
    """

    def make():
        novelty = Novelty()

        def work(batch: dict) -> dict:
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")}
            for text in batch["text"]:
                base = base_spans(text or "")
                more = novel_spans(text, base, novelty) if text else []
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(1 for s in (more if k == 3 else base) if s[1] == k))
                out["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                out["spans"].append(_listed(sorted(base + more)))
            return out | {"id": batch["id"]}

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return common.map_rows(rows, make, f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long").withColumnRenamed("id", id_col)
