"""Personal data in texts: patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common

KINDS = ("email", "ip", "card", "phone", "iban")
# The base patterns. An address starts where its run of characters does; a part after @ is matched in place.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
# Characters of an international account number by country, as the public registry of ISO 13616 lists them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_BODY = {c: re.compile(rf"(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + "(?![A-Za-z0-9])") for n, countries in IBAN_LENGTHS.items() for c in countries.split()}
DIGITS = re.compile("[^0-9]+")

#: Score without context of each kind, what a context word adds, and how far it reaches.
SCORE = {"email": 0.85, "ip": 0.5, "card": 0.7, "phone": 0.55, "iban": 0.9}
BONUS, REACH = 0.15, 48
# Words that speak for a kind.
CONTEXT = {
    "email": ("mail", "e-mail", "contact", "address", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "credit", "visa", "payment", "account"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "payment"),
}
WORDS = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, v)) + r")\b", re.IGNORECASE) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an international account number: letters count from 10, the first four characters go last."""
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _emails(text: str):
    """Leftmost matches, found from their @: a run of local characters, no part of an earlier match, then a domain."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start."""
    out = [(0, s, e) for s, e in _emails(text)]
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15]
    return out


def more_spans(text: str) -> list[tuple[int, int, int]]:
    """Account numbers of their country's length, in groups of four or without blanks, that pass their check."""
    out, done = [], 0
    for head in IBAN.finditer(text):
        body = IBAN_BODY[head[1]].match(text, head.end()) if head[1] in IBAN_BODY and head.start() >= done else None
        if body and mod97(text[head.start() : body.end()]):
            done = body.end()
            out.append((4, head.start(), done))
    return out


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    return round(min(1.0, SCORE[kind] + BONUS * bool(WORDS[kind].search(near))), 2)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_email, n_ip, n_card, n_phone, n_iban, base_sha256, spans, scores.

    Spans are kind:start:end in code points, end exclusive, by kind and start; scores
    has a number from 0 to 1 for each span in the same order. Null and empty texts
    have none; repeated rows have equal results, an empty table an empty one. Of
    matches of one kind that overlap the leftmost counts; kinds may overlap. Digits
    and letters of patterns are ASCII only. Other columns of docs play no part.
    """

    def make():
        def work(batch: dict) -> dict:
            out = {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "scores")}
            for text in batch["text"]:
                text = text or ""
                base, more = base_spans(text), more_spans(text)
                for k, kind in enumerate(KINDS):
                    out[f"n_{kind}"].append(sum(1 for s in (more if k == 4 else base) if s[0] == k))
                out["base_sha256"].append(hashlib.sha256(_listed(base).encode()).hexdigest())
                out["spans"].append(_listed(base + more))
                out["scores"].append(",".join(str(score(text, KINDS[k], s, e)) for k, s, e in base + more))
            return out | {"id": batch["id"]}

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    counts = [f"n_{k} long" for k in KINDS]
    return common.map_rows(rows, make, f"id {kind}, {', '.join(counts[:4])}, base_sha256 string, spans string, {counts[4]}, scores string").withColumnRenamed("id", id_col)
