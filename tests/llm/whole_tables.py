"""Holds the queries against plain versions on every document of a folder: python -m tests.llm.whole_tables FOLDER [QUERY ...]

Not collected by pytest: it takes minutes. Prints the rows that differ.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from veldmark.llm import decontaminate, near_dedup, pii


def op1(docs, rows, _):
    data = {i: (t or "").encode() for i, t in docs}
    seen, again = set(), set()
    for d in data.values():
        for k in range(len(d) - 399):
            h = hash(d[k : k + 400])
            (again if h in seen else seen).add(h)
    bad = 0
    for r in rows:
        d = data[r.doc_id]
        gone = np.zeros(len(d) + 1, np.int64)
        for k in range(len(d) - 399):
            if hash(d[k : k + 400]) in again:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        runs = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).tolist()
        kept = hashlib.sha256(np.frombuffer(d, np.uint8)[~gone].tobytes()).hexdigest()
        bad += (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.spans) != (len(d), int(gone.sum()), len(runs) // 2, kept, ",".join(f"{a}:{b}" for a, b in zip(runs[::2], runs[1::2], strict=True)))
    return bad, f"{sum(r.n_removed > 0 for r in rows)} documents lose bytes"


def op2(docs, rows, tables):
    """Every document that has an item's text word for word must be found with it; others are counted."""
    items = {r.item_id: " ".join(re.findall(r"[^\W]+", (r.text or "").lower())) for r in tables("benchmark")}
    plain = {i: f" {' '.join(re.findall(r'[^\W]+', (t or '').lower()))} " for i, t in docs}
    first = defaultdict(list)
    for k, t in items.items():
        if t:
            first[" ".join(t.split()[:3])].append(k)
    want = set()
    for i, t in plain.items():
        words = t.split()
        for j in range(len(words) - 2):
            want |= {(i, k) for k in first.get(" ".join(words[j : j + 3]), ()) if f" {items[k]} " in t}
    got = {(r.doc_id, r.item_id) for r in rows}
    return len(want - got), f"{len(want)} verbatim pairs, {len(got - want)} found beyond them, least overlap {decontaminate.LEAST_OVERLAP}"


def _spans(found, kinds, by_start):
    order = sorted(found, key=lambda s: (s[1], s[0])) if by_start else sorted(found)
    return hashlib.sha256(",".join(f"{kinds[k]}:{a}:{b}" for k, a, b in order).encode()).hexdigest()


def op5(docs, rows, _):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = {}
    for i, t in docs:
        t = t or ""
        found = [(0, m.start(), m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(1, m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
        n = Counter(k for k, *_ in found)
        want[i] = (n[0], n[1], n[2], _spans(found, ("assign", "access", "hex"), True))
    return sum((r.n_assign, r.n_access, r.n_hex, r.base_sha256) != want[r.doc_id] for r in rows), f"{sum(r.n_novel for r in rows)} further spans"


def op6(docs, rows, _):
    patterns = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = [lambda s: True, lambda s: all(int(p) <= 255 for p in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    want = {}
    for i, t in docs:
        found = [(k, m.start(), m.end()) for k, p in enumerate(patterns) for m in p.finditer(t or "") if fits[k](m[0])]
        n = Counter(k for k, *_ in found)
        want[i] = (*(n[k] for k in range(4)), _spans(found, ("email", "ip", "card", "phone"), False))
    return sum((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) != want[r.doc_id] for r in rows), f"{sum(want[i][0] for i in want)} addresses"


def op7(docs, rows, _):
    """Classes by comparing every two texts that share a shingle, and pairs by similarity."""
    sets, by_class = {}, {}
    for i, t in docs:
        grams, weight, _ = near_dedup.weighted_shingles([t or ""])
        if len(grams):
            by_class.setdefault(grams.tobytes() + weight.tobytes(), []).append(i)
            sets[i] = grams, weight
    parent = {i: i for i, _ in docs}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        a, b = sorted((find(a), find(b)))
        parent[b] = a

    reps = []
    for own in by_class.values():
        reps.append(min(own))
        for i in own:
            join(own[0], i)
    postings, bands = defaultdict(list), Counter()
    for i in reps:
        shared = Counter()
        grams, weight = sets[i]
        for g, w in zip(grams.tolist(), weight.tolist(), strict=True):
            for j, v in postings[g]:
                shared[j] += min(w, v)
            postings[g].append((i, w))
        for j, common in shared.items():
            if common >= 0.4 * min(weight.sum(), sets[j][1].sum()):
                like = near_dedup.probability_jaccard(sets[i], sets[j])
                bands[next((b for b in (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4) if like >= b), 0)] += 1
                if like >= near_dedup.LEAST - 1e-12:
                    join(i, j)
    size = Counter(find(i) for i in parent)
    bad = sum((r.class_id, r.class_size, r.kept) != (find(r.doc_id), size[find(r.doc_id)], find(r.doc_id) == r.doc_id) for r in rows)
    return bad, "pairs of different texts by similarity from: " + ", ".join(f"{b} {bands[b]}" for b in sorted(bands, reverse=True) if b)


def op8(docs, rows, _):
    by = defaultdict(list)
    for i, t in docs:
        by[t or ""].append(i)
    want = {i: (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids}
    return sum(tuple(r)[1:] != want[r.doc_id] for r in rows), f"{len(by)} texts"


def op9(docs, rows, _):
    from tokenizers import Tokenizer

    library, text = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), dict(docs)
    bad = 0
    for r in rows:
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        bad += (r.n_tokens, r.ids_sha256, r.decoded_sha256) != (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    return bad, f"{sum(r.n_tokens for r in rows)} tokens"


def held_out(column):
    def check(docs, rows, tables):
        truth = dict(docs)
        if column == "quality":
            truth = {r.doc_id: r.quality for r in tables("labels")}
            own = [(r.predicted, truth.get(r.doc_id)) for r in rows if r.held_out]
        else:
            truth = {r.doc_id: r.lang for r in tables("documents")}
            own = [(r.lang_pred, truth.get(r.doc_id)) for r in rows if r.held_out]
        own = [(p, t) for p, t in own if t is not None]
        return sum(p != t for p, t in own), f"of {len(own)} held-out rows"

    return check


CHECKS = {"op1_suffix_dedup": op1, "op2_decontaminate": op2, "op3_quality": held_out("quality"), "op4_language_id": held_out("lang"), "op5_secrets": op5, "op6_personal_data": op6, "op7_near_dedup": op7, "op8_exact_dedup": op8, "op9_bpe": op9}


def main(folder: str, names: list[str]) -> None:
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "12g").config("spark.driver.maxResultSize", "4g").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    for name in names or CHECKS:
        rows = entry.queries()[name](spark, folder).collect()
        bad, note = CHECKS[name](docs, rows, lambda t: spark.read.parquet(f"{folder}/{t}.parquet").collect())
        print(f"{name}: {len(rows)} rows over {len(docs)} documents, {bad} differ; {note}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
