"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common

BITS = 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
#: Labelled rows that training takes of each language, on average over hashes of the id.
ROWS_PER_LANG = 600
#: Languages that a model can have; it takes 128 KB for each.
MOST_LANGS = 1000
LETTER = regex.compile(r"\p{L}")
UND = "und"


@cache
def _letters() -> np.ndarray:
    """Code points of the basic plane by themselves if letters, else a space."""
    table = np.full(1 << 16, 32, np.uint32)
    found = [i for i in range(1 << 16) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]
    table[found] = found
    return table


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse rows: hashed n-grams of all texts one after the other, and where each text begins."""
    low = [t.lower() for t in texts]
    joined = " ".join(f" {t} " for t in low)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letters = np.where(points < 1 << 16, _letters()[np.minimum(points, 0xFFFF)], points)
    starts = np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + 3 for t in low[:-1]], out=starts[1:])
    space, columns = letters == 32, []
    padded = np.concatenate([letters, np.full(2, 32, np.uint32)])
    grams = np.zeros(len(letters), np.uint32)
    for n in ORDERS:
        grams = (grams + padded[n - 1 : n - 1 + len(letters)]) * np.uint32(0x9E3779B1)
        ids = (((grams ^ (grams >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)).astype(np.int32)
        if n == 1:
            ids[space] = 1 << BITS  # no feature
        else:
            ids[space & (padded[1 : 1 + len(letters)] == 32)] = 1 << BITS
        columns.append(ids)
    return np.stack(columns), starts


@dataclass
class Model:
    langs: list[str]
    log_prob: np.ndarray  # language x bucket, a last bucket of zeros
    prior: np.ndarray


def fit(docs: DataFrame, train, id_col: str, text_col: str, lang_col: str, rows_per_lang: int = ROWS_PER_LANG) -> Model | None:
    """Counts of a sample of the rows where train holds; None if there are none.

    The sample is bounded by rows_per_lang rows of each language on average, taken
    by a hash of the id; counts come to the driver as languages x buckets at most.
    More than MOST_LANGS languages are an error.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if len(found) > MOST_LANGS:
        raise ValueError(f"over {MOST_LANGS} languages: the column of languages is no such column")
    share = {r["lang"]: r["n"] for r in found}
    if not share:
        return None
    langs = sorted(share)
    scale = 1 << 24
    limits = F.create_map(*[F.lit(x) for k in langs for x in (k, min(scale, scale * rows_per_lang // share[k] + 1))])
    taken = rows.where(F.pmod(F.xxhash64("id", "lang"), F.lit(scale)) < limits[F.col("lang")])

    def make():
        def work(batch: dict) -> dict:
            out = {"lang": [], "bucket": [], "n": []}
            for lang in set(batch["lang"]):
                total = np.zeros((1 << BITS) + 1, np.int64)
                texts = [t for t, x in zip(batch["text"], batch["lang"], strict=True) if x == lang]
                for a, b in common.slices(texts):
                    total += np.bincount(features(texts[a:b])[0].ravel(), minlength=(1 << BITS) + 1)
                found = np.flatnonzero(total[:-1])
                out["lang"] += [lang] * len(found)
                out["bucket"] += found.tolist()
                out["n"] += total[found].tolist()
            return out

        return work

    counts = np.full((len(langs), 1 << BITS), SMOOTH)
    at = {k: i for i, k in enumerate(langs)}
    with common.small_batches(docs.sparkSession):
        for r in common.map_rows(taken, make, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
            counts[at[r["lang"]], r["bucket"]] += r["n"]
    log_prob = np.zeros((len(langs), (1 << BITS) + 1), np.float32)
    log_prob[:, :-1] = np.log(counts / counts.sum(axis=1, keepdims=True))
    total = sum(share.values())
    return Model(langs, log_prob, np.log([share[k] / total for k in langs]))


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Most likely language and its posterior probability; und and 0 without a letter."""
    lang, score = [UND] * len(texts), [0.0] * len(texts)
    found = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if model is None:
        return lang, score
    for a, b in common.slices([texts[i] for i in found]):
        rows = found[a:b]
        ids, starts = features([texts[i] for i in rows])
        like = np.zeros((len(rows), len(model.langs)))
        for k, table in enumerate(model.log_prob):
            weight = table[ids[0]]
            for other in ids[1:]:
                weight = weight + table[other]
            like[:, k] = np.add.reduceat(weight, starts, dtype=np.float64)
        like += model.prior
        like = np.exp(like - like.max(axis=1, keepdims=True))
        like /= like.sum(axis=1, keepdims=True)
        best = like.argmax(axis=1)
        for i, k, p in zip(rows, best, like[np.arange(len(rows)), best], strict=True):
            lang[i], score[i] = model.langs[k], float(p)
    return lang, score


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """numbered(docs) with lang_pred and score after its columns."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make():
        own = pickle.loads(shared.value)

        def work(batch: dict) -> dict:
            lang, score = predict(own, batch["text"])
            return {"lang_pred": lang, "score": score}

        return work

    return common.add_columns(common.numbered(docs), {"text": common.at(docs, text_col)}, make, "lang_pred string, score double")


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score after its columns; where docs has such a name itself, the new one gets an underscore."""
    return common.renamed(identified(docs, model, text_col), docs, ["lang_pred", "score"])


def told(docs: DataFrame, model: Model | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose language has a posterior of least or more, with the columns of docs; texts without a letter go."""
    rows = identified(docs, model, text_col).where((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return rows.drop("lang_pred", "score").toDF(*docs.columns)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: id_col, held_out, lang_pred, score.

    Learns from text and non-null language of rows whose crc32(id as text) mod 4 is
    not 2. A text that is null or has no letter gets und and score 0, as do all if
    no row teaches a language. A null id is not held out. Of languages with equal
    posteriors the first by name is told. Repeated rows count, and are answered, each
    by itself; an empty table gives an empty result. Other columns play no part.
    """
    model = fit(docs, ~common.held_out(id_col), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), common.held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model, "text").select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")
