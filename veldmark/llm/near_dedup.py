"""Near-duplicates: ProbMinHash signatures of weighted shingles, banding, verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldmark.llm import _common as common
from veldmark.llm._text import mix, shingles, words

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 25, 5
#: Bytes of texts on either side of a block in which members of a bucket are compared.
BLOCK = 8 << 20
STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of all texts one after the other, their weights, and where each text begins.

    A shingle's weight is 1 + log2 of its count, so that one line said a hundred
    times doesn't make all texts with it alike.
    A text of one to four words has one shingle of all its words, one without words has none.
    """
    found = words(texts)
    size = np.diff(found.first)
    grams = shingles(found.hashes, SHINGLE)
    text_of = np.repeat(np.arange(len(texts)), size)
    whole = np.flatnonzero(text_of[: len(grams)] == text_of[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    grams, text_of = grams[whole], text_of[whole]
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    if len(short):
        grams = np.concatenate([grams, *(shingles(found.hashes[found.first[i] : found.first[i + 1]], int(size[i])) for i in short)])
        text_of = np.concatenate([text_of, short])
    order = np.lexsort((grams, text_of))
    grams, text_of = grams[order], text_of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(new)
    return grams[at], 1 + np.log2(np.diff(np.append(at, len(grams)))), np.searchsorted(text_of[at], np.arange(len(texts) + 1))


def prob_min_hash(grams: np.ndarray, weight: np.ndarray, first: np.ndarray, registers: int = BANDS * ROWS) -> np.ndarray:
    """The element that arrives first in each register: text x register. Two texts agree in a register with the probability Jaccard of their weights.

    Each element is a Poisson process whose rate is its weight; its arrivals fall
    into registers at random, and both depend on the element only. An element ends
    with its first arrival after the text's horizon; a text with an empty register
    at its horizon goes again with one twice as far.
    """
    n = len(first) - 1
    out = np.zeros((n, registers), np.uint64)
    text_of = np.repeat(np.arange(n), np.diff(first))
    rate = np.bincount(text_of, weights=weight, minlength=n)
    horizon = np.divide(registers * (np.log(registers) + 3), rate, out=np.zeros(n), where=rate > 0)
    open_texts = rate > 0
    while open_texts.any():
        live = np.flatnonzero(open_texts[text_of])
        at = np.zeros(len(live))
        cells, times, elements = [], [], []
        draw = 0
        while len(live):
            draw += 1
            seed = mix(grams[live] + np.uint64(int(STEP) * draw % 2**64))
            at = at - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
            early = at <= horizon[text_of[live]]
            live, at = live[early], at[early]
            cells.append(text_of[live] * registers + (mix(seed[early] ^ STEP) % np.uint64(registers)).astype(np.int64))
            times.append(at)
            elements.append(live)
        cell, time, element = np.concatenate(cells), np.concatenate(times), np.concatenate(elements)
        best = np.full(n * registers, np.inf)
        np.minimum.at(best, cell, time)
        won = time == best[cell]
        full = np.isfinite(best).reshape(n, registers).all(axis=1) & open_texts
        won &= full[cell // registers]
        out.reshape(-1)[cell[won]] = grams[element[won]]
        open_texts &= ~full
        horizon[open_texts] *= 2
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, parts.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key.view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common elements i of 1 / sum over j of max(a_j / a_i, b_j / b_i). Each argument: sorted elements and their weights."""
    common_ids, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common_ids):
        return 0.0
    wa, wb = a[1][ia].astype(float), b[1][ib].astype(float)
    only_a, only_b = a[1].sum() - wa.sum(), b[1].sum() - wb.sum()
    ratio = wb / wa
    order = np.argsort(ratio, kind="stable")
    wa, wb, ratio = wa[order], wb[order], ratio[order]
    # max(a_j / a_i, b_j / b_i) is the first where ratio_j <= ratio_i
    upto = np.searchsorted(ratio, ratio, side="right")
    sum_a, sum_b = np.concatenate([[0], np.cumsum(wa)]), np.concatenate([[0], np.cumsum(wb)])
    return float(np.sum(1 / ((only_a + sum_a[upto]) / wa + (only_b + sum_b[-1] - sum_b[upto]) / wb)))


def _signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, txt (digest of the text), cls (digest of its weighted shingles, null without words), bands."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("txt"), text.alias("text"))

    def make():
        def work(batch: dict) -> dict:
            texts, cls, bands = batch["text"], [], []
            for a, b in common.slices(texts, 1 << 18):
                grams, count, first = weighted_shingles(texts[a:b])
                keys = band_keys(prob_min_hash(grams, count, first))
                for i in range(b - a):
                    s = slice(first[i], first[i + 1])
                    some = first[i] < first[i + 1]
                    cls.append(xxhash.xxh3_128_digest(grams[s].tobytes() + count[s].tobytes()) if some else None)
                    bands.append(keys[i] if some else None)
            return {"id": batch["id"], "txt": batch["txt"], "cls": cls, "bands": bands}

        return work

    return common.map_rows(rows, make, f"id {dict(rows.dtypes)['id']}, txt binary, cls binary, bands array<long>")


def _digest(text_col: str):
    return F.unhex(F.substring(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256), 1, 32))


def _linked(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are at least so similar."""
    full = common.joined(common.joined(pairs, texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a"), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def make():
        def work(batch: dict) -> dict:
            out = {"a": [], "b": []}
            rows = list(zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True))
            kept: dict = {}  # several pairs have the same pivot
            for a, b, text_a, text_b in rows:
                sets = []
                for node, text in ((a, text_a), (b, text_b)):
                    if node not in kept:
                        if len(kept) > 64:
                            kept.clear()
                        kept[node] = weighted_shingles([text])[:2]
                    sets.append(kept[node])
                if probability_jaccard(*sets) >= least - 1e-12:
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return work

    return common.map_rows(full, make, "a long, b long")


def across_components(rows: list[tuple[int, bool, int, str]], least: float = LEAST) -> list[tuple[int, int]]:
    """Links of one bucket, enough to join all roots that have a link there. Rows: node, whether it is a probe, root, text.

    Each probe meets every target of another root in an inverted index of shingles.
    Shares of common weight bound the probability Jaccard from above; without
    repeated shingles it is the plain Jaccard, which the counts give at once.
    """
    targets = [r for r in rows if not r[1]]
    if not targets or len(targets) == len(rows):
        return []
    sets = {r[0]: None for r in rows}
    for a, b in common.slices([r[3] for r in targets], 1 << 18):
        grams, count, first = weighted_shingles([r[3] for r in targets[a:b]])
        for i in range(b - a):
            sets[targets[a + i][0]] = grams[first[i] : first[i + 1]], count[first[i] : first[i + 1]]
    for node, _, _, text in rows:
        if sets[node] is None:
            sets[node] = weighted_shingles([text])[:2]
    own = [sets[r[0]] for r in targets]
    size = np.array([len(g) for g, _ in own])
    total = np.array([c.sum() for _, c in own])
    single = total == size
    every = np.concatenate([g for g, _ in own])
    order = np.argsort(every, kind="stable")
    sorted_grams, of, times = every[order], np.repeat(np.arange(len(own)), size)[order], np.concatenate([c for _, c in own])[order]
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    root_of = np.array([r[2] for r in targets])
    out = []
    for node, probe, root, _ in rows:
        if not probe:
            continue
        grams, count = sets[node]
        lo, hi = np.searchsorted(sorted_grams, grams), np.searchsorted(sorted_grams, grams, side="right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        seen = np.bincount(of[at], minlength=len(own))
        mine = np.bincount(of[at], weights=np.repeat(count, n), minlength=len(own)) / count.sum()
        theirs = np.bincount(of[at], weights=times[at], minlength=len(own)) / total
        maybe = np.flatnonzero(np.minimum(mine, theirs) >= least - 1e-9)
        plain = single[maybe] & (len(grams) == count.sum())
        exact = seen[maybe] / (len(grams) + size[maybe] - seen[maybe])
        for j, simple, value in zip(maybe[np.argsort(-exact, kind="stable")], plain[np.argsort(-exact, kind="stable")], np.sort(-exact), strict=True):
            a, b = find(root), find(int(root_of[j]))
            if a != b and (-value >= least - 1e-12 if simple else probability_jaccard((grams, count), own[j]) >= least - 1e-12):
                parent[max(a, b)] = min(a, b)
                out.append((node, targets[j][0]))
    return out


def _across(least: float):
    """Rows come sorted by bucket and block; each block is settled by itself."""

    def run(batches):
        held, block = [], None

        def flush(rows: list) -> pa.RecordBatch:
            found = across_components(rows, least)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

        for batch in batches:
            key, line, column, node, probe, root, text = (batch.column(i).to_pylist() for i in range(7))
            for i in range(batch.num_rows):
                now = key[i], line[i], column[i]
                if now != block and held:
                    yield flush(held)
                    held = []
                block = now
                held.append((node[i], probe[i], root[i], text[i]))
        if held:
            yield flush(held)

    return run


def components(edges: DataFrame, folder: str, name: str = "stars") -> DataFrame:
    """(node, root) of all nodes of the edges (a, b) but the roots; a root is the least node of its component.

    Large stars and small stars take turns until nothing changes; each turn is
    written to the shared folder.
    """
    edges, before, turn = common.stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), folder, f"{name}-0"), None, 0
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before, turn = now, turn + 1
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = common.joined(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # every edge now goes from a node to a smaller one
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = common.joined(large, lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(lower.select("a", F.col("m").alias("b"))).distinct()
        edges = common.stored(small, folder, f"{name}-{turn}")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, txt (16 bytes of the text's SHA-256), class_id, class_size, kept.

    Texts are alike if the probability Jaccard of their weighted five-word shingles
    is 0.8 or more; classes are the components of these links, class_id is the least
    id of a class, and its row is kept. Texts of one to four words count as one
    shingle; those without words, null ones among them, are classes of their own.
    Words ignore case and punctuation. Of rows that repeat id and text one is kept;
    a null id is larger than all others.

    Texts with equal weighted shingles are one node. Nodes share a bucket if a band
    of their signatures agrees. Each member of a bucket is verified against the
    bucket's least node. Buckets whose members are then in more than one component
    are looked at once more: each member outside the bucket's largest component is
    compared with all members, in blocks of bounded size.
    """
    spark, folder = docs.sparkSession, common.scratch(docs.sparkSession)
    signed = common.stored(_signatures(docs, id_col, text_col), folder, "signatures")
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "txt"))
    nodes = common.stored(signed.where("cls IS NOT NULL").groupBy("cls").agg(rep.alias("rep"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), folder, "nodes")
    banded = nodes.select("node", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("pivot")).where("size > 1").select("key", "pivot")
    members = common.stored(common.joined(banded, buckets, "key").select("key", "node", "pivot"), folder, "members")
    wanted = common.joined(nodes, members.select("node").distinct(), "node").select("node", F.col("rep.id").alias("rep_id"), F.col("rep.txt").alias("rep_txt"))
    rows = docs.select(F.col(id_col).alias("id"), _digest(text_col).alias("txt"), F.col(text_col).alias("text"))
    texts = common.stored(common.joined(rows, wanted, F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("txt") == F.col("rep_txt"))).groupBy("node").agg(F.first("text").alias("text")), folder, "texts")

    pairs = members.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    links = common.stored(_linked(pairs, texts, least), folder, "links-0")
    roots = components(links, folder, "stars-0")
    # buckets whose members are in more than one component: every pair across components is settled there
    labelled = common.joined(members, roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    open_rows = common.stored(common.joined(common.joined(labelled, mixed, "key"), texts.select("node", F.octet_length("text").alias("size")), "node"), folder, "open")
    if not open_rows.isEmpty():
        by_root = open_rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        per_key = by_root.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("most"))
        blocks = lambda c: F.ceil(c / block).cast("int")
        sized = common.joined(open_rows, per_key.select("key", "top", blocks(F.col("bytes")).alias("columns"), F.greatest(F.lit(1), blocks(F.col("bytes") - F.col("most"))).alias("lines")), "key")
        dealt = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        targets = sized.select("key", "node", "root", F.explode(upto(F.col("lines"))).alias("line"), dealt(F.col("columns")).alias("column"), F.lit(False).alias("probe"))
        probes = sized.where("root <> top").select("key", "node", "root", dealt(F.col("lines")).alias("line"), F.explode(upto(F.col("columns"))).alias("column"), F.lit(True).alias("probe"))
        order = ["key", "line", "column", "node", "probe"]
        rows = common.joined(targets.union(probes), texts, "node").repartition(common.partitions(spark), "key", "line", "column").sortWithinPartitions(*order).select(*order, "root", "text")
        links = common.stored(links.union(rows.mapInArrow(_across(least), "a long, b long")).distinct(), folder, "links-1")
        roots = components(links, folder, "stars-1")

    labelled = common.joined(nodes, roots, "node", "left").select("cls", "n", F.col("rep.id").alias("rep_id"), F.col("rep.txt").alias("rep_txt"), F.coalesce("root", "node").alias("root"))
    least_row = F.min(F.struct(F.col("rep_id").isNull().alias("none"), F.col("rep_id").alias("id"), F.col("rep_txt").alias("txt")))
    classes = labelled.groupBy("root").agg(least_row.alias("first"), F.sum("n").alias("class_size"))
    of_class = common.joined(labelled.select("cls", "root"), classes, "root").select("cls", "first", "class_size")
    counted = signed.groupBy("id", "txt", "cls").agg(F.count(F.lit(1)).alias("reps"))
    done = common.joined(counted, of_class, "cls", "left").select(
        "id", "txt", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("cls").isNull() | (F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.txt") == F.col("txt")))).alias("first_row"), F.col("cls").isNull().alias("alone"), F.explode(F.sequence(F.lit(1).cast("long"), "reps")).alias("rep"),
    )
    return done.select("id", "txt", "class_id", "class_size", (F.col("first_row") & (F.col("alone") | (F.col("rep") == 1))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, class_id, class_size, kept, as near_groups finds them.

    Null, empty and wordless texts are classes of their own; of rows that repeat id
    and text one is kept; an empty table gives an empty result. Other columns of
    docs play no part, whatever their names.
    """
    return near_groups(docs, id_col, text_col).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_groups keeps, with the columns of docs, whatever their names; an empty table stays empty."""
    kept = near_groups(docs, id_col, text_col).where("kept").groupBy("id", F.col("txt").alias("digest")).agg(F.count(F.lit(1)).alias("reps"))
    return common.kept_rows(docs, kept, id_col, _digest(text_col))
