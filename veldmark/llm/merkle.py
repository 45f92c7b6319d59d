"""A Merkle manifest of documents: blocks of leaves are reduced by tasks, the driver joins the small top, tasks finish proofs."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.llm import _common as common

ARITY = 3
#: Levels that one block has, so 3^7 = 2187 nodes of 32 bytes at most.
DEPTH = 7
#: Most nodes of the tree that the driver gets; with more, blocks of nodes are reduced by tasks once more.
TOP = 4096
DIGEST = 32
#: Bytes of the table of sources up to which it is broadcast.
BROADCAST_BYTES = 8 << 20


def encoded(*values: Column) -> Column:
    """Values one after the other, each as '-' if null, else its count of UTF-8 bytes, ':' and itself."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def joined(digests: list[bytes]) -> bytes:
    """The digest of digests written as hexadecimal text, one after the other."""
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def raised(nodes: list[bytes]) -> list[bytes]:
    """The level above: each run of ARITY nodes as its digest."""
    return [joined(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]


def levels(nodes: list[bytes], depth: int | None = None) -> list[list[bytes]]:
    """The nodes and all levels above them: up to a single node, or depth levels."""
    out = [nodes]
    while len(out[-1]) > 1 if depth is None else len(out) <= depth:
        out.append(raised(out[-1]))
    return out


def height(n: int) -> int:
    """Levels above n nodes until one is left."""
    h = 0
    while n > 1:
        n, h = -(-n // ARITY), h + 1
    return h


def path(tree: list[list[bytes]], i: int) -> bytes:
    """The siblings of node i, level by level: the number before it, the number after it, their digests."""
    out = []
    for nodes in tree[:-1]:
        start = i - i % ARITY
        run = nodes[start : start + ARITY]
        out += [bytes((i - start, len(run) - 1 - (i - start))), *run[: i - start], *run[i - start + 1 :]]
        i //= ARITY
    return b"".join(out)


def folded(leaf: bytes, way: bytes) -> bytes:
    """The root that a leaf and its path give."""
    at = 0
    while at < len(way):
        before, after = way[at] * DIGEST, way[at + 1] * DIGEST
        at += 2
        leaf = joined([way[at : at + before], leaf, way[at + before : at + before + after]])
        at += before + after
    return leaf


def siblings(way: bytes) -> bytes:
    """The digests of a path without the counts."""
    out, at = [], 0
    while at < len(way):
        size = (way[at] + way[at + 1]) * DIGEST
        out.append(way[at + 2 : at + 2 + size])
        at += 2 + size
    return b"".join(out)


def _ranged(df: DataFrame, order: list, folder: str, name: str) -> DataFrame:
    """df in sorted ranges, one a task, as a table with _part and _row (the place within the range)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = StructType([*df.schema, *StructType.fromDDL("_part int, _row long")])
    target = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(row, row + n), pa.int64())], schema=target)
            row += n

    n = common.partitions(df.sparkSession)
    return common.stored(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(run, kept), folder, name)


def _placed(df: DataFrame, order: list, folder: str, name: str) -> DataFrame:
    """df with its place in an order, from 0: ranges are sorted by tasks, and each begins after the rows of those before. One row a range is ordered in one task."""
    rows = _ranged(df, order, folder, name)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    return rows.join(F.broadcast(starts), "_part").withColumn("place", F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")


BLOCKS = "tree long, block long, n long, ids array<string>, nodes binary, others array<binary>, root binary"


def _blocks(nodes: DataFrame, folder: str, name: str, depth: int) -> DataFrame:
    """Blocks of 3^depth consecutive nodes of each tree as a table, with the node that each becomes.

    nodes: tree, pos (from 0), n (nodes of the tree), id, node, other. A tree that
    is smaller than a block becomes its root.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(BLOCKS)
    target, size = to_arrow_schema(kind), ARITY**depth

    def row(key: tuple, n: int, ids: list, own: list[bytes], others: list) -> pa.RecordBatch:
        root = levels(own, min(depth, height(n)))[-1][0]
        values = (key[0], key[1], n, ids, b"".join(own), others, root)
        return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, ids, own, others = None, 0, [], [], []
        for batch in batches:
            for tree, block, n, id_, node, other in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (tree, block) != last:
                    if last is not None:
                        yield row(last, total, ids, own, others)
                    last, total, ids, own, others = (tree, block), n, [], [], []
                ids.append(id_)
                own.append(node)
                others.append(other)
        if last is not None:
            yield row(last, total, ids, own, others)

    n = common.partitions(nodes.sparkSession)
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / size)).repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "pos")
    return common.stored(keyed.select("tree", "block", "n", "id", "node", "other").mapInArrow(run, kind), folder, name)


def _above(blocks: DataFrame, depth: int) -> DataFrame:
    """The nodes that blocks become, as nodes of their trees."""
    size = ARITY**depth
    none = F.lit(None)
    return blocks.select("tree", F.col("block").alias("pos"), F.ceil(F.col("n") / size).alias("n"), none.cast("string").alias("id"), F.col("root").alias("node"), none.cast("binary").alias("other"))


PATHS = "tree long, pos long, way binary, subroot binary"


def _top(spark: SparkSession, nodes: DataFrame, single: bool) -> tuple[DataFrame, bytes]:
    """The paths of at most TOP nodes to the root, and the root. single: the nodes are of the one tree of subroots, so their subroots are themselves."""
    trees: dict[int, list] = defaultdict(list)
    for r in nodes.select("tree", "pos", "node").collect():
        trees[r["tree"]].append((r["pos"], bytes(r["node"])))
    own = {t: levels([node for _, node in sorted(rows)]) for t, rows in trees.items()}
    order = sorted(own)
    upper = levels([own[t][-1][0] for t in order])
    rows = []
    for place, t in enumerate(order):
        rest = path(upper, place)
        rows += [(t, i, path(own[t], i) + rest, None if single else own[t][-1][0]) for i in range(len(own[t][0]))]
    return spark.createDataFrame(rows, PATHS), upper[-1][0] if upper[-1] else b""


def _down(blocks: DataFrame, above: DataFrame, make_rows, schema: str, depth: int) -> DataFrame:
    """Rows of blocks whose own node's path is known. make_rows gets a block's row, its levels and its path, and gives columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(schema)
    target = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                r["start"] = r["block"] * ARITY**depth
                own = [r["nodes"][a : a + DIGEST] for a in range(0, len(r["nodes"]), DIGEST)]
                out = make_rows(r, levels(own, min(depth, height(r["n"]))))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in target], schema=target)

    known = above.select("tree", F.col("pos").alias("block"), "way", "subroot")
    return blocks.join(known, ["tree", "block"]).mapInArrow(run, kind)


def _lower_paths(r: dict, tree: list[list[bytes]]) -> dict:
    n = len(tree[0])
    return {"tree": [r["tree"]] * n, "pos": range(r["start"], r["start"] + n), "way": [path(tree, i) + r["way"] for i in range(n)], "subroot": [r["subroot"]] * n}


PROOFS = "id string, leaf string, subroot string, proof_sha256 string, folded_root string"


def _proofs(r: dict, tree: list[list[bytes]]) -> dict:
    out: dict[str, list] = {"id": r["ids"], "leaf": [], "subroot": [r["subroot"].hex()] * len(tree[0]), "proof_sha256": [], "folded_root": []}
    for i, (leaf, other) in enumerate(zip(tree[0], r["others"], strict=True)):
        way = path(tree, i) + r["way"]
        out["leaf"].append(leaf.hex())
        out["proof_sha256"].append(joined([siblings(way)]).hex())
        out["folded_root"].append(folded(leaf if other is None else other, way).hex())
    return out


def manifest(leaves: DataFrame, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """Proofs of rows (id, tree, leaf binary, other binary): id as text, leaf, subroot, root, proof_sha256, folded_root, all hexadecimal.

    tree names the tree of a row (null comes first); within it leaves ascend by
    id, null first, and rows that repeat an id by their digests. folded_root is
    what other, or leaf where other is null, gives with the siblings of leaf.

    Leaves get their place from sorted ranges, so a tree with most of all rows
    isn't in one task. Tasks reduce blocks of 3^depth leaves. While more than `top`
    nodes are left, blocks of nodes are reduced again; when each tree is one
    node, so are blocks of these. The driver joins the rest, and the nodes' paths
    (some 600 bytes each, `top` at most) are broadcast, or joined level by level
    where there were several turns; tasks then finish each row's proof and fold.
    """
    spark = leaves.sparkSession
    folder = common.scratch(spark)
    tree, none = F.coalesce("tree", F.lit("")), F.col("tree").isNull()
    salted = leaves.select(F.col("id"), F.when(none, 0).otherwise(1).alias("_some"), tree.alias("_tree"), "leaf", "other", F.monotonically_increasing_id().alias("_salt"))
    salted = common.stored(salted, folder, "digests")  # else the ranges' sample would read and hash all texts once more
    places = _placed(salted, ["_some", "_tree", F.col("id").asc_nulls_first(), "leaf", "_salt"], folder, "leaves")
    sums = places.groupBy("_some", "_tree").agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("n"))
    trees = common.stored(_placed(sums, ["_some", "_tree"], folder, "trees").withColumnRenamed("place", "tree"), folder, "ranks")
    held, count = trees.agg(F.coalesce(F.sum(F.octet_length("_tree") + 64), F.lit(0)), F.count(F.lit(1))).first()
    with_tree = places.join(F.broadcast(trees) if held <= BROADCAST_BYTES else trees, ["_some", "_tree"])
    nodes = with_tree.select("tree", (F.col("place") - F.col("_first")).alias("pos"), "n", F.col("id").cast("string").alias("id"), F.col("leaf").alias("node"), "other")
    turns = [_blocks(nodes, folder, "blocks0", depth)]
    kinds, single = ["leaves"], False
    while turns[-1].count() > top:
        above = _above(turns[-1], depth)
        if not single and not above.where("n > 1").limit(1).count():
            # each tree is one node: from here on they are the nodes of the tree of subroots
            above, single = above.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "id", "node", "other"), True
            kinds.append("subroots")
        else:
            kinds.append("nodes")
        turns.append(_blocks(above, folder, f"blocks{len(turns)}", depth))
    paths, root = _top(spark, _above(turns[-1], depth), single)
    paths = F.broadcast(paths)
    for k in range(len(turns) - 1, 0, -1):
        lower = _down(turns[k], paths, _lower_paths, PATHS, depth)
        if kinds[k] == "subroots":
            own = _above(turns[k - 1], depth).select("tree", F.col("node").alias("_own"))
            lower = lower.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "way").join(own, "tree").select("tree", "pos", "way", F.col("_own").alias("subroot"))
        paths = common.stored(lower, folder, f"paths{k}")
    return _down(turns[0], paths, _proofs, PROOFS, depth).withColumn("root", F.lit(root.hex()))


def merkle(docs: DataFrame, top: int = TOP, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs (doc_id, source, lang, n_chars, text): doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of the five columns; null is a value of its own, so null
    and empty texts differ. Each source, null and the empty name among them, has
    a tree; their roots, ordered by name, have another. Where 2 divides the crc32
    of the id, the fold starts from the row without the line feeds of its text
    (a null id is left alone). Rows that repeat an id are all leaves. Long texts
    are hashed as wholes where they are scanned: only digests move. An empty
    table gives an empty result; other columns of docs play no part.
    """
    text = F.col("text").cast("string")
    row = lambda t: F.unhex(F.sha2(encoded(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), t).cast("binary"), 256))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    leaves = docs.select(F.col("doc_id").alias("id"), F.col("source").cast("string").alias("tree"), row(text).alias("leaf"), F.when(tampered, row(F.translate(text, "\n", ""))).alias("other"))
    kind = docs.schema["doc_id"].dataType
    done = manifest(leaves, top, depth)
    return done.select(F.col("id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
