"""Weighted digraphs (src, dst, weight) and rooted trees (node, parent)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldmark.session import cut


def edge_weights(contacts: DataFrame, src: str, dst: str, threshold: int = 1) -> DataFrame:
    """Contacts counted by pair; pairs with the threshold or more."""
    return contacts.groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= threshold)


def graph_size(edges: DataFrame) -> DataFrame:
    """Number of nodes and edges."""
    nodes = edges.select(F.col("src").alias("n")).union(edges.select("dst")).distinct().agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"))), F.lit(True))  # one row each


def reciprocal(edges: DataFrame, least: int = 3) -> DataFrame:
    """Unordered pairs with an edge of least or more in both directions, each once; a loop is its own reciprocal."""
    strong = edges.where(F.col("weight") >= least)
    back = strong.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("weight").alias("back_weight"))
    return strong.join(back, ["src", "dst"]).where("src <= dst").select("src", "dst", "weight", "back_weight")


def without_edges(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Nodes that no edge touches."""
    ends = edges.select(F.col("src").alias(node)).union(edges.select("dst"))
    return nodes.join(ends, node, "left_anti")


def layered(start: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """Nodes reached from start (node) through one table of edges (src, dst) after the other, with their layer."""
    reached, out = start.select("node").distinct(), None
    out = reached.select("node", F.lit(0).alias("layer"))
    for layer, edges in enumerate(hops, 1):
        reached = edges.join(reached.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        out = out.union(reached.select("node", F.lit(layer).alias("layer")))
    return out


def connector_edges(pre: DataFrame, post: DataFrame, connector: str) -> DataFrame:
    """Pre- and postsynaptic halves that meet at a connector: both must have neuron and part columns."""
    return pre.select(connector, F.col("neuron").alias("pre"), F.col("part").alias("pre_part")).join(post.select(connector, F.col("neuron").alias("post"), F.col("part").alias("post_part")), connector)


def coloured_edges(halves: DataFrame) -> DataFrame:
    """Contacts by pair of neurons and by their parts on both sides."""
    return halves.groupBy("pre", "pre_part", "post", "post_part").agg(F.count(F.lit(1)).alias("n"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of undirected edges (src, dst): the root is the least node that it is connected with.

    In each round every node takes the least label among its neighbours' and its
    own, and then the label of that label, so labels travel twice as far each time.
    A round is written to the shared folder; nothing but one flag comes to the driver.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct()
    both = cut(both)
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).where("node IS NOT NULL").distinct()
    state = cut(ends.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(state.select(F.col("node").alias("dst"), F.col("root").alias("other")), "dst").groupBy("src").agg(F.min("other").alias("other"))
        least = state.join(near.withColumnRenamed("src", "node"), "node", "left").select("node", "root", F.least("root", "other").alias("new"))
        far = least.select(F.col("node").alias("new"), F.col("new").alias("beyond"))
        turned = cut(least.join(far, "new").select("node", F.col("root").alias("old"), F.least("new", "beyond").alias("root")))
        if turned.where("old <> root").isEmpty():
            return turned.select("node", "root")
        state = turned.select("node", "root")


def path_to_root(nodes: DataFrame, node: str = "node", parent: str = "parent", length: Column | None = None) -> DataFrame:
    """node, root, distance and depth of each node of a forest.

    Every node points to its parent, and in each round to where its pointer's
    pointer goes; the rounds are the logarithm of the depth.
    """
    length = F.lit(1.0) if length is None else length
    state = cut(nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0.0).otherwise(length).cast("double").alias("distance"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce(F.col(parent), F.col(node)).alias("root")))
    while not state.where("up IS NOT NULL").isEmpty():
        other = state.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("distance").alias("more"), F.col("depth").alias("deeper"), F.col("root").alias("further"))
        none = F.lit(0)
        state = cut(state.join(other, "up", "left").select("node", F.col("next").alias("up"), (F.col("distance") + F.coalesce("more", none)).alias("distance"), (F.col("depth") + F.coalesce("deeper", none)).alias("depth"), F.coalesce("further", "root").alias("root")))
    return state.select("node", "root", "distance", "depth")


def ancestors(nodes: DataFrame, chosen: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(origin, ancestor, steps) of chosen nodes (column node), themselves at 0 steps; pointers of 1, 2, 4, ... steps extend what is known."""
    jump = cut(nodes.select(F.col(node).alias("ancestor"), F.col(parent).alias("next")).where("next IS NOT NULL"))
    known, steps = cut(chosen.select(F.col(node).alias("origin"), F.col(node).alias("ancestor"), F.lit(0).cast("long").alias("steps"))), 1
    while not jump.isEmpty():
        known = cut(known.union(known.join(jump, "ancestor").select("origin", F.col("next").alias("ancestor"), (F.col("steps") + steps).alias("steps"))))
        jump, steps = cut(jump.join(jump.select(F.col("ancestor").alias("next"), F.col("next").alias("far")), "next").select("ancestor", F.col("far").alias("next"))), steps * 2
    return known


def nearest_common_ancestor(nodes: DataFrame, chosen: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """The deepest node above (or at) all chosen ones."""
    above = ancestors(nodes, chosen, node, parent)
    n = above.agg(F.count_distinct("origin").alias("n"))
    shared = above.groupBy("ancestor").agg(F.count(F.lit(1)).alias("times"), F.sum("steps").alias("steps")).join(F.broadcast(n), F.col("times") == F.col("n"))
    return shared.orderBy("steps", "ancestor").limit(1).select(F.col("ancestor").alias("nca"))


def compartments(nodes: DataFrame, cuts: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """Each node with its part: axon strictly below a cut node, dendrite elsewhere; the cut node stays dendrite."""
    stopped = nodes.join(cuts.select(F.col(node).alias("_cut")), F.col(parent) == F.col("_cut"), "left").withColumn("_below", F.col("_cut").isNotNull())
    # a node below a cut is the root of its own piece
    pieces = stopped.select(F.col(node).alias("node"), F.when(~F.col("_below"), F.col(parent)).alias("parent"), "_below")
    roots = path_to_root(pieces).join(pieces.select(F.col("node").alias("root"), "_below"), "root")
    return roots.select("node", F.when(F.col("_below"), "axon").otherwise("dendrite").alias("part"))


def distances_from_common_ancestor(nodes: DataFrame, chosen: DataFrame, length: Column, node: str = "node", parent: str = "parent") -> DataFrame:
    """Path length of chosen nodes to the root less that of their nearest common ancestor; null for chosen ones outside the tree."""
    path = path_to_root(nodes, node, parent, length)
    base = path.join(F.broadcast(nearest_common_ancestor(nodes, chosen, node, parent)), F.col("node") == F.col("nca")).select(F.col("distance").alias("base"))
    return chosen.select(F.col(node).alias("node")).join(path, "node", "left").join(F.broadcast(base), F.lit(True), "left").select("node", (F.col("distance") - F.col("base")).alias("distance"))


def rerooted(nodes: DataFrame, root, node: str = "node", parent: str = "parent") -> DataFrame:
    """The same tree with another root: parents turn round along the way to the old one."""
    chosen = nodes.where(F.col(node) == root).select(F.col(node).alias("node"))
    way = ancestors(nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent")), chosen).select("ancestor", "steps")
    turned = way.select(F.col("ancestor").alias("node"), "steps").join(way.select(F.col("ancestor").alias("new"), (F.col("steps") + 1).alias("steps")), "steps", "left").select("node", "new", F.lit(True).alias("turned"))
    return nodes.select(F.col(node).alias("node"), F.col(parent).alias("old")).join(turned, "node", "left").select("node", F.when(F.coalesce("turned", F.lit(False)), F.col("new")).otherwise(F.col("old")).alias("parent"))


def smoothed_positions(nodes: DataFrame, axes: list[str], sigma: float, node: str = "node", parent: str = "parent") -> DataFrame:
    """node and its place after a Gaussian of path length along unbranched stretches.

    Roots, branch points and ends stay in place. A node between them takes the weighted
    mean of its stretch's nodes, both ends included, at most 3 sigma away. Nodes of a
    stretch meet in cells of 3 sigma, so a long stretch is spread over tasks. A node
    whose parent isn't among the nodes is a root.
    """
    places = [F.col(a).cast("double").alias(a) for a in axes]
    tree = nodes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), *places)
    above = nodes.select(F.col(node).alias("parent"), F.lit(True).alias("_there"), *[F.col(a).cast("double").alias(f"_up_{a}") for a in axes])
    children = tree.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("parent", "node")
    step = F.sqrt(sum((F.col(a) - F.col(f"_up_{a}")) * (F.col(a) - F.col(f"_up_{a}")) for a in axes))
    fixed = F.col("parent").isNull() | (F.coalesce("n", F.lit(0)) != 1)
    rooted = tree.join(above, "parent", "left").withColumn("parent", F.when(F.col("_there"), F.col("parent")))
    known = cut(rooted.join(children, "node", "left").select("node", "parent", *axes, F.coalesce(step, F.lit(0.0)).alias("step"), fixed.alias("fixed")))
    far = path_to_root(known, length=F.col("step")).select("node", "distance")
    top = known.select(F.col("node").alias("parent"), F.col("fixed").alias("_top"))
    stretch = path_to_root(known.join(top, "parent", "left").select("node", F.when(~F.col("_top"), F.col("parent")).alias("parent"))).select("node", F.col("root").alias("stretch"))
    placed = cut(known.join(far, "node").join(stretch, "node"))
    own = placed.where("parent IS NOT NULL").select("stretch", "node", "distance", "fixed", *axes)
    # the fixed node above a stretch is the parent of its first node
    first = placed.where("stretch = node AND parent IS NOT NULL").select("stretch", F.col("parent").alias("node"))
    members = own.unionByName(first.join(placed.select("node", "distance", F.lit(True).alias("fixed"), *axes), "node"))
    reach = 3.0 * sigma
    cell = F.floor(F.col("distance") / reach)
    moving = members.where("NOT fixed").select("stretch", "node", F.col("distance").alias("at"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    near = moving.join(members.select("stretch", cell.alias("cell"), "distance", *axes), ["stretch", "cell"]).withColumn("_d", F.col("distance") - F.col("at")).where(F.abs("_d") <= reach)
    weight = F.exp(-F.col("_d") * F.col("_d") / (2.0 * sigma * sigma))
    smooth = near.groupBy("node").agg(*[(F.sum(weight * F.col(a)) / F.sum(weight)).alias(a) for a in axes])
    return placed.where("fixed").select("node", *axes).unionByName(smooth)


def column_layout(df: DataFrame, column: Column, index: Column, count: Column, offset: float, spacing: float, height: float) -> DataFrame:
    """x and y of nodes in parallel columns; a column of one node sits at its top."""
    return df.withColumn("x", offset + column * spacing).withColumn("y", offset + F.coalesce(F.try_divide(index.cast("double"), count - 1), F.lit(0.0)) * height)
