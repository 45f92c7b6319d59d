"""Mixing sources to target weights: repetition rates by source, whole copies and one seeded draw by document. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veldmark.llm import _common as common

#: Weights of sources in order of their names, over and over.
WEIGHTS = (3, 1, 2)
#: Words of the mix per hundred words of the documents, and the most copies of a source.
SHARE, MOST = 150, 2
#: Bytes of the table of sources up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Hexadecimal digits of a draw: 52 bits, exact as a double.
DIGITS = 13


def words(text: Column) -> Column:
    """Runs of other characters than blank, tab, line feed, vertical tab, form feed and carriage return; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def rates(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """One row per source of rows (source, size): source, source_size, target, rate.

    Sources in order of their names' code points, null last, get the weights in
    turn. Targets add up to share percent of all sizes; one that is above most
    times its source's size stops there and the excess goes to the others by
    weight, until none is above. In order of the level at which they stop, a
    source stops if the level without those before it would be above its own:
    so one ordered pass does what repeated sharing would do. Sizes are whole
    numbers and targets the quotient of two of them. If share is above what all
    sources can give, all stop. A source of size 0 has target and rate 0. Only
    the table of sources, one row each, is ordered in one task.
    """
    ratio = math.lcm(*weights)
    by_name, by_level = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("_level", "source")
    some = F.array(*[F.lit(w).cast("long") for w in weights])
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = total.withColumn("_w", F.get(some, (F.row_number().over(by_name) - 1) % len(weights)))
    stops = F.col("source_size") * most
    levels = weighed.withColumns({"_stop": stops, "_level": stops * F.get(F.array(*[F.lit(ratio // w).cast("long") for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))})
    rest = by_level.rowsBetween(0, W.unboundedFollowing)
    spent = F.coalesce(F.sum("_stop").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = levels.withColumns({"_budget": F.sum("source_size").over(W.partitionBy()) * share - 100 * spent, "_weight": F.sum("_w").over(rest)})
    #: The level with those before stopped: budget / (100 weight). The first source that isn't above it sets it for all after.
    free = F.col("_budget") * F.col("_w") <= 100 * F.col("_stop") * F.col("_weight")
    settled = left.withColumn("_free", F.first(F.when(free, F.struct("_budget", "_weight")), ignorenulls=True).over(by_level.rowsBetween(W.unboundedPreceding, 0)))
    target = F.when(F.col("_free").isNull(), F.col("_stop").cast("double")).otherwise((F.col("_free._budget") * F.col("_w")).cast("double") / (100 * F.col("_free._weight")).cast("double"))
    return settled.select("source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size").cast("double")), F.lit(0.0)).alias("rate"))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that follows from the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long").cast("double") / float(1 << 4 * DIGITS)


def allotted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST, seed: int = 0) -> DataFrame:
    """The rows of docs and size, source_size, target and copies: how often the mix takes the row.

    copies is the whole part of the source's rate and one more where the draw by
    the row's id is below the fraction, so it has the rate as its mean and no row
    is taken more than most times. A row without id draws by its text. Rows that
    repeat an id draw alike. Null and empty texts have size 0, and very long ones
    are counted as wholes. An empty table gives an empty result. If docs has one
    of the added names, the added one gets an underscore.

    Words are summed by source in each task before rows move. The sums are a
    table in the shared folder, broadcast if it is below BROADCAST_BYTES; a
    longer one is joined by source, and adaptive execution splits a hot source.
    """
    rows, at = common.numbered(docs), lambda c: F.col(common.at(docs, c))
    spark, source = docs.sparkSession, at(source_col).cast("string")
    sized = rows.select("*", words(at(text_col).cast("string")).alias("size"))
    found = common.stored(rates(sized.select(source.alias("source"), "size"), weights, share, most), common.scratch(spark), "sources")
    known = found.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"), "source_size", "target", "rate")
    held = found.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    key = F.coalesce(at(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(at(text_col).cast("string"), F.lit("")).cast("binary"))))
    joined = sized.withColumns({"_source": F.coalesce(source, F.lit("")), "_none": source.isNull()}).join(F.broadcast(known) if held <= BROADCAST_BYTES else known, ["_source", "_none"])
    whole = F.floor("rate")
    copies = (whole + (draw(key, seed) < F.col("rate") - whole).cast("long")).alias("copies")
    return common.renamed(joined.select(*rows.columns, "size", "source_size", "target", copies), docs, ["size", "source_size", "target", "copies"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with a column copy from 1 (copy_ if docs has one)."""
    done = allotted(docs, id_col, text_col, source_col, **options)
    names = done.columns
    copy = "copy"
    while copy in {c.lower() for c in docs.columns}:
        copy += "_"
    return done.where(F.col(f"`{names[-1]}`") > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"`{names[-1]}`"))).alias(copy))
