"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / size of its source copies.
Documents stand in order of size, then of a hash of id and text; the expected
copies are summed along that order from one random offset, and a document is
taken once for each integer that its step crosses. As all steps of a source
are equal, the sum before a document is its rank times the step, and the rank
comes from counts by (source, size), by block of hashes, and a window inside a
block. A block is one of 4,096, so no window holds more than a small part of a
source, whatever the ids are, unless a source repeats one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Hexadecimal digits of the hash that number its block.
DIGITS = 3


def size_of(text: Column) -> Column:
    """Words: runs of characters other than blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def offset_of(source: Column, seed: int) -> Column:
    """A fixed number in [0, 1) for each source and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(source, F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size), one row per source, with target.

    Sources by code point, null last, weigh `weights` over and over and share `share` of all sizes. No target is above
    `most` times its source's size: sorted by that limit per weight, the first j sources stop at it, where j is the
    least number for which the rest, sharing what is left by weight, stay below theirs. One row per source meets in one
    task, however many documents there are.
    """
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    w = w.withColumn("most", most * F.col("source_size")).withColumn("at", F.col("most") / F.col("weight"))
    up = whole.orderBy("at", F.col("source").isNull(), "source")
    w = w.withColumns({"below": F.sum("most").over(up) - F.col("most"), "left": F.sum("weight").over(whole) - F.sum("weight").over(up) + F.col("weight"), "all": share * F.sum("source_size").over(whole)})
    w = w.withColumn("level", (F.col("all") - F.col("below")) / F.col("left"))
    level = F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", F.col("source").isNull(), "source", "level"))).over(whole)["level"]
    return w.withColumn("target", F.least("most", F.coalesce(F.col("weight") * level, F.col("most")))).select("source", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 20, keep_text: bool = True) -> DataFrame:
    """Rows of docs(doc_id, text, source, ...) with size, source_size, target (of the source) and copies (0 to ceil(most)).

    A null text has size 0; a null source is a source of its own, after all others. Rows with equal doc_id, text and source
    are interchangeable; reruns agree on how often each id and text is taken. A source of size 0 has target 0 and is not
    taken. Columns of docs with the names made here are replaced. Texts are read twice, once for the counts; without
    keep_text the result has none, and they are read once.
    """
    text = F.col("text").cast("string")
    place_of = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("/"), F.coalesce(text, F.lit(""))))
    sized = docs.drop("source_size", "target", "copies", "_rank", "_before", "_step", "_start", "_key").withColumns({"source": F.col("source").cast("string"), "size": size_of(text), "_order": place_of})
    sized = sized.withColumns({"_block": F.substring("_order", 1, DIGITS), "_key": F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))})
    sized = sized if keep_text else stash(sized.drop("text"))
    blocks = stash(sized.groupBy("_key", "size", "_block").agg(F.first("source").alias("source"), F.count("*").alias("n")))
    by_size = blocks.groupBy("_key", "size").agg(F.first("source").alias("source"), F.sum("n").alias("n"))
    of = targets(by_size.groupBy("_key").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("n")).alias("source_size")).drop("_key"), weights, share, most)
    of = of.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("_key"), "source_size", "target", F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("_step"), offset_of(F.col("source"), seed).alias("_start"))
    before = Window.partitionBy("_key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select("_key", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first")).join(of, "_key")
    within = Window.partitionBy("_key", "size").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    place = blocks.select("_key", "size", "_block", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_earlier")).join(by_size, ["_key", "size"])
    place = place.select("_key", "size", "_block", (F.col("_first") + F.col("_earlier")).alias("_before"), "source_size", "target", "_step", "_start")
    rank = F.row_number().over(Window.partitionBy("_key", "size", "_block").orderBy("_order"))
    ranked = sized.join(place, ["_key", "size", "_block"]).withColumn("_rank", F.col("_before") + rank)
    end = lambda rank: F.floor(F.col("_start") + F.col("_step") * rank)
    taken = ranked.withColumn("copies", end(F.col("_rank")) - end(F.col("_rank") - 1))
    return taken.drop("_key", "_order", "_block", "_rank", "_before", "_step", "_start")
