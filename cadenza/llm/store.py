"""Cutting lineage, and joins against sets of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import freed, scratch, shared_folder, stash, unstash

__all__ = ["attached", "only", "salted", "scratch", "shared_folder", "stash", "unstash"]

#: Ids that are broadcast at most (8 bytes each, some 50 MB as a hash table); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def only(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of df with (left_semi) or without (left_anti) a key in ids. ids goes out by broadcast after it was counted, up to BROADCAST_IDS, else by a shuffle."""
    ids = ids.select(key).distinct()
    with freed(df.sparkSession):
        few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def attached(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with side, which has one row for each key: by broadcast after side was counted, up to BROADCAST_IDS rows, else with the rows of hot keys dealt over tasks. Both should be stashes or cheap to read twice."""
    if side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return rows.join(F.broadcast(side), on, how)
    return salted(rows, side, on, how)


def salted(rows: DataFrame, side: DataFrame, on: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """rows joined with side on columns `on`, whatever part of rows one key holds.

    Keys with more rows than a quarter of an even task's are found first, from counts(on, n) where the caller has them; at
    most four for each shuffle partition can exist, so they are broadcast. Their rows are dealt by hash over as many parts
    as they have such shares, and their rows in side are copied to each: eight copies for each shuffle partition in all.
    Without counts `rows` is read twice, so it should be a stash. Null keys meet nothing.
    """
    spark = rows.sparkSession
    counts = rows.groupBy(*on).agg(F.count("*").alias("n")) if counts is None else counts.select(*on, "n")
    with freed(spark):
        seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).head()
    share = max(1, seen["all"] // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if seen["most"] <= share:
        return rows.join(side, on, how)
    with freed(spark):
        held = counts.where(F.col("n") > share).where(" and ".join(f"{c} is not null" for c in on))
        hot = [(*(r[c] for c in on), -(-r["n"] // share)) for r in held.collect()]
    if not hot:
        return rows.join(side, on, how)
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in held.select(*on).schema]
    hot = F.broadcast(spark.createDataFrame(hot, ", ".join([*kinds, "_parts int"])))
    dealt = rows.join(hot, on, "left").withColumn("_salt", F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*rows.columns), "_parts")).otherwise(0).cast("int")).drop("_parts")
    copied = side.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [*on, "_salt"], how).drop("_salt")
