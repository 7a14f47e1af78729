"""How the sources of each language differ, from each other and from the language.

A group is a language's source. Its vector over the terms that its language keeps is cut by term into shards, so that a
cell (group and shard) is small whatever the vocabulary. Cells stay in the partition that their key names; the other groups'
cells of the same shard visit them as compressed counts, in the rounds of a round-robin tournament in which each two meet
once. A meeting is evaluated in both directions, and a cell holds itself and one visitor at a time. Each cell ranks its own
terms on a heap; of all cells' heaps Spark ranks the best.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import attached, stash

#: Documents of a language that a kept term is in at least, terms ranked for each group, and what shares are scaled by.
LEAST, TOP, SCALE = 3, 200, 1_000_000_000
#: Terms of a shard, rounds that one job plays, rows of terms (and groups) that a task holds before it sums them, and rows that it hands on at once.
SHARD, ROUNDS, HELD, OUT = 1 << 16, 256, 1 << 19, 1 << 15


def _of_slice(batch: pa.RecordBatch, groups: dict[tuple[str, str], int]) -> pa.RecordBatch:
    """Occurrences and documents of each term, for each group among the texts of one slice; groups not met before are numbered."""
    w = tx.words(batch.column("text"), tx.LETTERS)
    of_doc = np.array([groups.setdefault(x, len(groups)) for x in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)], np.int64)
    terms, first, term = np.unique(w.hashes, return_index=True, return_inverse=True)
    size = max(1, len(terms))
    pairs, n = np.unique(w.text_of_word().astype(np.int64) * size + term, return_counts=True)
    keys, at = np.unique(of_doc[pairs // size] * size + pairs % size, return_inverse=True)
    counts = [pa.array(np.bincount(at, weights, len(keys)).astype(np.int64)) for weights in (n, None)]
    return pa.RecordBatch.from_arrays([pa.array((keys // size).astype(np.int32)), tx.spelled(w, first[keys % size]), *counts], ["group", "term", "n", "docs"])


def _summed(parts: list[pa.RecordBatch], groups: dict[tuple[str, str], int]) -> Iterator[pa.RecordBatch]:
    """The counts of several slices as one row for each group and term, a few rows at once."""
    table = pa.Table.from_batches(parts).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    parts.clear()
    names = [pa.array([x[k] for x in groups], pa.string()) for k in (0, 1)]
    table = table.take(pa.array(np.argsort(table.column("group").to_numpy(), kind="stable")))  # equal neighbours are less to shuffle
    for batch in table.to_batches(OUT):
        yield pa.RecordBatch.from_arrays([*(x.take(batch.column("group")) for x in names), *(batch.column(c) for c in ("term", "n_sum", "docs_sum"))], ["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term, for each group among some texts. Words as arrays take many times the bytes of their texts, so slices are small, and what several hold is summed."""
    parts: list[pa.RecordBatch] = []
    groups: dict[tuple[str, str], int] = {}
    for batch in tx.slices(batches):
        parts.append(_of_slice(batch, groups))
        if sum(x.num_rows for x in parts) + len(groups) >= HELD:
            yield from _summed(parts, groups)
            groups = {}
    if parts:
        yield from _summed(parts, groups)


def _packed(table: pa.Table) -> pa.Table:
    """A cell's counts and its language's, by place in the shard, each as one compressed value."""
    order = np.argsort(table.column("at").to_numpy(), kind="stable")
    at, n, all_n = (table.column(c).to_numpy()[order] for c in ("at", "n", "lang_n"))
    own = zlib.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes() + n.astype(np.int64).tobytes(), 1)
    one = lambda c: table.column(c).slice(0, 1)
    return pa.table({"lang": one("lang"), "source": one("source"), "shard": one("shard"), "counts": pa.array([own], pa.binary()), "lang_counts": pa.array([zlib.compress(all_n.astype(np.int64).tobytes(), 1)], pa.binary())})


def _unpacked(blob: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob) if blob else b""
    m = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, np.uint32, m)).astype(np.int64), np.frombuffer(raw, np.int64, m, 4 * m)


def scaled(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (n + 1) / total), exact for counts of any size."""
    if len(n) and int(n.max()) >= (1 << 63) // SCALE - 1:
        return np.array([1 + SCALE * (int(x) + 1) // total for x in n], np.int64)
    return 1 + (n + 1) * SCALE // max(1, total)


def _dense(row: dict) -> np.ndarray:
    """A cell's scaled shares of all terms of its shard."""
    at, n = _unpacked(row["counts"])
    counts = np.zeros(row["terms"], np.int64)
    counts[at] = n
    return scaled(counts, row["n"] + row["v"])


def _best(row: dict) -> list[tuple[int, int]]:
    """(place, value) of the TOP terms by value, then place, that the group has more of than its language."""
    at, n = _unpacked(row["counts"])
    p, q = scaled(n, row["n"] + row["v"]), scaled(np.frombuffer(zlib.decompress(row["lang_counts"]), np.int64) if len(at) else n, row["lang_n"] + row["v"])
    more = p > q
    at, value = at[more], (p - q)[more] ** 2 // q[more]
    if len(at) > TOP:
        least = np.partition(value, len(value) - TOP)[len(value) - TOP]
        at, value = at[value >= least], value[value >= least]
    return [(int(a), int(-v)) for v, a in heapq.nsmallest(TOP, zip(-value, at, strict=True))]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell and round: the resident first, then its visitors, none of which is kept."""
    mine, own = None, None
    kinds = [("lang", pa.string()), ("source", pa.string()), ("shard", pa.int32()), ("item", pa.string()), ("at", pa.int64()), ("value", pa.int64())]
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if row["round"] < 0:
                mine, own = {k: row[k] for k in ("lang", "source", "shard")}, _dense(row)
                if row["lang_counts"] is not None:
                    out += [(*mine.values(), None, at, value) for at, value in _best(row)]
                continue
            guest = _dense(row)
            off = (own - guest) ** 2
            out.append((*mine.values(), row["source"], None, int((off // guest).sum())))
            out.append((row["lang"], row["source"], row["shard"], mine["source"], None, int((off // own).sum())))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)], [n for n, _ in kinds])


def meeting(slot: Column, other: Column, n: Column) -> tuple[Column, Column]:
    """The round in which two of n slots meet, and whether `slot` is the visitor; of two slots one is, and each about half of the time."""
    m = n - 1 + n % 2  # rounds, an odd number
    last = F.greatest(slot, other)
    fixed = (last == m) & (n % 2 == 0)
    low = F.least(slot, other)
    round_of = F.when(fixed, low).otherwise(F.pmod((slot + other) * F.floor((m + 1) / 2), m))
    visits = F.when(fixed, (slot == last) == (low % 2 == 0)).otherwise(F.pmod(other - slot, m) <= F.floor(m / 2))
    return round_of.cast("int"), visits


def divergence(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) to rows lang, source, part, item, value, rank.

    Part `pair` has each other source of the language with its divergence from it over all kept terms, part `term` the TOP
    terms in which a group exceeds its language. Null text, lang and source are empty strings, each row is a document of its
    own, and a group without terms has pairs as any other. Of equal values the smaller item in UTF-8 goes first. Without
    rows the result is empty. Other columns aren't read.
    """
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = read.groupBy("lang", "source").agg(F.count("*").alias("rows"))
    counts = read.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = stash(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    kept = stash(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= LEAST).drop("docs"))
    sizes = stash(groups.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_n")), "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n")))
    shards = F.greatest(F.lit(1), F.ceil(F.col("v") / SHARD)).cast("int")
    placed = attached(kept, sizes.select("lang", shards.alias("shards")), ["lang"]).withColumn("shard", F.pmod(F.xxhash64("term"), "shards").cast("int"))
    placed = stash(placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1).select("lang", "shard", "term", "at", "lang_n"))
    vectors = counts.join(placed, ["lang", "term"]).select("lang", "source", "shard", "at", "n", "lang_n")
    vectors = stash(vectors.groupBy("lang", "source", "shard").applyInArrow(_packed, "lang string, source string, shard int, counts binary, lang_counts binary"))

    of_group = counts.join(kept.select("lang", "term"), ["lang", "term"]).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    slots = Window.partitionBy("lang").orderBy("source")
    groups = groups.join(of_group, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    groups = stash(groups.withColumns({"slot": F.row_number().over(slots) - 1, "sources": F.count("*").over(Window.partitionBy("lang"))}).withColumn("sources", F.col("sources").cast("int")))
    parts = sizes.select("lang", "v", "lang_n", F.explode(F.sequence(F.lit(0), shards - 1)).alias("shard"))
    held = placed.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("terms"))
    parts = stash(parts.join(held, ["lang", "shard"], "left").na.fill(0, ["terms"]))
    cells = groups.join(parts, "lang").join(vectors, ["lang", "source", "shard"], "left")
    cells = stash(cells.select("lang", "shard", "slot", "sources", "source", "n", "v", "lang_n", "terms", "counts", "lang_counts"))

    keep = ("lang", "shard", "source", "n", "v", "lang_n", "terms", "counts")
    nobody = F.lit(None).cast("binary")
    rounds = groups.agg(F.max("sources")).head()[0] or 0
    met = []
    for first in range(0, max(rounds, 1), ROUNDS):
        residents = cells.select(*keep, (F.col("lang_counts") if not first else nobody).alias("lang_counts"), F.col("slot").alias("host"), F.lit(-1).alias("round"))
        hosts = F.filter(F.sequence(F.lit(0), F.col("sources") - 1), lambda o: (o != F.col("slot")) & meeting(F.col("slot"), o, F.col("sources"))[1])
        visits = cells.withColumn("host", F.explode(hosts)).withColumn("round", meeting(F.col("slot"), F.col("host"), F.col("sources"))[0])
        visits = visits.where(F.col("round").between(first, first + ROUNDS - 1)).select(*keep, nobody.alias("lang_counts"), "host", "round")
        key = ["lang", "shard", "host"]
        played = residents.unionByName(visits).repartition(*key).sortWithinPartitions(*key, "round")
        met.append(stash(played.mapInArrow(_cells, "lang string, source string, shard int, item string, at long, value long")))
    all_met = met[0]
    for more in met[1:]:
        all_met = all_met.unionByName(more)

    pairs = all_met.where("item is not null").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = all_met.where("item is null").drop("item").join(placed.select("lang", "shard", "at", F.col("term").alias("item")), ["lang", "shard", "at"]).withColumn("part", F.lit("term"))
    columns = ("lang", "source", "part", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    found = pairs.select(*columns).unionByName(terms.select(*columns)).withColumn("rank", rank)
    return found.where((F.col("part") == "pair") | (F.col("rank") <= TOP))
