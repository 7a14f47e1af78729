"""Repeated passages by a sparse suffix array.

A suffix is kept where the hash of the next GRAM words is the smallest of `window` neighbours, so where a passage is
repeated both copies keep suffixes at the same of its words, and of any repeated passage of `least` words one kept
suffix begins early enough to share `least - window + 1` words. The kept suffixes of all documents are sorted by
those words, and one that equals a neighbour is a place to extend from: to the left and right, by comparing the
`least`-word stretches around it, by 96 bits of hash, as far as they occur elsewhere too.

Documents whose words are all equal are told apart first, and only the one with the smallest doc_id is searched, so a
large group of copies costs one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .store import only, salted, stash

LEAST = 50
WINDOW = 20
GRAM = 5


def _kept(w: tx.Words, window: int, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, word and hash of the kept suffixes with `shared` words left."""
    grams, text = tx.grams(w.hashes, GRAM), w.text_of_word()
    n = len(grams)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none, none
    best = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(1) + np.arange(n - window + 1)
    inside = text[: len(best)] == text[np.minimum(np.arange(len(best)) + window + GRAM - 2, len(text) - 1)]
    at = np.unique(best[inside])
    at = at[at + shared <= w.first[1:][text[at]]]
    suffix = tx.prefix_powers(w.hashes, shared)
    return text[at], at - w.first[text[at]], suffix[at].view(np.int64)


def _suffixes(least: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            w = tx.words(batch.column("text"), tx.ALNUM)
            text, at, suffix = _kept(w, window, least - window + 1)
            counts = np.bincount(text, minlength=batch.num_rows)
            place = np.arange(len(w.hashes)) - w.first[w.text_of_word()]
            c = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            some, begins = w.counts > 0, w.first[:-1][w.counts > 0]
            with np.errstate(over="ignore"):
                for k in range(2):
                    if len(begins):
                        c[k][some] = np.add.reduceat(tx.mix(w.hashes + tx.mix(place.astype(np.uint64) + np.uint64(k << 40))), begins).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(c[0]), pa.array(c[1]), tx.listed(at.astype(np.int32), counts, pa.int32()), tx.listed(suffix, counts, pa.int64())],
                ["doc_id", "n_words", "c1", "c2", "at", "suffix"],
            )

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by suffix, those equal to the row before or after. The partition's first and last rows stay too, as their neighbours may be in another one; extending decides."""
    held: pa.RecordBatch | None = None
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield _equal(held, before, batch.column("suffix")[0].as_py())
            before = held.column("suffix")[held.num_rows - 1].as_py()
        held = batch
    if held is not None:
        yield _equal(held, before, None)


def _equal(batch: pa.RecordBatch, before: int | None, after: int | None) -> pa.RecordBatch:
    s = batch.column("suffix").to_numpy()
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    same[0], same[-1] = before is None or before == s[0], after is None or after == s[-1]
    kept = pa.array(same[1:] | same[:-1])
    return pa.RecordBatch.from_arrays([batch.column("doc_id").filter(kept), batch.column("at").filter(kept)], ["doc_id", "at"])


def _stretches(least: int, window: int):
    """The stretches of `least` words that have a place to extend from among their first `window` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            w = tx.words(batch.column("text"), tx.ALNUM)
            counts = batch.column("places").value_lengths().to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(batch.num_rows), counts)
            at = w.first[text] + batch.column("places").flatten().to_numpy(zero_copy_only=False)
            edges = np.zeros(len(w.hashes) + 1, np.int64)
            np.add.at(edges, np.maximum(at - window + 1, w.first[text]), 1)
            np.add.at(edges, at + 1, -1)
            start = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
            start = start[start + least <= w.first[1:][w.text_of_word()[start]]]
            owner = w.text_of_word()[start]
            each = np.bincount(owner, minlength=batch.num_rows)
            check = (tx.prefix_powers(tx.mix(w.hashes), least)[start] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), tx.listed((start - w.first[owner]).astype(np.int32), each, pa.int32()), tx.listed(tx.prefix_powers(w.hashes, least)[start].view(np.int64), each, pa.int64()), tx.listed(check, each, pa.int32())],
                ["doc_id", "start", "stretch", "check"],
            )

    return run


def repeated_passages(docs: DataFrame, least: int = LEAST, window: int = WINDOW) -> DataFrame:
    """For each document of docs(doc_id, text) with a word in a passage of `least` or more words that occurs elsewhere too:
    doc_id, n_words, n_repeated (such words), n_extra (those in a passage that occurs before: in a document with a smaller
    doc_id, or earlier in this one), passages (array<struct<start, end>>, words from 0, end exclusive, in order).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. Null texts have none; rows without doc_id are
    left out; several rows of one doc_id are copies where their words are equal, and otherwise count as one document
    that has the words of the longest. Other columns aren't read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    made = stash(docs.mapInArrow(_suffixes(least, window), "doc_id long, n_words long, c1 long, c2 long, at array<int>, suffix array<long>").where(F.col("n_words") >= least))
    heads = made.groupBy("c1", "c2").agg(F.min("doc_id").alias("head"), F.max("n_words").alias("n_words"), F.count("*").alias("n")).where("n > 1")
    same = stash(salted(made.select("doc_id", "c1", "c2"), heads.drop("n"), ["c1", "c2"]).select("doc_id", "head", "n_words").distinct())
    copies = same.where("doc_id <> head")

    rows = only(made, copies, "doc_id", "left_anti").select("doc_id", F.explode(F.arrays_zip("at", "suffix")).alias("x")).select("doc_id", "x.at", "x.suffix")
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartitionByRange(parts, "suffix", "doc_id", "at").sortWithinPartitions("suffix", "doc_id", "at").mapInArrow(_neighbours, "doc_id long, at int")
    places = stash(found.groupBy("doc_id").agg(F.collect_set("at").alias("places")))

    texts = only(docs, places, "doc_id").join(places, "doc_id")
    stretches = stash(texts.mapInArrow(_stretches(least, window), "doc_id long, start array<int>, stretch array<long>, check array<int>"))
    # 96 bits stand for the words of a stretch; several rows of one id may repeat a place, which changes nothing below
    each = stretches.select("doc_id", F.explode(F.arrays_zip("start", "stretch", "check")).alias("x")).select("doc_id", "x.start", "x.stretch", "x.check")
    place = F.struct("doc_id", "start")
    first = stash(each.groupBy("stretch", "check").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").drop("last"))
    again = salted(each, first.drop("n"), ["stretch", "check"], counts=first).select("doc_id", "start", (F.struct("doc_id", "start") != F.col("first")).alias("extra"))

    order = Window.partitionBy("doc_id").orderBy("start")
    seen = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    step = lambda ahead: F.least(F.lit(least), F.coalesce(F.col("start") - ahead, F.lit(least)))
    lined = again.withColumns({"new": step(F.lag("start").over(order)), "late": F.when(F.col("extra"), step(F.max(F.when(F.col("extra"), F.col("start"))).over(seen))).otherwise(0)})
    lined = lined.withColumn("run", F.sum((F.col("start") - F.coalesce(F.lag("start").over(order), F.col("start") - least - 1) > least).cast("int")).over(order))
    runs = lined.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"), F.sum("new").alias("words"), F.sum("late").alias("late"))
    spans = runs.groupBy("doc_id").agg(F.sum("words").alias("n_repeated"), F.sum("late").alias("n_extra"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("passages"))

    n_words = made.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    searched = spans.join(same.where("doc_id = head").select("doc_id"), "doc_id", "left_anti").join(n_words, "doc_id")
    extra_of_heads = same.where("doc_id = head").join(spans.select("doc_id", "n_extra"), "doc_id", "left").select("doc_id", "n_words", F.col("n_words").alias("n_repeated"), F.coalesce("n_extra", F.lit(0)).alias("n_extra"), whole.alias("passages"))
    extra_of_copies = copies.select("doc_id", "n_words", F.col("n_words").alias("n_repeated"), F.col("n_words").alias("n_extra"), whole.alias("passages"))
    return searched.select("doc_id", "n_words", "n_repeated", "n_extra", "passages").union(extra_of_heads).union(extra_of_copies)
