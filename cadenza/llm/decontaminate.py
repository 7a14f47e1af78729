"""Benchmark decontamination by multi-pattern search with block shifts.

The patterns are windows of `window` consecutive benchmark words (a shorter
item is one pattern). For patterns of one length, a table gives for each block
of two words how far a search may skip when that block ends the current
position; blocks that end a pattern have shift 0, and there the patterns whose
suffix block has that hash are compared word for word.

A task searches many stretches of text side by side: the positions of all
stretches move on together, each by its own shift.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

WINDOW = 10
#: Patterns in one broadcast table (some 200 bytes each); a larger benchmark is searched in several passes.
BLOCK_PATTERNS = 200_000
_TABLE_BITS = 18
_STRETCH = 256


class Patterns:
    """Shift table and suffix buckets of patterns that all have `m` words."""

    def __init__(self, m: int, texts: list[bytes], hashes: np.ndarray, items: list[tuple[str, ...]]):
        self.m, self.block = m, min(2, m)
        ends = np.stack([self._slot(tx.grams(hashes[:, q - self.block + 1 : q + 1].ravel(), self.block)[:: self.block]) for q in range(self.block - 1, m)], 1)
        self.shift = np.full(1 << _TABLE_BITS, m - self.block + 1, np.int64)
        for q in range(ends.shape[1]):
            np.minimum.at(self.shift, ends[:, q], ends.shape[1] - 1 - q)
        order = np.argsort(ends[:, -1], kind="stable")
        self.suffix = ends[order, -1]
        self.whole = np.array([tx.grams(hashes[i], m)[0] for i in order], np.uint64)
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]

    @staticmethod
    def _slot(block_hashes: np.ndarray) -> np.ndarray:
        return (block_hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def find(self, w: tx.Words) -> Iterator[tuple[int, int]]:
        """(index of the first word, index of the pattern) of every occurrence."""
        m, first, counts = self.m, w.first[:-1], w.counts
        n = np.maximum(counts - m + 1, 0)
        pieces = -(-n // _STRETCH)
        if not pieces.sum():
            return
        nth = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(first + m - 1, pieces) + nth * _STRETCH
        stop = np.minimum(at + _STRETCH, np.repeat(first + counts, pieces))
        slots = self._slot(tx.grams(w.hashes, self.block))
        found = []
        while len(at):
            step = self.shift[slots[at - self.block + 1]]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        at = np.sort(np.concatenate(found))
        slot = slots[at - self.block + 1]
        lo, hi = np.searchsorted(self.suffix, slot, "left"), np.searchsorted(self.suffix, slot, "right")
        at, lo, size = np.repeat(at, hi - lo), np.repeat(lo, hi - lo), hi - lo
        pattern = lo + np.arange(len(lo)) - np.repeat(np.cumsum(size) - size, size)
        starts = at - m + 1
        likely = tx.grams(w.hashes, m)[starts] == self.whole[pattern]
        for i, p in zip(starts[likely].tolist(), pattern[likely].tolist(), strict=True):
            if b" ".join(w.word(j) for j in range(i, i + m)) == self.texts[p]:
                yield i, p


def _compile(rows: dict[tuple[bytes, ...], set[str]]) -> list[Patterns]:
    by_length: dict[int, list] = {}
    for p, items in rows.items():
        by_length.setdefault(len(p), []).append((p, tuple(sorted(items))))
    out = []
    for m, group in sorted(by_length.items()):
        joined = pa.array([b" ".join(p).decode("utf-8", "surrogateescape") for p, _ in group])
        hashes = tx.words(joined, tx.ALNUM).hashes.reshape(len(group), m)
        out.append(Patterns(m, [b" ".join(p) for p, _ in group], hashes, [i for _, i in group]))
    return out


def tables(benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_PATTERNS) -> Iterator[list[Patterns]]:
    """Search tables over benchmark(item_id, text), each of `block` patterns or little more. Rows stream through the driver, which holds one block."""
    rows: dict[tuple[bytes, ...], set[str]] = {}
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    for item in items.toLocalIterator():
        w = tx.words(pa.array([item.text]), tx.ALNUM)
        said = [w.word(i) for i in range(len(w.starts))]
        for i in range(max(len(said) - window, 0) + 1 if said else 0):
            rows.setdefault(tuple(said[i : i + window]), set()).add(item.item_id)
        if len(rows) >= block:
            yield _compile(rows)
            rows = {}
    yield _compile(rows)


def _search(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = pickle.loads(table.value)
        for batch in tx.slices(batches):
            w = tx.words(batch.column("text"), tx.ALNUM)
            hit, items = np.zeros(len(w.hashes), bool), [set(x) for x in batch.column("hit_items").to_pylist()]
            before = batch.column("hit_words")
            old = np.repeat(w.first[:-1], before.value_lengths().to_numpy(zero_copy_only=False)) + before.flatten().to_numpy(zero_copy_only=False)
            hit[old.astype(np.int64)] = True
            for group in groups:
                for i, p in group.find(w):
                    hit[i : i + group.m] = True
                    items[np.searchsorted(w.first, i, "right") - 1].update(group.items[p])
            at = np.flatnonzero(hit)
            text = np.searchsorted(w.first, at, "right") - 1
            made = {
                "n_words": pa.array(w.counts.astype(np.int64)),
                "hit_words": tx.listed((at - w.first[text]).astype(np.int32), np.bincount(text, minlength=batch.num_rows), pa.int32()),
                "hit_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(c)) for c in batch.schema.names], batch.schema.names)

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK_PATTERNS) -> DataFrame:
    """Rows of docs with n_words, hit_words (indexes of words inside any occurrence of a window) and hit_items (item_ids as strings, sorted).

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased. A null or empty text has no words.
    Items without item_id or words are left out; rows of one item_id are one item. Columns of docs with the names
    made here are replaced, all others stay. An empty benchmark hits nothing.
    """
    docs = docs.withColumns({"text": F.col("text").cast("string"), "n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<int>"), "hit_items": F.array().cast("array<string>")})
    for table in tables(benchmark, window, block):
        docs = docs.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(table))), docs.schema)
    return docs
