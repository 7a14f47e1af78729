"""Array kernels for tokenising and hashing text inside Spark tasks.

All of them take one Arrow string column and work on its byte buffer, so a
task spends a few array passes per batch instead of a Python call per word.
Word classes are byte classes: in UTF-8 every byte of a character beyond
ASCII is 0x80 or more, so the classes below split code points exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one kernel call takes at most, unless one text is larger.
SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` once A-Z are lower-cased.
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]` once A-Z are lower-cased.
LETTERS = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
#: `[^\x20\x09-\x0D]`
UNSPACED = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([seed], np.uint64)))


_OF_BYTE = stream(1, 256)
_STEP = stream(2, 1)[0] | np.uint64(1)
_OF_LENGTH = stream(3, 1)[0] | np.uint64(1)
_OF_PLACE = stream(4, 4096) | np.uint64(1)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of items whose sizes come to `most` at most, or of one item."""
    total, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + most, "right")))
        yield start, stop
        start = stop


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the texts of each hold `most` bytes at most, or are one text."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for start, stop in cuts(lengths, most):
            yield batch.slice(start, stop - start)


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text begins, with the end; null is empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    """The words of several texts: byte spans, one 64-bit hash each, and the words of text d at first[d]:first[d+1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words(texts: pa.Array, kind: np.ndarray, lower: bool = True) -> Words:
    """Maximal runs of bytes of one kind, none across two texts."""
    raw, at = buffer(texts)
    data = _LOWER[raw] if lower else raw
    n = len(data)
    inside = kind[data]
    if not n or not inside.any():
        none = np.zeros(0, np.int64)
        return Words(data, none, none, np.zeros(len(at), np.int64), np.zeros(0, np.uint64))
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    before[at[:-1][at[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    lengths = ends - starts
    begins = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(int(lengths.max()), _STEP, np.uint64))])
        sums = np.add.reduceat(_OF_BYTE[data[inside]] * powers[place], begins)
        hashes = mix(sums + lengths.astype(np.uint64) * _OF_LENGTH)
    return Words(data, starts, ends, np.searchsorted(starts, at), hashes)


def spelled(w: Words, which: np.ndarray) -> pa.Array:
    """The words at the places `which` as strings."""
    starts, lengths = w.starts[which], (w.ends - w.starts)[which]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    taken = w.data[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    return pa.StringArray.from_buffers(len(which), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(taken)))


def stems(w: Words, which: np.ndarray, length: int) -> np.ndarray:
    """A hash for the first `length` bytes of each word that `which` marks; such words are longer than that."""
    at = w.starts[which]
    with np.errstate(over="ignore"):
        total, power = np.full(len(at), np.uint64(length) * _OF_PLACE[0]), np.uint64(1)
        for j in range(length):
            total += _OF_BYTE[w.data[at + j]] * power
            power = power * _STEP
        return mix(total)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k consecutive words; across texts too, which the caller masks out."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes) - k + 1
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(k))
        for j in range(k):
            total += hashes[j : j + n] * _OF_PLACE[j]
        return mix(total)


def prefix_powers(hashes: np.ndarray, k: int) -> np.ndarray:
    """As grams(), by differences of one prefix array, so that its cost doesn't depend on k."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    n = len(hashes)
    with np.errstate(over="ignore"):
        powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _STEP, np.uint64))])
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        back = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inverse, np.uint64))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:n])])
        return mix((sums[k:] - sums[:-k]) * back[: n - k + 1] + np.uint64(k) * _OF_LENGTH)


def listed(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A list column whose row d has counts[d] of the values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
