"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the hash of each prefix modulo two primes, so the hash of any span is a difference of
two entries. From it come equality of spans, the longest common extension of two places (by binary search), and the
fingerprint: the hash of the whole text and a sample, by smallest hash, of its spans of SPAN code points.

The likeness of two texts starts from the spans that both fingerprints hold and from both texts' beginnings. Each such pair
of places is extended to the left and right as far as the texts agree, and the part of both texts that these stretches cover
is their likeness. Pairs of many documents are extended at once, by one binary search over a prefix array of all texts of a
batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

#: Two primes under 2^31, so that products fit 64 bits, and a base for each.
PRIMES, BASES = (2147483629, 2147483587), (1103515245, 1664525 * 641)
SPAN, KEPT = 12, 64
#: Code points of the texts that are compared at once.
SLICE = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(which: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1), kept and doubled as longer texts come."""
    p = np.uint64(PRIMES[which])
    while len(_powers[which]) < n:
        have = _powers[which]
        _powers[which] = np.concatenate([have, have * np.uint64(pow(BASES[which], len(have), int(p))) % p])
    return _powers[which][:n]


def smallest(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The KEPT smallest distinct values, and the first place of each."""
    # copies of one span can fill the smallest places, so more are taken until enough differ
    take = 2 * KEPT
    while take < len(seen):
        limit = np.partition(seen, take)[take]
        at = np.flatnonzero(seen <= limit)
        values, first = np.unique(seen[at], return_index=True)
        if len(values) > KEPT:
            return values[:KEPT], at[first[:KEPT]]
        take *= 4
    values, first = np.unique(seen, return_index=True)
    return values[:KEPT], first[:KEPT]


class PrefixHash:
    """Prefix arrays of one sequence of code points. A span's hash is sum(code[i] * base^(i - start)) times base^(length of the text - start) for comparison within one text; span() removes that factor."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.prefix = []
        for which, prime in enumerate(PRIMES):
            terms = (codes.astype(np.uint64) + np.uint64(1)) * _power(which, self.n) % np.uint64(prime)
            self.prefix.append(np.concatenate([[np.uint64(0)], np.cumsum(terms) % np.uint64(prime)]))

    @classmethod
    def of(cls, text: str) -> PrefixHash:
        return cls(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32))

    def joined(self, n: int, other: PrefixHash, m: int) -> PrefixHash:
        """Of this text's first n code points and the other's first m, without reading either again."""
        out = object.__new__(PrefixHash)
        out.n, out.prefix = n + m, []
        for which, prime in enumerate(PRIMES):
            p = np.uint64(prime)
            step = np.uint64(pow(BASES[which], n, prime))
            out.prefix.append(np.concatenate([self.prefix[which][: n + 1], (self.prefix[which][n] + other.prefix[which][1 : m + 1] * step) % p]))
        return out

    def _raw(self, which: int, i: int, j: int) -> int:
        return (int(self.prefix[which][j]) - int(self.prefix[which][i])) % PRIMES[which]

    def equal(self, i: int, other: PrefixHash, j: int, length: int) -> bool:
        """Whether the spans of that length at i here and at j in the other are equal."""
        return i + length <= self.n and j + length <= other.n and all(self._raw(w, i, i + length) * pow(BASES[w], j, p) % p == other._raw(w, j, j + length) * pow(BASES[w], i, p) % p for w, p in enumerate(PRIMES))

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """The length of the longest common span that begins at i here and at j in the other."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.equal(i, other, j, middle) else (low, middle - 1)
        return low

    def spans(self, length: int) -> np.ndarray:
        """The hash of every span of that length, in the first modulus, as it would be at place 0."""
        p, prime = np.uint64(PRIMES[0]), PRIMES[0]
        n = self.n - length + 1
        raw = (self.prefix[0][length:] + p - self.prefix[0][:n]) % p
        # base^-i = base^(top - i) * base^-top
        lifted = raw * _power(0, n)[::-1] % p
        return lifted * np.uint64(pow(pow(BASES[0], n - 1, prime), -1, prime)) % p

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """The KEPT smallest mixed hashes of distinct spans, and the first place of each; a shorter text is one span."""
        if not self.n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return smallest(tx.mix(self.spans(min(SPAN, self.n))) >> np.uint64(32))

    def fingerprint(self) -> str:
        whole = "".join(f"{self._raw(w, 0, self.n):08x}" for w in range(2))
        return f"{self.n:x}.{whole}.{self.sketch()[0].astype('>u4').tobytes().hex()}"


class Batch:
    """The prefix arrays of several texts as one, so that places of any two of them can be compared; text t begins at first[t]."""

    def __init__(self, texts: list[str]):
        codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
        self.lengths = np.array([len(c) for c in codes], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        self.whole = PrefixHash(np.concatenate([*codes, np.zeros(0, np.uint32)]))
        spans = self.whole.spans(SPAN) if self.whole.n >= SPAN else np.zeros(0, np.uint64)
        mixed = tx.mix(spans) >> np.uint64(32)
        self.sketches = []
        for begin, n in zip(self.first, self.lengths, strict=False):
            if n >= SPAN:
                self.sketches.append(smallest(mixed[begin : begin + n - SPAN + 1]))
            else:
                self.sketches.append((np.array([self._alone(int(begin), int(n))] if n else [], np.uint64), np.zeros(min(int(n), 1), np.int64)))

    def _alone(self, begin: int, n: int) -> np.uint64:
        """The mixed hash of one short text as it would be at place 0."""
        p = PRIMES[0]
        value = self.whole._raw(0, begin, begin + n) * pow(BASES[0], -begin, p) % p
        return tx.mix(np.array([value], np.uint64))[0] >> np.uint64(32)

    def fingerprint(self, t: int) -> str:
        begin, n = int(self.first[t]), int(self.lengths[t])
        whole = "".join(f"{self.whole._raw(w, begin, begin + n) * pow(BASES[w], -begin, p) % p:08x}" for w, p in enumerate(PRIMES))
        return f"{n:x}.{whole}.{self.sketches[t][0].astype('>u4').tobytes().hex()}"

    def _equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of these lengths at places i and j are equal."""
        same = np.ones(len(i), bool)
        for which, prime in enumerate(PRIMES):
            p, prefix = np.uint64(prime), self.whole.prefix[which]
            power = _power(which, self.whole.n + 1)
            low, high = np.minimum(i, j), np.maximum(i, j)
            same &= (prefix[low + length] + p - prefix[low]) % p * power[high - low] % p == (prefix[high + length] + p - prefix[high]) % p
        return same

    def extension(self, i: np.ndarray, j: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """The lengths, `most` at most, of the longest common spans that begin (back: end) at places i and j."""
        low, high = np.zeros(len(i), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = self._equal(i - middle, j - middle, middle) if back else self._equal(i, j, middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def likeness(self, pairs: list[tuple[int, int]]) -> np.ndarray:
        """Of each pair of texts, the part of both that is covered by common stretches, of SPAN code points or from both beginnings: 1 for equal texts, and only one empty: 0."""
        pair, i, j = [], [], []
        for k, (a, b) in enumerate(pairs):
            _, at, bt = np.intersect1d(self.sketches[a][0], self.sketches[b][0], assume_unique=True, return_indices=True)
            pair.append(np.full(len(at) + 1, k))
            i.append(np.concatenate([[0], self.sketches[a][1][at]]))
            j.append(np.concatenate([[0], self.sketches[b][1][bt]]))
        k, i, j = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in (pair, i, j))
        a, b = (np.array([p[s] for p in pairs], np.int64) for s in range(2))
        at, bt = self.first[a[k]] + i, self.first[b[k]] + j
        ahead = self.extension(at, bt, np.minimum(self.lengths[a[k]] - i, self.lengths[b[k]] - j))
        behind = self.extension(at, bt, np.minimum(i, j), back=True)
        # hashes of a sketch are short, so a pair of places counts only if its spans are equal
        used = (ahead >= SPAN) | ((i == 0) & (j == 0))
        k, begin, end, shift = k[used], (i - behind)[used], (i + ahead)[used], (j - i)[used]
        covered = _covered(k, begin, end, len(pairs)) + _covered(k, begin + shift, end + shift, len(pairs))
        total = self.lengths[a] + self.lengths[b]
        return np.where(total == 0, 1.0, covered / np.maximum(total, 1))


def _covered(k: np.ndarray, begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """For each of n pairs, how many places its stretches cover."""
    if not len(k):
        return np.zeros(n)
    order = np.lexsort((begin, k))
    k, begin, end = k[order], begin[order], end[order]
    # pairs are laid one after the other, so that one running maximum serves all
    width = int(end.max()) + 1
    far = np.maximum.accumulate(end + k * width)
    before = np.concatenate([[0], far[:-1]])
    return np.bincount(k, np.maximum(end + k * width - np.maximum(begin + k * width, before), 0), n)


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _rows(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """Of rows in order, all but the last, each with what follows it."""
    texts = [rows[0][1]]
    for (_, text), (_, after) in zip(rows, rows[1:], strict=False):
        texts += [_edited(text, after), after]
    batch, n = Batch(texts), len(rows) - 1
    near = batch.likeness([(2 * i, 2 * i + 1) for i in range(n)] + [(2 * i, 2 * i + 2) for i in range(n)])
    made = {
        "doc_id": pa.array([r[0] for r in rows[:-1]], pa.int64()),
        "n_chars": pa.array([len(r[1]) for r in rows[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts[1::2]], pa.string()),
        "fingerprint": pa.array([batch.fingerprint(2 * i) for i in range(n)], pa.string()),
        "edited_fingerprint": pa.array([batch.fingerprint(2 * i + 1) for i in range(n)], pa.string()),
        "near_edited": pa.array(near[:n]),
        "near_next": pa.array(near[n:]),
    }
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (bucket, ahead, order); a bucket ends with the row after its last, marked `ahead`."""
    held, size, bucket_of = [], 0, None
    for batch in batches:
        for bucket, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "text")), strict=True):
            if bucket != bucket_of or size > SLICE:
                if len(held) > 1:
                    yield _rows(held)
                held = held[-1:] if bucket == bucket_of else []
                size, bucket_of = sum(len(r[1]) for r in held), bucket
            held.append((doc_id, text))
            size += len(text)
    if len(held) > 1:
        yield _rows(held)


def edited_fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger doc_id (of equal ids, by the texts' hash, then the text; a null id is
    before all others), the first after the last; a single document follows itself. A null text is empty. Other columns
    aren't read.

    The ids are cut at quantiles into buckets, as many as the session has shuffle partitions, and an id that fills several
    buckets is cut by the hash of its texts. Each bucket is a task of its own, and also gets the first row of the next. So
    each text crosses the network once, and a task holds SLICE code points at a time, or two texts.
    """
    spark = docs.sparkSession
    buckets = buckets or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({"key": F.coalesce("doc_id", F.lit(lowest)), "hash": F.xxhash64("text")})
    shares = F.array(*(F.lit(i / buckets) for i in range(buckets)))
    cut = docs.agg(F.min("key").alias("first"), F.percentile_approx("key", shares, F.lit(50 * buckets)).alias("cuts")).head()
    cuts = sorted([cut["first"] if cut["first"] is not None else lowest, *(cut["cuts"] or [])])
    # an id that stands n times among the cuts has n buckets, dealt by hash
    starts = sorted(set(cuts))
    shared = [(c, cuts.index(c), cuts.count(c)) for c in starts]
    coarse = max(1, int(len(shared) ** 0.5))
    whole = F.array(*(F.struct(F.lit(c).alias("key"), F.lit(at).alias("at"), F.lit(n).alias("n")) for c, at, n in shared))
    # two short searches instead of one over all cuts
    outer = F.array(*map(F.lit, starts[::coarse]))
    placed = docs.withColumn("of", F.size(F.filter(outer, lambda c: c <= F.col("key"))) - 1)
    placed = placed.withColumn("of", F.element_at(F.filter(F.slice(whole, F.col("of") * coarse + 1, coarse), lambda c: c["key"] <= F.col("key")), -1))
    part = F.floor((F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("of.n")).cast("int")
    # rows after an id that has several buckets are in the last of them
    placed = placed.withColumn("bucket", F.col("of.at") + F.when(F.col("key") == F.col("of.key"), F.least(part, F.col("of.n") - 1)).otherwise(F.col("of.n") - 1)).drop("of")
    heads = placed.groupBy("bucket").agg(F.min(F.struct("key", "hash", "text", "doc_id")).alias("x"))
    # one row for each bucket
    around = Window.partitionBy(F.lit(0)).orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(around), F.max("bucket").over(Window.partitionBy(F.lit(0))))
    ahead = heads.withColumn("bucket", before).select(F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), F.col("x.key").alias("key"), F.col("x.hash").alias("hash"), "bucket", F.lit(True).alias("ahead"))
    dealt = placed.withColumn("ahead", F.lit(False)).unionByName(ahead)
    sorted_rows = dealt.repartitionById(len(cuts), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "ahead", "key", "hash", "text").select("bucket", "doc_id", "text")
    return sorted_rows.mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
