"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and the stems (the first bytes) of its longer words, hashed to buckets, so that
rare inflected forms share what their stem has learned. The machine learns a weight for each term and a vector for each,
whose products weigh pairs of terms that occur in one document. No term is screened by its own effect: a group mention
that is neutral alone keeps its vector, and with it what it means beside an insult.
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
from .learn import held_out, sample, sigmoid

BITS = 20
#: Labelled documents of each class that the machine is fitted on, with all their words.
PER_CLASS = 4000
#: Bytes of a stem, and training documents that hold a term at least: what one document alone has tells nothing of others.
STEM, SEEN = 6, 2
#: Steps for the weights alone, and as many for weights and vectors, each in whole passes, at least PASSES.
STEPS, PASSES, BATCH, FACTORS = 750, 6, 32, 4
#: Size of the vectors at first, and documents that a term counts against: one of n documents is trusted (n / (n + PRIOR))^2 in pairs, so that a rare term's vector is small and learns slowly.
INIT, PRIOR = 0.05, 20
#: Rates of weights and vectors, and what each step takes off their sizes, so that terms and pairs that tell nothing come to zero.
RATE, RATE_V, THIN_W, THIN_V = 0.3, 0.2, 3e-4, 1e-3
THRESHOLD = 0.3
FOLDS, FOLD = 4, 2


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of each text's terms, one text after the other, and the number of the text."""
    w = tx.words(texts, tx.ALNUM)
    text = w.text_of_word().astype(np.int64) << BITS
    longer = w.ends - w.starts > STEM
    hashes = np.concatenate([w.hashes, tx.stems(w, longer, STEM)])
    pairs = np.unique(np.concatenate([text, text[longer]]) | (hashes >> np.uint64(64 - BITS)).astype(np.int64))
    return pairs & ((1 << BITS) - 1), pairs >> BITS


class Machine:
    """terms: sorted buckets; c, w and v: the constant, and each term's weight and vector."""

    def __init__(self):
        self.terms, self.c = np.zeros(0, np.int32), 0.0
        self.w, self.v = np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32)

    def known(self, bucket: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of buckets and their documents, the terms among them."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, bucket), len(self.terms) - 1)
        held = self.terms[at] == bucket
        return at[held], doc[held]

    def logits(self, term: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of n documents whose terms are given, and the sums of their terms' vectors."""
        v = self.v[term]
        sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(FACTORS)], 1)
        own = np.bincount(doc, (v * v).sum(1), n)
        return self.c + np.bincount(doc, self.w[term], n) + 0.5 * ((sums * sums).sum(1) - own), sums

    def fit(self, bucket: np.ndarray, doc: np.ndarray, y: np.ndarray, shift: float) -> None:
        """Adaptive-gradient steps over batches of documents (doc sorted); a step touches the terms of its batch alone."""
        seen = np.bincount(bucket, minlength=1 << BITS)
        # a term that all have can't be told from the constant
        self.terms = np.flatnonzero((seen >= SEEN) & (seen < len(y))).astype(np.int32)
        rng, k = np.random.default_rng(2), len(self.terms)
        self.w, self.v = np.zeros(k, np.float32), np.zeros((k, FACTORS), np.float32)
        term, doc = self.known(bucket, doc)
        begins = np.searchsorted(doc, np.arange(len(y) + 1))
        seen_w, seen_v, seen_c = np.full(k, 1e-3, np.float32), np.full(k, 1e-3, np.float32), 1e-3
        # a term that few batches touch pays at each touch for the batches between
        thin = np.maximum(1.0, len(y) / BATCH / np.bincount(term, minlength=k))
        trust = (seen[self.terms] / (seen[self.terms] + PRIOR)) ** 2
        self.c = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        passes = max(PASSES, round(STEPS / -(-len(y) // BATCH)))
        for turn in range(2 * passes):
            if turn == passes:
                self.v = (rng.standard_normal((k, FACTORS)) * INIT * trust[:, None]).astype(np.float32)
            order = rng.permutation(len(y))
            for i in range(0, len(y), BATCH):
                some = order[i : i + BATCH]
                t = np.concatenate([term[begins[d] : begins[d + 1]] for d in some])
                of = np.repeat(np.arange(len(some)), begins[some + 1] - begins[some])
                z, sums = self.logits(t, of, len(some))
                off = (sigmoid(z) - y[some]) / len(some)
                each, place = np.unique(t, return_inverse=True)
                o, v = off[of], self.v[t]
                dw = np.bincount(place, o, len(each))
                dv = np.stack([np.bincount(place, o * (sums[of, f] - v[:, f]), len(each)) for f in range(FACTORS)], 1)
                seen_c += off.sum() ** 2
                seen_w[each] += dw * dw
                seen_v[each] += (dv * dv).sum(1)
                self.c -= RATE * off.sum() / seen_c**0.5
                step_w, step_v = RATE / np.sqrt(seen_w[each]), RATE_V / np.sqrt(seen_v[each])
                moved = self.w[each] - step_w * dw
                self.w[each] = np.sign(moved) * np.maximum(np.abs(moved) - step_w * thin[each] * THIN_W, 0)
                if turn < passes:
                    continue
                step_v = step_v * trust[each]
                moved = self.v[each] - step_v[:, None] * dv
                self.v[each] = moved * np.maximum(1 - step_v * thin[each] * THIN_V / np.sqrt((moved * moved).sum(1) + 1e-12), 0)[:, None]
        self.c += shift

    def score(self, texts: pa.Array) -> np.ndarray:
        term, doc = self.known(*_buckets(texts))
        return sigmoid(self.logits(term, doc, len(texts))[0])


def _training_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.slices(batches):
        bucket, doc = _buckets(batch.column("text"))
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
        packed = [bucket[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(packed, pa.binary())], ["doc_id", "y", "buckets"])


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> Machine:
    """The machine for labels(doc_id, toxic) outside the fold. Without labels of both classes it scores every text 0.5."""
    rows, shift = sample(docs, labels, "toxic", folds, fold, PER_CLASS)
    got = sorted((r.doc_id, r.y, bytes(r.buckets)) for r in rows.mapInArrow(_training_buckets, "doc_id long, y int, buckets binary").collect())
    machine, y = Machine(), np.array([r[1] for r in got], np.float64)
    if 0 < y.sum() < len(y):
        each = [np.frombuffer(r[2], np.int32) for r in got]
        machine.fit(np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each]), y, shift)
    return machine


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pickle.loads(model.value)
        for batch in tx.slices(batches):
            scores = pa.array(machine.score(batch.column("text")))
            yield pa.RecordBatch.from_arrays([scores if c == "score" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """Rows of docs(text, ...) with score in 0 to 1, from all words of each text; a null or empty text has no terms. A column `score` of docs is replaced."""
    docs = docs.withColumns({"text": F.col("text").cast("string"), "score": F.lit(0.0)})
    return docs.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(machine))), docs.schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score_toxicity(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
