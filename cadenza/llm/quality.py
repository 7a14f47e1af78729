"""Document quality by a convolutional network over bytes, trained and run in numpy.

A text is cut into overlapping chunks that cover all of it. Bytes are embedded, filters of twelve bytes slide over a
chunk in steps of four, each filter's largest response in the chunk stays, and the means of these over all chunks of
the text go to one logistic unit.
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
from .learn import Adam, held_out, sample, sigmoid

CHUNK, STEP, GROUP = 256, 192, 4
EMBED, FILTERS = 6, 32
#: Labelled documents of each class that the network is fitted on, with all their chunks.
PER_CLASS = 1500
#: Steps of the fit, documents to a step, chunks to a block, and blocks of a step that are held in memory.
STEPS, BATCH, BLOCK, HELD = 470, 32, 512, 8
THRESHOLD = 0.5
FOLDS, FOLD = 3, 1


def _chunks(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts as rows of CHUNK bytes, zero beyond a text's end, and the number of each text's chunks (1 at least)."""
    lengths = np.diff(at)
    counts = np.maximum(1, -(-(lengths - (CHUNK - STEP)) // STEP))
    nth = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    starts, ends = np.repeat(at[:-1], counts) + nth * STEP, np.repeat(at[1:], counts)
    index = starts[:, None] + np.arange(CHUNK)
    inside = index < ends[:, None]
    data = np.append(raw, np.uint8(0))
    return np.where(inside, data[np.minimum(index, len(raw))], 0).astype(np.uint8), counts


class ByteNet:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"e": normal(256, EMBED, scale=0.5), "w": normal(3, GROUP * EMBED, FILTERS, scale=(12 * EMBED) ** -0.5), "b": np.zeros(FILTERS, np.float32), "o": normal(FILTERS, scale=0.1), "c": np.zeros(1, np.float32)}
        self.p["e"][0] = 0

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's response at each step in each chunk, and the embedded chunks."""
        n = CHUNK // GROUP
        x = self.p["e"][chunks].reshape(len(chunks), n, GROUP * EMBED)
        # all taps of all filters in one product
        z = (x.reshape(-1, GROUP * EMBED) @ self.p["w"].transpose(1, 0, 2).reshape(GROUP * EMBED, -1)).reshape(len(chunks), n, 3 * FILTERS)
        y = z[:, : n - 2, :FILTERS] + z[:, 1 : n - 1, FILTERS : 2 * FILTERS]
        y += z[:, 2:, 2 * FILTERS :]
        return y, x

    def pool(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest response of each filter in each chunk, where it is, and the embedded chunks."""
        y, x = self.responses(chunks)
        where = y.argmax(1)
        return np.maximum(np.take_along_axis(y, where[:, None], 1)[:, 0] + self.p["b"], 0), where, x

    def score(self, chunks: np.ndarray, counts: np.ndarray) -> np.ndarray:
        pooled = np.concatenate([np.maximum(self.responses(chunks[i : i + BLOCK])[0].max(1) + self.p["b"], 0) for i in range(0, len(chunks), BLOCK)])
        mean = np.add.reduceat(pooled, np.cumsum(counts) - counts) / counts[:, None]
        return sigmoid((mean @ self.p["o"] + self.p["c"][0]).astype(np.float64))

    def _back(self, chunks: np.ndarray, back: np.ndarray, held: list) -> tuple[np.ndarray, np.ndarray]:
        """What the gradient by chunk and filter says of embeddings and filters. held: what pool() said of the first blocks; later ones are computed again."""
        de, dw = np.zeros_like(self.p["e"]), np.zeros_like(self.p["w"])
        for i in range(0, len(chunks), BLOCK):
            some = chunks[i : i + BLOCK]
            pooled, where, x = held[i // BLOCK] if i // BLOCK < len(held) else self.pool(some)
            g, rows = back[i : i + BLOCK] * (pooled > 0), np.arange(len(some))[:, None]
            for t in range(3):
                dw[t] += (x[rows, where + t].transpose(1, 2, 0) @ g.T[:, :, None])[:, :, 0].T
                which = some.reshape(len(some), -1, GROUP)[rows, where + t].ravel()
                dx = (g[:, :, None] * self.p["w"][t].T[None]).reshape(-1, EMBED)
                for d in range(EMBED):
                    de[:, d] += np.bincount(which, dx[:, d], 256)
        de[0] = 0
        return de, dw

    def fit(self, docs: list[bytes], y: np.ndarray, shift: float) -> None:
        """docs: the training texts, of which all chunks are read."""
        adam, rng = Adam(self.p, 0.004), np.random.default_rng(5)
        passes = max(1, round(STEPS / -(-len(docs) // BATCH)))
        for _ in range(passes):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), BATCH):
                some = order[i : i + BATCH]
                lengths = [len(docs[j]) for j in some]
                chunks, counts = _chunks(np.frombuffer(b"".join(docs[j] for j in some), np.uint8), np.concatenate([[0], np.cumsum(lengths)]))
                blocks, held = [], []
                for j in range(0, len(chunks), BLOCK):
                    one = self.pool(chunks[j : j + BLOCK])
                    blocks.append(one[0])
                    held += [one] if len(held) < HELD else []
                pooled = np.concatenate(blocks)
                mean = np.add.reduceat(pooled, np.cumsum(counts) - counts) / counts[:, None]
                off = (sigmoid(mean @ self.p["o"] + self.p["c"][0]) - y[some]).astype(np.float32) / len(some)
                back = (np.repeat(off / counts, counts)[:, None] * self.p["o"]).astype(np.float32)
                de, dw = self._back(chunks, back, held)
                adam.step({"e": de, "w": dw + 1e-5 * self.p["w"], "b": (back * (pooled > 0)).sum(0), "o": off @ mean + 1e-4 * self.p["o"], "c": np.array([off.sum()])})
        self.p["c"] += np.float32(shift)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> ByteNet:
    """The network for labels(doc_id, quality) outside the fold. Without labels of both classes it is left as it began and scores near 0.5."""
    rows, shift = sample(docs, labels, "quality", folds, fold, PER_CLASS)
    got = sorted((r.doc_id, r.y, r.text.encode()) for r in rows.select("doc_id", "y", "text").collect())
    net, y = ByteNet(), np.array([r[1] for r in got])
    if 0 < y.sum() < len(y):
        net.fit([r[2] for r in got], y, shift)
    return net


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = pickle.loads(model.value)
        for batch in tx.slices(batches):
            scores = net.score(*_chunks(*tx.buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(scores) if c == "score" else batch.column(c) for c in batch.schema.names], batch.schema.names)

    return run


def score_quality(docs: DataFrame, net: ByteNet) -> DataFrame:
    """Rows of docs(text, ...) with score in 0 to 1, from all of each text. A null or empty text is one chunk of zeros. A column `score` of docs is replaced."""
    docs = docs.withColumns({"text": F.col("text").cast("string"), "score": F.lit(0.0)})
    return docs.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(net))), docs.schema)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score_quality(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
