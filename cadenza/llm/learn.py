"""What the two classifiers share: a bounded sample of labelled rows, and Adam."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import only


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold that no label is learned from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, target: str, folds: int, fold: int, per_class: int) -> tuple[DataFrame, float]:
    """Training rows (doc_id, text, y), and the log-odds by which the sample's share of ones differs from that of all training labels.

    Of each class the `per_class` ids with the smallest hash are taken, so the sample is the same in every run and its
    size doesn't grow with the table. Null ids and labels are left out; of several labels of an id the largest holds, of
    several texts the one with the smallest hash, so that rows which share an id don't enlarge the sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("y").alias("y"))
    all_of = {row.y: row["count"] for row in known.groupBy("y").count().collect()}
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    ids = ids[0].union(ids[1])
    rows = only(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), ids, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).join(F.broadcast(ids), "doc_id")
    if len(all_of) < 2:
        return rows, 0.0
    odds = lambda n: math.log(n[1] / n[0])
    return rows, odds(all_of) - odds({y: min(n, per_class) for y, n in all_of.items()})


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
