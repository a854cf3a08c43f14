"""What the trained operators share: a bounded labelled sample, standard scaling and Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int, each: bool = True) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents for which ``train`` holds, in hash order.

    ``each``: half of them at most are of one label, so that a rare label is well represented.
    Rows whose id or label is null are left out; an id with several labels takes the largest.  The
    ids chosen are few by the parameter's bound, so they are sent to the scan of the documents.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    y = y.where(train)
    parts = [y.where(F.col("y") == k) for k in (0, 1)] if each else [y]
    chosen = None
    for part in parts:
        some = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // len(parts))
        chosen = some if chosen is None else chosen.union(some)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")


class Scale:
    def __init__(self, x: np.ndarray) -> None:
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        sd = x.std(0) if len(x) else np.ones(x.shape[1])
        self.sd = np.where(sd > 1e-9, sd, 1.0)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float) -> None:
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
