"""Quality scores by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words.  Each passage is encoded as a vector (byte
classes, word lengths, repetition, a hashed bag of words).  Gated attention
``softmax(w . (tanh(V h) * sigmoid(U h)))`` weighs the passages, and the score is a logistic
function of the weighted mean.  All weights are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fit import Adam, Scale, fold, labelled_sample, sigmoid
from .storage import bounded_batches
from .words import Words, each_block

PASSAGE = 64
TRAIN_DOCS = 4000  # bound of the labelled sample
BAG = 16
GATE = 16

_CLASS = np.full(256, 7, np.uint8)  # other ASCII punctuation
_CLASS[128:] = 6
_CLASS[97:123] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
for _c in (0x20, 9, 10, 11, 12, 13):
    _CLASS[_c] = 3
for _c in b".,;:'\"()-?":
    _CLASS[_c] = 4
for _c in b"!|#$%&*_=+<>[]{}\\/@^~`":
    _CLASS[_c] = 5
WIDTH = 8 + 7 + BAG


def encode_passages(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A row of WIDTH features for each passage, and the first passage of each document (n_docs + 1 bounds)."""
    counts = np.diff(words.first)
    per_doc = -(-counts // PASSAGE)
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    total = int(bounds[-1])
    if not total:
        return np.zeros((0, WIDTH), np.float32), bounds
    place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], counts)
    passage = np.repeat(bounds[:-1], counts) + place // PASSAGE
    start = np.searchsorted(passage, np.arange(total))
    n = np.diff(np.append(start, len(passage))).astype(np.float64)
    x = np.zeros((total, WIDTH), np.float32)
    lo, hi = int(words.begin[0]), int(words.end[-1])
    kinds = _CLASS[data[lo:hi]]
    at = words.begin[start] - lo
    size = np.maximum(1, np.diff(np.append(at, hi - lo))).astype(np.float64)
    for c in range(8):
        x[:, c] = np.add.reduceat(kinds == c, at, dtype=np.int64) / size
    length = (words.end - words.begin).astype(np.float64)
    mean = np.add.reduceat(length, start) / n
    x[:, 8] = mean
    x[:, 9] = np.sqrt(np.maximum(0, np.add.reduceat(length * length, start) / n - mean * mean))
    key = np.sort(passage.astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(new)
    where = (key[first] >> np.uint64(40)).astype(np.int64)
    run = np.diff(np.append(first, len(key)))
    begin = np.searchsorted(where, np.arange(total))
    x[:, 10] = np.diff(np.append(begin, len(where))) / n  # distinct words
    x[:, 11] = np.maximum.reduceat(run, begin) / n  # the most frequent word
    again = np.concatenate([[False], (words.hash[1:] == words.hash[:-1]) & (passage[1:] == passage[:-1])])
    x[:, 12] = np.add.reduceat(again, start, dtype=np.int64) / n
    x[:, 13] = np.log1p(n)
    x[:, 14] = np.add.reduceat(data[words.begin] < 97, start, dtype=np.int64) / n  # words that don't begin with a small letter
    bag = np.bincount(passage * BAG + (words.hash >> np.uint64(59)).astype(np.int64) % BAG, minlength=total * BAG).reshape(total, BAG)
    x[:, 15:] = bag / n[:, None]
    return x, bounds


class AttentionMIL:
    """Gated attention over passages; all weights are numpy arrays, small enough to send to every task."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.w = {
            "V": rng.normal(0, 0.2, (WIDTH, GATE)),
            "U": rng.normal(0, 0.2, (WIDTH, GATE)),
            "a": rng.normal(0, 0.2, GATE),
            "H": rng.normal(0, 0.2, (WIDTH, GATE)),
            "h": np.zeros(GATE),
            "c": rng.normal(0, 0.2, GATE),
            "b": np.zeros(1),
        }
        self.scale: Scale | None = None

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict[str, np.ndarray]:
        w = self.w
        t, g = np.tanh(x @ w["V"]), sigmoid(x @ w["U"])
        e = (t * g) @ w["a"]
        top = np.full(n, -np.inf)
        np.maximum.at(top, bag, e)
        s = np.exp(e - top[bag])
        alpha = s / np.bincount(bag, s, n)[bag]
        r = np.tanh(x @ w["H"] + w["h"])
        z = np.stack([np.bincount(bag, alpha * r[:, k], n) for k in range(GATE)], 1)
        return {"t": t, "g": g, "alpha": alpha, "r": r, "z": z, "p": sigmoid(z @ w["c"] + w["b"][0])}

    def fit(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.02, decay: float = 1e-4) -> AttentionMIL:
        """bag: the document (0 to len(y) - 1) of each row of x; every document has a row."""
        self.scale = Scale(x.astype(np.float64))
        x, n, w = self.scale(x), len(y), self.w
        adam = Adam(w, rate)
        for _ in range(rounds):
            f = self._forward(x, bag, n)
            d = (f["p"] - y) / n
            dz = d[:, None] * w["c"]
            dr = f["alpha"][:, None] * dz[bag]
            dalpha = (f["r"] * dz[bag]).sum(1)
            de = f["alpha"] * (dalpha - np.bincount(bag, f["alpha"] * dalpha, n)[bag])
            dh = dr * (1 - f["r"] ** 2)
            dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
            adam.step({"V": x.T @ dt + decay * w["V"], "U": x.T @ dg + decay * w["U"], "a": (f["t"] * f["g"]).T @ de, "H": x.T @ dh + decay * w["H"], "h": dh.sum(0), "c": f["z"].T @ d + decay * w["c"], "b": np.array([d.sum()])})
        return self

    def score(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of each document; one without words is all background: an empty representation."""
        n = len(bounds) - 1
        if not len(x):
            return np.full(n, float(sigmoid(self.w["b"][0])))
        bag = np.repeat(np.arange(n), np.diff(bounds))
        used = np.unique(bag)
        back = np.searchsorted(used, bag)
        out = np.full(n, float(sigmoid(self.w["b"][0])))
        out[used] = self._forward(self.scale(x), back, len(used))["p"]
        return out


def _passage_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, words, data in each_block(batch.column(1)):
            x, bounds = encode_passages(words, data)
            lists = [x[bounds[d] : bounds[d + 1]].ravel().tobytes() for d in range(words.n_docs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, words.n_docs), batch.column(2).slice(i, words.n_docs), pa.array(lists, pa.binary())], names=["doc_id", "y", "passages"])


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = TRAIN_DOCS, label: str = "quality") -> AttentionMIL:
    """Learn from at most ``most`` documents with a label for which ``keep`` holds; their whole texts count.

    The passages are encoded on the executors; the driver gets their features only.  With no usable
    label the model is the untrained one.  Half the sample at most is of one label; the offset is
    then moved to the label's share among all labelled rows.
    """
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, keep, most)
    rows = sample.mapInArrow(_passage_map, "doc_id long, y int, passages binary").orderBy("doc_id", "y", "passages").toArrow()
    model = AttentionMIL()
    xs = [np.frombuffer(v, np.float32).reshape(-1, WIDTH) for v in rows.column("passages").to_pylist()]
    ys = rows.column("y").to_numpy()
    has = [k for k, v in enumerate(xs) if len(v)]
    if not has or len(set(ys[has])) < 2:
        model.scale = Scale(np.zeros((0, WIDTH)))
        return model
    y = ys[has].astype(np.float64)
    model.fit(np.concatenate([xs[k] for k in has]), np.repeat(np.arange(len(has)), [len(xs[k]) for k in has]), y)
    share = labels.where(F.col(label).isin(0, 1)).where(keep).agg(F.avg(F.col(label).cast("double"))).first()[0]
    share, own = np.clip([share, y.mean()], 1e-3, 1 - 1e-3)
    model.w["b"] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    return model


def _score_map(model, at_text: int, keep: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: AttentionMIL = model.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, words, data in each_block(batch.column(at_text)):
                scores[i : i + words.n_docs] = known.score(*encode_passages(words, data))
            if keep is None:
                yield pa.RecordBatch.from_arrays([*batch.columns[:at_text], pa.array(scores)], names=[*batch.schema.names[:at_text], "score"])
            else:
                yield batch.filter(pa.array(scores >= keep))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, most: int = TRAIN_DOCS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows outside the held-out fold (crc32 of the id as text, modulo ``folds``,
    is ``held``).  Null and empty texts get the score of an empty representation.  Only the text is
    an input of a score.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold("doc_id", folds) != held, most))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_score_map(model, 2, None), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, held: int = 0, most: int = TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns; one pass, no shuffle of texts."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold("doc_id", folds) != held, most))
    return docs.mapInArrow(_score_map(model, docs.columns.index("text"), threshold), docs.schema)
