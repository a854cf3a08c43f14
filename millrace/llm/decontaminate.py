"""Benchmark decontamination by pigeonhole edit matching.

An item of n words may occur with up to ``floor(n * error)`` word edits.  It is cut into one piece
more than that, so one piece at least stands unchanged in any such occurrence.  A document's word
hashes are looked up for exact pieces; around each hit Myers' bit-parallel algorithm finds the least
edit distance of the whole item.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches
from .words import each_block, grams, text_buffer, Words

MOST_ITEM_BYTES = 64 << 20  # of items that a task holds at once


def best_match(pattern: list[int], text: list[int]) -> tuple[int, int]:
    """(least edit distance of the pattern to a stretch of the text, end of the first such stretch), by Myers' bit vectors."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return best, end


class Items:
    """The benchmark's items and the table of their pieces."""

    def __init__(self, ids: list[int], texts: list[str], error: float) -> None:
        data, offs = text_buffer(pa.array(texts, pa.string()))
        words = Words(data, offs, 0, len(texts))
        self.ids = ids
        self.words = [words.hash[words.first[k] : words.first[k + 1]] for k in range(len(texts))]
        self.budget = [int(len(w) * error) for w in self.words]
        pieces: dict[int, list[tuple[int, int, int]]] = {}  # words in a piece: (hash, item, offset)
        for k, (w, budget) in enumerate(zip(self.words, self.budget, strict=True)):
            if not len(w):
                continue
            cuts = [len(w) * x // (budget + 1) for x in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(b - a, []).append((int(grams(w[a:b], b - a)[0]), k, a))
        self.tables = []
        for size, rows in sorted(pieces.items()):
            rows.sort()
            keys = np.array([r[0] for r in rows], np.uint64)
            filled = np.zeros(1 << 20, bool)  # most words fail this test
            filled[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((size, keys, np.array([r[1:] for r in rows], np.int64), filled))

    def find(self, words: Words) -> dict[int, dict[int, tuple[int, int, int]]]:
        """Document: {item: (distance, first word, end word) of its best occurrence within the budget}."""
        spots: set[tuple[int, int, int]] = set()  # document, item, where the item would begin
        for size, keys, rows, filled in self.tables:
            g = grams(words.hash, size)
            at = np.flatnonzero(filled[(g & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = at[words.doc[at] == words.doc[at + size - 1]]
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for item, off in rows[a:b].tolist():
                    spots.add((int(words.doc[p]), item, p - off))
        out: dict[int, dict[int, tuple[int, int, int]]] = {}
        for (doc, item), own in groupby(sorted(spots), lambda x: x[:2]):
            budget, w = self.budget[item], self.words[item]
            first, last = int(words.first[doc]), int(words.first[doc + 1])
            for lo, hi in _windows([x[2] for x in own], len(w), budget, first, last):
                if hi - lo < len(w) - budget:
                    continue
                distance, end = best_match(w.tolist(), words.hash[lo:hi].tolist())
                if distance <= budget and (item not in out.get(doc, {}) or distance < out[doc][item][0]):
                    end += lo
                    back, length = best_match(w[::-1].tolist(), words.hash[max(lo, end - len(w) - budget) : end][::-1].tolist())
                    begin = end - (length if back == distance else len(w))
                    out.setdefault(doc, {})[item] = (distance, begin - first, end - first)
        return out


def _windows(starts: list[int], size: int, budget: int, first: int, last: int) -> Iterator[tuple[int, int]]:
    """Where an item of ``size`` words that would begin at one of the sorted ``starts`` can stand; windows that touch are one."""
    lo = hi = None
    for x in starts:
        a, b = max(first, x - budget), min(last, x + size + budget)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


def _parts(benchmark: DataFrame, error: float) -> Iterator:
    """The items for every task, in parts of about MOST_ITEM_BYTES: one part but for a very large benchmark."""
    bounded_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // MOST_ITEM_BYTES))
    for part in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        got = own.orderBy("item_id", "text").collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Items([r[0] for r in got], [r[1] for r in got], error))


def contamination(docs: DataFrame, benchmark: DataFrame, error: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, first_word, end_word): the best occurrence of each item in each document that has one.

    An occurrence is a stretch of the document's words (runs without ASCII space, A-Z as a-z) within
    ``floor(error * words of the item)`` word edits of the item; the best is that with the least
    distance, of these the first that ends, and the shortest.  Null or empty texts and items match
    nothing, and an empty table gives no rows; rows of ``docs`` that repeat each give their rows, items
    that repeat id and text count once; a null doc_id or item_id stays null.  Every task holds a part
    of the items of about MOST_ITEM_BYTES; a larger benchmark is taken part by part, each in a pass
    over the documents.  Other columns aren't read.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return reduce(DataFrame.union, [_found(texts, items) for items in _parts(benchmark, error)])


def _found(texts: DataFrame, items) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = items.value
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for at, words, _ in each_block(batch.column(1)):
                for doc, found in known.find(words).items():
                    rows += [(ids[at + doc], known.ids[k], *found[k]) for k in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "distance", "first_word", "end_word"])

    return texts.mapInArrow(run, "doc_id long, item_id long, distance long, first_word long, end_word long")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, error: float = 0.2, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item (see :func:`contamination`); all columns are kept.  One pass for each part of the items, no shuffle."""
    return reduce(lambda rows, items: _clean(rows, items, text_col), _parts(benchmark, error), docs)


def _clean(docs: DataFrame, items, text_col: str) -> DataFrame:
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Items = items.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, words, _ in each_block(batch.column(at_text)):
                keep[[at + doc for doc in known.find(words)]] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
