"""Byte-level BPE by corpus-level merge replay.

A task takes the distinct words (matches of the split pattern) of a block of documents as its
corpus.  An inverted index leads from the rank of a mergeable token pair to the word positions where
that pair stands.  Ranks are replayed in ascending order; a merge touches only the two neighbouring
pairs.  Replaying per block gives the same ids as over the whole table, since merges never cross a
word; it needs no shuffle, and memory is bounded by the block and a cache of known words, which ends with the task.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from contextlib import contextmanager
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches, return_freed_memory, trim

# Code points that the `regex` package takes for letters or numbers (a later Unicode
# version) while the tiktoken library's tables leave them unassigned.
LATER_LETTERS = (
    "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb"
    "\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3"
    "\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191"
    "\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96"
    "\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
BLOCK_CHARS = 2 << 20  # characters of a block; a longer text is a block of its own
CACHE_WORDS = 300_000  # words of a generation that a task keeps between blocks; two generations are kept


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file: base64 token and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many words at once with one set of ranks.

    The words stand one after another in flat lists, each followed by a stop (-1); a part that was
    merged into its left neighbour is -2.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.merged: dict[int, int] = {}  # left rank << 20 | right rank: rank of the two as one token, or -1

    def _rank(self, key: int) -> int:
        r = self.merged[key] = self.ranks.get(self.tokens[key >> 20] + self.tokens[key & 0xFFFFF], -1)
        return r

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word.  A word that is itself a token is that token."""
        whole = list(map(self.ranks.get, words))
        own = [w for w, r in zip(words, whole, strict=True) if r is None]
        collecting = gc.isenabled()
        gc.disable()  # the lists below hold no cycles
        try:
            split = iter(self._replay(own) if own else ())
        finally:
            if collecting:
                gc.enable()
        return [next(split) if r is None else (r,) for r in whole]

    def _replay(self, words: list[bytes]) -> list[tuple[int, ...]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stops = np.cumsum(sizes + 1) - 1
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
        start = self.single[data]
        start[stops] = -1
        rank = self.pairs[data[:-1], data[1:]]
        rank[stops[:-1]] = -1
        rank[stops - 1] = -1
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        values, first = np.unique(rank[at], return_index=True)
        index = {r: x.tolist() for r, x in zip(values.tolist(), np.split(at, first[1:]), strict=False)}  # pair's merge: its positions
        left = values.tolist()  # sorted, so a heap
        part = start.tolist()
        nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        part.append(-1)  # left of the first word (-1) and right of the last stop
        prv.append(len(part) - 2)
        get, compute, ends = self.merged.get, self._rank, stops.tolist()
        while left:
            r = heappop(left)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            held: set[int] | None = None  # words that must merge a pair of lower rank first
            again = []
            for i in places:
                a = part[i]
                if a < 0:
                    continue
                j = nxt[i]
                b = part[j]
                if b < 0:
                    continue
                key = a << 20 | b
                s = get(key)
                if (compute(key) if s is None else s) != r:
                    continue
                if held is not None and bisect_left(ends, i) in held:
                    again.append(i)
                    continue
                part[i] = r
                part[j] = -2
                m = nxt[i] = nxt[j]
                prv[m] = i
                b = part[m]
                if b >= 0:  # the pair with the right neighbour
                    key = r << 20 | b
                    s = get(key)
                    if s is None:
                        s = compute(key)
                    if s >= 0:
                        if s in index:
                            index[s].append(i)
                        else:
                            index[s] = [i]
                            heappush(left, s)
                        if s <= r:
                            held = held or set()
                            held.add(bisect_left(ends, i))
                h = prv[i]
                b = part[h]
                if b >= 0:  # and with the left one
                    key = b << 20 | r
                    s = get(key)
                    if s is None:
                        s = compute(key)
                    if s >= 0:
                        if s in index:
                            index[s].append(h)
                        else:
                            index[s] = [h]
                            heappush(left, s)
                        if s <= r:
                            held = held or set()
                            held.add(bisect_left(ends, i))
            if again:
                if r not in index:
                    index[r] = []
                    heappush(left, r)
                index[r] += again
        out, at = [], 0
        for e in ends:
            out.append(tuple([x for x in part[at:e] if x >= 0]))
            at = e + 1
        return out


class Tokenizer:
    """Splits texts, encodes their words through :class:`MergeReplay`, decodes ids."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        self.replay = MergeReplay(load_ranks(path))
        self.split = regex.compile(pattern).findall
        older = rf"[\p{{L}}--[{LATER_LETTERS}]]", rf"[\p{{N}}--[{LATER_LETTERS}]]"
        self.split_older = regex.compile("(?V1)" + pattern.replace(r"\p{L}", older[0]).replace(r"\p{N}", older[1])).findall
        self.is_later = regex.compile(f"[{LATER_LETTERS}]").search
        self.known: dict[str, str] = {}  # word: its ids, joined by commas
        self.older: dict[str, str] = {}
        self.by_name = {str(r): t for r, t in self.replay.tokens.items()}

    def _told(self, words: list[str]) -> list[str]:
        return [",".join(map(str, ids)) for ids in self.replay.encode([w.encode("utf-8") for w in words])]

    def encode_joined(self, texts: list[str]) -> list[str]:
        """The ids of each text of a block, in decimal, joined by commas."""
        split = [self.split(t) for t in texts]
        known = self.known
        new = list(set().union(*split).difference(known)) if split else []
        if any(map(self.is_later, new)):  # such words are never kept, so they are new each time
            split = [self.split_older(t) for t in texts]
            new = list(set().union(*split))
            told = dict(zip(new, self._told(new), strict=True))
            return [",".join(map(told.__getitem__, s)) for s in split]
        if len(known) > CACHE_WORDS:
            self.older, self.known = known, {}
            known, new = self.known, list(set().union(*split))
        if self.older:
            known.update((w, self.older[w]) for w in new if w in self.older)
            new = [w for w in new if w not in known]
        known.update(zip(new, self._told(new), strict=True))
        return [",".join(map(known.__getitem__, s)) for s in split]

    def encode_block(self, texts: list[str]) -> list[list[int]]:
        return [list(map(int, s.split(","))) if s else [] for s in self.encode_joined(texts)]

    def decode_joined(self, ids: str) -> bytes:
        return b"".join(map(self.by_name.__getitem__, ids.split(","))) if ids else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.replay.tokens.__getitem__, ids))


def blocks_of(texts: list[str]) -> Iterator[list[str]]:
    own: list[str] = []
    size = 0
    for t in texts:
        if own and size + len(t) > BLOCK_CHARS:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


@contextmanager
def _tokenizer(path: str, pattern: str) -> Iterator[Tokenizer]:
    """A tokenizer for one task: the worker lives on for later stages, and would hold the known words beside their data."""
    return_freed_memory()
    tok = Tokenizer(path, pattern)
    try:
        yield tok
    finally:
        tok.__dict__.clear()
        trim()


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids array<int>.  A null text is an empty one: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tokenizer(path, pattern) as tok:
            for batch in batches:
                texts, at = [t or "" for t in batch.column(1).to_pylist()], 0
                for block in blocks_of(texts):
                    ids = tok.encode_block(block)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])
                    at += len(block)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids to doc_id, data binary; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _tokenizer(path, "") as tok:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else tok.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "data"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Encode and decode in one pass over whole texts; a null text counts as empty.  ids_sha256 is over
    the decimal ids joined by commas, decoded_sha256 over the bytes that the ids decode to.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        with _tokenizer(path, pattern) as tok:
            for batch in batches:
                n, a, b = [], [], []
                for block in blocks_of([t or "" for t in batch.column(1).to_pylist()]):
                    for ids in tok.encode_joined(block):
                        n.append(ids.count(",") + 1 if ids else 0)
                        a.append(sha(ids.encode()).hexdigest())
                        b.append(sha(tok.decode_joined(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
