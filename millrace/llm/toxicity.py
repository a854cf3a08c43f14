"""Toxicity by Levenshtein automata intersected with a lexicon trie.

The lexicon (words, and stems that stand for any ending) is learned from a bounded labelled sample.
Its trie is intersected with the Levenshtein automaton of the errors each term allows, and the
product is determinised as it is used: a state is a set of (trie node, errors so far).  Each
distinct word of a task runs through it once.  A window of words around each hit tells quotation
(quote marks, reporting words) from abuse, and a logistic model on these counts gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fit import Adam, Scale, fold, labelled_sample, sigmoid
from .storage import bounded_batches, materialize
from .words import Words, each_block, grams

TRAIN_DOCS = 6000  # bound of the labelled sample
TERMS_MOST = 2000  # bound of the lexicon
SHORT = 3  # letters of words that are no terms: too many other words are like them
STEMS = range(4, 9)  # lengths of stems that are tried
WINDOW = 8  # words on each side of a hit
CACHE = 400_000  # distinct words whose result a task keeps
STEPS_MOST = 200_000  # transitions of the automaton that a task keeps
QUOTED_WEIGHT = 0.25  # of a hit in quotation

# Marks stripped from words, quote marks, and words that report speech.
MARKS = ".,;:!?'\"()[]{}<>|*&%$#@~`^_-+=/\\«»“”„‘’¿¡…"
OPENING = "\"'«“„‘"
CLOSING = "\"'»”“’"
REPORTING = frozenset("said says say called calls call quote quoted quotes wrote writes word term slur dit disait appelé mot sagte nannte schrieb wort dijo llamó escribió palabra".split())


def allowed(term: str) -> int:
    """Errors that a term allows: a stem (ending in *) needs to be longer than a word."""
    n = len(term.rstrip("*"))
    if term.endswith("*"):
        return 1 if n >= 6 else 0
    return 2 if n >= 9 else 1 if n >= 5 else 0


class FuzzyTrie:
    """The lexicon's trie and its product with Levenshtein automata, determinised lazily."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.child: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.most = [0]  # errors that any term below a node allows
        for k, term in enumerate(terms):
            node, e = 0, allowed(term)
            self.most[0] = max(self.most[0], e)
            for c in term.rstrip("*"):
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.ends.append([])
                    self.most.append(0)
                node = self.child[node][c]
                self.most[node] = max(self.most[node], e)
            self.ends[node].append(k)
        self._forget()

    def _forget(self) -> None:
        """Begin with no states but the first; they are made again as words need them."""
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []  # at the word's end: (errors, term)
        self.kept = 0
        self.start = self._state({(0, 0)}, None)

    def _state(self, pairs: set[tuple[int, int]], stem: tuple[int, int] | None) -> int:
        """Close under skipped term letters, drop what can't end, and note the best ending."""
        todo, best = list(pairs), {}
        while todo:
            node, e = todo.pop()
            if e > self.most[node] or best.get(node, 9) <= e:
                continue
            best[node] = e
            todo += [(c, e + 1) for c in self.child[node].values()]
        final = stem
        for node, e in best.items():
            for k in self.ends[node]:
                if e <= allowed(self.terms[k]):
                    if self.terms[k].endswith("*"):
                        stem = min(stem or (9, 0), (e, k))
                    final = min(final or (9, 0), (e, k))
        if stem:
            final = min(final, stem)
        key = (frozenset(best.items()), stem)
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
            self.final.append(final)
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        pairs, stem = self.states[state]
        nxt = set()
        for node, e in pairs:
            for d, to in self.child[node].items():
                nxt.add((to, e if d == c else e + 1))
            nxt.add((node, e + 1))
        to = self.steps[state][c] = self._state(nxt, stem)
        self.kept += 1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(errors, term) of the best term within its allowance, or None."""
        if self.kept > STEPS_MOST:
            self._forget()
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if not self.states[state][0]:
                break
        return self.final[state]


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(MARKS)


class Lexicon:
    """Matches the words of blocks; keeps results by word hash."""

    def __init__(self, terms: list[str]) -> None:
        self.trie = FuzzyTrie(terms)
        self.known: dict[int, tuple[int, int] | None] = {}

    def hits(self, words: Words, data: np.ndarray) -> dict[int, list[tuple[int, int, bool]]]:
        """Document: [(errors, term, quoted)] of its hits in order."""
        hashes, first = np.unique(words.hash, return_index=True)
        if len(self.known) > CACHE:
            self.known.clear()
        known, found = self.known, []
        for h, k in zip(hashes.tolist(), first.tolist(), strict=True):
            if h in known:
                hit = known[h]
            else:
                hit = known[h] = self.trie.match(plain(data[words.begin[k] : words.end[k]].tobytes()))
            if hit is not None:
                found.append(h)
        out: dict[int, list[tuple[int, int, bool]]] = {}
        if found:
            keys = np.array(found, np.uint64)
            for p in np.flatnonzero(keys[np.minimum(np.searchsorted(keys, words.hash), len(keys) - 1)] == words.hash).tolist():
                d = int(words.doc[p])
                out.setdefault(d, []).append((*known[int(words.hash[p])], self._quoted(words, data, p, d)))
        return out

    @staticmethod
    def _quoted(words: Words, data: np.ndarray, p: int, d: int) -> bool:
        """Whether the hit stands between quote marks, or follows a reporting word, within the window."""
        lo, hi = max(int(words.first[d]), p - WINDOW), min(int(words.first[d + 1]), p + WINDOW + 1)
        own = data[words.begin[p] : words.end[p]].tobytes().decode("utf-8", "replace")
        before = data[words.begin[lo] : words.begin[p]].tobytes().decode("utf-8", "replace")
        after = data[words.end[p] : words.end[hi - 1]].tobytes().decode("utf-8", "replace")
        opened = any(w[:1] in OPENING for w in [*before.split(), own] if w)
        closed = any(c in CLOSING for w in [own, *after.split()] if w for c in w.rstrip(".,;:!?")[-1:])
        return opened and closed or any(w.lower().strip(MARKS) in REPORTING for w in before.split()[-3:])


WIDTH = 6


def features(hits: list[tuple[int, int, bool]], n_words: int) -> list[float]:
    exact = [q for e, _, q in hits if e == 0]
    near = [q for e, _, q in hits if e]
    a, b = (sum(QUOTED_WEIGHT if q else 1.0 for q in x) for x in (exact, near))
    return [np.log1p(a), np.log1p(b), float(bool(a)), float(len({t for e, t, _ in hits if e == 0})), np.log1p(100 * (a + b) / max(1, n_words)), float(sum(q for _, _, q in hits))]


def _term_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, sketch, y, terms): the lowest shingle hash, and the distinct words and stems of each document."""
    for batch in batches:
        for i, words, data in each_block(batch.column(1)):
            g = grams(words.hash, 5)
            sketches, lists = [], []
            for d in range(words.n_docs):
                a, b = int(words.first[d]), int(words.first[d + 1])
                own = {plain(data[x:y].tobytes()) for x, y in zip(words.begin[a:b].tolist(), words.end[a:b].tolist(), strict=True)}
                lists.append(sorted(w for w in own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k} if len(w) > SHORT))
                sketches.append(int((g[a : b - 4] if b - a >= 5 else words.hash[a:b]).min().view(np.int64)) if b > a else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, words.n_docs), pa.array(sketches, pa.int64()), batch.column(2).slice(i, words.n_docs), pa.array(lists, pa.list_(pa.string()))], names=["doc_id", "sketch", "y", "terms"])


def learn_terms(sample: DataFrame) -> list[str]:
    """Words and stems of more than SHORT letters in many toxic and hardly any other documents of the sample, TERMS_MOST at most.

    Of near copies that with the smallest doc_id counts.
    """
    rows = sample.mapInArrow(_term_map, "doc_id long, sketch long, y int, terms array<string>")
    docs = materialize(rows.groupBy("sketch").agg(F.min(F.struct("doc_id", "y", "terms")).alias("x")).select("x.y", "x.terms"), "terms")
    toxic, clean = (docs.where(F.col("y") == k).count() for k in (1, 0))
    least = max(6, int(0.007 * toxic))
    counts = docs.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")).where((F.col("t") >= least) & (F.col("t") * (clean + 1) >= 12 * (F.col("n") + 0.5) * (toxic + 1)))
    got = {r["term"]: r["t"] for r in counts.orderBy(F.desc("t"), "term").limit(20 * TERMS_MOST).collect()}
    stems = sorted((x for x in got if x.endswith("*")), key=len)
    for s in stems:  # a stem gives way to the longest one, or the word, that is as frequent
        if s in got:
            same = [x for x in got if x != s and x.startswith(s[:-1]) and got[x] >= 0.97 * got[s]]
            if same:
                del got[s]
    kept = [x for x in got if not any(x != s and x.startswith(s[:-1]) for s in got if s.endswith("*"))]
    return sorted(sorted(kept, key=lambda x: (-got[x], x))[:TERMS_MOST])


def _feature_map(lexicon, keep: list[int], names: list[str], at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon)
        for batch in batches:
            x = np.zeros((batch.num_rows, WIDTH))
            for i, words, data in each_block(batch.column(at_text)):
                for d, hits in own.hits(words, data).items():
                    x[i + d] = features(hits, int(words.first[d + 1] - words.first[d]))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float64()))], names=[*names, "x"])

    return run


class ToxicModel:
    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self.w = {"c": np.zeros(WIDTH), "b": np.array([-3.0])}
        self.scale = Scale(np.zeros((0, WIDTH)))

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 600) -> None:
        self.scale = Scale(x)
        z, adam = self.scale(x), Adam(self.w, 0.05)
        for _ in range(rounds):
            d = (sigmoid(z @ self.w["c"] + self.w["b"][0]) - y) / len(y)
            adam.step({"c": z.T @ d + 1e-4 * self.w["c"], "b": np.array([d.sum()])})

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale(x) @ self.w["c"] + self.w["b"][0])


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = TRAIN_DOCS) -> ToxicModel:
    """Lexicon and weights from at most ``most`` labelled documents for which ``keep`` holds; whole texts count."""
    bounded_batches(docs.sparkSession)
    sample = labelled_sample(docs, labels, "toxic", keep, most)
    model = ToxicModel(learn_terms(sample))
    rows = sample.mapInArrow(_feature_map(model.terms, [0, 2], ["doc_id", "y"], 1), "doc_id long, y int, x array<double>").orderBy("doc_id", "y", "x").toArrow()
    y = rows.column("y").to_numpy().astype(np.float64)
    if len(set(y)) == 2:
        model.fit(np.array(rows.column("x").to_pylist()), y)
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 4, held: int = 2, most: int = TRAIN_DOCS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score (0 to 1), predicted.

    Learns from labelled rows outside the held-out fold (crc32 of the id as text, modulo ``folds``,
    is ``held``); with labels of one kind or none, all scores are that of an untrained model.  Null and
    empty texts have no hits and get the score of that.  Only the text is an input of a score.  Words of
    SHORT letters or fewer are never terms of the lexicon, which has TERMS_MOST at most.  Rows that
    repeat are scored alike; columns other than doc_id and text aren't read.
    """
    model = train(docs, labels, fold("doc_id", folds) != held, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    run = _feature_map(model.terms, [0, 1], ["doc_id", "held_out"], 2)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            x = batch.column(2).flatten().to_numpy().reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], names=["doc_id", "held_out", "score"])

    return rows.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
