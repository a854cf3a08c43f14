"""Removal of repeated passages by winnowing over word hashes.

The fingerprints of a document are the minima of each window of WINDOW hashes of GRAM consecutive
words, so two documents that share WINDOW + GRAM - 1 words in a row share a fingerprint, wherever the
passage stands in their lines.  Each fingerprint is joined to its first position in the corpus; the
words it covers stand there too, whatever surrounds them.  Matches on one diagonal are joined, both
ends are extended word by word, and the later run is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_batches, materialize
from .words import Words, each_block, list_column, long_grams, mix

GRAM = 20  # words; not less than WINDOW, so that the fingerprints of a shared passage leave no gap
WINDOW = 10  # grams
BESIDE = 20  # words on each side of a first place that are compared; not less than WINDOW
BROADCAST_ROWS = 200_000  # documents with runs; beyond it the join shuffles
HOT_SAMPLE = 1 / 8  # of the documents show which fingerprints are frequent; this decides only how they are joined
HOT_LEAST = 1000  # places of a fingerprint (or chains at an end) that is sent to every task, at least
HOT_MOST = 100_000  # such fingerprints at most: each has more than this part of all places
END_MOST = 20_000  # such ends at most


def _sliding(g: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    """The minimum or maximum of each ``size`` consecutive elements, by doubling."""
    width = 1
    while 2 * width <= size:
        g = best(g[:-width], g[width:])
        width *= 2
    return best(g[: len(g) - (size - width)], g[size - width :]) if width < size else g


def winnow(g: np.ndarray) -> np.ndarray:
    """Positions of the minima (all equal ones) of each window of WINDOW grams; one window at least."""
    if len(g) <= WINDOW:
        return np.flatnonzero(g == g.min()) if len(g) else np.zeros(0, np.int64)
    least = np.zeros(len(g) + WINDOW - 1, np.uint64)
    least[WINDOW - 1 : len(g)] = _sliding(g, WINDOW, np.minimum)
    return np.flatnonzero(g == _sliding(least, WINDOW, np.maximum))


def _prints(words: Words) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places and hashes of each document's fingerprints; one with fewer than GRAM words has one, of the whole.

    A place is the first word << 8 | the words after the fingerprint, 255 at most.
    """
    g, at, prints = long_grams(words.hash, GRAM), [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if 0 < b - a < GRAM:
            at.append(np.zeros(1, np.int64))
            prints.append(mix(long_grams(words.hash[a:b], b - a) + np.uint64(b - a)))
            continue
        own = g[a : max(a, b - GRAM + 1)]
        first = winnow(own)
        at.append(first << 8 | np.minimum(255, b - a - GRAM - first))
        prints.append(own[first])
    return at, prints


def _print_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text) to (key, doc_id, at, prints): fingerprints and their first words."""
    for batch in batches:
        for i, words, _ in each_block(batch.column(2)):
            at, prints = _prints(words)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, words.n_docs), batch.column(1).slice(i, words.n_docs), list_column(at, pa.int64()), list_column(prints, pa.int64())], names=["key", "doc_id", "at", "prints"])


def _word_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to (key, words): short hashes of the words."""
    for batch in batches:
        for i, words, _ in each_block(batch.column(1)):
            short = (words.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, words.n_docs), pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(short))], names=["key", "words"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and values of a list column."""
    offs = column.offsets.to_numpy()
    return offs - offs[0], column.flatten().to_numpy(zero_copy_only=False)


END = 2  # a row that is a stretch itself, beside those of its begins (0) and ends (1)


def _chain_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, places of (key0, pos, pos0)) to rows (key, key0, at, side, begin, end).

    Places on one diagonal that cover words without a gap are a chain; chains that touch are a stretch,
    a row of side 2.  The rows of side 0 and 1 are the begins and ends of chains that could extend
    their stretch, with their place in the earlier document: none does where a text begins or ends.
    """
    for batch in batches:
        places = batch.column(1)
        row, parts = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy())), places.flatten()
        key0, pos = parts.field("key0").to_numpy(), parts.field("pos").to_numpy()
        pos, after = pos >> 8, pos & 255
        shift = pos - (parts.field("pos0").to_numpy() >> 8)
        order = np.lexsort((pos, shift, key0, row))
        row, key0, pos, shift, after = (x[order] for x in (row, key0, pos, shift, after))
        a, z = _groups(len(row), (row[1:] != row[:-1]) | (key0[1:] != key0[:-1]) | (shift[1:] != shift[:-1]) | (np.diff(pos) > GRAM))
        row, key0, shift, begin, end, after = row[a], key0[a], shift[a], pos[a], pos[z] + GRAM, after[z]
        order = np.lexsort((begin, row))
        row, key0, shift, begin, end, after = (x[order] for x in (row, key0, shift, begin, end, after))
        apart = row << 40  # documents don't touch
        upto = np.maximum.accumulate(apart + end) if len(end) else end
        a, z = _groups(len(row), (apart + begin)[1:] > upto[:-1])
        each = np.repeat(np.arange(len(a)), z - a + 1)
        first, last = begin[a], upto[z] - apart[a]
        open_end = np.minimum.reduceat(np.where(end == last[each], after, 255), a) > 0 if len(a) else np.zeros(0, bool)
        left = (first[each] > 0) & (begin < first[each] + BESIDE)
        right = open_end[each] & (end > last[each] - BESIDE)
        none = pa.nulls(len(a), pa.int64())
        for side, who, other, at, x, y in ((0, row[left], key0[left], (begin - shift)[left], begin[left], end[left]), (1, row[right], key0[right], (end - shift)[right], begin[right], end[right]), (END, row[a], none, none, first, last)):
            ints = [at.cast(pa.int32()) if at is none else pa.array(at.astype(np.int32)), pa.array(np.full(len(who), side, np.int8)), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(other), *ints], names=["key", "key0", "at", "side", "begin", "end"])


def _groups(n: int, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of groups among n; ``new`` tells for each but the first whether it begins one."""
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a = np.flatnonzero(np.append(True, new))
    return a, np.append(a[1:], n) - 1


def _beside_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key0, words, ends of (at, side)) to a row for each end with the BESIDE words left (side 0) or right of it."""
    for batch in batches:
        (words_at, words), ends = _flat(batch.column(1)), batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), np.diff(ends.offsets.to_numpy()))
        parts = ends.flatten()
        lo, hi, side = words_at[row], words_at[row + 1], parts.field("side").to_numpy()
        at = np.minimum(hi, lo + parts.field("at").to_numpy())
        begin, end = np.where(side == 0, np.maximum(lo, at - BESIDE), at), np.where(side == 0, at, np.minimum(hi, at + BESIDE))
        offs = np.concatenate([[0], np.cumsum(end - begin)])
        own = words[np.arange(offs[-1]) + np.repeat(begin - offs[:-1], end - begin)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), parts.field("at"), parts.field("side"), pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(own.astype(np.int32)))], names=["key0", "at", "side", "beside"])


def _runs_map(least_words: int):
    """(key, ends of (side, begin, end, beside), words) to merged runs: the stretches, and what their begins and ends are extended by.

    An end is extended word by word along the words beside its earlier place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, (own_at, own) = batch.column(1), _flat(batch.column(2))
            row, parts = np.repeat(np.arange(batch.num_rows), np.diff(ends.offsets.to_numpy())), ends.flatten()
            lists = parts.field("beside").fill_null([])
            (beside_at, beside), side = _flat(lists), parts.field("side").to_numpy()
            lo, hi = own_at[row], own_at[row + 1]
            begin, end = lo + parts.field("begin").to_numpy(), np.minimum(hi, lo + parts.field("end").to_numpy())
            on = np.flatnonzero(side == 0)
            for j in range(1, BESIDE + 1):
                on = on[(begin[on] > lo[on]) & (beside_at[on + 1] - j >= beside_at[on])]
                on = on[own[begin[on] - 1] == beside[beside_at[on + 1] - j]]
                begin[on] -= 1
            on = np.flatnonzero(side == 1)
            for j in range(BESIDE):
                on = on[(end[on] < hi[on]) & (beside_at[on] + j < beside_at[on + 1])]
                on = on[own[end[on]] == beside[beside_at[on] + j]]
                end[on] += 1
            order = np.lexsort((begin, row))
            row, begin, end = row[order], begin[order] + row[order], end[order] + row[order]  # documents don't touch
            upto = np.maximum.accumulate(end) if len(end) else end
            a, z = _groups(len(row), begin[1:] > upto[:-1])
            row, begin, end = row[a], begin[a] - row[a] - own_at[row[a]], upto[z] - row[a] - own_at[row[a]]
            keep = (end - begin >= least_words) | (end - begin == np.diff(own_at)[row])
            row, span = row[keep], (begin.astype(np.int64) << 32 | end.astype(np.int64))[keep]
            docs, first = np.unique(row, return_index=True)
            spans = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(span))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(docs)), spans], names=["key", "spans"])

    return run


def _matches(feats: DataFrame) -> DataFrame:
    """(key, pos, key0, pos0): each place of a fingerprint but the first, with the first one.

    Fingerprints that a sample shows in more than a set share of all places are sent to every task
    (they are HOT_MOST at most), so that none meets in one task; the others are shuffled once.
    """
    prints = feats.select("key", "doc_id", F.explode(F.arrays_zip("at", "prints")).alias("x")).select("key", "doc_id", F.col("x.at").alias("pos"), F.col("x.prints").alias("print"))
    total = feats.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    bound = max(HOT_LEAST, total // HOT_MOST) * HOT_SAMPLE
    some = feats.where(F.rand(17) < HOT_SAMPLE).select(F.explode("prints").alias("print")).groupBy("print").count().where(F.col("count") >= bound).select("print")
    hot = materialize(some, "hot")
    place = F.struct("doc_id", "key", "pos")

    def others(rows: DataFrame, first: str) -> DataFrame:
        return rows.select("key", "pos", F.col(f"{first}.key").alias("key0"), F.col(f"{first}.pos").alias("pos0")).where("key <> key0 or pos <> pos0")

    rare = prints if hot.isEmpty() else prints.join(F.broadcast(hot), "print", "left_anti")
    upto = Window.partitionBy("print").orderBy("doc_id", "key", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = others(rare.withColumn("f", F.first(F.struct("key", "pos")).over(upto)), "f")
    if not hot.isEmpty():
        often = prints.join(F.broadcast(hot), "print", "left_semi").groupBy("print").agg(F.min(place).alias("f"))
        out = out.unionByName(others(prints.join(F.broadcast(often), "print"), "f"))
    return out


def repeated_runs(docs: DataFrame, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, spans): runs of words (begin << 32 | end) that stand earlier in the corpus, by order of doc_id (null first) and position.

    ``key`` is xxhash64(doc_id, text); rows that repeat both are one document.  A run counts from
    ``least_words`` words on, or as a whole document.  Every run of WINDOW + GRAM - 1 words has a
    fingerprint and is found, but for up to WINDOW - 1 words at an end if its outermost fingerprint
    first stands in a passage that ends sooner; of runs from GRAM words on, most are.  A document with
    fewer than GRAM words is compared as a whole.
    """
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    texts = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    feats = materialize(texts.mapInArrow(_print_map, "key long, doc_id long, at array<long>, prints array<long>"), "prints")
    places = _matches(feats).groupBy("key").agg(F.collect_set(F.struct("key0", "pos", "pos0")).alias("places"))
    chains = materialize(places.mapInArrow(_chain_map, "key long, key0 long, at int, side byte, begin int, end int"), "chains")

    def words_of(name: str) -> DataFrame:
        keys = chains.select(F.col(name).alias("key")).where("key is not null").distinct()
        if keys.count() <= BROADCAST_ROWS:
            keys = F.broadcast(keys)
        # rows that repeat id and text are one document
        return texts.select("key", "text").join(keys, "key", "left_semi").mapInArrow(_word_map, "key long, words array<int>").dropDuplicates(["key"]).withColumnRenamed("key", name)

    sides = chains.where(F.col("side") < END)
    ends = sides.groupBy("key0", "at", "side").agg(F.count("*").alias("n"))
    listed = ends.groupBy("key0").agg(F.collect_list(F.struct("at", "side")).alias("ends"))
    beside = materialize(words_of("key0").join(listed, "key0").select("key0", "words", "ends").mapInArrow(_beside_map, "key0 long, at int, side byte, beside array<int>"), "beside")
    # an end that very many chains share is sent to every task
    bound = max(HOT_LEAST, chains.count() // END_MOST)
    often = materialize(ends.where(F.col("n") > bound).drop("n"), "often")
    on = ["key0", "at", "side"]
    if often.isEmpty():
        told = sides.join(beside, on)
    else:
        hot = F.broadcast(beside.join(F.broadcast(often), on, "left_semi"))
        told = sides.join(hot, on).unionByName(sides.join(F.broadcast(often), on, "left_anti").join(beside, on))
    told = told.unionByName(chains.where(F.col("side") == END).withColumn("beside", F.lit(None).cast("array<int>")))
    told = told.groupBy("key").agg(F.collect_list(F.struct("side", "begin", "end", "beside")).alias("ends"))
    return words_of("key").join(told, "key").select("key", "ends", "words").mapInArrow(_runs_map(least_words), "key long, spans array<long>")


def _cut(data: np.ndarray, words: Words, a: int, b: int, lo: int, hi: int, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The bytes lo to hi without the runs of words (counted from the document's first, a), and the words deleted."""
    out, pos, deleted = [], lo, 0
    for x, y in runs:
        out.append(data[pos : int(words.begin[a + x])].tobytes())
        deleted += y - x
        pos = int(words.begin[a + y]) if a + y < b else hi
    out.append(data[pos:hi].tobytes())
    return b"".join(out), deleted


def _delete_map(at_text: int, at_runs: int, names: list[str], counts: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, deleted, changed = batch.column(at_text), np.zeros(batch.num_rows, np.int64), {}
            which = np.flatnonzero(pc.is_valid(batch.column(at_runs)).to_numpy(zero_copy_only=False))
            runs, own = batch.column(at_runs).take(pa.array(which)).to_pylist(), text.take(pa.array(which))
            for i, words, data in each_block(own):
                for d in range(words.n_docs):
                    raw = own[i + d].as_py().encode("utf-8")
                    lo = int(words.begin[words.first[d]]) - (len(raw) - len(raw.lstrip(b" \t\n\v\f\r")))
                    k = int(which[i + d])
                    left, deleted[k] = _cut(data, words, int(words.first[d]), int(words.first[d + 1]), lo, lo + len(raw), [(r >> 32, r & 0xFFFFFFFF) for r in runs[i + d]])
                    changed[k] = left.decode("utf-8")
            mask = np.zeros(batch.num_rows, bool)
            mask[list(changed)] = True
            text = pc.replace_with_mask(text, pa.array(mask), pa.array([changed[k] for k in sorted(changed)], text.type))
            columns = [text if k == at_text else batch.column(k) for k in range(batch.num_columns) if k != at_runs]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(deleted, pa.int64())] if counts else columns, names=[*names, counts] if counts else names)

    return run


def delete_repeated_lines(docs: DataFrame, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with later repeated runs of words cut out of the text; every row and every other column stays.

    A text all of whose words go becomes empty; a null text stays null.  ``counts`` names a column
    with the number of deleted words that follows (any column of that name is replaced).
    """
    bounded_batches(docs.sparkSession)
    runs = repeated_runs(docs, least_words, id_col, text_col).select(F.col("key").alias("__key"), F.col("spans").alias("__runs"))
    runs = materialize(runs, "runs")
    if runs.count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    names = [n for n in docs.columns if n != counts]
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    given = docs.select(*names).withColumn(text_col, F.col(text_col).cast("string")).withColumn("__own", key)
    joined = given.join(runs, given["__own"] == runs["__key"], "left").select(*names, "__runs")
    schema = joined.select(*names).schema
    if counts:
        schema = schema.add(counts, "long")
    return joined.mapInArrow(_delete_map(names.index(text_col), len(names), names, counts), schema)
