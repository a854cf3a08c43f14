"""Approximate nearest neighbours with balanced posting lists.

A bounded sample is clustered hierarchically with a size penalty, so lists are about equally long.
Each vector goes to its nearest centroid and, near a boundary, to further ones.  The centroids stand
in a navigable graph in memory, searched by beam to place the vectors.  A query takes all lists whose
centroid's distance is within a ratio of the nearest one's; within a list distances are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

SAMPLE = 32_768  # vectors that the centroids are fitted on
LIST = 256  # vectors that a posting list aims at
CENTROIDS_MOST = 8192  # bound of what is sent to every task
REPLICAS = 4  # lists of a boundary vector at most; the first is always its nearest
BOUNDARY = 1.15  # a vector goes to lists within this ratio of its nearest centroid's distance
PROBE = 1.6  # a query takes all lists within this ratio, whatever their number
FIRST = 48  # the nearest of them are read first; of the others only what beats the k-th found there is passed on
DEGREE = 24
CHUNK = 8192  # vectors of a list that one task holds
QUERIES = 4096  # queries of a list that one task holds
HUGE = 1e150  # norms beyond which squares overflow: such vectors stand in a list of their own that every query reads
OWN_LIST = -1  # that list


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0, (a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None, :])


def balanced_centroids(x: np.ndarray, k: int, seed: int = 11) -> np.ndarray:
    """About k centroids by repeated splits into 8, with a penalty on large parts."""
    rng = np.random.default_rng(seed)
    target, out, todo = max(1, len(x) / k), [], [np.arange(len(x))]
    while todo:
        own = todo.pop()
        parts = min(8, round(len(own) / target))
        if parts < 2:
            out.append(x[own].mean(0))
            continue
        p = x[own]
        c = p[rng.choice(len(own), parts, replace=False)]
        price = np.zeros(parts)
        for _ in range(12):
            d = _squared(p, c)
            label = (d + price[None, :]).argmin(1)
            n = np.bincount(label, minlength=parts)
            price += 0.1 * d.min(1).mean() * (n / n.mean() - 1)
            c = np.stack([p[label == i].mean(0) if n[i] else p[rng.integers(len(own))] for i in range(parts)])
        if n.max() == len(own):  # equal vectors can't be split
            out.append(p.mean(0))
            continue
        todo += [own[label == i] for i in range(parts) if n[i]]
    return np.array(out)


class CentroidGraph:
    """Nearest-neighbour graph of the centroids with a beam search for many vectors at once."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.c = centroids
        self.norm = (centroids * centroids).sum(1)
        n, rng = len(centroids), np.random.default_rng(5)
        near = min(DEGREE, n - 1)
        links = np.empty((n, DEGREE + 8), np.int32)
        for at in range(0, n, 1024):
            d = _squared(centroids[at : at + 1024], centroids)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            best = np.argpartition(d, near - 1, axis=1)[:, :near] if near else np.zeros((len(d), 0), int)
            far = rng.integers(0, n, (len(d), DEGREE + 8 - near))  # long links keep the graph connected
            links[at : at + len(d)] = np.concatenate([best, far], 1)
        self.links = links
        self.entry = rng.choice(n, min(n, 32), replace=False)

    def search(self, q: np.ndarray, k: int, beam: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, squared distances) of the k nearest that the beam finds, nearest first, for each row of q."""
        n, rows = len(self.c), np.arange(len(q))[:, None]
        beam = min(max(beam, k), n)
        k = min(k, n)
        ids = np.broadcast_to(self.entry, (len(q), len(self.entry)))
        seen = np.zeros((len(q), n), bool)
        seen[rows, ids] = True
        dist = self._to(q, ids)
        opened = np.zeros(ids.shape, bool)
        for _ in range(4 * n + 16):
            order = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            ids, dist, opened = (np.take_along_axis(v, order, 1) for v in (ids, dist, opened))
            todo = np.where(opened | ~np.isfinite(dist), np.inf, dist)
            pick = np.argsort(todo, axis=1, kind="stable")[:, :4]
            open_now = np.isfinite(np.take_along_axis(todo, pick, 1))
            if not open_now.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            new = self.links[np.take_along_axis(ids, pick, 1)].reshape(len(q), -1)
            ok = ~seen[rows, new] & np.repeat(open_now, self.links.shape[1], 1)
            seen[rows, new] |= ok
            d = np.where(ok, self._to(q, new), np.inf)
            s = np.argsort(new, axis=1, kind="stable")  # the same centroid from two parents counts once
            sorted_new = np.take_along_axis(new, s, 1)
            twice = np.zeros(new.shape, bool)
            np.put_along_axis(twice, s[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], 1)
            d[twice] = np.inf
            ids, dist, opened = np.concatenate([ids, new], 1), np.concatenate([dist, d], 1), np.concatenate([opened, ~np.isfinite(d)], 1)
        return ids[:, :k], dist[:, :k]

    def _to(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return np.maximum(0, (q * q).sum(1)[:, None] - 2 * np.einsum("id,ikd->ik", q, self.c[ids]) + self.norm[ids])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _lowest_map(keep: int):
    """(vec_id, embedding) to distinct vectors of a task with their ``keep`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1)
            flat, offs = lists.values.to_numpy() + 0.0, lists.offsets.to_numpy()  # -0 becomes 0
            own: dict[bytes, list[int]] = {}
            for k, v in enumerate(ids):
                own.setdefault(flat[offs[k] : offs[k + 1]].tobytes(), []).append(v)
            data = [np.frombuffer(b, flat.dtype) for b in own]
            offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int32) if data else np.zeros(1, np.int32)
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(data) if data else np.zeros(0, flat.dtype)))
            yield pa.RecordBatch.from_arrays([vectors, pa.array([sorted(set(v))[:keep] for v in own.values()], pa.list_(pa.int64()))], names=["embedding", "ids"])

    return run


def _norms(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths of rows, also where squares overflow or vanish."""
    top = np.abs(x).max(1, initial=0)
    top[top == 0] = 1
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(1))


def _assign_map(graph, dim: int, most: int, ratio: float, beam: int):
    """Add lists array<int>: the centroids within ``ratio`` of the nearest one's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: CentroidGraph = graph.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), dim)
                huge = _norms(x) > HUGE
                x[huge] = 0
                ids, dist = own.search(x, most, beam)
                take = np.sqrt(dist) <= ratio * np.sqrt(dist[:, :1]) + 1e-12
                take[:, 0] = True
                lists = [[OWN_LIST] if h else i[t].tolist() for i, t, h in zip(ids, take, huge, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*part.schema.names, "lists"])

    return run


def _probe_map(graph, dim: int, ratio: float):
    """Add lists array<int>: all centroids within ``ratio`` of the nearest one's distance, nearest first, after the list that all read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: CentroidGraph = graph.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x = _matrix(part.column(1), dim)
                huge = _norms(x) > HUGE
                x[huge] = 0
                dist = np.sqrt(_squared(x, own.c))
                take = (dist <= ratio * dist.min(1)[:, None] + 1e-12) | huge[:, None]
                order = np.argsort(dist, axis=1, kind="stable")
                lists = [[OWN_LIST, *o[t[o]].tolist()] for o, t in zip(order, take, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lists, pa.list_(pa.int32()))], names=[*part.schema.names, "lists"])

    return run


def _near(key: tuple, left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Distances of queries (query_id, embedding, bound) to the members (ids, embedding) of a list; the k best of each query within its bound.

    A product of matrices tells which k + 1 members (one may be the query) can be nearest, with a
    margin for its rounding; only these distances are computed exactly.
    """
    out: list[list] = [[], [], []]
    if left.num_rows and right.num_rows:
        left, right = left.combine_chunks(), right.combine_chunks()
        emb = right.column("embedding").combine_chunks()
        m = _matrix(emb, len(emb.values) // len(emb))
        members = right.column("ids").to_pylist()
        queries, vectors = left.column("query_id").to_pylist(), _matrix(left.column("embedding").combine_chunks(), m.shape[1])
        bounds = left.column("bound").to_numpy()
        with np.errstate(over="ignore", invalid="ignore"):
            norm, most = (m * m).sum(1), min(k + 1, len(m))
        for at in range(0, len(queries), 128):
            v, bound = vectors[at : at + 128], bounds[at : at + 128]
            with np.errstate(over="ignore", invalid="ignore"):
                own = (v * v).sum(1)
                d2 = own[:, None] + norm[None, :] - 2 * v @ m.T
                margin = 1e-11 * (own + norm.max())
                upto = np.minimum(np.partition(d2, most - 1, axis=1)[:, most - 1], bound * bound) + margin
                can = ~(d2 > upto[:, None])
            if not np.isfinite(d2).all():
                can[:] = True
            for q, x, b, c in zip(queries[at : at + 128], v, bound.tolist(), can, strict=True):
                best = np.flatnonzero(c)
                d = _distances(m[best], x)
                rows: list[tuple[float, int]] = []
                for y in np.argsort(d, kind="stable").tolist():
                    if d[y] > b or len(rows) >= k and d[y] > rows[k - 1][0]:
                        break
                    rows += [(float(d[y]), i) for i in members[best[y]] if i != q]
                    rows.sort()
                for s, i in rows[:k]:
                    out[0].append(q)
                    out[1].append(i)
                    out[2].append(s)
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def _distances(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = np.sqrt(((m - v) ** 2).sum(1))
        bad = ~np.isfinite(d)
        if bad.any():
            d[bad] = _norms(m[bad] - v)
    return d


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of rows that take part: id given, vector neither null nor zero, all components finite.

    Components keep their type if it is float; all others become double.
    """
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad & F.exists("embedding", lambda x: x != 0))


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, rows whose id is divisible by ``every``.

    Candidates are all rows of the query's length but those of its own id.  Scores are Euclidean distances in
    double precision on the vectors given; equal ones go by id.  Rows that can't take part (see
    :func:`usable`) are neither queries nor candidates.  Equal vectors are one member of a list that
    keeps their k+1 smallest ids, which is all that any result can need.  A query whose lists hold
    fewer than k candidates is compared with all vectors.
    """
    rows = usable(vectors, id_col, vector_col)
    dims = [r["dim"] for r in rows.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect()]
    if not dims:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    return reduce(DataFrame.union, [_nearest_of(rows.where(F.size("embedding") == dim), k, every) for dim in dims])


def _nearest_of(rows: DataFrame, k: int, every: int) -> DataFrame:
    """:func:`nearest` for vectors of one length."""
    spark, kind = rows.sparkSession, rows.schema["embedding"].dataType.simpleString()
    merged = rows.mapInArrow(_lowest_map(k + 1), f"embedding {kind}, ids array<long>")
    # tasks have reduced each vector to k+1 ids, so a group here has that times the tasks at most
    distinct = materialize(merged.groupBy("embedding").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")), "vectors")
    n = distinct.count()
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id", "embedding"])
    dim = rows.select(F.size("embedding")).first()[0]
    fair = distinct.where(F.aggregate("embedding", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x).cast("double"))) < HUGE / dim).select("embedding")
    part = min(1.0, SAMPLE / n)
    sample = fair.where(F.pmod(F.xxhash64("embedding"), F.lit(1_000_000)) < int(part * 1_000_000) + 1).limit(2 * SAMPLE).toArrow()
    if not sample.num_rows:
        sample = fair.limit(SAMPLE).toArrow()
    x = _matrix(sample.column(0).combine_chunks(), dim) if sample.num_rows else np.zeros((1, dim))
    graph = CentroidGraph(balanced_centroids(x, int(min(CENTROIDS_MOST, max(1, n // LIST)))))
    shared = spark.sparkContext.broadcast(graph)

    schema = f"ids array<long>, embedding {kind}, lists array<int>"
    members = materialize(distinct.select("ids", "embedding").mapInArrow(_assign_map(shared, dim, REPLICAS, BOUNDARY, 32), schema), "members").select("ids", "embedding", F.explode("lists").alias("list"))
    chunks = members.groupBy("list").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))  # one row for each centroid
    members = members.join(F.broadcast(chunks), "list").withColumn("chunk", F.pmod(F.xxhash64("embedding"), F.col("chunks")).cast("int")).select("list", "chunk", "ids", "embedding")
    probes = materialize(queries.mapInArrow(_probe_map(shared, dim, PROBE), f"query_id long, embedding {kind}, lists array<int>"), "probes")
    asked = probes.select("query_id", "embedding", F.posexplode("lists").alias("place", "list")).withColumn("bound", F.lit(float("inf")))
    endless = F.lit(float("inf"))

    def search(wanted: DataFrame, *known: DataFrame) -> DataFrame:
        """The k nearest among ``known`` and what the lists of ``wanted`` (query_id, embedding, list, bound) hold."""
        parts = F.broadcast(wanted.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))  # one row for each centroid
        left = wanted.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
        left = left.join(F.broadcast(chunks), "list").select("list", "part", "query_id", "embedding", "bound", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
        right = members.join(parts, "list").select("list", "chunk", "ids", "embedding", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        on = ["list", "chunk", "part"]
        near = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(lambda key, a, b: _near(key, a, b, k), "query_id long, vec_id long, score double")
        best = reduce(DataFrame.union, known, near).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = materialize(search(asked.where(F.col("place") <= FIRST)), "found")
    if len(graph.c) > FIRST:
        kth = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
        rest = asked.where(F.col("place") > FIRST).join(kth, "query_id", "left").withColumn("bound", F.coalesce("kth", endless))
        found = materialize(search(rest, found.select("query_id", "vec_id", "score")), "found")
    short = found.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    missing = materialize(queries.join(short, "query_id", "left_anti"), "short")
    if missing.isEmpty() or n * (k + 1) <= 1:
        return found
    # every list for these few
    wide = missing.select("query_id", "embedding", F.explode(F.sequence(F.lit(OWN_LIST), F.lit(len(graph.c) - 1))).alias("list"), endless.alias("bound"))
    return found.join(missing, "query_id", "left_anti").union(search(wide))
