"""Exact top-k by inner product with a pivot table (LAESA, Mico et al. 1994; bounds for inner products by the cosine rule).

Distances from every vector to a set of pivots are computed once. For a query q and a candidate x the largest
|d(q, p) - d(x, p)| over all pivots p is a lower bound of d(q, x), so (|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of
their inner product. Candidates are evaluated in the order of that bound until it falls below the k-th score found; all
that follow are out, so the result is exact. Scores are integers.

Queries are written in blocks of bounded size to the shared folder, with their pivot distances and with the k-th score
they reach on a sample, which is a valid first threshold. Candidates stay where they are: every task keeps a bounded chunk
of them and goes through the blocks one after the other, so neither side is copied, broadcast or shuffled, and only hits
that can still be among the best k meet in a window per query.

Vectors of different lengths are not compared. Rows whose id or vector is null, or whose vector has a null component, take
no part. Of queries with the same id the one with the least vector counts; candidates with the query's id are left out.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evq.llm.shared import mounted_folder, open_array, save_array

PIVOTS, SAMPLE, BLOCK, CHUNK, STEP = 24, 2048, 2048, 16384, 256
PARTS = ("ids", "vectors", "squares", "distances", "least")


def quantise(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("long")))


def spread_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` vectors, each the farthest from those before it."""
    if not len(vectors):
        return vectors
    chosen = [0]
    far = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def table_of(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lengths, and distances (pivots x vectors)."""
    v = vectors.astype(np.float64)
    squares = (v * v).sum(1)
    return squares, np.stack([np.sqrt(((v - p) ** 2).sum(1)) for p in pivots.astype(np.float64)])


def exact(vectors: np.ndarray, top: int) -> np.ndarray:
    """The vectors in the fastest type whose inner products are exact, if no other component is above ``top``."""
    most = max(int(np.abs(vectors).max(initial=0)), top) ** 2 * vectors.shape[1]
    return vectors.astype(np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64)


def search(query: tuple, chunk: tuple, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores, number evaluated) of the candidates that can be among the best k of one query."""
    own, vector, square, distances, least = query
    ids, vectors, squares, table = chunk
    bound, gap = np.zeros(len(ids)), np.empty(len(ids))
    for p in range(len(table)):
        np.subtract(table[p], distances[p], out=gap)
        np.maximum(bound, np.abs(gap, out=gap), out=bound)
    total = square + squares
    bound = (total - bound * bound) / 2 + 1e-9 * total + 1e-6  # room for rounding of the distances
    open_ = np.flatnonzero((bound >= least) & (ids != own))
    open_ = open_[np.argsort(-bound[open_])]
    got, scores, done, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
    while done < len(open_) and bound[open_[done]] >= least:
        step = open_[done:done + size]
        done, size = done + len(step), 4 * size
        found = (vectors[step] @ vector.astype(vectors.dtype)).astype(np.int64)
        good = found >= least
        got, scores = np.concatenate([got, step[good]]), np.concatenate([scores, found[good]])
        if len(got) >= k:
            best = np.lexsort((ids[got], -scores))[:k]
            got, scores = got[best], scores[best]
            least = max(least, int(scores[-1]))
    return ids[got], scores, done


def _rows(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors by the length of the vector."""
    lists = batch.column("vector")
    starts = np.asarray(lists.offsets, dtype=np.int64)
    lengths, flat, ids = np.diff(starts), np.asarray(lists.values), batch.column("id").to_numpy()
    out = {}
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        out[int(n)] = ids[own], flat[starts[own][:, None] + np.arange(n)]
    return out


def top_k(queries: DataFrame, candidates: DataFrame, k: int, key: str = "vec_id", vector: str = "vector") -> DataFrame:
    """query_id, rank (from 1), ``key``, score: the k highest integer inner products of each query, ties to smaller ids.

    ``vector`` is an array<long>, ``key`` an integer. An empty side gives no rows; fewer than k candidates give all.
    """
    spark = candidates.sparkSession

    def usable(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
        return own.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()))

    candidates = usable(candidates)
    queries = usable(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    # A bounded sample in hash order: it gives the pivots and first thresholds, never results.
    sample: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for row in candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        sample.setdefault(len(row["vector"]), ([], []))
        sample[len(row["vector"])][0].append(row["id"])
        sample[len(row["vector"])][1].append(row["vector"])
    sample = {n: (np.array(a, np.int64), np.array(v, np.int64).reshape(len(a), n)) for n, (a, v) in sample.items()}
    pivots = {n: spread_pivots(v, PIVOTS) for n, (_, v) in sample.items()}
    shared = spark.sparkContext.broadcast((sample, pivots))  # SAMPLE vectors at most
    folder = mounted_folder(spark, "pivot-blocks")

    def pivots_for(n: int) -> np.ndarray:
        found = shared.value[1].get(n)
        return np.zeros((1, n), np.int64) if found is None or not len(found) else found

    def write_blocks(batches):
        part, made = TaskContext.get().partitionId(), 0
        waiting: dict[int, list] = {}

        def flush(n):
            nonlocal made
            ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(n), strict=True))
            for a in range(0, len(ids), BLOCK):
                own, block = ids[a:a + BLOCK], vectors[a:a + BLOCK]
                squares, distances = table_of(block, pivots_for(n))
                least = np.full(len(own), np.iinfo(np.int64).min)
                if n in shared.value[0]:
                    known, base = shared.value[0][n]
                    base = exact(base, int(np.abs(block).max(initial=0)))
                    for i, q in enumerate(block):
                        scores = (base @ q.astype(base.dtype))[known != own[i]]
                        if len(scores) >= k:
                            least[i] = int(np.partition(scores, -k)[-k])
                name = f"{n}-{part}-{made}"
                for what, values in zip(PARTS, (own, block, squares, distances, least), strict=True):
                    save_array(os.path.join(folder, f"{name}.{what}.npy"), values)
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array([name])], names=["name"])

        for batch in batches:
            for n, rows in _rows(batch).items():
                waiting.setdefault(n, []).append(rows)
                if sum(len(x[0]) for x in waiting[n]) >= BLOCK:
                    yield from flush(n)
        for n in list(waiting):
            yield from flush(n)

    names = [r["name"] for r in queries.mapInArrow(write_blocks, "name string").collect()]  # one short name per block

    def go_through(batches):
        waiting: dict[int, list] = {}

        def flush(n):
            ids, vectors = (np.concatenate(x) for x in zip(*waiting.pop(n), strict=True))
            for a in range(0, len(ids), CHUNK):
                own, block = ids[a:a + CHUNK], vectors[a:a + CHUNK]
                squares, distances = table_of(block, pivots_for(n))
                for name in (x for x in names if x.startswith(f"{n}-")):
                    q_ids, q_vectors, q_squares, q_distances, q_least = (open_array(os.path.join(folder, f"{name}.{w}.npy")) for w in PARTS)
                    chunk = own, exact(block, int(np.abs(q_vectors).max(initial=0))), squares, distances
                    found = [search((q_ids[i], q_vectors[i], q_squares[i], q_distances[:, i], int(q_least[i])), chunk, k)
                             for i in range(len(q_ids))]
                    sizes = [len(x[0]) for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(q_ids, sizes)), pa.array(np.concatenate([x[0] for x in found])),
                         pa.array(np.concatenate([x[1] for x in found]))], names=["query_id", "id", "score"])

        for batch in batches:
            for n, rows in _rows(batch).items():
                waiting.setdefault(n, []).append(rows)
                if sum(len(x[0]) for x in waiting[n]) >= CHUNK:
                    yield from flush(n)
        for n in list(waiting):
            yield from flush(n)

    hits = candidates.mapInArrow(go_through, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
