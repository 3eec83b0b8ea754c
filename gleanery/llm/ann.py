"""Nearest neighbours by collision counting (query-aware hashing).

Each of m random projections of a block's vectors is a sorted array. A query
opens a window around its own projection in every array; by virtual rehashing
the windows widen by ``growth`` step by step. A vector that falls into at least
``share`` of the m windows is a frequent one. A query ends when ``spare`` of the
block's vectors (256 at least) are frequent, or when all windows are as wide as
the arrays; the exact distances of all frequent vectors are then compared. No
bucket is cut off, so a crowd of equal vectors is verified as a whole.

Rows are dealt to tasks as they are read, each task indexes its own blocks of at
most ``block_rows`` rows, and the stated query set goes over all rows in blocks
of at most ``query_rows`` queries, so all that is sent or held has a bound. A task
indexes a block of rows once for all queries of such a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """vec_id and v (doubles) of the rows that take part.

    Left out: null ids and vectors, empty or zero ones, null or non-finite parts.
    """
    v = F.transform(column, lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


class CollisionIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, m: int, share: float, spare: float, growth: float, seed: int):
        self.ids, self.vectors, self.growth = ids, vectors, growth
        n = len(ids)
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        projected = vectors @ self.lines
        self.order = np.ascontiguousarray(np.argsort(projected, axis=0, kind="stable").T.astype(np.int32))
        self.sorted = np.take_along_axis(projected.T, self.order, axis=1)
        self.needed = max(1, int(np.ceil(share * m)))
        self.enough = min(n, max(256, int(spare * n)))
        # The first windows: as wide as a few of the block's own rows need them.
        own = projected[:: max(1, n // 16)][:16]
        radii = [np.partition(np.partition(np.abs(projected - p), self.needed - 1, axis=1)[:, self.needed - 1], self.enough - 1)[self.enough - 1] for p in own]
        self.half = max(0.9 * float(np.median(radii)), 1e-12)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the rows and distances of its k nearest found."""
        m, n = self.sorted.shape
        at = (queries @ self.lines).T
        low = np.stack([np.searchsorted(self.sorted[j], at[j]) for j in range(m)], axis=1)
        high, half = low.copy(), np.full(len(queries), self.half)
        counts = np.zeros((len(queries), n), np.int16)
        active, found = np.arange(len(queries)), [None] * len(queries)
        while len(active):
            left = np.stack([np.searchsorted(self.sorted[j], at[j, active] - half[active]) for j in range(m)], axis=1)
            right = np.stack([np.searchsorted(self.sorted[j], at[j, active] + half[active], side="right") for j in range(m)], axis=1)
            more = []
            for i, q in enumerate(active.tolist()):
                a, b = np.minimum(left[i], low[q]), np.maximum(right[i], high[q])
                sides = [self.order[j, x:y] for j, (x, y) in enumerate(zip(a.tolist(), low[q].tolist())) if x < y]
                sides += [self.order[j, x:y] for j, (x, y) in enumerate(zip(high[q].tolist(), b.tolist())) if x < y]
                if sides:
                    counts[q] += np.bincount(np.concatenate(sides), minlength=n).astype(np.int16)
                low[q], high[q] = a, b
                frequent = np.flatnonzero(counts[q] >= self.needed)
                if len(frequent) < self.enough and (a.any() or (b < n).any()):
                    half[q] *= self.growth
                    more.append(q)
                    continue
                rows = frequent[self.ids[frequent] != own[q]]
                distance = np.sqrt(((self.vectors[rows] - queries[q]) ** 2).sum(axis=1))
                if len(rows) > k:  # ties go to the smaller id
                    near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
                    near = near[np.lexsort((self.ids[rows[near]], distance[near]))][:k]
                    rows, distance = rows[near], distance[near]
                found[q] = (rows, distance)
            active = np.array(more, np.int64)
        return found


def search(
    vectors: DataFrame, *, column: str = "embedding", every: int = 100, k: int = 10, m: int = 128, share: float = 0.7, spare: float = 0.1, growth: float = 1.1, block_rows: int = 8192, query_rows: int = 32768, seed: int = 7
) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k nearest other rows found.

    Queries are the rows whose id is divisible by ``every``; of rows that repeat
    an id the smallest vector asks. A row is left out as a candidate if its id is the
    query's. Vectors of another length than the
    query's are no candidates. Repeated rows are candidates each.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, column)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n = queries.count()
    parts = max(1, -(-n // query_rows))
    found = None
    for part in range(parts):
        mine = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        block: dict[int, list] = {}
        for r in mine.toLocalIterator():  # about query_rows rows, an array for each length of vectors
            block.setdefault(len(r["v"]), []).append((r["vec_id"], r["v"]))
        sent = spark.sparkContext.broadcast({size: (np.array([i for i, _ in x]), np.array([v for _, v in x], float)) for size, x in block.items()})

        def nearest(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            def block_of(ids: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
                index = CollisionIndex(ids, dense, m, share, spare, growth, seed)
                out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
                owns, queries = sent.value.get(dense.shape[1], (np.zeros(0, np.int64), dense[:0]))
                for start in range(0, len(owns), 256):
                    some = owns[start : start + 256]
                    for own, (at, distance) in zip(some.tolist(), index.search(queries[start : start + 256], some, k)):
                        out.append((np.full(len(at), own), index.ids[at], distance))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["query_id", "vec_id", "score"])

            by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for batch in batches:
                lists = batch.column(1)
                sizes = np.diff(lists.offsets.to_numpy())
                ids_of = batch.column(0).to_numpy()
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    dense = np.stack([np.asarray(lists[int(i)].values.to_numpy(zero_copy_only=False)) for i in at]) if len(np.unique(sizes)) > 1 else lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                    kept = by_size.setdefault(size, [])
                    kept.append((ids_of[at], dense))
                    if sum(len(x) for x, _ in kept) >= block_rows:
                        yield block_of(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))
                        kept.clear()
            for kept in by_size.values():
                if kept:
                    yield block_of(np.concatenate([x for x, _ in kept]), np.concatenate([y for _, y in kept]))

        here = rows.mapInArrow(nearest, "query_id long, vec_id long, score double")
        found = here if found is None else found.unionByName(here)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
