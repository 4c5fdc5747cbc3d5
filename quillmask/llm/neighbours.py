"""Nearest neighbours by largest inner product, with collision-counting hashing.

Maximum inner product is turned into nearest distance by one more coordinate (vectors are scaled by the largest norm M, which one aggregate finds, and get sqrt(1 - |x|^2 / M^2)). A set of ``hashes`` single random projections
is kept as sorted arrays. A query opens a window around its own projection in each array; virtual rehashing widens all windows together by ``growth``; a vector that falls into
at least ``share`` of a query's windows has collided often enough to be verified, by its exact inner product in double precision. The widening ends at the width at which a vector
as far as the k-th verified one would have reached the threshold with a margin of ``margin`` standard deviations (or where the windows hold all there is), which is the rule that sets the recall.

The threshold is high and the windows are wide, as they part near from far best in their tails; so what is counted is the shorter side of each window, mostly the vectors outside, the misses. The first
width is that of the nearest of a few vectors, as many for any block, which is an upper bound of the last one.

Every vector is indexed. Vectors are dealt into blocks of some ``vectors_in_block`` rows, and each block is shuffled once (to as many tasks as there are cores, where there are fewer blocks); its index is built once
in a task, through which the queries are streamed. The best of the blocks are merged by query. So memory is bounded by a block, whatever the number of rows, and no task sees the whole of either side.

Vectors of different lengths have no inner product: each length is answered by itself. Vectors that are null, empty, zero, or hold null or non-finite components take no part. Rows that share an
identifier are one row (the largest vector of them); a null identifier takes no part. Ties go to the smaller identifier. With fewer candidates than asked for, all are returned; a query without any has no rows, nor has an
empty table. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Vectors of a block that are looked at first.
FIRST = 512
LEAST_WIDTH = 1e-3


class Index:
    """The sorted projections of one block: those on one line after another, each line's ``apart`` above the one before, so that a single search finds a place on all of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, hashes: int, seed: int):
        self.ids, self.vectors, self.largest, self.size = ids, vectors, largest, len(ids)
        scaled = vectors / largest
        extra = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("ij,ij->i", scaled, scaled)))
        self.lines = np.random.default_rng(seed).standard_normal((hashes, vectors.shape[1] + 1))
        projected = (self.lines @ np.hstack([scaled, extra[:, None]]).T).astype(np.float32)
        order = np.argsort(projected, axis=1)
        # no projection of a unit point is longer than its line
        self.longest = float(np.sqrt((self.lines**2).sum(1)).max())
        self.bases = np.arange(hashes) * 8.0 * self.longest
        self.values = (np.take_along_axis(projected, order, axis=1) + self.bases[:, None]).ravel()
        self.order, self.ends = order.ravel(), np.arange(hashes + 1) * self.size
        self.first = np.linspace(0, self.size - 1, min(self.size, FIRST)).astype(np.int64)

    def window(self, centres: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """On each line, the places from width below the centre to width above it."""
        return np.searchsorted(self.values, centres - width), np.searchsorted(self.values, centres + width, "right")

    def count(self, *parts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """How often each vector stands between the places of parts (from, to on each line)."""
        return np.bincount(np.concatenate([self.order[x:y] for part in parts for x, y in zip(part[0].tolist(), part[1].tolist(), strict=True)]), minlength=self.size)


@lru_cache(maxsize=8)
def reach_of(hashes: int, need: int, margin: float) -> float:
    """The half width, as a multiple of a vector's distance, at which it has collided need times with that margin."""
    low, high = 0.0, 8.0
    for _ in range(50):
        mid = (low + high) / 2
        p = math.erf(mid / math.sqrt(2))
        low, high = (low, mid) if hashes * p - margin * math.sqrt(hashes * p * (1 - p)) >= need else (mid, high)
    return high


def search(index: Index, query: np.ndarray, own: int, k: int, share: float, growth: float, margin: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of the best k of the block for one query, and how many vectors were verified."""
    ids, vectors, hashes, norm = index.ids, index.vectors, len(index.bases), math.sqrt(query @ query)
    need = math.ceil(share * hashes)
    reach = reach_of(hashes, need, margin)
    # |p - q|^2 with unit q and points on the unit sphere
    distance = lambda score: math.sqrt(max(0.0, 2.0 - 2.0 * float(score) / norm / index.largest))
    centres = index.lines[:, :-1] @ (query / norm) + index.bases
    some = index.first[ids[index.first] != own]
    width = max(LEAST_WIDTH, reach * distance((vectors.take(some, 0) @ query).max())) if len(some) else 3 * index.longest
    seen = np.zeros(index.size, bool)
    best_at, best = np.zeros(0, np.int64), np.zeros(0)
    low, high = index.window(centres, width)
    if 2 * int((high - low).sum()) < len(index.order):
        missed = hashes - index.count((low, high))
    else:
        missed = index.count((index.ends[:-1], low), (high, index.ends[1:]))
    while True:
        fresh = np.flatnonzero((missed <= hashes - need) & ~seen)
        if len(fresh):
            seen[fresh] = True
            fresh = fresh[ids[fresh] != own]
            best_at, best = np.concatenate([best_at, fresh]), np.concatenate([best, vectors.take(fresh, 0) @ query])
            if len(best) > k:
                top = np.lexsort((ids[best_at], -best))[:k]
                best_at, best = best_at[top], best[top]
        wider = width * growth
        if len(best) >= k:
            last = reach * distance(best.min())
            if width >= last:
                break
            wider = min(wider, last)
        if width > 2 * index.longest:  # the windows hold all there is
            break
        width = wider
        below, above = index.window(centres, width)
        missed -= index.count((below, low), (high, above))
        low, high = below, above
    top = np.lexsort((ids[best_at], -best))
    return ids[best_at[top]], best[top], int(seen.sum())


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite and not all zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & ok & F.exists(vector, lambda x: x != 0)


UNIT = ("size", "block", "part")
FOUND = "query_id bigint, vec_id bigint, score double"


def _searched(largest: float, k: int, hashes: int, share: float, growth: float, margin: float, seed: int):
    """Over rows (size, block, part, asks, id, vec) in that order: a unit's vectors are held and indexed, its queries streamed."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, index = None, [], None
        for batch in batches:
            units = np.stack([batch.column(c).to_numpy() for c in UNIT], 1)
            asks, ids = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("id").to_numpy()
            column = batch.column("vec")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            turns = np.flatnonzero((units[1:] != units[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if tuple(units[a]) != unit:
                    unit, held, index = tuple(units[a]), [], None
                vectors = flat[ends[a] : ends[b]].reshape(b - a, -1)
                if not asks[a]:
                    held.append((ids[a:b], vectors.copy()))
                elif held:
                    if index is None:
                        index = Index(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]), largest, hashes, seed)
                        held = [(index.ids, index.vectors)]
                    found = [search(index, query, own, k, share, growth, margin)[:2] for own, query in zip(ids[a:b].tolist(), vectors, strict=True)]
                    asked = np.repeat(ids[a:b], [len(x) for x, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))], ["query_id", "vec_id", "score"])

    return best


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    hashes: int = 320,
    share: float = 0.95,
    growth: float = 1.12,
    margin: float = 1.5,
    seed: int = 7,
    vectors_in_block: int = 32768,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row where is_query (over ``id`` and ``vec``) holds, its k best other rows."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & usable(F.col("vec")))
    rows = rows.groupBy("id").agg(F.max("vec").alias("vec"))
    rows = rows.withColumns({"asks": F.coalesce(is_query, F.lit(False)), "size": F.size("vec")})
    count, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()
    blocks = max(1, -(-count // vectors_in_block))
    # with few blocks, each goes to several tasks that share its queries
    parts = max(1, -(-rows.sparkSession.sparkContext.defaultParallelism // blocks))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    block, part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)).cast("int")
    held = rows.select("size", block.alias("block"), F.explode(upto(parts)).alias("part"), F.lit(False).alias("asks"), "id", "vec")
    asked = rows.where("asks").select("size", F.explode(upto(blocks)).alias("block"), part.alias("part"), "asks", "id", "vec")
    units = held.unionByName(asked).repartition(*UNIT).sortWithinPartitions(*UNIT, "asks", "id")
    found = units.mapInArrow(_searched(norm or 1.0, k, hashes, share, growth, margin, seed), FOUND)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
