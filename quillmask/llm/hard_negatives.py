"""Hard negatives by dual-tree search: for an anchor and each of its positives, the rows of other labels whose inner product lies in a window that the positive's sets.

Both sides stand in trees: candidates of a block in one, the anchors of a batch in another. A node is split at a boundary between labels while it holds several, and by the direction in which it is widest once it holds one. Each node has a centre, a
radius, the range of its norms, and an angle around its centre. For two nodes these give an interval, from the ball and from the cone, that holds every inner product between them. Intervals of all node pairs come from one matrix product; the search goes down both
trees, nearest pairs first, and drops a pair, and with it a whole group of anchors, if its interval or its labels can't serve any anchor of the node. Pairs of leaves that are left are scored exactly, in integers.

Two searches follow each other. Positives: the best rows of the anchor's own label; a pair of nodes is dropped below the worst place that any of its anchors still fills. Negatives: every (anchor, positive) has a window of scores, whose lower end rises to
its tenth best; a pair is dropped if its interval misses all windows of the node. Candidates are dealt into blocks of some ``rows_in_block`` rows, each is shuffled once for either search and indexed once in a task, through which the anchors are streamed. The
bests of the blocks are merged by anchor. Memory is bounded by a block and a batch of anchors.

Rows whose label, identifier or vector is null, or that hold a null or non-finite component, take no part; nor do empty vectors. Vectors of different lengths have no inner product, each length is answered by itself. Rows that share an identifier are one row, the
largest of them by label and vector. Scores beyond 64 bits are the nearest that 64 bits hold. Ties go to the smaller identifier. Anchors without positives, and positives without negatives, have no rows, nor has an empty table. Other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Rows of a leaf: candidates, anchors.
LEAF, ANCHOR_LEAF = 32, 8
LARGEST = np.iinfo(np.int64).max
LEAST = -LARGEST


class Tree:
    """Nodes in order, parents first; a node's rows stand side by side."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int):
        order = np.lexsort((ids, labels))
        self.first, self.last, self.left, self.right = [0], [len(ids)], [-1], [-1]
        node = 0
        while node < len(self.first):
            a, b = self.first[node], self.last[node]
            own = labels[order[a:b]]
            at = 0
            if own[0] != own[-1]:
                turns = np.flatnonzero(own[1:] != own[:-1]) + 1
                at = int(turns[np.argmin(np.abs(turns - (b - a) // 2))])
            elif b - a > leaf:
                held = vectors[order[a:b]]
                # along the line through the two rows that are far apart
                far = held[np.argmax(((held - held[0]) ** 2).sum(1))]
                line = held[np.argmax(((held - far) ** 2).sum(1))] - far
                along = held @ line
                turn = np.argsort(along, kind="stable")
                order[a:b] = order[a:b][turn]
                # midway between the two, but leaving at least an eighth on either side
                at = int(np.clip(np.searchsorted(along[turn], (along.min() + along.max()) / 2), (b - a + 7) // 8, (b - a) * 7 // 8))
            if at and (b - a > leaf):
                self.left[node], self.right[node] = len(self.first), len(self.first) + 1
                self.first += [a, a + at]
                self.last += [a + at, b]
                self.left += [-1, -1]
                self.right += [-1, -1]
            node += 1
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        n, d = len(self.first), vectors.shape[1]
        norms = np.sqrt((self.vectors**2).sum(1))
        units = self.vectors / np.maximum(norms, 1e-300)[:, None]
        self.centre, self.axis = np.empty((n, d)), np.empty((n, d))
        self.radius, self.angle, self.short, self.long = (np.empty(n) for _ in range(4))
        self.low_label, self.high_label = np.empty(n, labels.dtype), np.empty(n, labels.dtype)
        for i, (a, b) in enumerate(zip(self.first, self.last, strict=True)):
            self.centre[i] = self.vectors[a:b].mean(0)
            self.radius[i] = np.sqrt(((self.vectors[a:b] - self.centre[i]) ** 2).sum(1).max())
            axis = units[a:b].mean(0)
            size = np.sqrt((axis**2).sum())
            self.axis[i] = axis / size if size > 1e-12 else 0.0
            self.angle[i] = np.arccos(np.clip((units[a:b] @ self.axis[i]).min(), -1, 1)) + 1e-7 if size > 1e-12 and norms[a:b].min() > 0 else np.pi
            self.short[i], self.long[i] = norms[a:b].min(), norms[a:b].max()
            self.low_label[i], self.high_label[i] = self.labels[a:b].min(), self.labels[a:b].max()

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(np.array(self.left) < 0)


def intervals(one: Tree, other: Tree) -> tuple[np.ndarray, np.ndarray]:
    """For each pair of nodes, bounds of the inner products of their rows; rounding is allowed for."""
    middle = one.centre @ other.centre.T
    one_long, other_long = np.sqrt((one.centre**2).sum(1)), np.sqrt((other.centre**2).sum(1))
    reach = one.radius[:, None] * other_long + one_long[:, None] * other.radius + one.radius[:, None] * other.radius
    between = np.arccos(np.clip(one.axis @ other.axis.T, -1, 1))
    spread = one.angle[:, None] + other.angle
    most, least = np.cos(np.maximum(between - spread, 0)), np.cos(np.minimum(between + spread, np.pi))
    longest, shortest = one.long[:, None] * other.long, one.short[:, None] * other.short
    high, low = most * np.where(most > 0, longest, shortest), least * np.where(least < 0, longest, shortest)
    slack = 1e-6 * longest + 1e-6
    return np.maximum(middle - reach, low) - slack, np.minimum(middle + reach, high) + slack


def products(one: np.ndarray, other: np.ndarray, safe: bool) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as 64-bit integers."""
    if safe:
        return (one @ other.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], object)
    return np.clip(whole(one) @ whole(other).T, LEAST + 2, LARGEST).astype(np.int64)


class Search:
    """The candidates of one block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        with np.errstate(all="ignore"):
            self.tree = Tree(ids, labels, vectors, LEAF)
        self.largest = float(np.abs(vectors).max())
        self.pairs = self.scored = 0

    def run(self, anchors: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor's place, window's place, id, score): for each anchor (its place) and each of its windows [low, high] of scores, the ids and scores of its k best rows of the same label, itself aside, or of another; windows that hold nothing have low > high."""
        with np.errstate(all="ignore"):
            index = Tree(np.arange(len(anchors)), labels, vectors, ANCHOR_LEAF)
            lower, upper = intervals(index, self.tree)
        at, tree = index.ids, self.tree
        own, low, high = anchors[at], low[at], high[at]
        windows = low.shape[1]
        safe = self.largest * float(np.abs(vectors).max()) * vectors.shape[1] < 2.0**53
        best = np.full((len(at), windows, k), LEAST)
        best_id = np.full((len(at), windows, k), LARGEST)
        need = low.copy()  # what a score must reach: the window's end, or the worst place
        # for each node of anchors: the least that any of its windows needs, the most that any allows
        open_ = low <= high
        span = [*zip(index.first, index.last, strict=True)]
        least = lambda a, b: float(x) if (x := np.where(open_[a:b], need[a:b], LARGEST).min()) > LEAST + 2 else -np.inf
        floor = np.array([least(a, b) for a, b in span])
        roof = np.array([float(x) if (x := np.where(open_[a:b], high[a:b], LEAST).max()) < LARGEST else np.inf for a, b in span])
        parent = np.full(len(index.first), -1)
        for i, child in enumerate(index.left):
            if child >= 0:
                parent[child] = parent[child + 1] = i
        if alike:
            apart = (index.low_label[:, None] > tree.high_label) | (index.high_label[:, None] < tree.low_label)
        else:
            one = (index.low_label == index.high_label)[:, None] & (tree.low_label == tree.high_label)
            apart = one & (index.low_label[:, None] == tree.low_label)
        self.pairs += len(index.leaves()) * len(tree.leaves())
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            if apart[i, j] or upper[i, j] < floor[i] or lower[i, j] > roof[i]:
                continue
            if index.left[i] < 0 and tree.left[j] < 0:
                self.scored += 1
                self._score(index, i, j, own, low, high, need, best, best_id, k, alike, safe)
                fresh, node = least(*span[i]), i
                while fresh > floor[node]:
                    floor[node] = fresh
                    node = parent[node]
                    if node < 0:
                        break
                    fresh = min(floor[index.left[node]], floor[index.right[node]])
                continue
            split_anchors = tree.left[j] < 0 or (index.left[i] >= 0 and index.last[i] - index.first[i] > (tree.last[j] - tree.first[j]) // 4)
            kids = [(index.left[i], j), (index.right[i], j)] if split_anchors else [(i, tree.left[j]), (i, tree.right[j])]
            # the last one put is the first one taken
            stack += kids if upper[kids[0]] <= upper[kids[1]] else kids[::-1]
        row, window, place = np.nonzero(best > LEAST)
        return at[row], window, best_id[row, window, place], best[row, window, place]

    def _score(self, index: Tree, i: int, j: int, own, low, high, need, best, best_id, k: int, alike: bool, safe: bool) -> None:
        tree = self.tree
        rows, columns = slice(index.first[i], index.last[i]), slice(tree.first[j], tree.last[j])
        scores = products(index.vectors[rows], tree.vectors[columns], safe)
        same = index.labels[rows, None] == tree.labels[columns]
        may = (same & (own[rows, None] != tree.ids[columns])) if alike else ~same
        # anchors by windows by candidates; an equal score may still stand before the worst place, by its id
        hits = may[:, None, :] & (scores[:, None, :] >= need[rows, :, None]) & (scores[:, None, :] <= high[rows, :, None])
        row, window = np.nonzero(hits.any(2))
        if not len(row):
            return
        new = np.where(hits[row, window], scores[row], LEAST)
        row = row + index.first[i]
        score = np.concatenate([best[row, window], new], 1)
        ids = np.concatenate([best_id[row, window], np.where(new > LEAST, tree.ids[columns], LARGEST)], 1)
        order = np.lexsort((ids, -score), axis=1)[:, :k]
        best[row, window], best_id[row, window] = np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)
        need[row, window] = np.maximum(low[row, window], best[row, window, -1])


UNIT = ("size", "block", "part")
FOUND = "anchor_id bigint, place int, id bigint, score bigint"


def _searched(k: int, alike: bool):
    """Over rows (size, block, part, asks, id, label, vec, low, high) in that order: a unit's candidates are held and indexed, its anchors streamed."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, search = None, [], None
        for batch in batches:
            units = np.stack([batch.column(c).to_numpy() for c in UNIT], 1)
            asks, ids, labels = batch.column("asks").to_numpy(zero_copy_only=False), batch.column("id").to_numpy(), batch.column("label").to_numpy()
            column = batch.column("vec")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
            turns = np.flatnonzero((units[1:] != units[:-1]).any(1) | (asks[1:] != asks[:-1])) + 1
            for a, b in zip([0, *turns.tolist()], [*turns.tolist(), len(ids)], strict=True):
                if a == b:
                    continue
                if tuple(units[a]) != unit:
                    unit, held, search = tuple(units[a]), [], None
                vectors = flat[ends[a] : ends[b]].reshape(b - a, -1)
                if not asks[a]:
                    held.append((ids[a:b], labels[a:b], vectors.copy()))
                elif held:
                    if search is None:
                        search = Search(*(np.concatenate(x) for x in zip(*held, strict=True)))
                        held = [(search.tree.ids, search.tree.labels, search.tree.vectors)]
                    ranges = []
                    for name in ("low", "high"):
                        lists = batch.column(name).slice(a, b - a)
                        ranges.append(np.array(lists.to_pylist(), np.int64).reshape(b - a, -1))
                    anchor, place, found_ids, scores = search.run(ids[a:b], labels[a:b], vectors, *ranges, k, alike)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][anchor]), pa.array(place.astype(np.int32)), pa.array(found_ids), pa.array(scores)], ["anchor_id", "place", "id", "score"])

    return found


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90), rows_in_block: int = 16384) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over rows (id, label, vec), vec whole numbers held as doubles.

    Anchors are the rows where is_anchor holds. The window's ends are hundredths of the positive's score.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    rows = rows.groupBy("id").agg(F.max(F.struct("label", "vec")).alias("row")).select("id", "row.*")
    rows = cut(rows.withColumns({"asks": F.coalesce(is_anchor, F.lit(False)), "size": F.size("vec")}))
    blocks = max(1, -(-rows.count() // rows_in_block))
    # with few blocks, each goes to several tasks that share its anchors
    parts = max(1, -(-spark.sparkContext.defaultParallelism // blocks))
    upto = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    block, part = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(parts)).cast("int").alias("part")
    none = F.array().cast("array<bigint>")
    held = rows.select("size", block, F.explode(upto(parts)).alias("part"), F.lit(False).alias("asks"), "id", "label", "vec", none.alias("low"), none.alias("high"))

    def search(asked: DataFrame, k: int, alike: bool) -> DataFrame:
        asked = asked.select("size", F.explode(upto(blocks)).alias("block"), part, F.lit(True).alias("asks"), "id", "label", "vec", "low", "high")
        units = held.unionByName(asked).repartition(*UNIT).sortWithinPartitions(*UNIT, "asks", "label", "id")
        place = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "id"))
        return units.mapInArrow(_searched(k, alike), FOUND).withColumn("rank", place).where(F.col("rank") <= k)

    whole = rows.where("asks").withColumns({"low": F.array(F.lit(LEAST + 1)), "high": F.array(F.lit(LARGEST))})
    best = cut(search(whole, positives, True).select("anchor_id", F.col("rank").alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # an anchor's windows, in the order of its positives; at most so many as positives, so this list is bounded
    bounds = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("of", "positive_score"))).alias("ends"))
    share = lambda x, hundredths: x.positive_score.cast("decimal(20, 0)") * hundredths / 100
    pad = lambda column, value: F.concat(column, F.array_repeat(F.lit(value), F.lit(positives) - F.size(column)))
    # the least and the most whole number inside; a negative score has no window
    least = F.transform("ends", lambda x: F.when(x.positive_score < 0, F.lit(LARGEST)).otherwise(F.ceil(share(x, window[0])).cast("bigint")))
    most = F.transform("ends", lambda x: F.when(x.positive_score < 0, F.lit(LEAST)).otherwise(F.floor(share(x, window[1])).cast("bigint")))
    asked = rows.where("asks").join(bounds, F.col("id") == F.col("anchor_id")).withColumns({"low": pad(least, LARGEST), "high": pad(most, LEAST)})
    found = search(asked, negatives, False).select("anchor_id", (F.col("place") + 1).alias("of"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor_id", "of"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    # floor() gives 64 bits; from 2^53 on a double is whole by itself
    scaled = lambda x: F.least(F.greatest(x.cast("double") * 256, F.lit(-1.7e308)), F.lit(1.7e308))
    whole = F.transform("embedding", lambda x: F.when(x.isNull() | ~(F.abs(x) < float("inf")), x.cast("double")).when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))
    return mine(rows.select(F.col("vec_id").alias("id"), label.alias("label"), whole.alias("vec")), F.col("id") % 100 == 0)


OP13_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.v) = len(b.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as rank
    from p join s using (anchor_id) where not alike and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 10"""
