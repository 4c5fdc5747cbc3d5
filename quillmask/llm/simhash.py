"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's bits are taken in segments; the counts of set bits in the segments are a point whose Manhattan distance to another point never exceeds the
Hamming distance of the two fingerprints. So fingerprints within ``radius`` bits lie within ``radius`` of each other in the embedding, and the range join is
made there on a grid: the axes are dealt into ``radius + 3`` slabs, and as a distance of radius touches radius slabs at most, two points in range share
the cell (unit cells of the untouched axes) of at least one choice of 3 slabs. Each distinct fingerprint goes to one cell for each choice; cells with
one fingerprint vanish in the join with the cells' sizes. Inside a cell the Manhattan distance is checked first, then the exact Hamming distance.

Copies are folded before anything else (one row a fingerprint, by partial aggregation). A cell of more than ``block`` fingerprints is dealt into blocks by hash, and each
pair of blocks is a unit of its own, so no task holds more than some 2 x block fingerprints and yet every pair meets. Within a unit only the links of a spanning forest are
returned, found by spreading from one fingerprint over those not reached yet: a large group costs its members, not its pairs, and no link between components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, cut, looked_up, raw, table
from .components import components
from .shingles import CELLS, shingles, wide_fingerprints
from .shingles import cells as shingle_cells
from .slices import portions

SEED = 42
_FOLD = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
ODD = 0x5555555555555555


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """A bit is 1 if it is set in over half of the XXH64 values of the text's word shingles, repeats included."""
    parts = text.translate(_FOLD).split() if text else []  # bytes.split() parts at [\x20\x09-\x0D] and no other characters
    if not parts:
        return 0
    line, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    votes, step = np.zeros(64, np.int64), 1 << 18
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    for at in range(0, n, step):
        h = np.array([digest(line[s:e], SEED) for s, e in zip(starts[at : at + step], ends[at : at + step], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint zero."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in raw(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    return df.mapInArrow(made, f"id {df.schema['id'].dataType.simpleString()}, fp bigint")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedding(fp: Column) -> Column:
    """The set bits of the 32 two-bit segments, each in its own two bits."""
    upper = F.shiftrightunsigned(fp, 1)
    one, two = fp.bitwiseXOR(upper).bitwiseAND(F.lit(ODD)), fp.bitwiseAND(upper).bitwiseAND(F.lit(ODD))
    return one.bitwiseOR(F.shiftleft(two, 1))


def cells(radius: int) -> list[int]:
    """Masks over the embedding, one for each choice of 3 of radius + 3 slabs of segments."""
    slabs = [sum(3 << 2 * int(i) for i in part) for part in np.array_split(np.arange(32), radius + 3)]
    return [signed(sum(x)) for x in combinations(slabs, 3)]


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between embeddings: two bits that differ in both places are a step from 1 to 2, in the upper one alone a step from 0 to 2."""
    x = a ^ b
    low, high = x & np.uint64(ODD), (x >> np.uint64(1)) & np.uint64(ODD)
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low)


def embedded(fp: np.ndarray) -> np.ndarray:
    return fp - ((fp >> np.uint64(1)) & np.uint64(ODD))


def near(one: np.ndarray, many: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of many are within radius bits of the row one. The Manhattan bound goes first; that of a fingerprint of several numbers is the sum of theirs."""
    at = np.flatnonzero(manhattan(embedded(many), embedded(one)).sum(1) <= radius)
    return at[np.bitwise_count(many[at] ^ one).sum(1, dtype=np.int64) <= radius]


def forest(fp: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among fingerprints, as positions."""
    left, us, vs = np.arange(len(fp)), [], []
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            u = front.pop()
            hit = near(fp[u], fp[left], radius)
            if len(hit):
                new = left[hit].tolist()
                us += [u] * len(new)
                vs += new
                front += new
                left = np.delete(left, hit)
    return us, vs


def _linked(radius: int, width: int):
    """Over rows (unit columns..., width columns of a fingerprint, root) sorted by unit: spanning links (u, v) between roots."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(unit: np.ndarray, fp: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
            """unit: whether a row begins a unit."""
            begin = np.flatnonzero(unit)
            size = np.diff(np.append(begin, len(fp)))
            member = np.repeat(size, size)
            number = np.cumsum(unit)
            us, vs = [], []
            small = np.flatnonzero(member <= 8)
            for step in range(1, 8):
                a, b = small[:-step], small[step:]
                same = number[a] == number[b]
                a, b = a[same], b[same]
                if not len(a):
                    break
                ok = manhattan(embedded(fp[a]), embedded(fp[b])).sum(1) <= radius
                a, b = a[ok], b[ok]
                ok = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= radius
                us.append(root[a[ok]])
                vs.append(root[b[ok]])
            for s, n in zip(begin[size > 8], size[size > 8], strict=True):
                u, v = forest(fp[s : s + n], radius)
                us.append(root[s : s + n][u])
                vs.append(root[s : s + n][v])
            u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        def of(columns: list[np.ndarray], upto: int) -> pa.RecordBatch:
            fp = np.stack([x[:upto].view(np.uint64) for x in columns[-1 - width : -1]], 1)
            return links(new[:upto], fp, columns[-1][:upto])

        held: list[np.ndarray] = []
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            held = [np.concatenate(x) for x in zip(held, now, strict=True)] if held else now
            new = np.ones(len(held[0]), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in held[: -1 - width]])
            last = int(np.flatnonzero(new)[-1]) if len(new) else 0
            if last:
                yield of(held, last)
                held = [x[last:] for x in held]
        if held and len(held[0]):
            new = np.ones(len(held[0]), bool)
            new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in held[: -1 - width]])
            yield of(held, len(held[0]))

    return linked


def _met(placed: DataFrame, names: list[str], radius: int, block: int, deal: list[str] | None = None) -> DataFrame:
    """Spanning links of (cell, fingerprint columns, root): rows meet in their cells, large cells in pairs of blocks, dealt by the fingerprint or by deal."""
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block)
    # Spark sizes rows behind an explode as the table in front of it and would send all of them to every task by way of the driver
    shared = placed.join(sizes.hint("merge"), "cell").select("cell", blocks.alias("blocks"), F.pmod(F.xxhash64(*(deal or names)), blocks).alias("own"), *names, "root")
    units = shared.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "own", *names, "root")
    units = units.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), *names, "root")
    units = units.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high", *names)
    return units.mapInArrow(_linked(radius, len(names)), "u bigint, v bigint").distinct()


def links(roots: DataFrame, radius: int = 3, block: int = 2048, deal: list[str] | None = None) -> DataFrame:
    """Spanning links (u, v) between the roots of (fp, root), of which any two within radius bits are connected. One row a fingerprint, or more of them, if deal names the column that parts them in blocks."""
    point = roots.select("fp", "root", embedding(F.col("fp")).alias("e"))
    masks = F.array(*(F.struct(F.lit(i).alias("choice"), F.lit(m).alias("mask")) for i, m in enumerate(cells(radius))))
    # one choice's number is mixed into the cell, so that a cell is a single long; the few cells that meet by chance only make a unit larger
    placed = point.select("fp", "root", F.explode(masks).alias("x"), "e").select(F.xxhash64("x.choice", F.col("e").bitwiseAND(F.col("x.mask"))).alias("cell"), "fp", "root")
    return _met(placed, ["fp"], radius, block, deal)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3, block: int = 2048) -> DataFrame:
    """(id, fp, component): for each row its fingerprint and the smallest identifier among the rows reachable over fingerprints within radius bits.

    Identifiers are integers. Null and empty texts have fingerprint zero and are linked like any other; rows with a null identifier get a fingerprint and no component unless a
    row with one is in reach. Repeated rows are answered each. An empty table gives an empty result.
    """
    prints = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "id", "text", words))
    roots = cut(prints.groupBy("fp").agg(F.min("id").alias("root"), F.count("*").alias("n")))
    found = components(links(roots.where(F.col("root").isNotNull()).select("fp", "root"), radius, block))
    ends = cut(roots.join(found, roots["root"] == found["node"], "left").select("fp", F.coalesce("component", "root").alias("component"), "n"))
    return looked_up(prints, ends, ["fp"], prints.count()).select("id", "fp", "component")


#: Numbers of a wide fingerprint.
WIDE = ("a", "b", "c", "d")
#: Bytes of text whose shingles are made at once.
PORTION = 1 << 20


def reach_of(similarity: float, spare: int = 24) -> int:
    """The bits of 256 in which two wide fingerprints are expected to differ at that Jaccard similarity of their shingles, and four times the spread (some 6 bits) more."""
    return round(256 * math.acos(2 * similarity / (1 + similarity)) / math.pi) + spare


def alike(sets: list[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs of sets with at least that Jaccard similarity, as positions; every pair is compared that the forest doesn't connect already."""
    size = np.array([len(x) for x in sets])
    number = np.unique(np.concatenate(sets), return_inverse=True)[1].reshape(-1)
    ends = np.cumsum(size)
    marked = np.zeros(number.max() + 1, bool)
    left, us, vs = np.arange(len(sets)), [], []
    of = lambda i: number[ends[i] - size[i] : ends[i]]
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            u = front.pop()
            some = np.flatnonzero((size[left] >= similarity * size[u] - 1e-9) & (similarity * size[left] - 1e-9 <= size[u]))
            if not len(some):
                continue
            marked[of(u)] = True
            shared = np.add.reduceat(marked[np.concatenate([of(i) for i in left[some].tolist()])], np.concatenate([[0], np.cumsum(size[left[some]])[:-1]]), dtype=np.int64)
            marked[of(u)] = False
            hit = some[shared >= similarity * (size[u] + size[left[some]] - shared) - 1e-9]
            if len(hit):
                new = left[hit].tolist()
                us += [u] * len(new)
                vs += new
                front += new
                left = np.delete(left, hit)
    return us, vs


def _verified(docs: DataFrame, loose: DataFrame, words: int, similarity: float, shingles_in_block: int) -> DataFrame:
    """Spanning links (u, v) of the pairs in a component of loose (node, component) whose shingles have that Jaccard similarity. A component's texts are dealt into blocks by hash, so many that one has some shingles_in_block of them; each pair of blocks is a
    unit."""
    few = loose.count() <= 500_000
    held = docs.where(F.col("text").isNotNull()).join(F.broadcast(loose) if few else loose, docs["id"] == loose["node"]).select("component", "id", "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in portions(batch.column(2), PORTION):
                found, begin = shingles(texts, words)
                size = np.diff(begin)
                at = pa.array(np.flatnonzero(size))
                sets = [found[x:y].tobytes() for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True) if y > x]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).take(at), batch.column(1).slice(a, b - a).take(at), pa.array(size[size > 0], pa.int64()), pa.array(sets, pa.binary())], ["component", "root", "size", "shingles"])

    sets = cut(held.mapInArrow(made, "component bigint, root bigint, size bigint, shingles binary"))
    sizes = sets.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("all")).where("n > 1")
    blocks = F.least(F.col("n"), F.ceil(F.col("all") / shingles_in_block))
    units = sets.join(sizes, "component").select("component", blocks.alias("blocks"), F.pmod(F.xxhash64("root"), blocks).alias("own"), "root", "shingles")
    units = units.select("component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "own", "root", "shingles")
    units = units.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "root", "shingles")

    def linked(unit: pa.Table) -> pa.Table:
        root = unit.column("root").to_numpy()
        u, v = alike([np.frombuffer(x, "<u8") for x in unit.column("shingles").to_pylist()], similarity)
        return pa.table({"u": np.maximum(root[u], root[v]), "v": np.minimum(root[u], root[v])}) if u else pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    return units.groupBy("component", "low", "high").applyInArrow(linked, "u bigint, v bigint").distinct()


def wide_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, among: DataFrame | None = None) -> DataFrame:
    """(id, a, b, c, d, whole, cells): 256-bit fingerprints of distinct word shingles, a hash of the set of them, 0 without words, and the numbers of the cells in which like texts meet. among (a column of identifiers): rows of others are left out, before their texts are read if the identifiers are few enough to be sent
    to every task, else by their fingerprints, so that no text moves for it."""
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    wanted = among.toDF("id").distinct() if among is not None else None
    few = wanted is not None and wanted.count() <= 2_000_000
    if few:
        df = df.join(F.broadcast(wanted), "id", "left_semi")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in portions(batch.column(1), PORTION):
                found, begin = shingles(texts, words)
                prints = wide_fingerprints(found, begin)
                whole = np.array([xxhash.xxh3_64_intdigest(found[x:y].tobytes(), SEED) if y > x else 0 for x, y in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)], np.uint64)
                met = pa.FixedSizeListArray.from_arrays(pa.array(shingle_cells(found, begin, prints).ravel()), CELLS).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(prints[:, i].copy()) for i in range(4)), pa.array(whole.view(np.int64)), met], ["id", *WIDE, "whole", "cells"])

    prints = df.mapInArrow(made, "id bigint, a bigint, b bigint, c bigint, d bigint, whole bigint, cells array<bigint>")
    return prints if few or wanted is None else prints.join(wanted, "id", "left_semi")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, block: int = 2048, shingles_in_block: int = 500_000, prints: DataFrame | None = None, radius: int = 3
) -> DataFrame:
    """(id, component), a row for each identifier: the smallest one reachable over texts whose word shingles have that Jaccard similarity or more. prints: the rows of wide_prints() that are to be compared, where they are known; only these texts take part.

    Fingerprints only find the candidates. The first of a wide fingerprint's numbers is a fingerprint of 64 bits itself: the grid of slabs over its segments' counts, the Manhattan bound and the distance connect all texts within ``radius`` bits of it,
    none left to chance. At a similarity of 0.8, though, 256-bit fingerprints differ in some 39 bits (two unrelated ones in 128, give or take 8), for which such a grid would have too many cells. So beside the grid bits are sampled, each sample of them
    together with the text's least shingles by some orders, so that texts which have nothing in common don't meet however large the table is; pairs that share a cell are held against the Manhattan bound of all four numbers and then against
    reach_of() bits. What either finds is joined into loose components. Inside a loose component every pair of texts is then compared by its shingles, whether it shared a cell or not, and only pairs
    of the similarity count. So no link is wrong, and one is missed only if nothing ties its ends loosely (at 0.8 itself 1 in 200 pairs share none of the cells, fewer above).

    Texts with the same shingles and fingerprint are one from the start, as are all texts without words, null ones among them: they tie each other and nothing else. Rows that share an identifier are one node, whatever their
    texts. Rows with a null identifier are left out. An empty table gives no rows; other columns are not looked at. Where prints have no cells, those of the texts are taken.
    """
    df = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull())
    if prints is not None and "cells" not in prints.columns:
        prints = prints.join(wide_prints(docs, id_col, text_col, words).select("id", "cells").distinct(), "id")
    prints = cut(wide_prints(docs, id_col, text_col, words) if prints is None else prints)
    # texts with the same shingles have the same cells
    roots = cut(prints.groupBy(*WIDE, "whole", "cells").agg(F.min("id").alias("root"), F.max("id").alias("last"), F.count("*").alias("n")))
    worded = roots.where(F.col("whole") != 0)
    placed = worded.select(F.explode("cells").alias("cell"), *WIDE, "root")
    # many texts may have one fingerprint, so the root deals them into blocks
    exact = links(worded.select(F.col("a").alias("fp"), "root"), radius, block, ["root"])
    loose = cut(components(exact.unionByName(_met(placed, list(WIDE), reach_of(similarity), block, ["root"]))).distinct())
    again = roots.where(F.col("root") < F.col("last")).select(*WIDE, "whole", "root", "n")
    same = looked_up(prints, again, [*WIDE, "whole"], prints.count()).select(F.col("id").alias("u"), F.col("root").alias("v"))
    found = components(same.unionByName(_verified(df, loose, words, similarity, shingles_in_block)))
    ids = prints.select("id").distinct()
    return ids.join(found.distinct(), ids["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("component"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
