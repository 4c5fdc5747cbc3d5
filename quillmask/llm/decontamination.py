"""Benchmark decontamination by a broadcast set of the test items' word n-grams.

The items' texts go to the tasks as one buffer with the bounds of its words; their windows as sorted 64-bit hashes, each with a place in the buffer and the items that have it. Word hashes of many training texts are rolled into window hashes at once; a
table of bits rules out nearly all of them, the others are looked up, and every hit is compared word by word, byte by byte. The set is broadcast only up to ``max_words`` item words, which is checked by counting first. A larger benchmark is taken in blocks
of that size: each block but the last leaves only the findings of the texts that have any, and the last pass adds them up. An item longer than an eighth of a block is taken in pieces that overlap by a window less a word, so no item is too long for a block.

Null texts have no words and no hits. Items that are null or without words have no windows; repeated items count once by identifier.
A null item identifier takes no part. Empty tables on either side give no hits. Rows that repeat an identifier, also a null one, are answered each; very long texts are read whole; other columns stay, but for those named like a
finding, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table
from .slices import Texts, byte_table, differing, mixed, polynomials, portions

WINDOW = 10
#: Item words in a broadcast set: some 90 bytes each, measured, so 180 MB at the most.
MAX_WORDS = 2_000_000
WORD = byte_table((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
#: Bytes of text that are scanned at once.
PORTION = 1 << 20

#: What stands between words, and words.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
A_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

FINDINGS = ("n_words", "hits", "items")
FOUND = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<{item}>"


class Words:
    """The words of texts, A-Z lower-cased: their bytes, bounds, texts and hashes."""

    def __init__(self, texts: Texts):
        self.bytes = LOWER[texts.bytes]
        self.start, self.end, self.text = Texts(self.bytes, texts.ends).bounds(WORD)
        self.value = mixed(polynomials(self.bytes, self.start, self.end) ^ mixed(self.end - self.start))

    def rolled(self, n: int) -> np.ndarray:
        """The hashes of the runs of n words that begin at each word, over the ends of texts, too."""
        h = self.value
        for k in range(1, n):
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + self.value[k:]
        return mixed(h)

    def run(self, at: int, n: int) -> tuple[bytes, ...]:
        return tuple(self.bytes[self.start[i] : self.end[i]].tobytes() for i in range(at, at + n))

    def unlike(self, at: np.ndarray, other: Words, places: np.ndarray, n: int) -> np.ndarray:
        """Which runs of n words at the words ``at`` differ from those of other at places."""
        out = np.zeros(len(at), bool)
        for k in range(n):
            size = self.end[at + k] - self.start[at + k]
            out |= size != other.end[places + k] - other.start[places + k]
            left = np.flatnonzero(~out)
            out[left[differing(self.bytes, self.start[at[left] + k], other.start[places[left] + k], size[left], other.bytes)]] = True
        return out


class Windows:
    """The items' windows by length: hashes in order, each with the place of its first word, and the items that have it; and a table of bits over the hashes' upper parts."""

    def __init__(self, items: list[tuple], window: int):
        texts = [text or b"" for _, text in items]
        self.items = [item for item, _ in items]
        self.words = Words(Texts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])))
        del texts
        of = self.words.text
        count = np.bincount(of, minlength=len(items))
        # windows of an item are as long as all others, or as the item, if that is shorter
        length = np.minimum(count, window)
        left = (np.cumsum(count) - 1)[of] - np.arange(len(of)) + 1
        self.lengths: dict[int, tuple] = {}
        for n in np.unique(length[length > 0]).tolist():
            at = np.flatnonzero((length[of] == n) & (left >= n))
            hashes = self.words.rolled(n)[at]
            order = np.lexsort((of[at], hashes))
            at, hashes = at[order], hashes[order]
            new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
            group = np.cumsum(new) - 1
            mixed_up = np.unique(group[self.words.unlike(at, self.words, at[np.flatnonzero(new)][group], n)]) if len(at) else group
            if len(mixed_up):  # windows whose hashes collide are told apart by their words
                some = np.flatnonzero(np.isin(group, mixed_up))
                names = {w: i for i, w in enumerate(sorted({self.words.run(int(p), n) for p in at[some]}))}
                kind = np.zeros(len(at), np.int64)
                kind[some] = [names[self.words.run(int(p), n)] for p in at[some]]
                order = np.lexsort((of[at], kind, hashes))
                at, hashes, kind = at[order], hashes[order], kind[order]
                new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (kind[1:] != kind[:-1])])
            begin = np.flatnonzero(new)
            once = new | np.concatenate([[True], of[at][1:] != of[at][:-1]])
            holders, bounds = of[at][once].astype(np.int32), np.concatenate([np.flatnonzero(new[once]), [int(once.sum())]]).astype(np.int32)
            own = hashes[begin]
            self.lengths[n] = (own, at[begin].astype(np.int32), bounds, holders, int(np.unique(own, return_counts=True)[1].max()))
        # eight bits for each window, so that an eighth at most of what isn't one passes
        self.shift = np.uint64(64 - max(3, int(8 * sum(len(x[0]) for x in self.lengths.values())).bit_length()))
        self.bits = {n: np.zeros(1 << (64 - int(self.shift)), bool) for n in self.lengths}
        for n, (hashes, *_) in self.lengths.items():
            self.bits[n][hashes >> self.shift] = True

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A mask of the words inside occurrences, and the pairs of texts and items (by number) that occur in them."""
        inside, text, item = np.zeros(len(words.start) + 1, np.int64), [], []
        for n, (hashes, places, bounds, holders, most) in self.lengths.items():
            if len(words.start) < n:
                continue
            h = words.rolled(n)
            may = np.flatnonzero(self.bits[n][h >> self.shift])
            may = may[words.text[may] == words.text[may + n - 1]]
            first = np.searchsorted(hashes, h[may])
            for k in range(most):  # windows of one hash: one, but for collisions
                near = np.minimum(first + k, len(hashes) - 1)
                hit = np.flatnonzero((hashes[near] == h[may]) & (first + k < len(hashes)))
                hit = hit[~words.unlike(may[hit], self.words, places[near[hit]], n)]
                at, near = may[hit], near[hit]
                inside[at] += 1
                inside[at + n] -= 1
                size = bounds[near + 1] - bounds[near]
                text.append(np.repeat(words.text[at], size))
                item.append(holders[np.repeat(bounds[near] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))])
        pairs = np.unique(np.stack([np.concatenate(text), np.concatenate(item)], 1), axis=0) if text else np.zeros((0, 2), np.int64)
        return np.cumsum(inside[:-1]) > 0, pairs[:, 0], pairs[:, 1]


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(df: DataFrame, text_col: str, windows: Windows, item_type: str) -> DataFrame:
    """df with the findings of this set of windows, and with those that earlier passes left in columns of their names."""
    held = df.sparkSession.sparkContext.broadcast(windows)
    others = [c for c in df.columns if c not in FINDINGS]
    again = "hits" in df.columns

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours = held.value
        for batch in batches:
            for a, b, texts in portions(batch.column(text_col), PORTION):
                words = Words(texts)
                inside, of, item = ours.find(words)
                first = np.searchsorted(words.text, np.arange(b - a + 1))
                spans: list[list] = [[] for _ in range(b - a)]
                own: list[set] = [set() for _ in range(b - a)]
                for i, k in zip(of.tolist(), item.tolist(), strict=True):
                    own[i].add(ours.items[k])
                before = batch.slice(a, b - a).select(["hits", "items"]).to_pylist() if again else ()
                for i, x in enumerate(before):
                    own[i].update(x["items"] or ())
                    for hit in x["hits"] or ():
                        inside[first[i] + hit["start"] : first[i] + hit["end"]] = True
                joined = inside[1:] & inside[:-1] & (words.text[1:] == words.text[:-1])
                turns, ends = inside.copy(), inside.copy()
                turns[1:] &= ~joined
                ends[:-1] &= ~joined
                for s, e in zip(np.flatnonzero(turns).tolist(), (np.flatnonzero(ends) + 1).tolist(), strict=True):
                    i = int(words.text[s])
                    spans[i].append({"start": s - int(first[i]), "end": e - int(first[i])})
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(a, b - a) for c in others), pa.array(np.diff(first), pa.int64()), pa.array(spans, SPAN),
                        pa.array([sorted(x) for x in own], pa.list_(pa.string() if item_type == "string" else pa.int64())),
                    ],
                    [*others, *FINDINGS],
                )

    schema = T.StructType([*(df.schema[c] for c in others), *T.StructType.fromDDL(FOUND.format(item=item_type)).fields])
    return df.mapInArrow(scanned, schema)


def find_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_words: int = MAX_WORDS) -> DataFrame:
    """docs with n_words, hits (word positions, half open, merged) and items (identifiers whose windows occur, long or string); columns of these names are replaced."""
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull())
    item_type = "string" if items.schema["item"].dataType.simpleString() == "string" else "bigint"
    size = items.select(F.sum(F.coalesce(F.size(F.split("text", NO_WORD)), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size // max_words))
    docs = docs.drop(*FINDINGS)
    if blocks == 1:
        return _scan(docs, text_col, _windows(items, window), item_type)
    blocks, items = 2 * blocks, _pieces(items, window, max(2 * window, max_words // 8))
    part = lambda b: _windows(items.where(F.pmod(F.xxhash64("item", "piece"), F.lit(blocks)) == b), window)
    # the texts, written once with a number for each, so that passes can name them
    numbered = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for b in range(blocks - 1):
        own = cut(_scan(numbered.select("_row", F.col(f"`{text_col}`").alias(text_col)), text_col, part(b), item_type).where(F.size("hits") > 0).select("_row", "hits", "items"))
        found = own if found is None else found.unionByName(own)
    added = cut(found.groupBy("_row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")))
    # a few hundred thousand findings are sent to every task; more meet the texts in a shuffle
    known = numbered.join(F.broadcast(added) if added.count() <= 200_000 else added, "_row", "left")
    return _scan(known.drop("_row"), text_col, part(blocks - 1), item_type)


def _windows(items: DataFrame, window: int) -> Windows:
    return Windows([(r.item, r.text.encode() if r.text else None) for r in items.select("item", "text").toLocalIterator()], window)


def _pieces(items: DataFrame, window: int, words: int) -> DataFrame:
    """(item, text, piece): items of more than so many words in overlapping pieces, which have the same windows."""
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), NO_WORD), lambda w: w != "")
    step = words - window + 1
    starts = F.when(F.size("words") > words, F.sequence(F.lit(1), F.size("words") - (window - 1), F.lit(step))).otherwise(F.array(F.lit(1)))
    cut_up = items.select("item", parts.alias("words")).select("item", "words", F.posexplode_outer(starts).alias("piece", "at"))
    return cut_up.select("item", F.array_join(F.slice("words", F.col("at"), F.lit(words)), " ").alias("text"), "piece")


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, hits: pa.Array) -> pa.Array:
    def one(t: str | None, spans: list | None) -> str | None:
        if t is None or not spans:
            return t
        wanted = [(h["start"], h["end"] - 1) for h in spans]
        out, at, k, first = [], 0, 0, 0
        for n, m in enumerate(A_WORD.finditer(t)):
            if n == wanted[k][0]:
                first = m.start()
            if n == wanted[k][1]:
                out.append(t[at:first])
                at, k = m.end(), k + 1
                if k == len(wanted):
                    break
        return "".join([*out, t[at:]])

    return pa.array([one(t, h) for t, h in zip(text.to_pylist(), hits.to_pylist(), strict=True)], pa.string())


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of find_contamination with each hit, from its first word to its last, cut out of the text, which is read once."""
    return found.withColumn(text_col, F.when(F.size("hits") == 0, F.col(text_col)).otherwise(_without(F.col(text_col), F.col("hits"))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: a + h.end - h.start)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated")
    )


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bp AS (
  SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS g FROM bp
), ns AS (
  SELECT DISTINCT n FROM bw
), dp AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n
), hits AS (
  SELECT dp.doc_id, dp.p, dp.n, bw.item_id FROM dp JOIN bw ON dp.n = bw.n AND array_to_string(list_slice(dp.w, dp.p, dp.p + dp.n - 1), ' ') = bw.g
), hit_words AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
