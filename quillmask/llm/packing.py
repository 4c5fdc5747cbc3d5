"""Packing of tokenised documents into windows by the sum-of-squares rule.

Each document is its token ids and one closing id. Whole windows are cut off first; the rest, shorter than a window, is placed into the
fill level that makes the sum over levels of (number of windows partly filled to that level) squared smallest. The counts stand in an
array with a place for each level, so a placement is a few vector operations whatever the number of open windows.

Packing is per input partition, in one pass without a shuffle: a partition's rows never meet another's. At most ``max_open`` windows are
open. Each one beyond is a surplus that is closed alone: pieces of the emptiest windows are cut to fill the fullest, all others stay in the level array and the rule goes on deciding. At a
partition's end all are closed that way, which leaves one window partly filled; it is cut at the binary digits of its length (``tail="binary"``), so that every sequence is a whole window or
a power of two, or left to be padded (``tail="pad"``).

Null and empty texts are documents of the closing id alone, as are texts of null identifiers, which come back with a null one. Repeated rows are packed each; of levels that are equally good the
fullest is taken, and of windows at one level the latest. An empty table gives no pieces. Very long texts, and runs of white space of any length, are encoded whole. Other columns are not returned.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, table

CLOSING = 1
#: White space in a row from which on the faster library isn't used.
SAFE_RUN = 10_000
PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Callable[[bytes], np.ndarray]:
    """Text to ids, for a byte-level BPE file of the tokenizers library.

    With the same vocabulary as ranks beside it (.tiktoken), texts of the scripts on which both libraries split alike are encoded from the ranks, which is several times
    faster and gives the same ids; all other texts, those that hold an added token of the vocabulary, and those with a run of SAFE_RUN or more blanks, for which the other library's stack is too small, go through tokenizers itself.
    """
    import os
    import re

    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    exact = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    ranks = vocabulary.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda data: exact(data.decode())
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as file:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    # the vocabulary's added tokens, as <|endoftext|>, are ids of their own wherever they stand in a text
    added = "".join("|" + re.escape(token.content) for token in whole.get_added_tokens_decoder().values())
    other = re.compile("[^\t\n\r -~¡-ɏ‐-‧€]|(?<![\t\n\r ])[\t\n\r ]{%d}%s" % (SAFE_RUN, added))

    def encode(data: bytes) -> np.ndarray:
        text = data.decode()
        if other.search(text):
            return exact(text)
        return np.array(fast.encode_ordinary(text), "<u4")

    return encode


class Packer:
    """The open windows of one partition; finished ones are handed out as (document, start, ids, document's tokens, sequence, offset)."""

    def __init__(self, window: int, max_open: int, first_sequence: int):
        self.window, self.max_open, self.next = window, max_open, first_sequence
        self.count = np.zeros(window + 1, np.int64)
        self.at: list[list] = [[] for _ in range(window + 1)]
        self.open = 0
        # for measurements: rests placed by the rule, and windows closed because too many were open
        self.placed = self.surplus = 0
        self.out: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def level(self, size: int) -> int:
        """The level, 0 for a new window, at which adding size makes the sum of squares least; ties go to the fullest."""
        n, top = self.count, self.window - size
        # moving a window from level h to h + size changes the sum by 2 n[h + size] + 1 - 2 n[h] + 1; full windows and level 0 don't count
        cost = 2 * n[size : self.window + 1] + 1
        cost[top] = 0
        cost[1:] -= 2 * n[1 : top + 1] - 1
        cost[1:][n[1 : top + 1] == 0] = np.iinfo(np.int64).max
        return top - int(np.argmin(cost[::-1]))

    def add(self, doc: int, ids: np.ndarray) -> None:
        total, w = len(ids), self.window
        whole = total - total % w
        for s in range(0, whole, w):
            self.emit([(doc, s, ids[s : s + w], total)])
        if whole == total:
            return
        size = total - whole
        h = self.level(size)
        pieces = self.pull(h) if h else []
        pieces.append((doc, whole, ids[whole:].copy() if whole else ids, total))
        self.placed += 1
        if h + size == w:
            self.emit(pieces)
            return
        self.put(h + size, pieces)
        while self.open > self.max_open:
            self.surplus += 1
            self.close_one()

    def put(self, level: int, pieces: list[tuple]) -> None:
        self.at[level].append(pieces)
        self.count[level] += 1
        self.open += 1

    def pull(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        self.open -= 1
        return self.at[level].pop()

    def close_one(self) -> None:
        """Fill one of the fullest windows with pieces cut from the emptiest; what is left of the last one cut stays open."""
        held = np.flatnonzero(self.count)
        high = int(held[-1])
        pieces, room = self.pull(high), self.window - high
        while room and self.open:
            low = int(np.flatnonzero(self.count)[0])
            spare = self.pull(low)
            while room and spare:
                doc, start, ids, total = spare.pop()
                pieces.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    spare.append((doc, start + room, ids[room:], total))
                low -= len(pieces[-1][2])
                room -= len(pieces[-1][2])
            if spare:
                self.put(low, spare)
        if room:
            self.put(self.window - room, pieces)
        else:
            self.emit(pieces)

    def end(self, tail: str) -> None:
        while self.open > 1:
            self.close_one()
        pieces = next((self.pull(int(h)) for h in np.flatnonzero(self.count)), [])
        left = sum(len(x[2]) for x in pieces)
        if tail == "pad" and pieces:
            self.emit(pieces)
            return
        pieces = pieces[::-1]
        while left:
            room, part = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                doc, start, ids, total = pieces.pop()
                part.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                room -= len(part[-1][2])
            self.emit(part)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, max_open: int = 4096, tail: str = "binary", with_ids: bool = False) -> DataFrame:
    """One row for each piece, in the order of its sequence; with_ids adds the ids themselves. sequence_id holds the partition in its upper 31 bits."""
    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    names = ["id", *(x.split()[0] for x in PIECES.split(", ")), *(["ids"] if with_ids else [])]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        packer = Packer(window, max_open, TaskContext.get().partitionId() << 32)
        closing = np.array([CLOSING], "<u4")
        id_type = None

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in rows], id_type)] + [
                pa.array(x, pa.int64())
                for x in ([r[1] for r in rows], [len(r[2]) for r in rows], [zlib.crc32(np.ascontiguousarray(r[2]).tobytes()) for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows])
            ]
            return pa.RecordBatch.from_arrays(columns + ([pa.array([r[2].astype(np.int64) for r in rows], pa.list_(pa.int64()))] if with_ids else []), names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                packer.add(doc, np.concatenate([encode(text), closing]) if text else closing)
                if len(packer.out) >= 2000:
                    yield batch_of(packer.take())
        packer.end(tail)
        if packer.out:
            yield batch_of(packer.take())

    return df.mapInArrow(packed, f"id {kind}, {PIECES}{', ids array<bigint>' * with_ids}").withColumnRenamed("id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())
