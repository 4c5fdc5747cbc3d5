"""Places before and after Unicode normalisation (NFKC): a monotone map between a text and its normalised form, so that what was found in the one can be masked in the other.

Normalisation works on stretches that begin with a character which never joins what stands before it. Stretch by stretch, a span of the normalised text is that of the characters which it came from; a span that begins or ends within a
stretch takes all of it, as of a ligature there is no half.
"""

from __future__ import annotations

import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .spans import masked, merged, portions, span_lists


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that may be joined to one before them although they aren't marks: second parts of canonical compositions, and the vowels and finals of Hangul."""
    parts = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    seconds = {chr(int(x[1], 16)) for x in parts if len(x) == 2 and not x[0].startswith("<")}
    return frozenset(c for c in seconds if not unicodedata.combining(c)) | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}


@lru_cache(maxsize=4096)
def begins(c: str) -> bool:
    """Whether a stretch begins with the character."""
    first = unicodedata.normalize("NFKD", c)[0]
    return not unicodedata.combining(first) and first not in joining()


class Places:
    """The stretches of a text, as it is and normalised, by where they begin."""

    def __init__(self, text: str):
        if text.isascii():
            cuts = None
        else:
            cuts = [0, *(i for i, c in enumerate(text) if i and begins(c)), len(text)] if text else [0]
        self.same = cuts is None or unicodedata.is_normalized("NFKC", text)
        if not self.same:
            self.before = cuts
            self.after = [0, *accumulate(len(unicodedata.normalize("NFKC", text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False))]

    def original(self, s: int, e: int) -> tuple[int, int]:
        """The span of the text as it is that a span of the normalised text came from."""
        if self.same or s < 0:
            return s, e
        return self.before[bisect_right(self.after, s) - 1], self.before[bisect_left(self.after, e)]


def with_masked_originals(df: DataFrame, text_col: str, spans_col: str, to: str) -> DataFrame:
    """df with a column ``to`` in place of spans_col, which holds spans of the normalised text (those at -1 have no place): the text, as it came, with the characters masked that the spans came from."""

    def one(text: str | None, spans: list[tuple[int, int]] | None) -> str | None:
        if not text or not spans:
            return text
        places, out, at = Places(text), [], 0
        for s, e in merged([places.original(s, e) for s, e in spans if s >= 0]):
            out += [text[at:s], masked(text[s:e])]
            at = e
        return "".join([*out, text[at:]])

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            at = batch.schema.get_field_index(spans_col)
            columns, names = [*batch.columns], [*batch.schema.names]
            columns[at], names[at] = pa.array([one(t, own) for t, own in zip(batch.column(text_col).to_pylist(), span_lists(batch.column(at)), strict=True)], pa.string()), to
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(mask, StructType([StructField(to, StringType()) if f.name == spans_col else f for f in df.schema.fields]))
