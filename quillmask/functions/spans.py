"""Finding values in text, and merging and masking what is found, all within one row: no join, no shuffle.

A span is struct<s:int,e:int>, half open, in code points. What walks along a text is an Arrow function over a batch of rows, linear in the text and in what is found: as a fold over an array, Spark copies the
array at every step, and it finds a position in a text by counting from the text's beginning.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .automaton import masked_in_turn, starts_of, starts_of_each
from .text import BOUNDARY, WS, variants

SPANS = "array<struct<s:int,e:int>>"
#: Bytes of a batch that are taken out of Arrow at once.
PORTION = 1 << 20
_INT = IntegerType()
_SPAN = StructType().add("s", _INT).add("e", _INT)
_HIT = StructType().add("s", _INT).add("e", _INT).add("good", BooleanType()).add("around", StringType())
_CODES = re.compile(r"\\x\{([0-9A-F]+)\}")
_WS = _CODES.sub(lambda m: f"\\u{int(m[1], 16):04x}", WS)
_WHITE, _NO_WS, _EDGE = re.compile(f"[{_WS}]+"), re.compile(f"[^{_WS}]"), re.compile(f"[{_WS}{BOUNDARY}]")


def portions(batch: pa.RecordBatch, at_most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """The batch in slices of so many bytes at most, or of a single row. As objects a batch of 10,000 texts and what is found in them would take many times its bytes, in each worker."""
    if batch.num_rows <= 1 or batch.nbytes <= at_most:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from portions(batch.slice(0, half), at_most)
        yield from portions(batch.slice(half), at_most)


def by_portions(f: Callable[..., pa.Array]) -> Callable[..., pa.Array]:
    """f over Arrow columns, computed portion by portion."""

    @wraps(f)
    def whole(*columns: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([*columns], [str(i) for i in range(len(columns))])
        return pa.concat_arrays([f(*part.columns) for part in portions(batch)])

    return whole


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda, which would else compute it for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one, by start."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def strip_white(text: str) -> str:
    """The text without its white space."""
    return _WHITE.sub("", text)


def masked(text: str) -> str:
    """X for every character that isn't white space."""
    return _NO_WS.sub("X", text)


def _lists(rows: list[list | None], values: pa.Array) -> pa.Array:
    """values dealt to rows by their lengths."""
    ends = np.concatenate([[0], np.cumsum([len(r) if r is not None else 0 for r in rows], dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in rows), False])), values)


def _spans(rows: list[list[tuple[int, int]] | None]) -> pa.Array:
    flat = np.array([x for r in rows if r for x in r], np.int32).reshape(-1, 2)
    return _lists(rows, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["s", "e"]))


def span_lists(column: pa.Array) -> list[list[tuple[int, int]] | None]:
    """The rows of an array of spans."""
    flat = column.flatten()
    s, e = flat.field("s").to_pylist(), flat.field("e").to_pylist()
    ends = [0, *accumulate(n or 0 for n in column.value_lengths().to_pylist())]
    return [None if not ok else list(zip(s[a:b], e[a:b], strict=True)) for ok, a, b in zip(column.is_valid().to_pylist(), ends, ends[1:], strict=False)]


def hits_of_each(text: str | None, values: list[str | None] | None) -> list[list[tuple[int, int]]]:
    """The spans of each of the values in the text."""
    own = [v or "" for v in values or ()]
    return [[(at, at + len(v)) for at in starts] for v, starts in zip(own, starts_of_each(text or "", own), strict=True)]


@F.arrow_udf(ArrayType(_SPAN))
@by_portions
def find_all(text: pa.Array, value: pa.Array) -> pa.Array:
    """Every occurrence from left to right, none overlapping another; none of an empty value or in a null text."""
    return _spans([[(at, at + len(v)) for at in starts_of(t or "", v or "")] for t, v in zip(text.to_pylist(), value.to_pylist(), strict=True)])


def hits_around(texts: list[str], values: list[list[str]], extra: int | None = None, only_bad: bool = False) -> pa.Array:
    """For each text and value an array of the occurrences as struct<s, e, good, around>, as located() has them."""

    def one(text: str, value: str, starts: list[int]) -> Iterator[tuple]:
        n, size = len(value), len(text)
        for s in starts:
            e = s + n
            good = (s == 0 or bool(_EDGE.match(text, s - 1))) and (e == size or bool(_EDGE.match(text, e)))
            yield s, e, good, None if extra is None or (good and only_bad) else text[max(0, s - extra) : e + extra]

    rows = [[list(one(t, v, starts)) for v, starts in zip(own, starts_of_each(t, own), strict=True)] for t, own in zip(texts, values, strict=True)]
    lists = [hits for row in rows for hits in row]
    s, e, good, around = zip(*(h for hits in lists for h in hits), strict=True) if any(lists) else ((), (), (), ())
    hits = pa.StructArray.from_arrays([pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array(good, pa.bool_()), pa.array(around, pa.string())], ["s", "e", "good", "around"])
    return _lists(rows, _lists(lists, hits))


@lru_cache(maxsize=16)
def located(extra: int | None = None, only_bad: bool = False) -> Callable[[Column, Column], Column]:
    """A function of a text and an array of values: for each value an array of its occurrences as struct<s, e, good, around>. good: whether token boundaries stand at both ends. around: the text from extra characters
    before to extra after, null without extra, and with only_bad also where an occurrence is good."""

    @F.arrow_udf(ArrayType(ArrayType(_HIT)))
    @by_portions
    def found(text: pa.Array, values: pa.Array) -> pa.Array:
        return hits_around([t or "" for t in text.to_pylist()], [[v or "" for v in own or ()] for own in values.to_pylist()], extra, only_bad)

    return found


@F.arrow_udf(ArrayType(ArrayType(_SPAN)))
@by_portions
def _find_each(text: pa.Array, values: pa.Array) -> pa.Array:
    rows = [hits_of_each(t, own) for t, own in zip(text.to_pylist(), values.to_pylist(), strict=True)]
    return _lists(rows, _spans([hits for row in rows for hits in row]))


def find_variants(text: Column, value: Column) -> Column:
    """The occurrences of the value and of its white space variants, distinct, by start and end. They may overlap."""
    return F.array_sort(F.array_distinct(F.flatten(_find_each(text, variants(value)))))


@F.arrow_udf(ArrayType(_SPAN))
@by_portions
def marked(text: pa.Array, values: pa.Array) -> pa.Array:
    """Where any of the values stands, overlapping and touching places as one."""
    return _spans([merged([hit for hits in hits_of_each(t, [*dict.fromkeys(own or ())]) for hit in hits]) for t, own in zip(text.to_pylist(), values.to_pylist(), strict=True)])


@F.arrow_udf(ArrayType(_SPAN))
@by_portions
def merge_spans(spans: pa.Array) -> pa.Array:
    """Overlapping and touching spans as one, by start."""
    return _spans([None if r is None else merged(r) for r in span_lists(spans)])


@F.arrow_udf(StringType())
@by_portions
def mask_spans(text: pa.Array, spans: pa.Array) -> pa.Array:
    """The text with what lies in the spans masked; spans are disjoint and in order."""

    def one(t: str | None, own: list[tuple[int, int]] | None) -> str | None:
        if t is None or not own:
            return t
        out, at = [], 0
        for s, e in own:
            out += [t[at:s], masked(t[s:e])]
            at = e
        return "".join([*out, t[at:]])

    return pa.array([one(t, own) for t, own in zip(text.to_pylist(), span_lists(spans), strict=True)], pa.string())


def masked_where(text: str, values: list[str]) -> str:
    """The text masked where any of the values stands."""
    out, at = [], 0
    for s, e in merged([hit for hits in hits_of_each(text, [*dict.fromkeys(values)]) for hit in hits]):
        out += [text[at:s], masked(text[s:e])]
        at = e
    return "".join([*out, text[at:]])


def with_cut_out(df: DataFrame, text_col: str, spans_col: str, to: str) -> DataFrame:
    """df with a column ``to`` in place of spans_col: what lies in each of the spans, in their order. A step of its own, as Spark doesn't chain functions whose arguments are made of another one's results inside lambdas."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            at = batch.schema.get_field_index(spans_col)
            rows = [[(t or "")[s:e] for s, e in own or ()] for t, own in zip(batch.column(text_col).to_pylist(), span_lists(batch.column(at)), strict=True)]
            columns, names = [*batch.columns], [*batch.schema.names]
            columns[at], names[at] = _lists(rows, pa.array([x for r in rows for x in r], pa.string())), to
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([StructField(to, ArrayType(StringType())) if f.name == spans_col else f for f in df.schema.fields])
    return df.mapInArrow(cut, schema)


def mask_each(text: Column, values: Column) -> Column:
    """Each value in turn replaced by its mask wherever it stands in what the ones before left."""
    return _mask_each(text, values)


def masked_each(text: str, values: list[str]) -> str:
    return masked_in_turn(text, [v for v in values if v], "X", lambda c: not _NO_WS.match(c))


@F.arrow_udf(StringType())
@by_portions
def _mask_each(text: pa.Array, values: pa.Array) -> pa.Array:
    return pa.array([None if t is None else masked_each(t, own or []) for t, own in zip(text.to_pylist(), values.to_pylist(), strict=True)], pa.string())


@F.arrow_udf(ArrayType(_INT))
def running_total(numbers: pa.Array) -> pa.Array:
    """The sums of an array's elements up to each one."""
    flat, size = numbers.flatten(), numbers.value_lengths()
    if numbers.null_count or flat.null_count:
        return pa.array([None if r is None else np.cumsum(r, dtype=np.int32) for r in numbers.to_pylist()], pa.list_(pa.int32()))
    # one sum over all rows, less what stands before each of them
    ends, size = np.concatenate([[0], np.cumsum(size.to_numpy(), dtype=np.int64)]), size.to_numpy()
    total = np.concatenate([[0], np.cumsum(flat.to_numpy(), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((total[1:] - np.repeat(total[ends[:-1]], size)).astype(np.int32)))


@F.arrow_udf(ArrayType(_INT))
def greedy(starts: pa.Array, width: pa.Array) -> pa.Array:
    """Of ascending starts, those at least width after the last one taken."""

    def one(own: list[int], least: int) -> Iterator[int]:
        at = 0
        while at < len(own):
            yield own[at]
            at = bisect_right(own, own[at] + least - 1)

    return pa.array([None if r is None else list(one(r, max(1, w or 1))) for r, w in zip(starts.to_pylist(), width.to_pylist(), strict=True)], pa.list_(pa.int32()))
