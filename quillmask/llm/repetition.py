"""Quality rules on repetition: what share of a text's characters stands inside word sequences, and lines, that it holds more than once.

Texts are taken together, some megabytes at once. Words get numbers that are equal for equal bytes only. A polynomial hash rolls over the numbers, from sequences of n - 1 words to sequences of n, for all texts in one numpy
operation a length; sorting brings equal hashes of a text together, and sequences count as repeated only after their words' numbers have been compared. Characters are code points inside words; those of a word count once for each length, in however many
repeated sequences it stands. All occurrences of a repeated sequence count, the first one too; of a repeated line all but the first.

A text fails if its characters inside repeated sequences of n words are more than SEQUENCES[n] of all, for any n, or those in repeated lines more than LINES. The longer the sequence, the less of it may be repeated.

Each text is judged by itself, in one pass without a shuffle; memory grows with the longest text only. Words are what stands between blanks (space, tab and the line breaks of ASCII), lines what stands between line feeds, and a line without a word
is never counted. A null text has no words, as an empty one; both fail the rule on the number of words. Repeated rows are answered each, an empty table gives no rows. Other columns stay, but for those of the names of the results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .slices import Texts, byte_table, identify, mixed, polynomials, portions

#: The largest share of a text's characters inside repeated sequences of so many words, in hundredths.
SEQUENCES = {5: 32, 6: 31, 7: 30, 8: 29, 9: 28, 10: 27}
#: The same for repeated lines.
LINES = 30
#: Words in a window of the basic rule.
WINDOW = 8
WORD, LINE = byte_table((0x20, 0x20), (0x09, 0x0D)), byte_table((0x0A, 0x0A))
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
#: Bytes of text that are measured at once.
PORTION = 2 << 20
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}_chars" for n in SEQUENCES)]


def rolling(words: np.ndarray, lengths: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the lengths, rising, the hashes of the sequences that start at each word."""
    values = mixed(words)
    h = values
    for n in range(1, max(lengths) + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + values[n - 1 :]
        if n in lengths:
            yield n, h


def repeated(words: np.ndarray, text: np.ndarray, n: int, hashes: np.ndarray) -> np.ndarray:
    """Which words stand in a sequence of n that its text holds more than once."""
    at = np.flatnonzero(text[: len(hashes)] == text[n - 1 :]) if len(hashes) else np.zeros(0, np.int64)
    keys = hashes[at] + mixed(~text[at].astype(np.uint64))
    order = np.argsort(keys)
    keys, at = keys[order], at[order]
    same = keys[1:] == keys[:-1]
    one, other = at[:-1][same], at[1:][same]
    equal = text[one] == text[other]
    for k in range(n):
        equal &= words[one + k] == words[other + k]
    if equal.all():
        found = np.concatenate([one, other])
    else:  # hashes that collided: what has such a hash is compared by its words
        of_run = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        rows = at[of_run]
        _, number, times = np.unique(np.stack([text[rows], *(words[rows + k] for k in range(n))], 1), axis=0, return_inverse=True, return_counts=True)
        found = rows[times[number.reshape(-1)] > 1]
    deep = np.zeros(len(words) + 1, np.int64)
    found = np.unique(found)
    deep[found] += 1
    deep[found + n] -= 1
    return np.cumsum(deep[:-1]) > 0


def measures(texts: Texts) -> list[np.ndarray]:
    """The columns of MEASURES."""
    rows = len(texts.ends) - 1
    total = lambda of, weights: np.bincount(of, weights, rows).astype(np.int64) if len(of) else np.zeros(rows, np.int64)
    starts, ends, text = texts.bounds(WORD)
    inner = np.flatnonzero((texts.bytes & 0xC0) == 0x80)
    chars = ends - starts - (np.searchsorted(inner, ends) - np.searchsorted(inner, starts))
    words, _ = identify(texts.bytes, starts, ends, polynomials)
    line_from, line_to, line_text = texts.bounds(LINE)
    first_word, after = np.searchsorted(starts, line_from), np.searchsorted(starts, line_to)
    with_word = after > first_word
    line_from, line_to, line_text, first_word, after = (x[with_word] for x in (line_from, line_to, line_text, first_word, after))
    lines, _ = identify(texts.bytes, line_from, line_to, polynomials)
    again = np.ones(len(lines), bool)
    again[np.unique(np.stack([line_text, lines], 1), axis=0, return_index=True)[1]] = False
    chars_to = np.concatenate([[0], np.cumsum(chars)])
    out = {
        "n_words": total(text, None),
        "word_chars": total(text, chars),
        "n_symbols": texts.count(SYMBOLS[texts.bytes]),
        "n_dup_lines": total(line_text, again),
        "dup_line_chars": total(line_text, (chars_to[after] - chars_to[first_word]) * again),
    }
    for n, hashes in rolling(words, sorted({WINDOW, *SEQUENCES})):
        inside = repeated(words, text, n, hashes)
        if n in SEQUENCES:
            out[f"dup_{n}_chars"] = total(text, chars * inside)
        if n == WINDOW:
            out["n_repeat_words"] = total(text, inside)
    return [out[m] for m in MEASURES]


def measure_repetition(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without text_col, with the columns of MEASURES (long)."""
    rest = [c for c in docs.columns if c not in (text_col, *MEASURES)]
    df = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(text_col).alias("n_words"))
    schema = df.select(*(F.col(f"`{c}`") for c in rest), *(F.lit(0).cast("long").alias(m) for m in MEASURES)).schema

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *others, column = batch.columns
            for a, b, texts in portions(column, PORTION):
                yield pa.RecordBatch.from_arrays([*(x.slice(a, b - a) for x in others), *(pa.array(m, pa.int64()) for m in measures(texts))], [*rest, *MEASURES])

    return df.mapInArrow(measured, schema)


def judge(measured: DataFrame) -> DataFrame:
    """The measures with base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    over = lambda name, share: 100 * F.col(name) > share * F.col("word_chars")
    bad = over("dup_line_chars", LINES)
    for n, share in SEQUENCES.items():
        bad |= over(f"dup_{n}_chars", share)
    return measured.withColumns({"base_failed": failed, "kept": ~failed & ~bad})


def op11_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(measure_repetition(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _sql() -> str:
    long = lambda n: f"coalesce(max(case when n = {n} then chars end), 0)::bigint"
    bad = " or ".join([f"100 * dup_line_chars > {LINES} * word_chars", *(f"100 * dup_{n}_chars > {s} * word_chars" for n, s in SEQUENCES.items())])
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
d as (select *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from t),
lines as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from d),
line_rows as (select r, line, i, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) as chars, row_number() over (partition by r, line order by i) as k from lines),
line_sums as (select r, count(*) filter (k > 1 and chars > 0) as n_dup_lines, sum(chars) filter (k > 1) as dup_line_chars from line_rows group by r),
w as (select r, unnest(words) as word, generate_subscripts(words, 1) as i from d),
grams as (select r, n, i, array_to_string(words[i:i + n - 1], ' ') as gram from (select r, words, unnest(range(1, len(words) + 1)) as i from d) x, (select unnest([{", ".join(map(str, SEQUENCES))}]) as n) y where i + n - 1 <= len(words)),
dup as (select r, n, i from (select r, n, i, count(*) over (partition by r, n, gram) as c from grams) x where c > 1),
covered as (select distinct r, n, unnest(range(i, i + n)) as i from dup),
sums as (select r, n, count(*) as words, sum(length(word)) as chars from covered join w using (r, i) group by r, n),
per as (select r, {", ".join(f"{long(n)} as dup_{n}_chars" for n in SEQUENCES)}, coalesce(max(case when n = {WINDOW} then words end), 0)::bigint as n_repeat_words from sums group by r),
m as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    n_dup_lines::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(dup_line_chars, 0)::bigint as dup_line_chars, {", ".join(f"coalesce(dup_{n}_chars, 0)::bigint as dup_{n}_chars" for n in SEQUENCES)}
    from d left join line_sums using (r) left join per using (r))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or {bad}) as kept from m"""


OP11_SQL = _sql()
