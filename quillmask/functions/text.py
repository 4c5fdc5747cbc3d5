"""Column helpers over text. Offsets and lengths are in code points; every helper is an expression that Catalyst can compile, but for the two Unicode normalisers."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# White space as the data model has it (Unicode white space and the byte order mark), inside a character class.
WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
# The same class with one range around all that lies beyond Latin-1, so that a letter isn't held against each of it.
_WHITE = r"\t-\r \x{A0}[\x{1680}-\x{FEFF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]]"
# What may stand beside a token, besides white space.
BOUNDARY = r".,;:!?()\[\]{}<>$\x22'\-"
# Words that are never masked in page text.
STOP_WORDS = (
    "die finanzbranche", "finanzbranche", "die", "in", "derzeit", "eine", "phase", "intensiver", "digitalisierung", "investitionen", "sicherheit", "und",
    "datenschutz", "sind", "für", "banken", "oberste", "priorität", "zahlungssysteme", "online", "banking", "werden", "von", "kunden", "zunehmend", "akzeptiert",
    "im", "rahmen", "neuer", "gesetze", "wird", "transparenz", "finanzwesen", "weiter", "erhöht", "viele", "unternehmen", "setzen", "auf", "elektronische",
    "rechnungsstellung", "um", "prozesse", "zu", "optimieren",
)
# Colours that count as red.
REDS = ("FF0000", "C00000", "E00000")


def trim_ws(s: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(s, rf"\A[{_WHITE}]+|[{_WHITE}]+\z", "")


def strip_ws(s: Column) -> Column:
    return F.regexp_replace(s, f"[{_WHITE}]+", "")


def is_blank(s: Column) -> Column:
    """Whether there is nothing but white space. Most words are told by their first letter, without a regular expression."""
    return ~(s.between("!", "~") | s.rlike(f"[^{WS}]"))


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]+", "")


def mask(s: Column) -> Column:
    """X for every character that isn't white space."""
    return F.regexp_replace(s, f"[^{WS}]", "X")


def normalize_phone(s: Column) -> Column:
    return F.regexp_replace(F.coalesce(s, F.lit("")), "[^0-9+]", "")


def is_email(s: Column) -> Column:
    return F.contains(s, F.lit("@"))


def is_phone(s: Column) -> Column:
    """Six or more of digits, blanks, brackets and hyphens, after an optional plus."""
    return s.rlike(r"\A[+]?[0-9 ()-]{6,}\z")


def is_strict_card(s: Column) -> Column:
    return s.rlike(rf"\A[0-9]{{4}}[{WS}][0-9]{{4}}[{WS}][0-9]{{4}}[{WS}][0-9]{{4}}\z")


def is_card_or_iban(s: Column) -> Column:
    """12 to 19 digits in all, or DE and 8 or more characters without white space."""
    return F.length(digits(s)).between(12, 19) | (F.startswith(strip_ws(s), F.lit("DE")) & (F.length(strip_ws(s)) >= 8))


def digit_ratio(s: Column) -> Column:
    """Digits among the characters that aren't white space; null without such."""
    return F.length(digits(s)) / F.nullif(F.length(strip_ws(s)), F.lit(0)).cast("double")


def is_stop_word(s: Column) -> Column:
    return F.lower(trim_ws(s)).isin(*STOP_WORDS)


def variants(s: Column) -> Column:
    """The value as it is, and with its white space runs removed, single and double."""
    run = f"[{WS}]+"
    return F.array_distinct(F.array(s, *(F.regexp_replace(s, run, to) for to in ("", " ", "  "))))


def is_boundary(char: Column) -> Column:
    return (char == "") | char.rlike(f"[{WS}{BOUNDARY}]")


def has_token_boundary(text: Column, start: Column, end: Column) -> Column:
    left = F.when(start <= 0, " ").otherwise(F.substring(text, start, F.lit(1)))
    right = F.when(end >= F.length(text), " ").otherwise(F.substring(text, end + 1, F.lit(1)))
    return is_boundary(left) & is_boundary(right)


def context(text: Column, start: Column, end: Column, extra: int = 12) -> Column:
    """The text from extra characters before start to extra after end."""
    low = F.greatest(F.lit(0), start - extra)
    return F.substring(text, low + 1, F.least(F.length(text), end + extra) - low)


def similarity(a: Column, b: Column, a_len: Column | None = None, b_len: Column | None = None) -> Column:
    """1 - distance / longer length; 0 if both are empty. The lengths are those before normalisation, where they differ."""
    longer = F.greatest(F.length(a) if a_len is None else a_len, F.length(b) if b_len is None else b_len)
    return F.when(longer == 0, 0.0).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer.cast("double"))


def overlay_text(width: Column) -> Column:
    """The replacement for a stretch of page text: an X for each 8 units of width, 4 at least."""
    return F.repeat(F.lit("X"), F.greatest(F.lit(4), F.floor(width / 8).cast("int")))


def escape_xml(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def is_red(color: Column) -> Column:
    return F.coalesce(F.upper(color).isin(*REDS), F.lit(False))


def is_red_xml(xml: Column) -> Column:
    """Whether run markup names a red colour, in upper case as written by word processors."""
    found = F.contains(xml, F.lit(REDS[0]))
    for red in REDS[1:]:
        found = found | F.contains(xml, F.lit(red))
    return found


def nfkc_of(s: str | None) -> str:
    return "" if s is None else s if unicodedata.is_normalized("NFKC", s) else unicodedata.normalize("NFKC", s)


def _diacritic(c: str) -> bool:
    """Combining marks, modifier letters and symbols, and the spacing accents."""
    return unicodedata.category(c) in ("Mn", "Lm", "Sk") or c in "·"


def ocr_form(s: str | None) -> str:
    """Compatibility decomposition without diacritics, white space single, trimmed, lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", s or "") if not _diacritic(c))
    return " ".join(plain.replace("﻿", " ").split()).lower()


@F.pandas_udf(StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(nfkc_of)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda values: None if values is None else [nfkc_of(x) for x in values])


@F.pandas_udf(StringType())
def ocr_normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(ocr_form)
