"""Masking of recognised words in images: detections are matched to runs of words, and the runs' boxes are covered.

Words (doc_id, word_idx, text, x, y, width, height) come from any recogniser. One image's words and its detections are nested into one row each and meet by document, so no word is copied for a detection; matching is then one Arrow pass over the rows, and
boxes are column expressions.

Nothing is compared to every run of words. Where a run may match is looked up: a value's tokens by the words that equal them or share a text with one letter left out, the value's whole text, and parts of it of which one must stand unchanged, by their places
in the words' joined text. Edits are only counted there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T
from ..functions.automaton import every_start_of_each
from ..functions.spans import by_portions

_DIGIT = re.compile("[0-9]")


def within(a: str, b: str, most: int) -> bool:
    """Whether two strings are at most so many edits apart."""
    while a and b and a[0] == b[0]:
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        a, b = a[n:], b[n:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    # the first letters differ: one of them is extra, or they are taken for each other
    return most > 0 and (within(a[1:], b[1:], most - 1) or within(a[1:], b, most - 1) or within(a, b[1:], most - 1))


def exact_only(token: str) -> bool:
    """Tokens that are no other token's misreading."""
    return len(token) <= 3 or bool(_DIGIT.search(token))


def shortened(word: str) -> Iterator[str]:
    yield word
    for i in range(len(word)):
        yield word[:i] + word[i + 1 :]


class Words:
    """The recognised words of one image, as they are compared, with their places in the joined text."""

    def __init__(self, words: list[str]):
        self.words = words
        self.solid = [w.replace(" ", "") for w in words]
        self.joined = "".join(self.solid)
        self.starts = np.array([0, *accumulate(map(len, self.solid))], np.int64)
        self.places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            self.places.setdefault(w, []).append(i)

    def alike(self, tokens: set[str]) -> dict[str, list[str]]:
        """For each token the words that match it: itself, and for those that may be misread, words without a digit one edit away."""
        found = {t: [t] if t in self.places else [] for t in tokens}
        keys: dict[str, list[str]] = {}
        for t in tokens:
            for key in () if exact_only(t) else dict.fromkeys(shortened(t)):
                keys.setdefault(key, []).append(t)
        sizes = {len(t) + d for t in tokens if not exact_only(t) for d in (-1, 0, 1)}
        for w in self.places if keys else ():
            if len(w) in sizes and not _DIGIT.search(w):
                near = {t for key in shortened(w) if key in keys for t in keys[key]}
                for t in near:
                    if t != w and within(w, t, 1):
                        found[t].append(w)
        return found

    def ends(self, n: int) -> np.ndarray:
        """Where the run of n words from each word on ends in the joined text; the last runs are shorter."""
        return self.starts[np.minimum(np.arange(len(self.words)) + n, len(self.words))]

    def spans(self, low: int, high: int) -> tuple[int, int]:
        """The words that begin at a place from low to high."""
        return int(np.searchsorted(self.starts[:-1], low)), int(np.searchsorted(self.starts[:-1], high, "right"))


def matching_runs(words: Words, targets: list[str]) -> list[list[int]]:
    """For each target (as it is compared) the runs of as many words as it has tokens that match it, from left to right without overlap, by their first word.

    A run matches if its text is the target's without blanks; if its words are the target's tokens, or one edit away where neither has a digit and the token more than three letters; or if its text has the same digits and at most
    two edits, no more than 0.12 of the target.
    """
    tokens = [t.split() for t in targets]
    compact = ["".join(t) for t in tokens]
    alike = words.alike({t for own in tokens for t in own})
    allowed = [0 if len(c) < 9 else 1 if len(c) < 17 else 2 for c in compact]
    # of k + 1 parts of a text with k edits, one is unchanged, at most k away from its place
    parts = [[c] if not k else [c[len(c) * i // (k + 1) : len(c) * (i + 1) // (k + 1)] for i in range(k + 1)] for c, k in zip(compact, allowed, strict=True)]
    found = {}
    wanted = [p for own in parts for p in own]
    for part, places in zip(wanted, every_start_of_each(words.joined, wanted), strict=True):
        found[part] = places
    ends: dict[int, np.ndarray] = {}
    out = []
    for own, c, k, pieces in zip(tokens, compact, allowed, parts, strict=True):
        n, starts = len(own), set()
        if not n:
            out.append([])
            continue
        if n not in ends:
            ends[n] = words.ends(n)
        # token by token, from the one with the fewest places
        lists = [[p for w in alike[t] for p in words.places[w]] for t in own]
        j = min(range(n), key=lambda i: len(lists[i]))
        may = [set(alike[t]) for t in own]
        for p in lists[j]:
            s = p - j
            if s >= 0 and s + n <= len(words.words) and all(words.words[s + i] in may[i] for i in range(n)):
                starts.add(s)
        digits, offset = "".join(_DIGIT.findall(c)), 0
        for piece in pieces:
            for x in found[piece]:
                a, b = words.spans(x - offset - k, x - offset + k)
                sizes = ends[n][a:b] - words.starts[a:b]
                for s in (a + np.flatnonzero(np.abs(sizes - len(c)) <= k)).tolist():
                    if s not in starts:
                        text = words.joined[words.starts[s] : ends[n][s]]
                        if text == c or (k and "".join(_DIGIT.findall(text)) == digits and within(text, c, k)):
                            starts.add(s)
            offset += len(piece)
        taken, free = [], 0
        for s in sorted(starts):
            if s >= free:
                taken.append(s)
                free = s + n
        out.append(taken)
    return out


_RUN = StructType().add("det", "integer").add("start", "integer").add("n", "integer")


@F.arrow_udf(ArrayType(_RUN))
@by_portions
def word_runs(words: pa.Array, values: pa.Array) -> pa.Array:
    """The runs of words (an array of texts) that match each of the values: det is the value's place in its array, start the run's first word, n how many it has."""
    known: dict[str | None, str] = {}

    def form(s: str | None) -> str:
        if s not in known:
            known[s] = T.ocr_form(s)
        return known[s]

    rows = []
    for own, wanted in zip(words.to_pylist(), values.to_pylist(), strict=True):
        if own is None or wanted is None:
            rows.append(None)
            continue
        targets = [form(v) for v in wanted]
        runs = matching_runs(Words([form(w) for w in own]), targets)
        rows.append([{"det": d, "start": s, "n": min(len(t.split()), len(own) - s)} for d, (t, starts) in enumerate(zip(targets, runs, strict=True)) for s in starts])
    return pa.array(rows, pa.list_(pa.struct([("det", pa.int32()), ("start", pa.int32()), ("n", pa.int32())])))


def match_words(words: DataFrame, detections: DataFrame) -> DataFrame:
    """(doc_id, det_idx, value, start, n_words, x, y, width, height): the runs of as many words as the value has, from left to right without overlap."""
    nested = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("word_idx", "text", "x", "y", "width", "height"))).alias("words"))
    wanted = detections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("det_idx", "value"))).alias("wanted"))
    runs = nested.join(wanted, "doc_id").withColumn("runs", word_runs(F.transform("words", lambda w: w.text), F.transform("wanted", lambda d: d.value)))

    def box(run):
        own = F.slice("words", run.start + 1, run.n)
        x0, y0 = F.array_min(F.transform(own, lambda w: w.x)), F.array_min(F.transform(own, lambda w: w.y))
        x1, y1 = F.array_max(F.transform(own, lambda w: w.x + w.width)), F.array_max(F.transform(own, lambda w: w.y + w.height))
        d = F.get("wanted", run.det)
        return F.struct(d.det_idx.alias("det_idx"), d.value.alias("value"), run.start.alias("start"), run.n.alias("n_words"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("width"), (y1 - y0).alias("height"))

    return runs.select("doc_id", F.explode_outer(F.transform("runs", box)).alias("b")).where("b is not null").select("doc_id", "b.*")


def cover(boxes: DataFrame, pad: int = 2) -> DataFrame:
    """The rectangles that cover boxes."""
    return boxes.withColumns({"x": F.col("x") - pad, "y": F.col("y") - pad, "width": F.col("width") + 2 * pad, "height": F.col("height") + 2 * pad})
