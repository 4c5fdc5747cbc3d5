"""Edit distances by bit vectors: a column of the distance table is held as differences, a bit for each row, and advanced by a few operations on words of 64 rows, for many texts or stretches of one text at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_ONE = _U(1)


def distance(a: str, b: str) -> int:
    """The edit distance of two strings; one word has as many bits as the first has letters."""
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = whole, 0, len(a)
    for c in b:
        same = at.get(c, 0)
        turned = same | down
        across = (((same & up) + up) ^ up) | same
        right, left = down | (whole & ~(across | up)), up & across
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & whole, (left << 1) & whole
        up, down = left | (whole & ~(turned | right)), right & turned
    return score


class Pattern:
    """A value, its letters' rows as words of 64 bits, and the columns of several texts that are read side by side."""

    def __init__(self, value: str):
        codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.size = len(codes)
        self.letters, of = np.unique(codes, return_inverse=True)
        self.often = np.bincount(of, minlength=len(self.letters))
        self.words = -(-self.size // 64)
        # the last row stands for all other letters
        self.rows = np.zeros((self.words, len(self.letters) + 1), _U)
        for i, letter in enumerate(of.tolist()):
            self.rows[i // 64, letter] |= _ONE << _U(i % 64)

    def coded(self, text: str) -> np.ndarray:
        """The text's letters as numbers of the value's letters."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at, len(self.letters)).astype(np.int32)

    def scores(self, columns: Iterator[np.ndarray], lanes: int, anywhere: bool) -> Iterator[np.ndarray]:
        """After each letter of the lanes (a column holds one of each), the distance of the value to what was read, or, with ``anywhere``, to the nearest stretch that ends there."""
        up, down = np.full((self.words, lanes), ~_U(0)), np.zeros((self.words, lanes), _U)
        score, top = np.full(lanes, self.size, np.int64), _U((self.size - 1) % 64)
        first = np.full(lanes, 0 if anywhere else 1, _U)
        none = np.zeros(lanes, _U)
        for letters in columns:
            more, less = first, none
            for w in range(self.words):
                same, v, n = self.rows[w][letters], up[w], down[w]
                turned = same | n
                same |= less
                across = (((same & v) + v) ^ v) | same
                right, left = n | ~(across | v), v & across
                last = top if w == self.words - 1 else _U(63)
                next_more, next_less = (right >> last) & _ONE, (left >> last) & _ONE
                right, left = (right << _ONE) | more, (left << _ONE) | less
                up[w], down[w] = left | ~(turned | right), right & turned
                more, less = next_more, next_less
            score += more.astype(np.int64) - less.astype(np.int64)
            yield score


def close_windows(text: str, value: str, size: int, most: int, at_once: int = 1 << 15) -> Iterator[int]:
    """Where windows of so many letters, no less than the value has, are within most edits of it, in order.

    The letters that a window has too many are that many edits, and what is left of most bounds how many of the value's letters can be missing in it: running counts of the letters rule out all windows that lack more. If many are left, one pass over
    the text, cut into pieces that are read side by side, finds where stretches within most edits end, and only windows that hold such an end stay. The others are compared whole.
    """
    if len(text) < size or not value:
        return
    pattern = Pattern(value)
    codes = pattern.coded(text)
    may = _with_letters(pattern, codes, size, pattern.size - (most - (size - pattern.size)))
    if 4 * len(may) > len(text):
        # a window holds an end if it lies in (start, start + size]
        ends = _near_ends(pattern, codes, most)
        held = np.zeros(len(text) - size + 2, np.int64)
        np.add.at(held, np.maximum(ends - size, 0), 1)
        np.add.at(held, np.minimum(ends, len(held) - 1), -1)
        may = may[np.cumsum(held)[may] > 0]
    done, take = 0, 256
    while done < len(may):
        own = may[done : done + take]
        score = own
        for score in pattern.scores((codes[own + i] for i in range(size)), len(own), False):
            pass
        yield from own[score <= most].tolist()
        done, take = done + take, min(at_once, 4 * take)


def _with_letters(pattern: Pattern, codes: np.ndarray, size: int, need: int) -> np.ndarray:
    """Windows that hold at least so many of the value's letters, each as often as the value at the most."""
    inside = np.zeros(len(codes) - size + 1, np.int32)
    times = np.bincount(codes, minlength=len(pattern.letters) + 1)
    left = pattern.size
    for letter in np.argsort(times[:-1], kind="stable").tolist():  # the rarest first
        often = int(pattern.often[letter])
        left -= often
        if times[letter]:
            before = np.concatenate([[0], np.cumsum(codes == letter, dtype=np.int32)])
            inside += np.minimum(before[size:] - before[:-size], often)
        if left < need and (not len(inside) or int(inside.max()) + left < need):
            return np.zeros(0, np.int64)
    return np.flatnonzero(inside >= need)


def _near_ends(pattern: Pattern, codes: np.ndarray, most: int, lanes: int = 4096) -> np.ndarray:
    """The numbers of letters after which a stretch within most edits of the value ends."""
    lead = pattern.size + most  # no such stretch is longer
    piece = max(128, 2 * lead)
    starts = np.arange(0, len(codes), piece)
    other = np.int32(len(pattern.letters))
    padded = np.concatenate([np.full(lead, other, np.int32), codes, np.full(piece, other, np.int32)])
    found = []
    for at in range(0, len(starts), lanes):
        own = starts[at : at + lanes]
        # padded[own + i] is the letter lead places before a piece's i-th
        for i, score in enumerate(pattern.scores((padded[own + k] for k in range(lead + piece)), len(own), True)):
            if i >= lead:
                hit = own[score <= most] + (i - lead + 1)
                if len(hit):
                    found.append(hit)
    out = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.sort(out[out <= len(codes)])
