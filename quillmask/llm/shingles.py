"""Word shingles of many texts at once, as sets of 64-bit numbers, and 256-bit SimHash fingerprints of them.

Words' bytes are hashed by a polynomial, hashes roll over neighbouring words, and sorting by text leaves each shingle once: all are numpy operations over some megabytes of text. For the fingerprint each shingle is mixed into 256 bits; their counts are
summed eight at a time, in the bytes of 64-bit numbers, over at most 255 shingles, and then by text.

Fingerprints of many texts meet in cells. Of sampled bits alone there are as many cells as the bits have values, so the texts of a cell grow with the table, and the pairs in it with their square. A cell here is some of the bits and the least of the
text's own shingles by several orders: two texts agree in one of these as often as they are alike, and unrelated ones hardly ever, however many there are.
"""

from __future__ import annotations

import numpy as np

from .slices import Texts, byte_table, mixed, polynomials

WORD = byte_table((0x20, 0x20), (0x09, 0x0D))
LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)
#: Shingles whose bits are counted at once.
COUNTED = 1 << 15
#: Cells of a text; orders by which a cell has its least shingle, and bits of the fingerprint. At a similarity of 0.8 two texts agree in 0.8 ** LEAST * 0.85 ** BITS of their cells, 0.21, and in none of them once in 200 pairs.
CELLS, LEAST, BITS = 22, 4, 4


def shingles(texts: Texts, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word shingles (A-Z lower-cased) of all texts, sorted by text and number, and where each text's begin; a text of fewer words is one shingle, one without words has none."""
    folded = Texts(LOWER[texts.bytes], texts.ends)
    starts, ends, text = folded.bounds(WORD)
    values = mixed(polynomials(folded.bytes, starts, ends) ^ mixed(ends - starts))
    count = np.bincount(text, minlength=len(texts.ends) - 1)
    first = np.cumsum(count) - count
    h, found, of = values, [], []
    for n in range(1, words + 1):
        if n > 1:
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + values[n - 1 :]
        at = np.flatnonzero(text[: len(h)] == text[n - 1 :]) if n == words and len(h) else first[count == n]
        found.append(mixed(h[at] ^ np.uint64(n)))
        of.append(text[at])
    found, of = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((found, of))
    found, of = found[order], of[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (of[1:] != of[:-1])
    found, of = found[new], of[new]
    return found, np.searchsorted(of, np.arange(len(count) + 1))


def wide_fingerprints(found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of four 64-bit numbers for each text: a bit is 1 if it is set in over half of the text's shingles; zero without shingles."""
    size = np.diff(begin)
    votes = np.zeros((len(size), 256), np.int64)
    # stretches of one text, of at most 255 shingles
    parts = -(-size // 255)
    of = np.repeat(np.arange(len(size)), parts)
    start = begin[:-1][of] + 255 * (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts))
    seeds = mixed(np.arange(4, dtype=np.uint64) + np.uint64(1000))
    at = 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(start, start[at] + COUNTED)))
        last = int(start[to]) if to < len(of) else len(found)
        lanes = np.stack([mixed(found[start[at] : last] ^ s) for s in seeds], 1)
        bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), 32), axis=1, bitorder="little").view(np.uint64)
        np.add.at(votes, of[at:to], np.add.reduceat(bits, start[at:to] - start[at], axis=0).view(np.uint8).astype(np.int64))
        at = to
    return np.packbits(2 * votes > size[:, None], axis=1, bitorder="little").view("<i8")


def cells(found: np.ndarray, begin: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """A row of CELLS numbers for each text: what its least shingles and sampled bits of its fingerprint come to; zeros without shingles."""
    rng = np.random.default_rng(42)
    # shingles are numbers without a pattern, so a product with an odd number orders them anew
    orders = 2 * rng.integers(0, 1 << 63, (CELLS, LEAST), np.uint64) + np.uint64(1)
    masks = np.zeros((CELLS, 256), np.uint8)
    for own in masks:
        own[rng.choice(256, BITS, replace=False)] = 1
    masks = np.packbits(masks, axis=1, bitorder="little").view("<u8")
    some = np.flatnonzero(np.diff(begin))
    out = np.zeros((len(begin) - 1, CELLS), np.uint64)
    if len(some):
        starts, bits = begin[:-1][some], prints[some].view(np.uint64)
        for i in range(CELLS):
            parts = [np.minimum.reduceat(found * order, starts) for order in orders[i]] + [bits[:, j] & masks[i, j] for j in range(4)]
            cell = np.full(len(some), i, np.uint64)
            for part in parts:
                cell = mixed(cell ^ part)
            out[some, i] = cell
    return out.view(np.int64)
