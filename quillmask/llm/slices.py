"""Tokens of many texts at once: a lookup table finds their bounds in the concatenated UTF-8 of a batch, a hash groups them, and bytes are compared before two count as one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are compared at once.
COMPARED = 1 << 18


def byte_table(*outside: tuple[int, int]) -> np.ndarray:
    """Whether a byte stands in a token: all but those of the ranges (first, last)."""
    out = np.ones(256, bool)
    for first, last in outside:
        out[first : last + 1] = False
    return out


@dataclass
class Texts:
    """Texts one after another in one buffer; text i is bytes[ends[i] : ends[i + 1]]."""

    bytes: np.ndarray
    ends: np.ndarray

    def bounds(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From, to and text of each longest run of bytes that the table holds; no run goes over the end of a text."""
        held = inside[self.bytes]
        first, last = held.copy(), held.copy()
        first[1:] &= ~held[:-1]
        last[:-1] &= ~held[1:]
        cuts = self.ends[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(held))]
        first[cuts] = held[cuts]
        last[cuts - 1] = held[cuts - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(self.ends, starts, "right") - 1

    def count(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text a mask over all bytes holds."""
        return np.array([np.count_nonzero(mask[a:b]) for a, b in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True)], np.int64)


def portions(column: pa.Array, at_most: int) -> Iterator[tuple[int, int, Texts]]:
    """Rows from, to, and their texts (null: empty), so many bytes at once; a longer text is taken alone."""
    column = column.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + at_most, "right")) - 1)
        yield at, to, Texts(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        at = to


def spread(lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices from, to, some bytes at once: their lengths, the place of each one's first byte among theirs, and each byte's place in its slice."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED, "right")))
        n = lengths[at:to]
        before = np.cumsum(n) - n
        yield at, to, n, before, np.arange(int(n.sum())) - np.repeat(before, n)
        at = to


def differing(data: np.ndarray, starts: np.ndarray, others: np.ndarray, lengths: np.ndarray, other_data: np.ndarray | None = None) -> np.ndarray:
    """Which of the slices of data differ from the slices, of the same lengths, of data or other_data that start at others."""
    other_data = data if other_data is None else other_data
    out = np.zeros(len(starts), bool)
    for at, to, n, before, place in spread(lengths):
        unlike = data[np.repeat(starts[at:to], n) + place] != other_data[np.repeat(others[at:to], n) + place]
        out[at:to] = np.add.reduceat(unlike, before, dtype=np.int64) > 0
    return out


def polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each slice's bytes, modulo two to the 64th."""
    out = np.zeros(len(starts), np.uint64)
    for at, to, n, before, place in spread(ends - starts):
        powers = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
        out[at:to] = np.add.reduceat((data[np.repeat(starts[at:to], n) + place].astype(np.uint64) + np.uint64(1)) * powers[place], before)
    return out


def mixed(numbers: np.ndarray) -> np.ndarray:
    """64 bits for each number, without any pattern that sums could cancel."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def xxhashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    view = memoryview(np.ascontiguousarray(data))
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))


def identify(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes=xxhashes) -> tuple[np.ndarray, np.ndarray]:
    """A number for each slice, equal for equal bytes only, and for each number one slice that has it. Slices aren't empty."""
    keys = hashes(data, starts, ends)
    _, first, number = np.unique(keys, return_index=True, return_inverse=True)
    shown, lengths = first[number], ends - starts
    unlike = lengths != lengths[shown]
    check = np.flatnonzero(~unlike & (shown != np.arange(len(shown))))
    unlike[check[differing(data, starts[check], starts[shown[check]], lengths[check])]] = True
    others: dict[bytes, int] = {}
    more: list[int] = []
    for i in np.flatnonzero(unlike).tolist():  # hashes that collided
        own = data[starts[i] : ends[i]].tobytes()
        if own not in others:
            others[own] = len(first) + len(more)
            more.append(i)
        number[i] = others[own]
    return number, np.concatenate([first, np.array(more, np.int64)])
