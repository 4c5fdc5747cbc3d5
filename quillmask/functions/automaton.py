"""Many values found in one pass over a text, by an Aho-Corasick automaton; few ones by the plain search, which is faster for them. Both give the same places."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np

#: From so many values on a text is read once for all of them.
MANY = 24


@lru_cache(maxsize=8)
def automaton(values: tuple[str, ...]) -> ahocorasick.Automaton | None:
    """Documents that are given the same values, as lists of names are, share one."""
    out = ahocorasick.Automaton()
    for i, v in enumerate(values):
        if v:
            out.add_word(v, i)
    if not len(out):
        return None
    out.make_automaton()
    return out


def starts_of(text: str, value: str) -> Iterator[int]:
    """Where the value stands, from left to right, none overlapping another; nowhere if it is empty."""
    at = text.find(value) if value else -1
    while at >= 0:
        yield at
        at = text.find(value, at + len(value))


def starts_of_each(text: str, values: list[str], many: int = MANY) -> list[list[int]]:
    """starts_of() for each of the values."""
    if len(values) < many:
        return [list(starts_of(text, v)) for v in values]
    distinct = tuple(dict.fromkeys(values))
    found: dict[str, list[int]] = {v: [] for v in distinct}
    made, sizes = automaton(distinct), [len(v) for v in distinct]
    lists, free = [found[v] for v in distinct], [0] * len(distinct)
    for last, i in made.iter(text) if made is not None and text else ():
        s = last + 1 - sizes[i]
        if s >= free[i]:
            lists[i].append(s)
            free[i] = last + 1
    return [found[v] for v in values]


def every_start_of_each(text: str, values: list[str], many: int = MANY) -> list[list[int]]:
    """Where each of the values stands, overlaps included."""
    if len(values) < many:
        out = []
        for v in values:
            places, at = [], text.find(v) if v else -1
            while at >= 0:
                places.append(at)
                at = text.find(v, at + 1)
            out.append(places)
        return out
    distinct = tuple(dict.fromkeys(values))
    found: dict[str, list[int]] = {v: [] for v in distinct}
    made = automaton(distinct)
    for last, i in made.iter(text) if made is not None and text else ():
        found[distinct[i]].append(last + 1 - len(distinct[i]))
    return [found[v] for v in values]


def masked_in_turn(text: str, values: list[str], mask: str, is_blank, many: int = MANY) -> str:
    """Each value in turn replaced, wherever it stands in what the ones before left, by the mask character in place of what isn't blank.

    A value without that character stands, in a text masked in parts, where it stood before, as long as none of its characters that aren't blank was masked. So all places can be found first, in one pass; only values that hold the mask
    character are searched for again.
    """
    turn: list[str] = []
    for v in [*values, None]:
        if v is not None and mask not in v:
            turn.append(v)
            continue
        text = _masked_once(text, turn, mask, is_blank, many)
        turn = []
        if v is not None and v in text:
            text = text.replace(v, "".join(c if is_blank(c) else mask for c in v))
    return text


def _masked_once(text: str, values: list[str], mask: str, is_blank, many: int) -> str:
    values = [*dict.fromkeys(v for v in values if v)]
    shape = lambda v: bytes(not is_blank(c) for c in v)
    if len(values) < many:
        for v in values:
            if v in text:
                text = text.replace(v, "".join(c if is_blank(c) else mask for c in v))
        return text
    made, sizes = automaton(tuple(values)), [len(v) for v in values]
    places: dict[int, list[int]] = {}
    for last, i in made.iter(text) if text else ():
        places.setdefault(i, []).append(last + 1 - sizes[i])
    if not places:
        return text
    gone = bytearray(len(text))
    for i in sorted(places):
        hides, size, free = shape(values[i]), sizes[i], 0
        solid = [k for k, x in enumerate(hides) if x]
        plain = len(solid) == size
        for s in places[i]:
            if s < free or (gone.find(1, s, s + size) >= 0 if plain else any(gone[s + k] for k in solid)):
                continue
            free = s + size
            if plain:
                gone[s:free] = hides
            else:
                for k in solid:
                    gone[s + k] = 1
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    codes[np.frombuffer(gone, np.uint8).astype(bool)] = ord(mask)
    return codes.tobytes().decode("utf-32-le", "surrogatepass")
