"""Word-processor XML as a tree of events: the runs of the body's own paragraphs, and hits styled over several runs.

A part is read once into events, one for each tag, whose running sum of openings and closings is their depth. What stands on a level is told by depth and by the element that holds it, so nested tables, content controls and links are never taken for
the body's own. Hits and runs are two lists of intervals in order; one sweep over both cuts runs at the hits' ends. Everything is per row, without a shuffle, in Arrow batches, in time that grows with the XML and what is found in it.

XML that breaks off is read up to there. A null part gives null.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from xml.sax.saxutils import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T
from ..functions.spans import _lists, by_portions, hits_of_each

#: A tag, or what looks like one but isn't. No part of the pattern gives back what it took, so a tag that is never closed costs one look.
_TAG = re.compile(r"""<!--(?>.*?-->)|<!\[CDATA\[(?>.*?\]\]>)|<\?(?>.*?\?>)|<(?P<end>/?)(?P<name>[^\s/>!?]++)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.DOTALL)
#: A tag of XML whose tags are plain: no comment or the like among them but the declaration, and none with a sign of quotes or an angle bracket out of its place.
_PLAIN = re.compile(r"</?([^\s/>!?]++)[^>]*+>")
_COLOR = re.compile(r'<w:color\s[^>]*?w:val="([^"]*)"')
_OVERLAID = {True: re.compile(r"<w:(?:color|u|i)(?:\s[^>]*)?(?:/>|></w:(?:color|u|i)>)"), False: re.compile(r"<w:(?:color|u)(?:\s[^>]*)?(?:/>|></w:(?:color|u)>)")}
# What is laid over a run, by whether the whole hit was red before.
_OVERLAY = {True: '<w:i/><w:u w:val="single"/><w:color w:val="FF0000"/>', False: '<w:u w:val="single"/><w:color w:val="7B3F00"/>'}


def all_tags(xml: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Names, steps and places of the tags, one look at a time."""
    at, names, step, places = xml.find("<"), [], [], []
    while at >= 0:
        tag = _TAG.match(xml, at)
        if tag is None:
            break
        if tag["name"]:
            names.append(tag["name"])
            step.append(-1 if tag["end"] else 0 if tag["rest"].endswith("/") else 1)
            places.append(tag.span())
        at = xml.find("<", tag.end())
    return names, step, places


def plain_tags(xml: str) -> tuple[list[str], list[int], list[tuple[int, int]]] | None:
    """The same for all tags at once; None where the XML isn't as plain as that asks."""
    skip = xml.find("?>") + 2 if xml.startswith("<?xml ") else 0
    if skip == 1:
        return None
    xml = xml[skip:]
    letters = np.frombuffer(xml.encode("utf-32-le", "surrogatepass"), "<u4")
    begin, end = np.flatnonzero(letters == ord("<")), np.flatnonzero(letters == ord(">"))
    if not len(begin) or len(begin) != len(end) or (begin > end).any() or (end[:-1] > begin[1:]).any():
        return None
    for quote, most in (("'", 0), ('"', 1)):
        at = np.flatnonzero(letters == ord(quote))
        of = np.searchsorted(begin, at) - 1
        count = np.bincount(of[(of >= 0) & (at < end[of])])
        if (count > 0 if most == 0 else count % 2 > 0).any():
            return None
    names = _PLAIN.findall(xml)
    if len(names) != len(begin) or any('"' in name for name in {*names}):
        return None
    step = np.where(letters[begin + 1] == ord("/"), -1, letters[end - 1] != ord("/"))
    return names, step.tolist(), [*zip((begin + skip).tolist(), (end + skip + 1).tolist(), strict=True)]


class Events:
    """Tags in order: name, place, and the level that an element stands on, with the place and number of its closing tag and the element that holds it."""

    def __init__(self, xml: str):
        names, step, places = plain_tags(xml) or all_tags(xml)
        self.xml, self.name, self.place = xml, names, places
        step = np.array(step, np.int64)
        level = np.cumsum(step) + (step <= 0)
        n = len(step)
        # one level after another; on each, openings and closings follow each other, so the next of its events that isn't an element without content closes
        self.close, self.parent = np.full(n, -1), np.full(n, -1)
        paired = np.flatnonzero(step != 0)
        paired = paired[np.argsort(level[paired], kind="stable")]
        ends = np.flatnonzero((level[paired[:-1]] == level[paired[1:]]) & (step[paired[:-1]] > 0) & (step[paired[1:]] < 0))
        self.close[paired[ends]] = paired[ends + 1]
        alone = np.flatnonzero(step == 0)
        self.close[alone] = alone
        opens = np.flatnonzero(step > 0)
        keys = np.sort(level[opens] * n + opens)
        elements = np.flatnonzero(step >= 0)
        above = np.searchsorted(keys, (level[elements] - 1) * n + elements) - 1
        held = elements[(above >= 0) & (keys[above] // max(1, n) == level[elements] - 1)] if len(keys) else elements[:0]
        self.parent[held] = keys[np.searchsorted(keys, (level[held] - 1) * n + held) - 1] % max(1, n)
        self.level, self.elements = level, elements[np.argsort(level[elements], kind="stable")]
        self.closing = self.close.tolist()

    def on(self, level: int) -> np.ndarray:
        """The elements of a level, in order."""
        levels = self.level[self.elements]
        return self.elements[np.searchsorted(levels, level) : np.searchsorted(levels, level, "right")]

    def inside(self, holders: list[int]) -> Iterator[tuple[int, list[int]]]:
        """Each of the elements, which stand on one level, with the closed elements that it holds itself."""
        kids: dict[int, list[int]] = {h: [] for h in holders}
        if holders:
            at = self.on(int(self.level[holders[0]]) + 1)
            at = at[self.close[at] >= 0]
            for x, holder in zip(at.tolist(), self.parent[at].tolist(), strict=True):
                if (own := kids.get(holder)) is not None:
                    own.append(x)
        yield from kids.items()

    def content(self, x: int) -> str:
        """What stands between an element's tags."""
        return self.xml[self.place[x][1] : self.place[self.closing[x]][0]] if self.closing[x] != x else ""

    def whole(self, x: int) -> str:
        return self.xml[self.place[x][0] : self.place[self.closing[x]][1]]


@dataclass(slots=True)
class Run:
    paragraph: int
    number: int
    #: its place in the XML, and its opening tag
    start: int
    end: int
    opening: str
    style: str
    marks: int
    #: as it stands in the XML
    text: str
    #: what it holds besides style and text
    others: str


def body_runs(xml: str) -> list[Run]:
    """The runs that the body's own paragraphs hold themselves, tables, content controls and links left out. The text elements of a run count as one."""
    events = Events(xml)
    bodies = [i for i, n in enumerate(events.name) if n == "w:body" and events.close[i] > i][:1]
    paragraphs = [x for _, kids in events.inside(bodies) for x in kids if events.name[x] == "w:p"]
    held = [(p, x) for p, (_, kids) in enumerate(events.inside(paragraphs)) for x in kids if events.name[x] == "w:r"]
    parts = dict(events.inside([x for _, x in held]))
    out, number, last, names, places = [], 0, -1, events.name, events.place
    for p, x in held:
        number, last = (number + 1 if p == last else 0), p
        texts, style, marks, others = [], None, 0, []
        for k in parts[x]:
            name = names[k]
            if name == "w:t":
                texts.append(events.content(k))
            elif name != "w:rPr":
                marks += name in ("w:tab", "w:br")
                others.append(events.whole(k))
            elif style is None:
                style = events.content(k)
        start, behind = places[x]
        out.append(Run(p, number, start, places[events.closing[x]][1], xml[start:behind], style or "", marks, "".join(texts), "".join(others)))
    return out


def styled_xml(xml: str, values: list[str]) -> str:
    """The XML in which every hit of the values is styled, over as many runs as it reaches.

    The text is that of the runs, end to end, paragraphs parted by line feeds. A run is cut where a hit begins or ends; its first piece keeps what else it held. A hit whose characters were all red becomes red, italic and underlined, any other brown and underlined. Of
    several hits over one stretch, the last by start, then end, decides.
    """
    runs = body_runs(xml)
    texts = [unescape(r.text, {"&quot;": '"', "&apos;": "'"}) for r in runs]
    breaks = [runs[i].paragraph - (runs[i - 1].paragraph if i else 0) for i in range(len(runs))]
    starts = [0, *accumulate(len(t) + b for t, b in zip(texts, [*breaks[1:], 0], strict=False))][: len(runs)]
    starts = [s + (breaks[0] if breaks else 0) for s in starts]
    flat = "".join("\n" * b + t for b, t in zip(breaks, texts, strict=True))
    hits = sorted({h for own in hits_of_each(flat, [*dict.fromkeys(values)]) for h in own})
    if not hits:
        return xml
    red = [bool(c := _COLOR.search(r.style)) and c[1].upper() in T.REDS for r in runs]
    other = [0, *accumulate(0 if is_red else len(t) for is_red, t in zip(red, texts, strict=True))]

    def not_red(place: int) -> int:
        """How many characters of runs that aren't red stand before a place of the text."""
        i = bisect_right(starts, place) - 1
        return other[i] + (0 if red[i] else min(place - starts[i], len(texts[i]))) if i >= 0 else 0

    exact = [not_red(s) == not_red(e) for s, e in hits]
    bounds = sorted({x for h in hits for x in h})
    out, at, next_hit, open_ = [], 0, 0, []
    for run, text, start in zip(runs, texts, starts, strict=True):
        end, pieces, place = start + len(text), [], start
        while place < end:
            while next_hit < len(hits) and hits[next_hit][0] <= place:
                heapq.heappush(open_, (-next_hit, hits[next_hit][1]))
                next_hit += 1
            while open_ and open_[0][1] <= place:
                heapq.heappop(open_)
            style = exact[-open_[0][0]] if open_ else None
            i = bisect_right(bounds, place)
            to = min(end, bounds[i]) if i < len(bounds) else end
            pieces.append((text[place - start : to - start], style))
            place = to
        if any(style is not None for _, style in pieces):
            out += [xml[at : run.start], *_cut(run, pieces)]
            at = run.end
    return "".join([*out, xml[at:]])


def _cut(run: Run, pieces: list[tuple[str, bool | None]]) -> Iterator[str]:
    for i, (text, exact) in enumerate(pieces):
        style = run.style if exact is None else _OVERLAID[exact].sub("", run.style) + _OVERLAY[exact]
        yield f'{run.opening}{f"<w:rPr>{style}</w:rPr>" if style else ""}{"" if i else run.others}<w:t xml:space="preserve">{escape(text)}</w:t></w:r>'


@F.arrow_udf(StringType())
@by_portions
def style_hits(xml: pa.Array, values: pa.Array) -> pa.Array:
    """styled_xml() for columns: the XML of a main part, and the values to be found in it."""
    return pa.array([None if x is None else styled_xml(x, [v for v in own or () if v]) for x, own in zip(xml.to_pylist(), values.to_pylist(), strict=True)], pa.string())


_ROWS = StructType().add("p", "integer").add("r", "integer").add("n_ws", "integer").add("text", "string").add("start", "integer").add("end", "integer")


def _placed(xml: str) -> Iterator[tuple[int, int, int, str, int, int]]:
    at = 0
    for r in body_runs(xml):
        at += r.marks
        at += at > 0 and len(r.text) > 0
        yield r.paragraph, r.number, r.marks, r.text, at, at + len(r.text)
        at += len(r.text)


def placed_runs(xml: str) -> Iterator[dict]:
    """The runs with their places in the flattened text, in which tabs and breaks are blanks and a blank stands between any two texts."""
    for row in _placed(xml):
        yield dict(zip(_ROWS.names, row, strict=True))


@F.arrow_udf(ArrayType(_ROWS))
@by_portions
def runs(xml: pa.Array) -> pa.Array:
    rows = [None if x is None else [*_placed(x)] for x in xml.to_pylist()]
    columns = [*zip(*(r for own in rows if own for r in own), strict=True)] or [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    return _lists(rows, pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _ROWS.names))


def run_rows(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, p, r, n_ws, text, start, end): a row for each run of a main part."""
    main = parts.where(F.col("part") == "word/document.xml")
    return main.select(id_col, F.explode_outer(runs("xml")).alias("x")).where("x is not null").select(id_col, "x.*")


def style_parts(parts: DataFrame, values: Column) -> DataFrame:
    """parts (part, xml, ...) with the hits of ``values`` (an array) styled in word/document.xml."""
    return parts.withColumn("xml", F.when(F.col("part") == "word/document.xml", style_hits(F.col("xml"), values)).otherwise(F.col("xml")))


__all__ = ["Events", "all_tags", "body_runs", "placed_runs", "plain_tags", "run_rows", "runs", "style_hits", "style_parts", "styled_xml"]
