"""Word-processor documents: masking and annotation of their main part.

The XML is worked on row by row, without a shuffle, by passes along it in Arrow batches. Text elements are rebuilt by position, never by replacing what happens to
look like them.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.spans import by_portions, masked_each
from .masking import wanted_values

#: A text element: opening, content and closing.
TEXT = re.compile("(<w:t(?:[ \t\n\x0b\f\r][^>]*)?>)([^\n\r\u2028\u2029]*?)(</w:t>)")
#: A text element without markup in it, and a run's opening.
_PLAIN = re.compile("<w:t(?:[ \t\n\x0b\f\r][^>]*)?>([^<]*)</w:t>")
_RUN = re.compile("\\A<w:r(?:[ \t\n\x0b\f\r][^>]*)?>")
# Colours of annotations.
RED, BROWN = "FF0000", "8B4513"


def masked_xml(xml: str, values: list[str]) -> str:
    """The text of all elements, end to end, masked value by value, and dealt back to the elements by their lengths."""
    parts = TEXT.split(xml)
    contents = parts[2::4]
    text, at = masked_each("".join(contents), values), 0
    for i, content in enumerate(contents):
        parts[2 + 4 * i] = text[at : at + len(content)]
        at += len(content)
    return "".join(parts)


@F.arrow_udf(StringType())
@by_portions
def mask_xml(xml: pa.Array, values: pa.Array) -> pa.Array:
    return pa.array([None if x is None else masked_xml(x, own or []) for x, own in zip(xml.to_pylist(), values.to_pylist(), strict=True)], pa.string())


def mask_parts(parts: DataFrame, dets_col: str = "dets", strict: bool = False) -> DataFrame:
    """parts (doc_id, part, xml, dets) with ``xml`` masked in word/document.xml; strict masks headers, footers and notes too, and finds values that are escaped in XML."""
    values = wanted_values(F.col(dets_col))
    if strict:
        values = F.transform(values, T.escape_xml)
    main = F.col("part") == "word/document.xml"
    if strict:
        main = main | F.col("part").rlike(r"\Aword/(header|footer|footnotes|endnotes|comments)[0-9]*\.xml\z")
    return parts.withColumn("xml", F.when(main, mask_xml(F.col("xml"), values)).otherwise(F.col("xml")))


def put_after(xml: str, tag: str, what: str) -> str:
    """The XML with something put behind the first such tag."""
    before, found, behind = xml.partition(tag)
    return before + found + what + behind if found else xml


def add_missing(xml: str, sign: str, what: str) -> str:
    return xml if sign in xml else put_after(xml, "<w:rPr>", what)


def painted(run: str) -> str:
    """The run in brown."""
    sign = '<w:color w:val="'
    if "<w:color" not in run:
        return put_after(run, "<w:rPr>", f'{sign}{BROWN}"/>')
    at = run.find(sign) + len(sign)
    end = run.find('"', at) if at >= len(sign) else -1
    return run[:at] + BROWN + run[end:] if end >= 0 else run


def styled_run(run: str) -> str:
    """A run's markup in its annotation style: red ones red, italic and underlined; others brown and underlined."""
    line = '<w:u w:val="single"/>'
    red = any(f'<w:color w:val="{c}"' in run for c in T.REDS)
    if "<w:rPr>" not in run:
        style = f'<w:color w:val="{RED}"/><w:i/>{line}' if red else f'<w:color w:val="{BROWN}"/>{line}'
        return _RUN.sub(lambda m: f"{m[0]}<w:rPr>{style}</w:rPr>", run)
    if red:
        run = add_missing(add_missing(run, "<w:color", f'<w:color w:val="{RED}"/>'), "<w:i", "<w:i/>")
    return add_missing(run if red else painted(run), "<w:u", line)


def annotated(xml: str, text: str, values: list[str]) -> str:
    """See annotate_xml(). The text elements are read once, and again only where a run was restyled."""
    elements = None
    for v in values:
        if not v or v not in text:
            continue
        if elements is None:
            elements = [*_PLAIN.finditer(xml)]
            contents = [m[1] for m in elements]
            joint = "\0".join(contents)
        if "\0" not in v and v not in joint:
            continue
        at = next((m.start() for m, own in zip(elements, contents, strict=True) if v in own), -1)
        lead = max(xml.rfind("<w:r ", 0, at), xml.rfind("<w:r>", 0, at)) if at >= 0 else -1
        if lead < 0:
            continue
        end = at + xml[at:].find("</w:r>") + 6
        new = xml[:lead] + styled_run(xml[lead:end]) + xml[end:]
        if new != xml:
            xml, elements = new, None
    return xml


@F.arrow_udf(StringType())
@by_portions
def annotate_xml(xml: pa.Array, text: pa.Array, values: pa.Array) -> pa.Array:
    """The XML with, for each value that the text holds, the run of the first text element that contains it restyled. Further occurrences restyle the same run to the same end."""
    rows = zip(xml.to_pylist(), text.to_pylist(), values.to_pylist(), strict=True)
    return pa.array([None if x is None or own is None else annotated(x, t or "", own) for x, t, own in rows], pa.string())


def default_half_points(styles: Column) -> Column:
    """The default font size of word/styles.xml in half points, null if it names none."""
    default = F.regexp_extract(styles, r"(?s)<w:docDefaults>.*?<w:rPrDefault>(.*?)</w:rPrDefault>", 1)
    return F.regexp_extract(default, r'<w:sz\s[^>]*?w:val="([0-9]+)"', 1).try_cast("int")
