"""Word-processor containers: unpacking, repacking and a minimal new one. Small helpers around the zip format; the content is worked on by columns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from ..functions.spans import by_portions, masked_where

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_W = f"{{{NAMESPACE}}}"
# The parts of a container that holds one document.
_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def _parts(content: bytes | None) -> list[dict] | None:
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return [{"part": n, "xml": z.read(n).decode("utf-8", "replace")} for n in z.namelist() if n.endswith((".xml", ".rels"))]
    except zipfile.BadZipFile:
        return None


def _part(content: bytes | None, name: str) -> str | None:
    """One part alone; null where there is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
            return z.read(name).decode("utf-8", "replace")
    except (zipfile.BadZipFile, KeyError):
        return None


_MARKS = {f"{_W}tab": "\t", f"{_W}br": "\n"}


def _text(content: bytes | None) -> str | None:
    xml = _part(content, "word/document.xml")
    if xml is None:
        return None
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None
    text = f"{_W}t"
    return "".join("".join((e.text or "") if e.tag == text else _MARKS[e.tag] for e in p.iter() if e.tag == text or e.tag in _MARKS) + "\n\n" for p in root.iter(f"{_W}p")).replace("\r", "")


@F.pandas_udf(StringType())
def main_part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A container's word/document.xml, null where there is none; no other part is unpacked."""
    for s in batches:
        yield s.map(lambda content: _part(content, "word/document.xml"))


@F.pandas_udf(StringType())
def styles_part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A container's word/styles.xml, null where there is none."""
    for s in batches:
        yield s.map(lambda content: _part(content, "word/styles.xml"))


@F.pandas_udf(ArrayType(StructType().add("part", StringType()).add("xml", StringType())))
def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """XML parts of containers; null for what isn't one."""
    for s in batches:
        yield s.map(_parts)


@F.arrow_udf(StringType())
@by_portions
def document_text(content: pa.Array) -> pa.Array:
    """The plain text, paragraphs parted by an empty line, without carriage returns; null for what isn't a document."""
    return pa.array([None if c is None else _text(c) for c in content.to_pylist()], pa.string())


def _replaced(old: bytes, new: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(old)) as a, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as b:
        if "word/document.xml" not in a.namelist():
            raise ValueError("word/document.xml not found")
        for info in a.infolist():
            b.writestr(info.filename, new if info.filename == "word/document.xml" else a.read(info.filename))
    return out.getvalue()


@F.pandas_udf(BinaryType())
def with_document(content: pd.Series, xml: pd.Series) -> pd.Series:
    """Containers with word/document.xml replaced and all other parts as they were. A container without that part is an error."""

    return pd.Series([_replaced(c, x) for c, x in zip(content, xml, strict=True)])


@F.pandas_udf(BinaryType())
def with_part(content: pd.Series, xml: pd.Series) -> pd.Series:
    """Like with_document, for rows that may have no new part: theirs are null."""
    return pd.Series([None if x is None or c is None else _replaced(c, x) for c, x in zip(content, xml, strict=True)], dtype=object)


def _container(xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", xml)):
            z.writestr(name, part)
    return out.getvalue()


def _paragraph(text: str) -> str:
    body = f'<w:p><w:r><w:t xml:space="preserve">{escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text))}</w:t></w:r></w:p>'
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>'


@F.pandas_udf(BinaryType())
def new_document(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Containers of one paragraph with the text."""
    for s in batches:
        yield s.map(lambda text: _container(_paragraph(text or "")))


@F.arrow_udf(BinaryType())
@by_portions
def new_container(xml: pa.Array, text: pa.Array) -> pa.Array:
    """New containers: with the XML as the main part, or else of one paragraph with the text; null where both are."""
    rows = zip(xml.to_pylist(), text.to_pylist(), strict=True)
    return pa.array([None if x is None and t is None else _container(_paragraph(t) if x is None else x) for x, t in rows], pa.binary())


@F.arrow_udf(BinaryType())
@by_portions
def masked_content(kind: pa.Array, name: pa.Array, content: pa.Array, values: pa.Array, spellings: pa.Array) -> pa.Array:
    """Containers masked: of kind docx the main part, value by value, all else as it was; of kind doc the text where any of the spellings stands, as a new container, null for what can't be read. Null for all other kinds. A file is unpacked, masked and packed at
    once, so that a task has one worker for it and nothing but the file is held between."""
    # the operators' package reads this module
    from ..operators.word_files import masked_xml

    def one(k: str | None, n: str | None, c: bytes | None, own: list[str] | None, spelt: list[str] | None) -> bytes | None:
        if k == "docx":
            if (xml := _part(c, "word/document.xml")) is None:
                raise ValueError(f"word/document.xml not found: {n}")
            return _replaced(c, masked_xml(xml, own or []))
        if k == "doc" and (text := _text(c)) is not None:
            return _container(_paragraph(masked_where(text, spelt or [])))
        return None

    return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in (kind, name, content, values, spellings)), strict=True)], pa.binary())


def part_rows(files: DataFrame, id_col: str = "doc_id", content: Column | None = None) -> DataFrame:
    """(id, part, xml)."""
    parts = files.select(id_col, F.explode_outer(unpack(F.col("content") if content is None else content)).alias("p")).where("p is not null")
    return parts.select(id_col, "p.part", "p.xml")
