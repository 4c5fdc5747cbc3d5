"""Inputs for the queries, made from the documents table, which holds no detections, page items or recognised words. Not operators: the same derivation stands in SQL beside the queries.

prepare() writes them once to a folder; with that folder in the session's ``quillmask.prepared`` they are read from there, so that a benchmark times the operators alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import let
from ..functions.text import escape_xml
from .containers import new_container
from .detections import DETECTIONS, explode_detections, parse_detections, to_json

#: Bytes of the documents' files for each task.
PART = 4 << 20
#: (type, pattern, what every match holds) of values taken from a document, the first match each.
TAKEN = (
    ("EMAIL", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[a-z]", "@"),
    ("CARD", r"[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}", ""),
    ("PHONE", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "+1 ("),
    ("IP", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "."),
    ("NAME", r"[A-Za-z]{10,}", ""),
    ("PAIR", r"[A-Za-z]+ [A-Za-z]+", " "),
)


_MADE: dict[str, Callable[..., DataFrame]] = {}


def prepared(make: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The input as make() derives it, or as prepare() has written it."""
    _MADE[make.__name__] = make

    @wraps(make)
    def read(spark: SparkSession, sf_dir: str, **how: bool) -> DataFrame:
        folder = spark.conf.get("quillmask.prepared", None)
        return spark.read.parquet(f"{folder}/{make.__name__}.parquet") if folder else make(spark, sf_dir, **how)

    return read


def prepare(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write all derived inputs to the folder and use them from now on."""
    for name, make in _MADE.items():
        make(spark, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark.conf.set("quillmask.prepared", folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text), dealt by document. A file's group of rows is read by one task, and what is derived here is many times the text, so tasks would be few and large; and what is made of a document's rows needs no shuffle behind this one."""
    path = f"{sf_dir}/documents.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    parts = max(min(spark.sparkContext.defaultParallelism, size >> 18), -(-size // PART), 1)
    return spark.read.parquet(path).select("doc_id", "text").repartition(parts, "doc_id")


def made_detections(text: Column, doc_id: Column) -> Column:
    """Values that are there, parts of words, repeats, strangers, stop words, empty and blank ones."""
    one = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    got = F.struct(*(F.when(F.contains(text, F.lit(held)), F.regexp_extract(text, pattern, 0)).otherwise("").alias(kind) for kind, pattern, held in TAKEN))
    fixed = [one("OTHER", F.concat(F.lit("Zyxwv "), doc_id.cast("string"))), one("STOP", F.lit("und")), one("EMPTY", F.lit("")), one("BLANK", F.lit("  "))]

    def listed(own: Column) -> Column:
        name = own.NAME
        found = [one(kind, own[kind]) for kind, *_ in TAKEN]
        found += [one("PART", F.substring(name, 3, 5)), one("NAME", name), one("NAME", F.when(name != "", F.concat(name, F.lit(" "))).otherwise(""))]
        return F.filter(F.array(*found), lambda d: d.value != "")

    return F.concat(let(got, listed), F.array(*fixed)).cast(DETECTIONS)


@prepared
def documents_with_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, raw): each document and its detections in the JSON contract."""
    docs = documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("raw", to_json(made_detections(F.col("text"), F.col("doc_id"))))


def documents_with_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): of every 50th document the JSON breaks off."""
    broken = F.col("doc_id") % 50 == 7
    return documents_with_json(spark, sf_dir).select("doc_id", F.when(broken, F.substring("raw", 1, 10)).otherwise(F.col("raw")).alias("raw"))


def documents_to_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, dets): digits full-width and fi as a ligature, in the texts only."""
    docs = documents_with_detections(spark, sf_dir)
    return docs.withColumn("text", F.replace(F.translate("text", "0123456789", "０１２３４５６７８９"), F.lit("fi"), F.lit("ﬁ")))


@prepared
def documents_with_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, dets), the detections parsed from the JSON contract."""
    return documents_with_json(spark, sf_dir).select("doc_id", "text", parse_detections(F.col("raw")).alias("dets"))


@prepared
def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_detections(documents_with_detections(spark, sf_dir).select("doc_id", "dets"))


@prepared
def page_items(spark: SparkSession, sf_dir: str, keyed: bool = False) -> DataFrame:
    """(doc_id, page, item_idx, str, x, y, width, height): words as items, lines as lines, 50 lines a page, y a little uneven within a line.

    keyed is for items that meet values by doc_id: documents without one, which meet none, are left out before they are dealt. Catalyst does that for the values; past the rows' numbers it can't here, and
    texts dealt otherwise than the values' would be shuffled a second time."""
    docs = documents(spark, sf_dir)
    line = (docs.where("doc_id is not null") if keyed else docs).select("doc_id", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line", "body"))
    words = line.select("doc_id", "line", F.monotonically_increasing_id().alias("row"), "body").select("doc_id", "line", "row", F.posexplode_outer(F.split("body", " ", -1)).alias("n", "str"))
    # a sum over the line's words so far keeps the rows where they are; behind a Python function they would be shuffled again
    so_far = F.sum(F.length("str") + 1).over(Window.partitionBy("doc_id", "row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    words = words.withColumn("at", (so_far - F.length("str") - 1).cast("int"))
    return words.select(
        "doc_id", F.floor(F.col("line") / 50).cast("int").alias("page"), (F.col("line") * 100000 + F.col("n")).alias("item_idx"), "str",
        (F.col("at") * 6.0).cast("double").alias("x"), (F.lit(800.0) - 14.0 * (F.col("line") % 50) + F.col("n") % 3).cast("double").alias("y"), (F.length("str") * 6.0).cast("double").alias("width"), F.lit(12.0).alias("height"),
    )


@prepared
def page_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, width, height): the pages of page_items(), by the number of lines."""
    last = F.floor((F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)) - 1) / 50).cast("int")
    pages = documents(spark, sf_dir).select("doc_id", F.explode(F.sequence(F.lit(0), last)).alias("page")).distinct()
    return pages.withColumns({"width": F.lit(600.0), "height": F.lit(842.0)})


@prepared
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, word_idx, text, x, y, width, height): the words of all lines in boxes, numbered through, every 13th with its second letter misread."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    placed = F.flatten(F.transform(lines, lambda body, line: F.transform(F.split(body, " ", -1), lambda w, n: F.struct(w.alias("w"), line.alias("line"), n.alias("n")))))
    each = documents(spark, sf_dir).select("doc_id", F.posexplode_outer(placed).alias("word_idx", "p")).select("doc_id", "word_idx", "p.w", "p.line", "p.n")
    wrong = (F.col("word_idx") % 13 == 12) & (F.length("w") > 4)
    text = F.when(wrong, F.concat(F.substring("w", 1, 1), F.lit("q"), F.substring("w", F.lit(3), F.length("w")))).otherwise(F.col("w"))
    return each.select("doc_id", "word_idx", text.alias("text"), (F.col("n") * 50).cast("int").alias("x"), (F.col("line") * 14 + F.col("n") % 2 + 10).cast("int").alias("y"), (F.length("w") * 6).cast("int").alias("width"), F.lit(12).alias("height"))


@prepared
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, xml, dets, text): documents as word-processor XML, a paragraph a line, runs of up to 40 characters, every 5th red."""
    xml_text = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def paragraph(line: Column) -> Column:
        pieces = F.regexp_extract_all(line, F.lit("(?s).{1,40}"), F.lit(0))
        run = lambda p, i: F.concat(F.lit("<w:r>"), F.when(i % 5 == 4, '<w:rPr><w:color w:val="FF0000"/></w:rPr>').otherwise(""), F.lit("<w:t>"), p, F.lit("</w:t></w:r>"))
        return F.concat(F.lit("<w:p>"), F.array_join(F.transform(pieces, run), ""), F.lit("</w:p>"))

    docs = documents_with_detections(spark, sf_dir)
    body = F.array_join(F.transform(F.split(xml_text, "\n", -1), paragraph), "")
    return docs.select("doc_id", F.lit("word/document.xml").alias("part"), F.concat(F.lit("<w:document><w:body>"), body, F.lit("</w:body></w:document>")).alias("xml"), "dets", "text")


#: A table in a table's cell, and a paragraph behind it in the same cell.
TABLE = (
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    "<w:p><w:r><w:t>behind</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
)


@prepared
def nested_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, part, xml, dets): documents as word-processor XML, a paragraph a line, runs of up to 7 characters, every 3rd red and bold, every 5th behind a tab. Every 4th line stands behind a table that holds another, every 11th in a content control."""

    def paragraph(line: Column, n: Column) -> Column:
        def run(piece: Column, i: Column) -> Column:
            style, tab = F.when(i % 3 == 1, '<w:rPr><w:b/><w:color w:val="FF0000"/></w:rPr>').otherwise(""), F.when(i % 5 == 4, "<w:tab/>").otherwise("")
            return F.concat(F.lit("<w:r>"), style, tab, F.lit('<w:t xml:space="preserve">'), escape_xml(piece), F.lit("</w:t></w:r>"))

        pieces = F.regexp_extract_all(line, F.lit("(?s).{1,7}"), F.lit(0))
        own = F.concat(F.lit("<w:p>"), F.array_join(F.transform(pieces, run), ""), F.lit("</w:p>"))
        held = F.when(n % 11 == 10, F.concat(F.lit("<w:sdt><w:sdtContent>"), own, F.lit("</w:sdtContent></w:sdt>"))).otherwise(own)
        return F.concat(F.when(n % 4 == 3, TABLE).otherwise(""), held)

    docs = documents_with_detections(spark, sf_dir)
    body = F.array_join(F.transform(F.split("text", "\n", -1), paragraph), "")
    return docs.select("doc_id", F.lit("word/document.xml").alias("part"), F.concat(F.lit("<w:document><w:body>"), body, F.lit("</w:body></w:document>")).alias("xml"), "dets")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, mime, content, dets): documents as files of four kinds, word-processor files with a paragraph a line, old ones with a single paragraph, the others without content that can be read here."""
    docs = documents_with_detections(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, ("docx", "doc", "pdf", "png"))), (F.col("doc_id") % 4).cast("int"))
    lines = F.transform(F.split("text", "\n", -1), lambda line: F.concat(F.lit('<w:p><w:r><w:t xml:space="preserve">'), F.replace(F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</w:t></w:r></w:p>")))
    space = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    xml = F.concat(F.lit(f'<w:document xmlns:w="{space}"><w:body>'), F.array_join(lines, ""), F.lit("</w:body></w:document>"))
    named = docs.withColumns({"_kind": kind, "_xml": xml})
    content = new_container(F.when(F.col("_kind") == "docx", F.col("_xml")), F.when(F.col("_kind") == "doc", F.coalesce("text", F.lit(""))))
    return named.select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.col("_kind")).alias("file_name"), F.lit("").alias("mime"), content.alias("content"), "dets")


def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, xml): parts with styles; of every third document without a size."""
    size = F.concat(F.lit('<w:rPrDefault><w:rPr><w:rFonts w:ascii="A"/><w:sz w:val="'), (20 + F.col("doc_id") % 9).cast("string"), F.lit('"/></w:rPr></w:rPrDefault>'))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("<w:styles><w:docDefaults>"), F.when(F.col("doc_id") % 3 != 0, size).otherwise("<w:rPrDefault/>"), F.lit('</w:docDefaults><w:style><w:rPr><w:sz w:val="99"/></w:rPr></w:style></w:styles>')).alias("xml"))


__all__ = ["parse_detections", "detection_rows", "documents", "documents_with_detections", "documents_with_json", "files", "nested_parts", "page_items", "page_sizes", "prepare", "recognised_words", "styles", "word_parts"]
