"""Files: reading them with their kind, text extraction by kind, and the names and sinks of what comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import document_text

# Kinds by extension and by media type.
IMAGES = ("jpg", "jpeg", "png", "gif", "bmp", "tiff", "webp")
DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
DOC_TYPE, PDF_TYPE = "application/msword", "application/pdf"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, file_name, mime, content): binary files; the content is only read where it is used."""
    reader = spark.read.format("binaryFile")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.lit("").alias("mime"), "content")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def file_type(name: Column, mime: Column, strict: bool = True) -> Column:
    """docx, doc, pdf or image, by extension first and then by media type. Anything else raises, or is null if not strict."""
    low, kind = F.lower(name), F.lower(F.coalesce(mime, F.lit("")))
    has = lambda ext: F.endswith(low, F.lit(f".{ext}"))
    image = F.startswith(kind, F.lit("image/"))
    for ext in IMAGES:
        image = image | has(ext)
    found = (
        F.when(has("docx"), "docx").when(has("doc"), "doc").when(has("pdf"), "pdf").when(image, "image")
        .when(F.contains(kind, F.lit("wordprocessingml")), "docx").when(F.contains(kind, F.lit("msword")), "doc").when(F.contains(kind, F.lit("pdf")), "pdf")
    )
    return found.otherwise(F.raise_error(F.concat(F.lit("unsupported file type: "), name)).cast("string")) if strict else found


def media_type(name: Column, mime: Column) -> Column:
    """The given type; where there is none, the extension's for documents. In lower case where the extension says nothing."""
    low, given = F.lower(name), F.coalesce(mime, F.lit(""))
    default = lambda ext, kind: F.when(F.endswith(low, F.lit(f".{ext}")), F.coalesce(F.nullif(given, F.lit("")), F.lit(kind)))
    image = F.lit(False)
    for ext in IMAGES:
        image = image | F.endswith(low, F.lit(f".{ext}"))
    return F.coalesce(default("docx", DOCX_TYPE), default("doc", DOC_TYPE), default("pdf", PDF_TYPE), F.when(image, given), F.lower(given))


def is_image(name: Column, mime: Column) -> Column:
    return F.coalesce(file_type(name, mime, strict=False) == "image", F.lit(False))


def output_name(name: Column) -> Column:
    """name_MASKED.ext, with png for images and the last extension in lower case for others."""
    ext = F.lower(F.element_at(F.split(name, r"\."), -1))
    return F.concat(F.regexp_replace(name, r"\.[^/.]+\z", ""), F.lit("_MASKED."), F.when(is_image(name, F.lit("")), "png").otherwise(ext))


def extract(files: DataFrame, pdf_texts: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, text, file_type, is_scanned): documents by kind in one pass. pdf_texts (id, text, is_scanned) are what operators.pages.document_text makes of a PDF reader's items; PDF files without a row there
    and images are scans without text. Word files that can't be read have a null text."""
    typed = files.withColumn("file_type", file_type(F.col("file_name"), F.col("mime")))
    word = F.col("file_type").isin("docx", "doc")
    # the UDF sees no content but that of word files
    out = typed.select(id_col, "file_type", F.when(word, document_text(F.when(word, F.col("content")))).alias("_word"))
    if pdf_texts is None:
        pdf = out.withColumns({"_pdf": F.lit(None).cast("string"), "_scan": F.lit(True)})
    else:
        pdf = out.join(pdf_texts.select(id_col, F.col("text").alias("_pdf"), F.col("is_scanned").alias("_scan")), id_col, "left")
    text = F.when(word, F.col("_word")).when(F.col("file_type") == "pdf", F.coalesce("_pdf", F.lit(""))).otherwise("")
    scan = F.when(word, False).when(F.col("file_type") == "pdf", F.coalesce("_scan", F.lit(True))).otherwise(True)
    return pdf.select(id_col, text.alias("text"), "file_type", scan.alias("is_scanned"))


def write_contents(files: DataFrame, folder: str) -> None:
    """A table of (file_name, content) as Parquet, by kind of file; the sink for rewritten documents at scale. Single files are a matter of whoever serves them."""
    files.withColumn("kind", F.element_at(F.split("file_name", r"\."), -1)).write.mode("overwrite").partitionBy("kind").parquet(folder)
