"""Masking of whole files by kind: unpacked, masked and packed again in one pass over the files, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import containers
from ..sources.files import file_type, output_name
from . import images, masking, pages, word_files


def default_font_sizes(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, half_pts): the default font size that a word-processor file names, null without one."""
    return files.select(id_col, word_files.default_half_points(containers.styles_part("content")).alias("half_pts"))


def mask_files(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, file_type, output_name, content) of files (id, file_name, mime, content, dets).

    docx: the main part is masked value by value and put back, all other parts stay; a container without one is an error. doc: its text is masked by ranges and comes back as a new one-paragraph docx container, null if
    it can't be read. pdf and image: content is null, as their pixels and operators are drawn elsewhere; mask_images() and pages.rectangles() say what to cover.
    """
    values = masking.wanted_values(F.col("dets"))
    kind = F.col("file_type")
    typed = files.withColumn("file_type", file_type(F.col("file_name"), F.col("mime"))).withColumn("_values", values)
    # only files that can be masked here reach the function
    word = kind.isin("docx", "doc")
    packed = containers.masked_content(kind, F.col("file_name"), F.when(word, F.col("content")), F.col("_values"), F.when(kind == "doc", F.flatten(F.transform("_values", T.variants))))
    return typed.select(id_col, "file_type", output_name(F.col("file_name")).alias("output_name"), packed.alias("content"))


def mask_images(pictures: DataFrame, words: DataFrame, detections: DataFrame) -> DataFrame:
    """(doc_id, det_idx, value, x, y, width, height): what to cover in each picture (doc_id): the boxes of the words that match, and where the recogniser returned no word at all, a placeholder for each detection."""
    seen = words.select("doc_id").distinct()
    boxes = images.cover(images.match_words(words.join(pictures.select("doc_id"), "doc_id", "left_semi"), detections))
    blind = pictures.select("doc_id").join(seen, "doc_id", "left_anti")
    rest = pages.fallback_rectangles(detections.join(blind, "doc_id", "left_semi"))
    return boxes.select(*rest.columns).unionByName(rest)
