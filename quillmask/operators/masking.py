"""Masked text: by ranges of all detections, or value by value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import mask_each, mask_spans, marked


def wanted_values(dets: Column) -> Column:
    """The detections' values, trimmed, without blank ones, in order."""
    return F.filter(F.transform(dets, lambda d: T.trim_ws(F.coalesce(d.value, F.lit("")))), lambda v: v != "")


def masked_ranges(text: Column, dets: Column) -> Column:
    """Where any value or white space variant of one stands, merged."""
    return marked(text, F.flatten(F.transform(wanted_values(dets), T.variants)))


def mask_documents(docs: DataFrame, text_col: str = "text", dets_col: str = "dets") -> DataFrame:
    """docs with ``ranges`` and ``masked_text``: same length, white space where it was. Null texts are empty; a projection, so it runs over streams as well."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dets = F.coalesce(F.col(dets_col), F.array().cast("array<struct<type:string,value:string>>"))
    return docs.withColumn("ranges", masked_ranges(text, dets)).withColumn("masked_text", mask_spans(text, F.col("ranges")))


def mask_documents_each(docs: DataFrame, text_col: str = "text", dets_col: str = "dets") -> DataFrame:
    """docs with ``masked_text``: value after value, exact spelling only, earlier masks counting for later values."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    dets = F.coalesce(F.col(dets_col), F.array().cast("array<struct<type:string,value:string>>"))
    return docs.withColumn("masked_text", mask_each(text, wanted_values(dets)))
