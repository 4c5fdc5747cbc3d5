"""Supplied detections: the JSON contract, and the same as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DETECTIONS = "array<struct<type:string,value:string>>"


def is_json(raw: Column) -> Column:
    """Whether a text is one JSON value and nothing else. The parser stops behind a first value, so the text is read inside a list and inside an object: what follows a value can't be right in both."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), raw, F.lit(b))).isNotNull()
    return inside("[", "]") & inside('{"a":', "}")


def parse_detections(raw: Column) -> Column:
    """``{"pii": [{"type", "value"}, ...]}`` to an array; a missing value is the empty string, any other shape of ``pii`` no detections. Text that isn't JSON raises."""
    parsed = F.from_json(raw, "struct<pii:string,bad:string>", {"columnNameOfCorruptRecord": "bad"})
    checked = F.when(raw.isNotNull() & ~is_json(raw), F.raise_error(F.lit("the detections are not JSON")).cast(DETECTIONS))
    items = F.when(F.startswith(F.ltrim(parsed["pii"]), F.lit("[")), F.from_json(parsed["pii"], DETECTIONS))
    whole = F.transform(F.coalesce(items, F.array().cast(DETECTIONS)), lambda d: F.struct(d.type.alias("type"), F.coalesce(d.value, F.lit("")).alias("value")))
    return F.coalesce(checked, whole)


def quarantine(df: DataFrame, raw_col: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Records whose detections are JSON, with ``dets`` in place of raw_col, and those whose detections aren't, as they came, with ``error``. Nothing fails; a record is in one of the two. A null text is no detections.

    The permissive parser puts a text that it can't read into its column for corrupt records, but for one in which more than a value stands.
    """
    parsed = F.from_json(F.col(raw_col), "struct<pii:string,bad:string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"})
    bad = F.col(raw_col).isNotNull() & ~is_json(F.col(raw_col))
    read = df.where(~bad)
    error = F.when(parsed["bad"].isNotNull(), "not JSON").otherwise("more than one JSON value")
    rest = [c for c in df.columns if c != raw_col]
    return read.select(*rest, parse_detections(F.col(raw_col)).alias("dets")), df.where(bad).withColumn("error", error)


def to_json(dets: Column) -> Column:
    """An array of detections in the contract's form."""
    return F.to_json(F.struct(dets.alias("pii")))


def explode_detections(df: DataFrame, dets: str = "dets") -> DataFrame:
    """A row for each detection, numbered from 0 in the order of its list."""
    rest = [c for c in df.columns if c != dets]
    return df.select(*rest, F.posexplode_outer(dets).alias("det_idx", "d")).where("det_idx is not null").select(*rest, "det_idx", F.col("d.type").alias("type"), F.col("d.value").alias("value"))


def nest_detections(docs: DataFrame, detections: DataFrame) -> DataFrame:
    """docs with a column ``dets`` from rows (doc_id, det_idx, type, value): one shuffle on doc_id, after which everything is by row."""
    item = F.struct("det_idx", "type", F.coalesce("value", F.lit("")).alias("value"))
    nested = detections.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda d: F.struct(d.type.alias("type"), d.value.alias("value"))).alias("dets"))
    return docs.join(nested, "doc_id", "left").withColumn("dets", F.coalesce("dets", F.array().cast(DETECTIONS)))
