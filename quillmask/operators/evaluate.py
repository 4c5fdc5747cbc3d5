"""Evaluation of supplied detections against their document.

A document's detections stand nested beside its text, so the whole evaluation is a projection: no shuffle, whatever the size, and it runs over a stream as it does over a table. Rules that
look like joins and groupings (duplicates by trimmed value, occurrences by value) are within one document and are taken over the nested array.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions import text as T
from ..functions.edits import close_windows, distance
from ..functions.normal import with_masked_originals
from ..functions.spans import SPANS, by_portions, hits_around, portions

FOUND = "array<struct<s:int,e:int,good:boolean,around:string>>"


def hits_of(text: Column, value: Column, found: Column, stream: Column | None = None) -> Column:
    """found, the value's exact hits; for a value shaped like a phone number a single hit at -1 if its digits stand in the document's digit stream."""
    value_stream = T.normalize_phone(value)
    in_stream = (value_stream != "") & F.contains(T.normalize_phone(text) if stream is None else stream, value_stream)
    unknown = F.array(F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), F.lit(True).alias("good"), F.lit(None).cast("string").alias("around")))
    return F.when(T.is_phone(value), F.when(in_stream, unknown).otherwise(F.array().cast(FOUND))).otherwise(found)


def good_hits(value: Column, hits: Column) -> Column:
    """Hits without a place, between token boundaries, or of an e-mail address."""
    return F.filter(hits, lambda h: (h.s == -1) | T.is_email(value) | h.good)


def near_places(text: str, value: str, least: float = 0.7, most: int = 3) -> list[str]:
    """The first segments of the value's length and four more that are similar to it (the last ones are shorter); none for an empty value or one that the text holds."""
    n, size = len(value), len(text)
    if not n or size < n or value in text:
        return []
    out: list[str] = []
    # whole segments differ by four insertions at the least, so short values can only match at the end
    allowed = max(k for k in range(n + 5) if 1.0 - k / (n + 4) >= least)
    if allowed >= 4:
        out = [text[p : p + n + 4] for p in islice(close_windows(text, value, n + 4, allowed), most)]
    for p in range(max(0, size - n - 3), size - n + 1):
        if len(out) < most and 1.0 - distance(value, text[p:]) / max(n, size - p) >= least:
            out.append(text[p:])
    return out


@F.arrow_udf(ArrayType(ArrayType(StringType())))
@by_portions
def near_each(text: pa.Array, values: pa.Array) -> pa.Array:
    """For each value its near misses in the text."""
    return pa.array([[near_places(t or "", v or "") for v in own or ()] for t, own in zip(text.to_pylist(), values.to_pylist(), strict=True)], pa.list_(pa.list_(pa.string())))


def with_found(docs: DataFrame, text_col: str, normalize: bool, suggest: bool) -> DataFrame:
    """docs with the text, ``_values`` and ``_keys`` normalised, ``_found`` (each value's occurrences) and, with suggest, ``_near`` (its near misses).

    All that walks along the text is one step, so that a task has a single worker for it, which holds a portion of its batch as objects. As a function for each of the columns it was five workers a task, each with a batch of its own.
    """
    found, near = ArrayType(ArrayType(StructType().add("s", "integer").add("e", "integer").add("good", "boolean").add("around", "string"))), ArrayType(ArrayType(StringType()))
    schema = StructType([*docs.schema.fields]).add("_found", found)
    schema = schema.add("_near", near) if suggest else schema

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole)):
            columns, names = [*batch.columns], [*batch.schema.names]
            t, v, k = (names.index(c) for c in (text_col, "_values", "_keys"))
            texts, values, keys = (columns[i].to_pylist() for i in (t, v, k))
            if normalize:
                texts, values, keys = [T.nfkc_of(x) for x in texts], [[T.nfkc_of(x) for x in own] for own in values], [[T.nfkc_of(x) for x in own] for own in keys]
                columns[t], columns[v], columns[k] = pa.array(texts, pa.string()), pa.array(values, pa.list_(pa.string())), pa.array(keys, pa.list_(pa.string()))
            columns.append(hits_around(texts, values, 14 if suggest else None, True))
            if suggest:
                columns.append(pa.array([[near_places(x, y) for y in own] for x, own in zip(texts, values, strict=True)], pa.list_(pa.list_(pa.string()))))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(find, schema)


def evaluate(docs: DataFrame, normalize: bool = True, suggest: bool = True, text_col: str = "text", dets_col: str = "dets") -> DataFrame:
    """docs with ``results`` (one for each detection, in order) and ``duplicates``.

    results: array<struct<det_idx, type, value, bucket, status, hits, notes>>; bucket is ``matched``, ``partials`` or ``notFound``, status ``exact`` or ``partial`` where matched. Offsets are those of the
    normalised text, which is returned as ``text``. duplicates: array<struct<value, count_in_json, count_in_doc, extra>>. normalize=False takes text and values as normalised already;
    suggest=False leaves the near-miss searches out.
    """
    dets = F.coalesce(F.col(dets_col), F.array().cast("array<struct<type:string,value:string>>"))
    base = docs.withColumns({text_col: F.coalesce(F.col(text_col), F.lit("")), "_dets": dets})
    values = F.transform("_dets", lambda d: F.coalesce(d.value, F.lit("")))
    keys = F.transform("_dets", lambda d: T.trim_ws(F.coalesce(d.value, F.lit(""))))
    # contexts are only looked at where no hit counts
    base = with_found(base.withColumns({"_values": values, "_keys": keys}), text_col, normalize, suggest).withColumn("_stream", T.normalize_phone(F.col(text_col)))
    text, stream = F.col(text_col), F.col("_stream")

    def first(d: Column, i: Column) -> Column:
        v = F.get("_values", i)
        hits = hits_of(text, v, F.get("_found", i), stream)
        return F.struct(d.type.alias("type"), F.coalesce(d.value, F.lit("")).alias("raw"), v.alias("v"), F.get("_keys", i).alias("key"), hits.alias("all"), good_hits(v, hits).alias("good"))

    base = base.withColumn("_first", F.transform("_dets", first))
    distinct = F.array_distinct(F.col("_first.key"))

    def counted(key: Column) -> Column:
        listed = F.size(F.filter("_first", lambda x: x.key == key))
        held = F.aggregate(F.filter("_first", lambda x: x.v == key), F.lit(0), lambda a, x: a + F.size(x.good))
        return F.struct(key.alias("value"), listed.alias("count_in_json"), held.alias("count_in_doc"), (listed - held).alias("extra"))

    base = base.withColumn("duplicates", F.filter(F.transform(distinct, counted), lambda d: d.extra > 0))

    def second(x: Column, i: Column) -> Column:
        empty, lost, weak = x.v == "", F.size(x["all"]) == 0, F.size(x.good) == 0
        bucket = F.when(empty | lost, "notFound").when(weak, "partials").otherwise("matched")
        status = F.when(bucket == "matched", F.when(F.exists(x.good, lambda h: h.s == -1), "partial").otherwise("exact"))
        none = F.lit(None).cast("string")
        quoted = lambda near: F.array_join(F.transform(near, lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ", ")
        if suggest:
            near = F.get("_near", i)
            missing = F.when(F.size(near) > 0, F.concat(F.lit("Not found; nearest text candidates: "), quoted(near), F.lit(".")))
            around = F.filter(F.transform(x["all"], lambda h: h.around), lambda w: T.similarity(x.v, w) >= 0.75)
            close = F.when((bucket == "partials") & (F.size(around) > 0), F.concat(F.lit("Partial match near “…"), F.get(around, F.lit(0)), F.lit("…”. Consider boundary/spacing/diacritics issues.")))
        else:
            missing = close = none
        own = (
            F.when(empty, "Empty value in JSON.")
            .when(lost, missing)
            .when(weak, "Found only as a substring (token boundary mismatch).")
            .when(F.size(x.good) > 1, F.concat(F.lit("Appears "), F.size(x.good).cast("string"), F.lit(" times in document.")))
        )
        dup = F.get(F.filter("duplicates", lambda d: d.value == x.key), F.lit(0))
        nth = F.size(F.filter(F.slice("_first", F.lit(1), i), lambda y: y.key == x.key))
        extra = F.when(nth >= dup.count_in_doc, F.concat(F.lit("Duplicate: JSON lists "), dup.count_in_json.cast("string"), F.lit(", but document has "), dup.count_in_doc.cast("string"), F.lit(".")))
        return F.struct(
            i.cast("int").alias("det_idx"), x.type.alias("type"), x.raw.alias("value"), bucket.alias("bucket"), status.alias("status"),
            F.when(bucket == "matched", F.transform(x.good, lambda h: F.struct(h.s.alias("s"), h.e.alias("e")))).otherwise(F.array().cast(SPANS)).alias("hits"), F.array_compact(F.array(own, extra, close)).alias("notes"),
        )

    base = base.withColumn("results", F.transform("_first", second))
    return base.drop("_dets", "_values", "_keys", "_stream", "_found", "_near", "_first")


def mask_evaluated(docs: DataFrame, text_col: str = "text", dets_col: str = "dets") -> DataFrame:
    """docs evaluated, with ``text`` as it came and ``masked_text``: the same with the hits of matched detections masked. What was found in the normalised text is masked where it came from."""
    out = evaluate(docs.withColumn("_came", F.coalesce(F.col(text_col), F.lit(""))), suggest=False, text_col=text_col, dets_col=dets_col)
    hits = F.flatten(F.transform(F.filter("results", lambda r: r.bucket == "matched"), lambda r: r.hits))
    out = out.withColumn(text_col, F.col("_came")).drop("_came").withColumn("_hits", hits)
    return with_masked_originals(out, text_col, "_hits", "masked_text")


def result_rows(evaluated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each detection."""
    return evaluated.select(id_col, F.explode_outer("results").alias("r")).where("r is not null").select(id_col, "r.*")


def duplicate_rows(evaluated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return evaluated.select(id_col, F.explode_outer("duplicates").alias("d")).where("d is not null").select(id_col, "d.*")


def occurrence_rows(evaluated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row for each kept hit, once for every detection that has it."""
    return result_rows(evaluated, id_col).select(id_col, "det_idx", "value", F.explode_outer("hits").alias("h")).where("h is not null").select(id_col, "det_idx", "value", "h.s", "h.e", (F.col("h.s") == -1).alias("normalized"))
