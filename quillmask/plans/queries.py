"""The engine's queries over the driver's tables, one for each group of operators, with the SQL of those that SQL can express.

Computed arrays are exploded with the outer form and empty ones filtered out behind it: before the plain form Catalyst puts a filter on the array's size, which would compute the array twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.spans import find_all, find_variants, located
from ..operators import evaluate as E
from ..operators import file_masking, images, masking, pages, report, word_files, word_tree
from ..sources import containers, detections, files, harness
from ..streaming import assembly

Query = Callable[[SparkSession, str], DataFrame]


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    exts = ["docx", "doc", "PDF", "jpg", "tif", "TIFF", "x.png", "webp"]
    docs = harness.documents(spark, sf_dir)
    at = (F.col("doc_id") % 8).cast("int")
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.lit("."), F.get(F.array(*map(F.lit, exts)), at))
    mime = F.when(at == 4, "image/tiff").otherwise("")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), name.alias("name"), mime.alias("mime"))
    kind = files.file_type(F.col("name"), F.col("mime"), strict=False)
    return docs.select("doc_id", kind.alias("file_type"), files.media_type(F.col("name"), F.col("mime")).alias("media_type"), files.is_image(F.col("name"), F.col("mime")).alias("is_image"), files.output_name(F.col("name")).alias("output_name"), pages.is_scanned(F.col("text"), F.lit(1)).alias("is_scanned"))


def parse_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.detection_rows(spark, sf_dir)


def scalar_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return harness.detection_rows(spark, sf_dir).select(
        "doc_id", "det_idx", T.normalize_phone(v).alias("phone_digits"), T.is_email(v).alias("is_email"), T.is_phone(v).alias("is_phone"), T.is_strict_card(v).alias("is_strict_card"),
        T.is_card_or_iban(v).alias("is_card_or_iban"), F.round(T.digit_ratio(v), 6).alias("digit_ratio"), F.size(T.variants(v)).cast("long").alias("n_variants"), T.is_stop_word(v).alias("is_stop_word"), T.mask(v).alias("masked"),
        T.overlay_text(F.length(v) * 6.0).alias("overlay"), T.escape_xml(v).alias("escaped"),
    )


def _each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, det_idx, type, value): the text is carried along a projection, not through a shuffle."""
    docs = harness.documents_with_detections(spark, sf_dir)
    return docs.select("doc_id", "text", F.posexplode_outer("dets").alias("det_idx", "d")).where("det_idx is not null").select("doc_id", "text", "det_idx", F.col("d.type").alias("type"), F.col("d.value").alias("value"))


def find_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _each(spark, sf_dir).select("doc_id", "det_idx", "value", F.explode_outer(find_all(F.col("text"), F.col("value"))).alias("h")).where("h is not null")
    return hits.select("doc_id", "det_idx", "value", "h.s", "h.e")


def find_variant_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _each(spark, sf_dir).where(T.trim_ws(F.col("value")) != "").select("doc_id", "det_idx", F.explode_outer(find_variants(F.col("text"), T.trim_ws(F.col("value")))).alias("h")).where("h is not null")
    return hits.select("doc_id", "det_idx", "h.s", "h.e")


def token_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = harness.documents_with_detections(spark, sf_dir).withColumn("hits", located(14)(F.col("text"), F.transform("dets", lambda d: d.value)))
    each = docs.select("doc_id", F.posexplode_outer("hits").alias("det_idx", "own")).select("doc_id", "det_idx", F.explode_outer("own").alias("h")).where("h is not null")
    return each.select("doc_id", "det_idx", "h.s", F.col("h.good").alias("at_boundary"), "h.around")


def phone_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    phones = _each(spark, sf_dir).where(T.is_phone(F.col("value")))
    return phones.select("doc_id", "det_idx", "value", (F.size(E.hits_of(F.col("text"), F.col("value"), F.array().cast(E.FOUND))) > 0).alias("in_stream"))


def _evaluated(spark: SparkSession, sf_dir: str, suggest: bool = False) -> DataFrame:
    """Searches for near misses only where the result shows them."""
    return E.evaluate(harness.documents_with_detections(spark, sf_dir), suggest=suggest)


def eval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.result_rows(_evaluated(spark, sf_dir)).select("doc_id", "det_idx", "bucket", "status", F.size("hits").cast("long").alias("n_hits"))


def eval_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with ligatures and full-width digits: found in the normalised text, masked in the text as it came."""
    return E.mask_evaluated(harness.documents_to_normalise(spark, sf_dir)).select("doc_id", "masked_text")


def eval_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicates as evaluated over streams: each document's detections arrive in parts of four, beside the documents."""
    docs = harness.documents_with_detections(spark, sf_dir)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 1000).alias("at")
    of = F.greatest(F.lit(1), F.ceil(F.size("dets") / 4).cast("int"))
    part = F.explode(F.transform(F.sequence(F.lit(0), of - 1), lambda i: F.struct(i.alias("part"), of.alias("of"), detections.to_json(F.slice("dets", 4 * i + 1, F.lit(4))).alias("raw"))))
    parts = docs.select("doc_id", at, part.alias("p")).select("doc_id", "at", "p.*")
    return E.duplicate_rows(assembly.evaluate_arrivals(docs.select("doc_id", "text", at), parts)).select("doc_id", "value", *(F.col(c).cast("long").alias(c) for c in ("count_in_json", "count_in_doc", "extra")))


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections of all records that can be read, and the records that can't, at -1, side by side."""
    read, broken = detections.quarantine(harness.documents_with_damage(spark, sf_dir))
    return detections.explode_detections(read).unionByName(broken.select("doc_id", F.lit(-1).alias("det_idx"), "raw", "error"), allowMissingColumns=True)


def eval_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.occurrence_rows(_evaluated(spark, sf_dir)).select("doc_id", "det_idx", "s", "e", "normalized")


def eval_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.duplicate_rows(_evaluated(spark, sf_dir))
    return out.select("doc_id", "value", *(F.col(c).cast("long").alias(c) for c in ("count_in_json", "count_in_doc", "extra")))


def eval_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.result_rows(_evaluated(spark, sf_dir, suggest=True)).select("doc_id", "det_idx", F.array_join("notes", " | ").alias("notes"))


def near_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = E.result_rows(_evaluated(spark, sf_dir, suggest=True))
    return out.select("doc_id", "det_idx", "bucket", F.array_join("notes", " | ").alias("notes"))


def merge_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = harness.documents_with_detections(spark, sf_dir)
    return docs.select("doc_id", F.explode_outer(masking.masked_ranges(F.col("text"), F.col("dets"))).alias("r")).where("r is not null").select("doc_id", "r.s", "r.e")


def mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = masking.mask_documents(harness.documents_with_detections(spark, sf_dir))
    return out.select("doc_id", F.size("ranges").cast("long").alias("n_ranges"), "masked_text")


def mask_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masking.mask_documents_each(harness.documents_with_detections(spark, sf_dir)).select("doc_id", "masked_text")


def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.distinct_values(harness.detection_rows(spark, sf_dir))
    return out.select("doc_id", "det_idx", "type", "value", T.is_stop_word(F.col("value")).alias("is_stop_word"))


def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.document_text(harness.page_items(spark, sf_dir))


def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.line_rows(harness.page_items(spark, sf_dir))
    return out.select("doc_id", "page", "line_id", F.size("items").cast("long").alias("n_items"), "text")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.match_lines(pages.line_rows(harness.page_items(spark, sf_dir, keyed=True)), harness.detection_rows(spark, sf_dir))


def pdf_line_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("doc_id", "page", "value", "det_idx", "line_id", "tier")


def pdf_page_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_counts(_matched(spark, sf_dir))


def pdf_item_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.match_items(_matched(spark, sf_dir))
    return out.select("doc_id", "page", "value", "how", F.array_join(F.col("found.str"), "|").alias("found"))


def pdf_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.rectangles(_matched(spark, sf_dir))


def pdf_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.overlays(_matched(spark, sf_dir), harness.page_sizes(spark, sf_dir))


def pdf_position_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.position_rectangles(pages.page_positions(harness.page_items(spark, sf_dir, keyed=True), harness.page_sizes(spark, sf_dir)), harness.detection_rows(spark, sf_dir))


def scanned_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.scan_rectangles(harness.page_sizes(spark, sf_dir), harness.detection_rows(spark, sf_dir))


def image_fallback_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.fallback_rectangles(harness.detection_rows(spark, sf_dir))


def ocr_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.cover(images.match_words(harness.recognised_words(spark, sf_dir), harness.detection_rows(spark, sf_dir)))


def reviewed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _evaluated(spark, sf_dir).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    return report.review_document(named, half_pts=F.lit(22))


def reviewed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewed documents as word-processor files, and their text as it is read again."""
    order = F.array_position(F.array(*map(F.lit, ("heading", "body", "appendix_heading", "appendix"))), F.col("part"))
    return report.as_documents(reviewed_runs(spark, sf_dir), order).select("doc_id", containers.document_text("content").alias("text"))


def reviewed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = harness.documents_with_json(spark, sf_dir)
    parsed = docs.withColumn("dets", harness.parse_detections(F.col("raw")))
    return report.review_json(E.evaluate(parsed))


def reviewed_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reviewed JSON as word-processor files, and their text as it is read again."""
    docs = harness.documents_with_json(spark, sf_dir).withColumn("name", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".json")))
    evaluated = E.evaluate(docs.withColumn("dets", harness.parse_detections(F.col("raw"))))
    return report.json_documents(evaluated).select("doc_id", containers.document_text("content").alias("text"))


def docx_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_files.mask_parts(harness.word_parts(spark, sf_dir)).select("doc_id", "part", "xml")


def docx_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = harness.word_parts(spark, sf_dir)
    return parts.select("doc_id", word_files.annotate_xml(F.col("xml"), F.col("text"), F.transform("dets", lambda d: d.value)).alias("xml"))


def docx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_tree.run_rows(harness.nested_parts(spark, sf_dir))


def docx_styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit of the detections styled, over as many runs as it reaches."""
    return word_tree.style_parts(harness.nested_parts(spark, sf_dir), F.transform("dets", lambda d: d.value)).select("doc_id", "xml")


def file_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.extract(harness.files(spark, sf_dir), pages.document_text(harness.page_items(spark, sf_dir)))


def mask_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked files' names, and their text as it is read again."""
    out = file_masking.mask_files(harness.files(spark, sf_dir))
    return out.select("doc_id", "file_type", "output_name", containers.document_text("content").alias("text"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_text(harness.page_items(spark, sf_dir), " ")


def font_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.styles(spark, sf_dir).select("doc_id", word_files.default_half_points(F.col("xml")).alias("half_pts"))


def red_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's markup names a red colour, and whether its first colour is one."""
    xml = F.col("xml")
    return harness.word_parts(spark, sf_dir).select("doc_id", T.is_red_xml(xml).alias("has_red"), T.is_red(F.lower(F.regexp_extract(xml, '<w:color w:val="([^"]*)"', 1))).alias("first_is_red"))


def image_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all documents; in those of an empty line alone the recogniser finds no word."""
    docs = harness.documents(spark, sf_dir).select("doc_id")
    return file_masking.mask_images(docs, harness.recognised_words(spark, sf_dir).where(F.col("text") != ""), harness.detection_rows(spark, sf_dir))


QUERIES: dict[str, Query] = {
    "file_kinds": file_kinds, "parse_detections": parse_detections, "scalar_predicates": scalar_predicates, "find_all": find_all_hits, "find_all_variants": find_variant_hits, "token_boundary": token_boundary, "phone_match": phone_match,
    "eval_status": eval_status, "eval_masked": eval_masked, "eval_streamed": eval_streamed, "quarantined": quarantined, "eval_occurrences": eval_occurrences, "eval_duplicates": eval_duplicates, "eval_notes": eval_notes, "near_miss": near_miss, "merge_ranges": merge_ranges, "mask_text": mask_text,
    "mask_sequential": mask_sequential, "distinct_values": distinct_values, "pdf_text": pdf_text, "pdf_lines": pdf_lines, "pdf_line_match": pdf_line_match, "pdf_page_counts": pdf_page_counts, "pdf_item_match": pdf_item_match, "pdf_rects": pdf_rects,
    "pdf_overlays": pdf_overlays, "pdf_position_rects": pdf_position_rects, "scanned_rects": scanned_rects, "image_fallback_rects": image_fallback_rects, "ocr_boxes": ocr_boxes, "reviewed_runs": reviewed_runs, "reviewed_json": reviewed_json, "reviewed_files": reviewed_files, "reviewed_json_files": reviewed_json_files,
    "docx_mask": docx_mask, "docx_annotate": docx_annotate, "docx_runs": docx_runs, "docx_styled": docx_styled, "file_texts": file_texts, "mask_files": mask_files, "page_texts": page_texts, "font_sizes": font_sizes, "red_marks": red_marks, "image_masks": image_masks,
}
