"""Literal edge cases, expected values by hand (FIXTURES.md, section 3)."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmask.functions import spans as S
from quillmask.functions import text as T
from quillmask.operators import evaluate, images, masking, pages, report, word_files
from quillmask.sources import containers, detections, files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], [*values] or ["x"])
    return row.select(column.alias("out")).first()["out"]


def pairs(found):
    return [(h["s"], h["e"]) for h in found]


@pytest.mark.parametrize(
    ("text", "value", "want"),
    [("aaaa", "aa", [(0, 2), (2, 4)]), ("abc", "", []), ("a\\Eb\\E", "\\E", [(1, 3), (4, 6)]), ("x(y)(y)", "(y)", [(1, 4), (4, 7)]), ("", "a", []), ("a😀b😀", "😀", [(1, 2), (3, 4)])],
)
def test_find_all(spark, text, value, want):
    assert pairs(one(spark, S.find_all(F.col("t"), F.col("v")), t=text, v=value)) == want


def test_variants_and_merge(spark):
    assert pairs(one(spark, S.find_variants(F.col("t"), F.col("v")), t="AnnLee Ann Lee", v="Ann Lee")) == [(0, 6), (7, 14)]
    ranges = F.array(*(S.span(F.lit(s), F.lit(e)) for s, e in ((6, 7), (1, 3), (3, 4))))
    assert pairs(one(spark, S.merge_spans(ranges))) == [(1, 4), (6, 7)]
    assert one(spark, S.greedy(F.array(*map(F.lit, (0, 1, 2, 5, 6, 9))), F.lit(2))) == [0, 2, 5, 9]


def test_masks(spark):
    assert one(spark, T.mask(F.col("v")), v="Ann Lee-1") == "XXX XXXXX"
    det = [{"type": "N", "value": "Ann Lee"}, {"type": "N", "value": "Lee"}]
    docs = spark.createDataFrame([(1, "Ann Lee met Lee", det), (2, None, det), (3, "x", None)], f"doc_id int, text string, dets {detections.DETECTIONS}")
    assert [r.masked_text for r in masking.mask_documents_each(docs).orderBy("doc_id").collect()] == ["XXX XXX met XXX", "", "x"]
    assert [r.masked_text for r in masking.mask_documents(docs).orderBy("doc_id").collect()] == ["XXX XXX met XXX", "", "x"]


@pytest.mark.parametrize(
    ("expr", "value", "want"),
    [(T.is_phone, "2024-10-12", True), (T.is_phone, "123456\n", False), (T.is_card_or_iban, "DEUTSCHE BANK", True), (T.is_stop_word, "FÜR", True), (T.is_strict_card, "1234 5678 9012 3456", True), (T.is_email, "a@b", True)],
)
def test_predicates(spark, expr, value, want):
    assert one(spark, expr(F.col("v")), v=value) is want


def test_boundary(spark):
    hits = F.get(S.located()(F.col("t"), F.array("v")), 0)
    assert pairs(one(spark, evaluate.good_hits(F.col("v"), hits), t="anna ann,", v="ann")) == [(5, 8)]


def evaluated(spark, text, values, **options):
    docs = spark.createDataFrame([(1, text, [{"type": "T", "value": v} for v in values])], f"doc_id int, text string, dets {detections.DETECTIONS}")
    return evaluate.evaluate(docs, **options).first()


def test_evaluation(spark):
    r = evaluated(spark, "id 12 then 3456", ["123456"]).results[0]
    assert (r.bucket, r.status, r.hits[0].s) == ("matched", "partial", -1)
    r = evaluated(spark, "xa@b.coy", ["a@b.co"]).results[0]
    assert (r.bucket, r.status) == ("matched", "exact")
    assert evaluated(spark, "Ann", ["Ann", "Ann"]).duplicates == []
    assert [tuple(d) for d in evaluated(spark, "Bob", ["Ann"]).duplicates] == [("Ann", 1, 0, 1)]
    assert [tuple(d) for d in evaluated(spark, "Ann x", ["Ann", "Ann "]).duplicates] == [("Ann", 2, 1, 1)]
    r = evaluated(spark, "x", [""]).results[0]
    assert r.bucket == "notFound" and r.notes[0] == "Empty value in JSON."
    assert evaluated(spark, None, ["Ann"]).results[0].bucket == "notFound"
    assert evaluated(spark, "ﬁn", ["fin"]).results[0].bucket == "matched"


def test_near_misses(spark):
    value = "abcdefghijklmnopqrstuvwxyz"
    near = lambda **row: one(spark, F.get(evaluate.near_each(F.col("t"), F.array("v")), 0), **row)
    found = near(t="zz abcdefghijkXmnopqrstuvwxyz zz", v=value)
    assert 1 <= len(found) <= 3 and "abcdefghijkXm" in found[0]
    assert near(t="ab", v=value) == [] and near(t=value, v=value) == [] and near(t="x", v="") == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_misses_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        value = "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(1, 24)))
        text = "".join(rng.choice("abé😀 ") for _ in range(rng.randrange(0, 60)))
        if rng.random() < 0.7:
            own = list(value)
            own[rng.randrange(len(own))] = "q"
            text = text[:20] + "".join(own) + text[20:]
        n = len(value)
        want = [] if value in text else [s for p in range(len(text) - n + 1) if 1.0 - edits(value, s := text[p : p + n + 4]) / max(n, len(s)) >= 0.7][:3]
        assert evaluate.near_places(text, value) == want, (text, value)


def test_lines(spark):
    ys = [700.0, 697.0, 693.5, 688.5, 689.0, 600.0]
    items = spark.createDataFrame([(1, 0, i, "w", 0.0, y, 5.0, 12.0) for i, y in enumerate(ys)], "doc_id long, page int, item_idx int, str string, x double, y double, width double, height double")
    assert [r.line_id for r in pages.lines(items).orderBy("item_idx").collect()] == [0, 0, 0, 1, 1, 2]


def test_scans(spark):
    assert one(spark, pages.is_scanned(F.col("t"), F.lit(1)), t=" " + "x" * 99) is True
    assert one(spark, pages.is_scanned(F.col("t"), F.lit(1)), t="x" * 100) is False


@pytest.mark.parametrize(("window", "target", "want"), [("dupont", "dupomt", True), ("a1234", "a1235", False)])
def test_recognised_tokens(window, target, want):
    assert (images.matching_runs(images.Words([window]), [target]) == [[0]]) is want
    assert T.ocr_form("Éva") == T.ocr_form("eva") == "eva"


def test_files(spark):
    assert one(spark, files.output_name(F.col("n")), n="scan.v2.JPG") == "scan.v2_MASKED.png"
    assert one(spark, files.file_type(F.col("n"), F.col("m")), n="a.tif", m="image/tiff") == "image"
    with pytest.raises(Exception, match="unsupported file type"):
        one(spark, files.file_type(F.col("n"), F.col("m")), n="a.tif", m="")


@pytest.mark.parametrize(("raw", "want"), [('{"pii":"x"}', []), ("{}", []), ('{"pii":[{"type":"A","value":null},{"type":"B"}]}', [("A", ""), ("B", "")])])
def test_detections_json(spark, raw, want):
    assert [tuple(d) for d in one(spark, detections.parse_detections(F.col("r")), r=raw)] == want


def test_detections_that_are_not_json_raise(spark):
    with pytest.raises(Exception, match="not JSON"):
        one(spark, detections.parse_detections(F.col("r")), r="{oops")


def test_scan_rectangles(spark):
    sizes = spark.createDataFrame([(1, 0, 600.0, 800.0)], "doc_id long, page int, width double, height double")
    dets = spark.createDataFrame([(1, 0, "A", "x"), (1, 1, "A", "y")], "doc_id long, det_idx int, type string, value string")
    assert [(r.x, r.y, r.width, r.height) for r in pages.scan_rectangles(sizes, dets).orderBy("det_idx").collect()] == [(50, 700, 300, 20), (50, 670, 300, 20)]


def test_value_spans(spark):
    json = '{"pii":[{"type":"A","value":"x\\"y"},{"type":"B","value":"z"}]}'
    assert [json[h["s"] : h["e"]] for h in one(spark, report.value_spans(F.col("j"), F.lit(2)), j=json)] == ['x\\"y', "z"]


def test_word_files(spark):
    xml = '<w:document><w:body><w:p><w:r><w:t>Ann </w:t></w:r><w:r><w:rPr><w:color w:val="FF0000"/></w:rPr><w:t>Lee</w:t></w:r></w:p></w:body></w:document>'
    assert "<w:t>XXX </w:t>" in (out := one(spark, word_files.mask_xml(F.col("x"), F.array(F.lit("Ann Lee"))), x=xml)) and "<w:t>XXX</w:t>" in out
    styled = one(spark, word_files.annotate_xml(F.col("x"), F.lit("Ann Lee"), F.array(F.lit("Ann"), F.lit("Lee"))), x=xml)
    assert 'w:val="8B4513"' in styled and "<w:i/>" in styled
    made = spark.createDataFrame([("a & b",)], ["t"]).select(containers.new_document("t").alias("c")).first().c
    assert "a &amp; b" in zipfile.ZipFile(io.BytesIO(made)).read("word/document.xml").decode()
    back = spark.createDataFrame([(bytearray(made),), (bytearray(b"no"),)], ["c"]).select(containers.document_text("c").alias("t")).collect()
    assert [r.t for r in back] == ["a & b\n\n", None]
