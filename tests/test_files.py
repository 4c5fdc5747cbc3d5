"""Files read, masked and packed again."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmask.operators import file_masking
from quillmask.sources import containers, detections, files

NAMESPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def container(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, part in parts.items():
            z.writestr(f"word/{name}.xml", part)
    return bytearray(out.getvalue())


def test_files_and_texts_are_read(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(container(document="<x/>"))
    (tmp_path / "b.txt").write_text("größe\nzwei", encoding="utf-8")
    read = files.read_files(spark, str(tmp_path)).orderBy("file_name").collect()
    assert [(r.file_name, r.mime, len(r.content) > 0) for r in read] == [("a.docx", "", True), ("b.txt", "", True)]
    assert [r.file_name for r in files.read_files(spark, str(tmp_path), "*.txt").collect()] == ["b.txt"]
    (text,) = files.read_texts(spark, str(tmp_path / "b.txt")).collect()
    assert text.text == "größe\nzwei" and text.path.endswith("b.txt")


def test_masking_of_files_by_kind(spark):
    body = f'<w:document {NAMESPACE}><w:body><w:p><w:r><w:t>Ann </w:t></w:r><w:r><w:t>Lee &amp; Co</w:t></w:r></w:p></w:body></w:document>'
    word = container(document=body, styles="<w:styles/>", header1="Ann Lee")
    old = spark.range(1).select(containers.new_document(F.lit("Ann Lee met AnnLee")).alias("c")).first().c
    kind = f"doc_id int, file_name string, mime string, content binary, dets {detections.DETECTIONS}"
    dets = [{"type": "N", "value": " Ann Lee "}]
    rows = [(1, "a.docx", "", word, dets), (2, "b.doc", "", old, dets), (3, "c.pdf", "", bytearray(b"%PDF"), dets), (4, "d.jpg", "", bytearray(b"x"), dets), (5, "e.doc", "", bytearray(b"\xd0\xcf"), dets), (6, "f.docx", "", word, None)]
    out = {r.doc_id: r for r in file_masking.mask_files(spark.createDataFrame(rows, kind)).collect()}
    assert {i: (r.file_type, r.output_name, r.content is None) for i, r in out.items()} == {
        1: ("docx", "a_MASKED.docx", False), 2: ("doc", "b_MASKED.doc", False), 3: ("pdf", "c_MASKED.pdf", True), 4: ("image", "d_MASKED.png", True), 5: ("doc", "e_MASKED.doc", True), 6: ("docx", "f_MASKED.docx", False),
    }
    parts = zipfile.ZipFile(io.BytesIO(out[1].content))
    assert parts.read("word/document.xml").decode() == body.replace("Ann ", "XXX ").replace("Lee ", "XXX ") and parts.read("word/header1.xml") == b"Ann Lee" and parts.namelist() == ["word/document.xml", "word/styles.xml", "word/header1.xml"]
    assert zipfile.ZipFile(io.BytesIO(out[6].content)).read("word/document.xml").decode() == body
    assert "XXX XXX met XXXXXX" in zipfile.ZipFile(io.BytesIO(out[2].content)).read("word/document.xml").decode()
    with pytest.raises(Exception, match="word/document.xml not found"):
        file_masking.mask_files(spark.createDataFrame([(1, "a.docx", "", container(styles="<w:styles/>"), dets)], kind)).collect()
    assert file_masking.mask_files(spark.createDataFrame([], kind)).count() == 0


def test_default_font_size(spark):
    sized = '<w:styles><w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="22"/></w:rPr></w:rPrDefault></w:docDefaults></w:styles>'
    rows = [(1, container(styles=sized)), (2, container(styles="<w:styles/>")), (3, container(document="<x/>")), (4, bytearray(b"no")), (5, None)]
    out = file_masking.default_font_sizes(spark.createDataFrame(rows, "doc_id int, content binary")).orderBy("doc_id").collect()
    assert [r.half_pts for r in out] == [22, None, None, None, None]


def test_pictures_without_words_get_placeholders(spark):
    words = spark.createDataFrame([(1, 0, "Ann", 10, 20, 30, 12), (1, 1, "Lee", 45, 21, 30, 12), (3, 0, "other", 0, 0, 5, 5)], "doc_id int, word_idx int, text string, x int, y int, width int, height int")
    dets = spark.createDataFrame([(i, n, "T", v) for i in (1, 2) for n, v in enumerate(["Ann Lee", "Bob"])], "doc_id int, det_idx int, type string, value string")
    pictures = spark.createDataFrame([(1,), (2,)], "doc_id int")
    out = sorted(tuple(r) for r in file_masking.mask_images(pictures, words, dets).collect())
    assert out == [(1, 0, "Ann Lee", 8.0, 18.0, 69.0, 17.0), (2, 0, "Ann Lee", 45.0, 35.0, 310.0, 25.0), (2, 1, "Bob", 45.0, 65.0, 310.0, 25.0)]


def test_contents_are_written_by_kind(spark, tmp_path):
    made = spark.createDataFrame([("a_MASKED.docx", bytearray(b"x")), ("b_MASKED.png", bytearray(b"y"))], "file_name string, content binary")
    files.write_contents(made, str(tmp_path / "out"))
    assert sorted((r.kind, r.file_name) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("docx", "a_MASKED.docx"), ("png", "b_MASKED.png")]


def test_reports_as_word_files(spark):
    from quillmask.operators import evaluate, report

    dets = [{"type": "N", "value": "Ann"}, {"type": "N", "value": "Bob & <Co>"}]
    docs = spark.createDataFrame([(1, "Ann met\nLee", '{"pii":[{"type":"N","value":"Ann"},\n{"type":"N","value":"Bob & <Co>"}]}', dets, "d")], f"doc_id int, text string, raw string, dets {detections.DETECTIONS}, name string")
    ev = evaluate.evaluate(docs)
    part = F.when(F.col("part") == "heading", 0).when(F.col("part") == "body", 1).when(F.col("part") == "appendix_heading", 2).otherwise(3)
    made = report.as_documents(report.review_document(ev, half_pts=F.lit(22)), part).select(containers.document_text("content").alias("t"), "content").first()
    assert made.t == "d — REVIEWED\n\nAnn met\nLee\n\nNot found in document (detected but no exact match):\n\nN: Bob & <Co>\n\n"
    xml = zipfile.ZipFile(io.BytesIO(made.content)).read("word/document.xml").decode()
    assert '<w:r><w:rPr><w:i/><w:color w:val="FF0000"/><w:sz w:val="22"/><w:u w:val="single"/></w:rPr><w:t xml:space="preserve">Ann</w:t></w:r>' in xml and xml.count("<w:p>") == 4
    shown = report.as_documents(report.review_json(ev), F.col("line")).select(containers.document_text("content").alias("t"), "content").first()
    assert shown.t.split("\n\n")[0] == '{"pii":[{"type":"N","value":"Ann"},' and "Bob & <Co>  — Not found in document." in shown.t
    assert 'w:ascii="Courier New"' in zipfile.ZipFile(io.BytesIO(shown.content)).read("word/document.xml").decode()


def test_detections_are_nested_beside_their_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    rows = spark.createDataFrame([(1, 1, "B", None), (1, 0, "A", "x"), (3, 0, "C", "y")], "doc_id int, det_idx int, type string, value string")
    out = {r.doc_id: [tuple(d) for d in r.dets] for r in detections.nest_detections(docs, rows).collect()}
    assert out == {1: [("A", "x"), ("B", "")], 2: []}
