"""How work is dealt: tasks by the size of the documents, one worker a task for what walks along a text, and no shuffle of what is many times the text."""

import pyarrow as pa
import pytest

from quillmask.functions.spans import by_portions, portions
from quillmask.operators import evaluate, file_masking, pages
from quillmask.plans.queries import QUERIES
from quillmask.sources import harness

PYTHON = ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas")


def plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].splitlines()


def test_a_group_of_rows_is_dealt_to_several_tasks(spark, tmp_path):
    docs = spark.range(20000).selectExpr("id as doc_id", "concat(uuid(), uuid(), uuid(), uuid()) as text")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    dealt = harness.documents(spark, str(tmp_path))
    assert min(dealt.rdd.glom().map(len).collect()) > 0 and dealt.rdd.getNumPartitions() >= 3 and dealt.count() == 20000


@pytest.mark.parametrize("name", ["page_texts", "pdf_line_match", "pdf_page_counts", "pdf_item_match", "pdf_rects", "ocr_boxes"])
def test_words_stay_where_their_document_is(spark, data, name):
    """Only texts are shuffled, by their document."""
    moved = [x for x in plan(QUERIES[name](spark, data)) if "Exchange" in x and "Broadcast" not in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved)


def test_items_are_sorted_once_for_their_lines(spark, data):
    """The one window is that of the words' places; lines, many times the text, aren't sorted to meet values; page sizes need no words."""
    assert sum("Window [" in x for x in plan(QUERIES["pdf_lines"](spark, data))) == 1
    for name in ("pdf_line_match", "pdf_item_match", "pdf_rects"):
        assert not any("SortMergeJoin" in x for x in plan(QUERIES[name](spark, data)))
    assert sum("posexplode(split(body" in x for x in plan(QUERIES["pdf_overlays"](spark, data))) == 1


@pytest.mark.parametrize("name", ["pdf_line_match", "pdf_page_counts", "pdf_item_match", "pdf_rects"])
def test_texts_are_shuffled_once_for_items_and_values(spark, data, name):
    df = QUERIES[name](spark, data)
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    assert sorted("ReusedExchange" in x for x in ran if "REPARTITION_BY_NUM" in x) == [False, True]


def test_positions_and_page_sizes_stay_where_their_document_is(spark):
    df = QUERIES["pdf_position_rects"](spark, "/root/testdata/sf0.01")
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    moved = [x for x in ran if "Exchange" in x]
    assert moved and all("REPARTITION_BY_NUM" in x for x in moved) and sorted("ReusedExchange" in x for x in moved) == [False, True, True]
    assert not any("SortMergeJoin" in x for x in plan(df))


def test_positions_meet_their_own_page(spark):
    items = [(1, 0, 0, "ab", 1.0, 10.0, 0.0, 0.0), (1, 0, 1, "", 2.0, 10.0, 5.0, 5.0), (1, 1, 2, "cd", 3.0, 20.0, 8.0, 9.0), (1, 2, 3, "no size", 3.0, 20.0, 8.0, 9.0), (2, 0, 0, None, 1.0, 1.0, 1.0, 1.0), (3, 0, 0, "ab", 1.0, 10.0, None, None)]
    items = spark.createDataFrame(items, "doc_id long, page int, item_idx long, str string, x double, y double, width double, height double")
    sizes = spark.createDataFrame([(1, 0, 100.0), (1, 1, 200.0), (1, 7, 300.0), (2, 0, 100.0), (3, 0, 400.0)], "doc_id long, page int, height double")
    got = sorted(tuple(r) for r in pages.text_positions(items, sizes).collect())
    assert got == [(1, 0, 0, "ab", 1.0, 90.0, 100.0, 12.0), (1, 1, 2, "cd", 3.0, 180.0, 8.0, 9.0), (3, 0, 0, "ab", 1.0, 390.0, 100.0, 12.0)]
    values = spark.createDataFrame([(1, 0, "T", " b "), (1, 1, "T", "d"), (2, 0, "T", "a"), (3, 0, "T", " ")], "doc_id long, det_idx int, type string, value string")
    got = sorted(tuple(r) for r in pages.position_rectangles(pages.page_positions(items, sizes), values).collect())
    assert got == [(1, 0, 0, "b", -1.0, -4.0, 104.0, 16.0), (1, 1, 1, "d", 1.0, 9.0, 12.0, 13.0)]


def test_documents_without_a_key_keep_their_pages_and_meet_no_values(spark, tmp_path):
    docs = [(None, "Mail a.b@c.de now"), (1, "Mail a.b@c.de now"), (2, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.text) for r in QUERIES["page_texts"](spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "Mail a.b@c.de now"), (2, ""), (None, "Mail a.b@c.de now")]
    every = harness.page_items(spark, str(tmp_path))
    assert every.where("doc_id is not null").exceptAll(harness.page_items(spark, str(tmp_path), keyed=True)).count() == 0
    assert every.where("doc_id is null").count() == 3 and harness.page_items(spark, str(tmp_path), keyed=True).count() == 4
    assert {(r.doc_id, r.value) for r in QUERIES["pdf_item_match"](spark, str(tmp_path)).collect()} == {(1, "a.b@c.de"), (1, "Mail a")}


@pytest.mark.parametrize("suggest", [True, False])
def test_evaluation_takes_one_worker_a_task(spark, suggest):
    docs = spark.createDataFrame([(1, "a b", [("T", "a")])], "doc_id long, text string, dets array<struct<type:string,value:string>>")
    assert sum(any(p in x for p in PYTHON) for x in plan(evaluate.evaluate(docs, suggest=suggest))) == 1


def test_files_take_one_worker_a_task(spark):
    files = spark.range(1).selectExpr("id as doc_id", "concat('a', id, '.docx') as file_name", "'' as mime", "cast(cast(id as string) as binary) as content", "array(named_struct('type', 'T', 'value', cast(id as string))) as dets")
    assert sum(any(p in x for p in PYTHON) for x in plan(file_masking.mask_files(files))) == 1


def test_portions_hold_all_rows_in_order_and_few_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * (i % 2000) for i in range(5000)] + ["y" * 3_000_000])], ["text"])
    parts = list(portions(batch))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == batch.column(0).to_pylist()
    assert all(p.nbytes <= 1 << 20 or p.num_rows == 1 for p in parts) and len(parts) > 4
    assert by_portions(lambda a: a)(batch.column(0)).equals(batch.column(0)) and len(by_portions(lambda a: a)(batch.column(0).slice(0, 0))) == 0


def test_places_of_words_of_repeated_documents(spark, tmp_path):
    spark.createDataFrame([(1, "ab c  d"), (1, "ab c  d"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.item_idx, r.str, r.x) for r in harness.page_items(spark, str(tmp_path)).collect())
    one = [(1, 0, "ab", 0.0), (1, 1, "c", 18.0), (1, 2, "", 30.0), (1, 3, "d", 36.0)]
    assert got == sorted([*one, *one, (2, 0, "", 0.0)])
