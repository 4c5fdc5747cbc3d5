"""Every query against its SQL."""

import pytest

from quillmask.plans.queries import QUERIES
from quillmask.plans.sql import SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, data, same, name):
    same(QUERIES[name](spark, data), SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_masked_text_keeps_length_and_white_space(spark, data):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = QUERIES["mask_text"](spark, data).join(docs, "doc_id")
    assert both.where((F.length("text") != F.length("masked_text")) | (F.regexp_replace("text", r"\S", "") != F.regexp_replace("masked_text", r"\S", ""))).count() == 0


def test_recognised_words_are_those_of_all_lines(spark, data):
    from quillmask.sources import harness

    want = sum(len(line.split(" ")) for r in harness.documents(spark, data).collect() for line in (r.text or "").split("\n"))
    words = harness.recognised_words(spark, data)
    assert words.count() == words.select("doc_id", "word_idx").distinct().count() == want
    assert QUERIES["ocr_boxes"](spark, data).where("y > 14").limit(1).count() == 1


def test_reviewed_json_has_suggestions(spark, data):
    from quillmask.operators import evaluate, report
    from quillmask.sources import harness

    docs = harness.documents_with_json(spark, data).where("doc_id < 20")
    whole = report.review_json(evaluate.evaluate(docs.withColumn("dets", harness.parse_detections(docs["raw"])))).toPandas().astype(str)
    found = QUERIES["reviewed_json"](spark, data).where("doc_id < 20").toPandas().astype(str)
    assert sorted(map(tuple, found.values)) == sorted(map(tuple, whole.values))


def test_each_detection_is_in_one_bucket(spark, data):
    out = QUERIES["eval_status"](spark, data)
    assert out.groupBy("doc_id", "det_idx").count().where("count <> 1").count() == 0
    assert {r[0] for r in out.select("bucket").distinct().collect()} <= {"matched", "partials", "notFound"}
