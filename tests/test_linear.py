"""What walks along a text takes time in proportion to it, and gives what a plain reading gives."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quillmask.functions import spans as S
from quillmask.functions import text as T
from quillmask.operators import evaluate, masking, report, word_files
from quillmask.sources import detections


def timed(df):
    """The first row and the seconds that it takes once the workers run."""
    df.first()
    began = time.time()
    row = df.first()
    return row, time.time() - began


def document(spark, text, *values):
    return spark.createDataFrame([(1, text, [{"type": "T", "value": v} for v in values])], f"doc_id int, text string, dets {detections.DETECTIONS}")


def test_many_hits_are_masked_in_time(spark):
    df = masking.mask_documents(document(spark, "ab " * 100_000, "ab"))
    row, took = timed(df.select(F.size("ranges").alias("n"), "masked_text"))
    assert row.n == 100_000 and row.masked_text == "XX " * 100_000 and took < 2


def test_many_hits_are_evaluated_and_reported_in_time(spark):
    text = "ab abc " * 50_000
    row, took = timed(evaluate.evaluate(document(spark, text, "ab"), suggest=True))
    assert len(row.results[0].hits) == 50_000 and took < 10
    runs, took = timed(report.review_document(evaluate.evaluate(document(spark, text, "ab"), suggest=False).withColumn("name", F.lit("d"))).groupBy().agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
    assert runs.n == 100_001 and runs.chars == len(text) + len("d — REVIEWED") and took < 15


def test_long_json_and_xml_are_read_once(spark):
    json = '{"pii":[' + ",\n".join('{"type":"T","value":"v%d"}' % i for i in range(20_000)) + "]}"
    docs = spark.createDataFrame([(1, "x", json)], "doc_id int, text string, raw string").withColumn("dets", detections.parse_detections(F.col("raw")))
    shown = docs.withColumns({"results": F.transform("dets", lambda d, i: F.struct(i.alias("det_idx"), d.type.alias("type"), d.value.alias("value"), F.lit("matched").alias("bucket"), F.array().cast("array<string>").alias("notes"))), "duplicates": F.array().cast("array<struct<value:string,count_in_json:int,count_in_doc:int,extra:int>>")})
    row, took = timed(report.review_json(shown).groupBy().agg(F.count("*").alias("n"), F.max("line").alias("line"), F.sum(F.length("text")).alias("chars")))
    assert row.line == 19_999 and row.chars == len(json.replace("\n", "")) and took < 10
    xml = "<w:body>" + "<w:p><w:r><w:t>Ann </w:t></w:r><w:r><w:t>Lee</w:t></w:r></w:p>" * 20_000 + "</w:body>"
    row, took = timed(spark.createDataFrame([(xml,)], "x string").select(word_files.mask_xml(F.col("x"), F.array(F.lit("Ann Lee"))).alias("m")))
    assert row.m.count("<w:t>XXX </w:t>") == 20_000 and took < 5


def test_spans_by_brute_force(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("ab é\u00a0,.") for _ in range(rng.randrange(0, 60))), "".join(rng.choice("ab é") for _ in range(rng.randrange(0, 4)))) for _ in range(300)]
    df = spark.createDataFrame(rows, "t string, v string")
    hits = df.select("t", "v", S.find_all("t", "v").alias("all"), F.get(S.located(3)(F.col("t"), F.array("v")), 0).alias("found"))
    hits = hits.withColumn("again", F.transform("found", lambda h: F.struct(T.has_token_boundary(F.col("t"), h.s, h.e).alias("good"), T.context(F.col("t"), h.s, h.e, 3).alias("around"))))
    for r in hits.collect():
        want = [m.start() for m in re.finditer(re.escape(r.v), r.t)] if r.v else []
        assert [h.s for h in r["all"]] == [h.s for h in r.found] == want
        assert [(h.good, h.around) for h in r.found] == [(h.good, h.around) for h in r.again]
    spans = [[(s, s + rng.randrange(0, 5)) for s in rng.sample(range(30), rng.randrange(0, 8))] for _ in range(100)]
    merged = spark.createDataFrame([(i, x) for i, x in enumerate(spans)], f"i int, x {S.SPANS}").select("i", S.merge_spans("x").alias("m")).collect()
    for r in merged:
        own = spans[r.i]
        # two of them are one if they overlap or touch: so are the half steps that they cover, ends included
        covered = sorted({p for s, e in own for p in range(2 * s, 2 * e + 1)})
        want, out = [], []
        for p in covered:
            if want and p == want[-1][1] + 1:
                want[-1][1] = p
            else:
                want.append([p, p])
        out = [(a // 2, b // 2) for a, b in want]
        assert [(h.s, h.e) for h in r.m] == out


@pytest.mark.parametrize(("starts", "width", "want"), [([], 1, []), ([0, 1, 2, 5, 6, 9], 2, [0, 2, 5, 9]), (list(range(100_000)), 3, list(range(0, 100_000, 3)))])
def test_greedy(spark, starts, width, want):
    df = spark.createDataFrame([(starts,)], "s array<int>")
    assert df.select(S.greedy("s", F.lit(width)).alias("g")).first().g == want


def test_lines_of_json():
    json = '{"a":\n"value":"x\ny",\n\n"value":"","value":"z"'
    spans = report.values_in(json, 3)
    assert [json[s:e] for s, e in spans] == ["x\ny", "", "z"]
    assert list(report.line_pieces(json, spans)) == [
        (0, '{"a":', -1, False), (1, '"value":"', -1, False), (1, "x", 0, False), (2, "y", 0, True), (2, '",', -1, False), (3, "", -1, False), (4, '"value":"', -1, False), (4, "", 1, True), (4, '","value":"', -1, False), (4, "z", 2, True), (4, '"', -1, False),
    ]
