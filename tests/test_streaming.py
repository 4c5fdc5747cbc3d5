from quillmask.streaming.masking import mask_stream, read_documents


def test_masking_of_arriving_documents(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(1, "Ann Lee met Ann", '{"pii":[{"type":"N","value":"Ann"},{"type":"N","value":"Bob"}]}'), (2, None, "{}")]
    schema = "doc_id long, text string, raw string"
    spark.createDataFrame(rows[:1], schema).write.mode("append").parquet(source)
    mask_stream(read_documents(spark, source), out, state).awaitTermination(60)
    spark.createDataFrame(rows[1:], schema).write.mode("append").parquet(source)
    mask_stream(read_documents(spark, source), out, state).awaitTermination(60)
    got = {r.doc_id: (r.masked_text, [b.bucket for b in r.results]) for r in spark.read.parquet(out).collect()}
    assert got == {1: ("XXX Lee met XXX", ["matched", "notFound"]), 2: ("", [])}
