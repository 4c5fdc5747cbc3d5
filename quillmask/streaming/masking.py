"""Masking and evaluation of documents as they arrive. Both are projections, so a stream needs no state, no watermark and no second copy of the logic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.evaluate import evaluate
from ..operators.masking import mask_documents
from ..sources.detections import parse_detections

INPUT = "doc_id long, text string, raw string"


def read_documents(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """(doc_id, text, dets) from Parquet files (doc_id, text, raw) that arrive in a folder; raw is the detections' JSON."""
    stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return stream.select("doc_id", "text", parse_detections(F.col("raw")).alias("dets"))


def mask_stream(docs: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Masked documents (doc_id, masked_text) and each detection's bucket (results), appended to Parquet in out, each once."""
    # the evaluation returns the text that its offsets are about; what is masked is the text as it came
    both = evaluate(docs.withColumn("_given", F.col("text")))
    masked = mask_documents(both.withColumn("text", F.col("_given")))
    rows = masked.select("doc_id", "masked_text", F.transform("results", lambda r: F.struct(r.det_idx.alias("det_idx"), r.bucket.alias("bucket"))).alias("results"))
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
