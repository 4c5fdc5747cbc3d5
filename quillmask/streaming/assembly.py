"""Documents and their detections from two streams: a document and the parts of its list of detections arrive in any order, also more than once, and are put together by keyed state before they are evaluated.

The state of a document is its text and the parts seen. It is handed on once, when its text and all its parts are there, or with what has come when the watermark passes its last event by ``wait``; until then the state stays, so that repeats
are recognised. Parts whose document never comes are dropped then. State is dealt by document, so no executor holds more than its share, and is kept in the checkpoint folder, from which a lost executor's part is rebuilt. Behind it, evaluation is a
projection as over tables: the rows are those of the batch query, whatever the order of arrival.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evaluate import evaluate
from ..sources.detections import DETECTIONS, parse_detections

DOCUMENTS, PARTS = "doc_id long, text string, at timestamp", "doc_id long, part int, of int, raw string, at timestamp"
_STATE = "text string, parts array<int>, raws array<string>, of int, done boolean"
_OUT = "doc_id long, text string, raws array<string>"


def read_parts(spark: SparkSession, documents: str, parts: str, files_at_once: int = 1000) -> tuple[DataFrame, DataFrame]:
    """The two streams from folders of Parquet files."""
    read = lambda folder, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return read(documents, DOCUMENTS), read(parts, PARTS)


def assemble(documents: DataFrame, parts: DataFrame, delay: str = "1 hour", wait_ms: int = 3_600_000) -> DataFrame:
    """(doc_id, text, dets) from documents (doc_id, text, at) and parts (doc_id, part, of, raw, at): part numbers count from 0 to of - 1, raw is JSON. Rows with a null doc_id or at are left out, as they can't be put together. Of
    repeats the first to come counts."""
    here = documents.select("doc_id", "at", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("int").alias("of"), F.lit(None).cast("string").alias("raw"))
    listed = parts.select("doc_id", "at", F.lit(None).cast("string").alias("text"), "part", "of", F.coalesce("raw", F.lit("{}")).alias("raw"))
    events = here.unionByName(listed).where("doc_id is not null and at is not null").withWatermark("at", delay)

    def put(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, own, raws, of, done = state.get if state.exists else (None, [], [], None, False)
        held, latest = dict(zip(own, raws, strict=True)), 0
        if state.hasTimedOut:
            state.remove()
        else:
            for rows in batches:
                latest = max(latest, int(rows["at"].max().timestamp() * 1000))
                for t, part, n, raw in zip(rows["text"], rows["part"], rows["of"], rows["raw"], strict=True):
                    if pd.isna(part):
                        text = t if text is None else text
                    else:
                        held.setdefault(int(part), raw)
                        of = int(n) if of is None else of
        ready = not done and text is not None and (state.hasTimedOut or (of is not None and set(range(of)) <= set(held)))
        if not state.hasTimedOut:
            # what was handed on isn't needed any more, only that it was
            keep = {} if done or ready else held
            state.update(("" if done or ready else text, list(keep), list(keep.values()), of, done or ready))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait_ms)
        if ready:
            yield pd.DataFrame({"doc_id": [key[0]], "text": [text], "raws": [[held[p] for p in sorted(held)]]})

    whole = events.groupBy("doc_id").applyInPandasWithState(put, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return whole.select("doc_id", "text", F.flatten(F.transform("raws", parse_detections)).cast(DETECTIONS).alias("dets"))


def evaluate_stream(whole: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Evaluated documents (doc_id, results, duplicates), appended to Parquet in out, each once."""
    rows = evaluate(whole, suggest=False).select("doc_id", "results", "duplicates")
    writer = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def shared_folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where none is set, as in tests, one of this machine's own if Spark runs on it alone, else it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-quillmask-")
    made = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, made)
    return made


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: there is nobody left to ask
        return


def evaluate_arrivals(documents: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, results, duplicates): tables of documents and parts written as files, read as streams until all is read, and what came out as a table. Its folder goes at the end of the program."""
    spark, folder = documents.sparkSession, shared_folder(documents.sparkSession)
    documents.select("doc_id", "text", "at").write.parquet(f"{folder}/documents")
    parts.select("doc_id", "part", "of", "raw", "at").write.parquet(f"{folder}/parts")
    whole = assemble(*read_parts(spark, f"{folder}/documents", f"{folder}/parts", files_at_once=10_000))
    query = evaluate_stream(whole, f"{folder}/out", f"{folder}/state")
    query.awaitTermination()
    return spark.read.schema(evaluate(whole, suggest=False).select("doc_id", "results", "duplicates").schema).parquet(f"{folder}/out")
