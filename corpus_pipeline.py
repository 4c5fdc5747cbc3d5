"""A training corpus from the documents table: toxic documents go, repeated lines go, near-duplicates go, benchmark text goes, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last return the columns of
documents. No stage looks at less than all of what its predecessor kept.

Null and empty texts pass the first two stages like any other document without a reason to go; the near-duplicate stage takes all texts without words for copies of each other. Rows with a null doc_id are scored, keep their
lines, go if they are copies of each other or of any other row, and else are packed. Repeated rows are one row after the near-duplicate stage. Other columns than those of documents are dropped. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.llm.common import cut, drop, release, table
from quillmask.llm.decontamination import find_contamination
from quillmask.llm.lines import dedup_lines
from quillmask.llm.packing import pack, vocabulary_path
from quillmask.llm.simhash import similar_documents, wide_prints
from quillmask.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 and over go. The labels used are those of the training folds, for the documents at hand."""
    return score_toxicity(docs, table(spark, sf_dir, "labels")).where(F.col("score") < 0.5).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document that loses all its lines stays, with an empty text. n_chars is counted again."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def number_unnamed(docs: DataFrame, came: DataFrame) -> DataFrame | None:
    """A row for each text of the docs without a doc_id, with a number in its place (node) that no row of came has; None where all have one. Numbers go up by the text's hash and lie above all identifiers, or below them where there is no room above."""
    unnamed = docs.where("doc_id is null")
    if unnamed.isEmpty():
        return None
    once = unnamed.groupBy("text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("own")).orderBy(F.xxhash64("text"), "text")
    rows = cut(once.select("text", "own.*", F.monotonically_increasing_id().alias("at")))
    # how many rows stand in front of each task's, so that numbers have no gaps
    counts, ahead, total = rows.groupBy(F.shiftright("at", 33).alias("task")).count().orderBy("task").collect(), [], 0
    for r in counts:
        ahead.append((r["task"], total))
        total += r["count"]
    low, high = came.agg(F.min("doc_id").cast("long"), F.max("doc_id").cast("long")).first()
    first = 0 if high is None else high + 1 if high + total < 1 << 63 else low - total
    if first < -(1 << 63):
        raise OverflowError("no numbers are left above or below the identifiers for the documents without one")
    of = F.broadcast(docs.sparkSession.createDataFrame(ahead, "task long, ahead long"))
    node = F.lit(first) + F.col("ahead") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return cut(rows.join(of, F.shiftright("at", 33) == F.col("task")).select(node.alias("node"), *COLUMNS[1:]))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that copies tie together, whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest doc_id stays, once. Documents without a doc_id come behind all others.

    docs are what the stages before left of the table documents. Of a near copy, line dedup leaves only the lines that differ, so that it isn't like anything any more; so documents are first compared as they
    were in that table. Those that stay are then compared as they are now; the ones without words are copies of each other. Fingerprints of texts that line dedup left as they were are made once. Of documents without a doc_id line dedup takes nothing, so they are the same in both.
    """
    named = docs.where("doc_id is not null")
    came, now = (df.select("doc_id", "text").where("doc_id is not null") for df in (table(spark, sf_dir, "documents"), named))
    unnamed = number_unnamed(docs, came)
    if unnamed is not None:
        came, now = (df.unionByName(unnamed.select(F.col("node").alias("doc_id"), "text")) for df in (came, now))

    def are(groups: DataFrame) -> DataFrame:
        if unnamed is None:
            return groups.where(F.col("id") == F.col("component")).select("id")
        own = groups.join(unnamed.select(F.col("node").alias("id"), F.lit(True).alias("late")), "id", "left")
        return own.groupBy("component").agg(F.min(F.struct(F.coalesce("late", F.lit(False)), "id")).alias("first")).select("first.id")

    before = cut(wide_prints(came, words=5, among=now.select("doc_id")))
    first = cut(are(similar_documents(came, words=5, similarity=0.8, prints=before)))
    # an identifier's texts, whatever their order, by two hashes; 64 bits each
    marks = lambda df: df.groupBy("doc_id").agg(F.count("*").alias("n"), *(F.sum(h("text").cast("decimal(38, 0)")).alias(name) for name, h in (("x", F.xxhash64), ("y", lambda c: F.xxhash64(F.lit(1), c)))))
    same = marks(came).join(marks(now), ["doc_id", "n", "x", "y"]).select(F.col("doc_id").alias("id"))
    stays = cut(first.join(same.withColumn("same", F.lit(True)), "id", "left"))
    kept = before.join(stays.where("same").select("id"), "id", "left_semi")
    fresh = wide_prints(now, words=5, among=stays.where("same is null").select("id"))
    stays = cut(are(similar_documents(now, words=5, similarity=0.8, prints=kept.unionByName(fresh))))
    gone = cut(named.select("doc_id").join(stays, F.col("doc_id") == F.col("id"), "left_anti"))
    # a few million identifiers at most are sent to every task; more meet the documents in a shuffle
    rest = named.join(F.broadcast(gone) if gone.count() <= 2_000_000 else gone, "doc_id", "left_anti")
    repeated = named.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    out = (rest.dropDuplicates(["doc_id", "text"]) if repeated else rest).select(*COLUMNS)
    if unnamed is None:
        return out
    alone = unnamed.join(stays, F.col("node") == F.col("id"), "left_semi").withColumn("doc_id", F.lit(None).cast(docs.schema["doc_id"].dataType))
    return out.unionByName(alone.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).where(F.size("hits") == 0).select(*COLUMNS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_documents),
]

#: The toxicity and SimHash stages can't be written in SQL. The tests hold the stages after the first, and run() as a whole, against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and the documents it was given, are removed when it is done."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with release() as kept:
            kept.append(cut(stage(spark, docs, sf_dir)))
        drop(docs)
        docs = kept[0]
    return STAGES[-1][1](spark, docs, sf_dir)
