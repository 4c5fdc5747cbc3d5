"""Line dedup across documents, with DataFrame functions only.

Every line's key (ends stripped, A-Z lower-cased) is hashed to 128 bits. A key's documents are counted by partial aggregation before the shuffle, so a line that
every document holds costs one row a task. Keys with more than a thousandth of all repeated lines, of which there can't be more than a thousand, are looked up from a broadcast table;
the others meet their lines in a join. Only the hashes move; the texts meet the positions to drop in a single join on the document.

Null or empty texts are one empty line. Rows with a null identifier keep their lines and count as no document. Rows that repeat an
identifier are one document. An empty table gives an empty result. Other columns are not returned by the query and are kept by the operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import let
from .common import BLANKS, ascii_lower, cut, table

#: Keys that can be hot at once: each has more than this part of the lines.
HOT_KEYS = 1000


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """(id, body, drops): for each document (body: its text's hash) the positions of its lines that an earlier document keeps."""
    lines = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("body"), F.posexplode_outer(line_keys(F.col(text_col))).alias("pos", "key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))
    )
    held = lines if min_docs <= 2 else lines.select("id", "h1", "h2").distinct()
    often = held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n"))
    often = cut(often.where(F.col("first") < F.col("last") if min_docs == 2 else F.col("n") >= min_docs).select("h1", "h2", "first", "n"))
    total = often.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT_KEYS > total
    hot, rest = often.where(is_hot).select("h1", "h2", F.col("first").alias("hot")), often.where(~is_hot).select("h1", "h2", "first")
    # a hot key's lines have found their match already; dealt out by position they meet nothing in the join that follows
    marked = lines.join(F.broadcast(hot), ["h1", "h2"], "left").withColumn("h1", F.when(F.col("hot").isNotNull(), F.xxhash64("id", "pos")).otherwise(F.col("h1")))
    kept_in = marked.join(rest, ["h1", "h2"], "left").withColumn("first", F.coalesce("hot", "first"))
    return kept_in.where(F.col("id") != F.col("first")).groupBy("id", "body").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with ``text_col`` replaced by what is kept (never null), and ``n_lines`` and ``n_dropped``.

    Keys of min_chars code points or more that min_docs documents hold stay in the smallest id that holds them, with all their repeats there.
    """
    drops = repeated_lines(docs, id_col, text_col, min_chars, min_docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = docs.withColumns({"_id": F.col(id_col), "_body": F.xxhash64(text)}).join(drops.withColumnsRenamed({"id": "_id", "body": "_body"}), ["_id", "_body"], "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "drops")
    kept = let(lines, lambda all_lines: F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    return both.withColumns(
        {"n_lines": F.size(lines).cast("long"), "n_dropped": F.when(F.col("drops").isNull(), 0).otherwise(F.size("drops")).cast("long"), text_col: F.when(F.col("drops").isNull(), text).otherwise(kept)}
    ).drop("_id", "_body", "drops")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM lines
), often AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND o.first <> k.doc_id AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
