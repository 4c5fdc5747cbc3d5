"""Resolution of not-modified revisit records in web archives.

A revisit refers to what an earlier capture of the same page holds. URLs are brought to a canonical form; each revisit is joined as of its time to the latest earlier full response
of that form (one whose status, if it has one, is 2xx and not 206); the first validator that both sides have (entity tag, else modification date, else payload digest) must agree; and of the revisit's headers those
that a not-modified answer may carry replace the response's.

The as-of join is in two steps, so that a page with very many captures is never one task's: time is cut into spans, the last response of each (page, span) is found by partial
aggregation, handed on from span to span over that short table (a row for each span of time in which a page was met, whatever the number of captures), and only inside a (page, span) are records put in order. Bodies don't move.

Records with a null or empty URL, time or identifier resolve to nothing (state ``unresolved``) and are no one's response; equal times are ordered by identifier, equal identifiers with the response first; repeated rows are
answered each; absent headers, and null values of validators, count as none; of header names that differ in case only the revisit's stands. Very long header maps and URLs are taken whole. An empty table gives no rows; other columns are not
looked at and not returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Headers that a 304 answer may carry (RFC 9110, 15.4.5), in lower case.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"(?:utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessionid)"


def canonical_url(url: Column) -> Column:
    """Host (lower case, without www and a default port), path without trailing slashes, and sorted query without tracking parameters; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*", ""), "(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), r"^www[0-9]*\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(f"(?i)^{TRACKING}(=|$)"))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(query), "&"))).otherwise(""))


def merge_headers(old: Column, new: Column) -> Column:
    """The response's headers, with the permitted ones of the revisit in their place."""
    none = F.lit(None).cast("map<string,string>")
    old, new = F.coalesce(old, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), F.coalesce(new, none)
    allowed = F.map_filter(F.coalesce(new, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), lambda k, _: F.lower(k).isin(*PERMITTED))
    stays = F.map_filter(old, lambda k, _: ~F.exists(F.map_keys(allowed), lambda x: F.lower(x) == F.lower(k)))
    return F.map_concat(stays, allowed)


def resolve_revisits(records: DataFrame, span: int = 3_600_000_000) -> DataFrame:
    """records (record_id, url, ts long, type, digest, etag, last_modified, headers map, and status int or no such column) to one row for each revisit.

    type is ``response`` for full responses and ``revisit``; span is in the unit of ts. Returns record_id, canonical, refers_to, refers_ts, state (``resolved``, ``mismatch``, ``unresolved``) and headers
    (merged if resolved, else the revisit's own).
    """
    names = ("record_id", "ts", "digest", "etag", "last_modified", "headers")
    status = F.coalesce(F.col("status"), F.lit(200)) if "status" in records.columns else F.lit(200)
    whole_body = (F.col("type") == "response") & status.between(200, 299) & (status != 206)
    rows = records.select(*names, "type", whole_body.alias("is_full"), F.nullif(canonical_url(F.col("url")), F.lit("")).alias("canonical"))
    ok = F.col("canonical").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    rows = rows.withColumns({"usable": ok, "span": F.floor(F.col("ts") / span)})
    whole = F.when(F.col("is_full"), F.struct(*names))
    good = rows.where("usable").withColumn("full", whole)
    order = ["ts", "record_id"]
    last = good.where("full is not null").groupBy("canonical", "span").agg(F.max_by("full", F.struct("ts", "record_id")).alias("closing"))
    # spans without a response of their own get the latest one before, too
    spans = good.where(F.col("type") == "revisit").select("canonical", "span").distinct()
    over_spans = Window.partitionBy("canonical").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.join(last, ["canonical", "span"], "full").withColumn("before", F.last("closing", ignorenulls=True).over(over_spans)).select("canonical", "span", "before")
    inside = Window.partitionBy("canonical", "span").orderBy(*order, F.col("type") == "response").rowsBetween(Window.unboundedPreceding, -1)
    found = good.withColumn("here", F.last("full", ignorenulls=True).over(inside)).where(F.col("type") == "revisit")
    found = found.join(carried, ["canonical", "span"], "left").withColumn("old", F.coalesce("here", "before"))
    lost = rows.where(~F.col("usable") & (F.col("type") == "revisit")).withColumn("old", whole)
    both = found.select(*names, "canonical", "old").unionByName(lost.select(*names, "canonical", "old"))
    agree = lambda c: F.when(F.col(c).isNotNull() & F.col(f"old.{c}").isNotNull(), F.col(c) == F.col(f"old.{c}"))
    valid = F.coalesce(agree("etag"), agree("last_modified"), agree("digest"), F.lit(False))
    state = F.when(F.col("old").isNull(), "unresolved").when(valid, "resolved").otherwise("mismatch")
    return both.withColumn("state", state).select(
        "record_id", "canonical", F.col("old.record_id").alias("refers_to"), F.col("old.ts").alias("refers_ts"), "state", F.when(F.col("state") == "resolved", merge_headers(F.col("old.headers"), F.col("headers"))).otherwise(F.col("headers")).alias("headers")
    )


def page_records(pages: DataFrame) -> DataFrame:
    """Capture records made from pages, which hold none: a response for each page but every 11th (every 13th not found, every 19th partial), and a revisit that is later, or of the same time for every 17th. By
    page_id % 5 the two have equal entity tags, different ones, equal modification dates and a tag on one side only, different dates, or digests alone, of which every 7th of the revisits' is another."""
    p, digest = F.col("page_id"), F.md5(F.coalesce("html", F.lit("")))
    none, case, number = F.lit(None).cast("string"), p % 5, p.cast("string")
    tag = lambda other: F.when(case == 0, F.concat(F.lit("e"), number)).when(case == 1, F.concat(F.lit(other), number))
    date = lambda other: F.when(case == 2, F.concat(F.lit("m"), number)).when(case == 3, F.concat(F.lit(other), number))
    status = F.when(p % 13 == 0, 404).when(p % 19 == 0, 206).otherwise(200)
    own_tag = F.when(case == 2, F.concat(F.lit("r"), number)).otherwise(tag("a"))
    some = lambda pairs: F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e.value.isNotNull()))
    response = F.struct(
        (2 * p).alias("record_id"), F.lit("response").alias("type"), status.alias("status"), (10 * p).alias("ts"), digest.alias("digest"), own_tag.alias("etag"), date("x").alias("last_modified"),
        some([("Content-Type", F.lit("text/html")), ("ETag", own_tag), ("Last-Modified", date("x"))]).alias("headers"),
    )
    revisit = F.struct(
        (2 * p + 1).alias("record_id"), F.lit("revisit").alias("type"), F.lit(304).alias("status"), F.when(p % 17 == 0, 10 * p).otherwise(10 * p + 25).alias("ts"), F.when(p % 7 == 0, F.lit("other")).otherwise(digest).alias("digest"),
        tag("b").alias("etag"), date("y").alias("last_modified"), some([("etag", tag("b")), ("Date", F.concat(F.lit("d"), number)), ("Server", F.lit("s"))]).alias("headers"),
    )
    made = pages.select("url", F.explode(F.when(p % 11 == 0, F.array(revisit)).otherwise(F.array(response, revisit))).alias("r"))
    return made.select("url", "r.*")


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resolve_revisits(page_records(table(spark, sf_dir, "pages")), span=40960)
    pairs = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return out.select("record_id", "canonical", "refers_to", "refers_ts", "state", F.array_join(pairs, ";").alias("headers"))


OP7_SQL = r"""
WITH bare AS (
  SELECT page_id AS p, md5(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(trim(url), '#.*', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS u FROM pages
), parts AS (
  SELECT p, digest,
    regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
    regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(?:utm_[a-z]+|ref|gclid|fbclid|sessionid|phpsessionid)(=|$)'))) AS q
  FROM bare
), canon AS (
  SELECT p, p % 5 AS c, digest, nullif(host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END, '') AS canonical FROM parts
), full_ AS (
  SELECT 2 * p AS record_id, 10 * p AS ts, canonical, digest,
    CASE c WHEN 0 THEN 'e' || p WHEN 1 THEN 'a' || p WHEN 2 THEN 'r' || p END AS etag, CASE c WHEN 2 THEN 'm' || p WHEN 3 THEN 'x' || p END AS modified
  FROM canon WHERE p % 11 <> 0 AND p % 13 <> 0 AND p % 19 <> 0
), revisit AS (
  SELECT 2 * p + 1 AS record_id, CASE WHEN p % 17 = 0 THEN 10 * p ELSE 10 * p + 25 END AS ts, canonical, CASE WHEN p % 7 = 0 THEN 'other' ELSE digest END AS digest, p,
    CASE c WHEN 0 THEN 'e' || p WHEN 1 THEN 'b' || p END AS etag, CASE c WHEN 2 THEN 'm' || p WHEN 3 THEN 'y' || p END AS modified
  FROM canon
), ranked AS (
  SELECT r.record_id, r.canonical, r.etag, r.p, f.record_id AS refers_to, f.ts AS refers_ts, f.etag AS old_etag, f.modified AS old_modified,
    CASE WHEN f.record_id IS NULL THEN 'unresolved' WHEN coalesce(f.etag = r.etag, f.modified = r.modified, f.digest = r.digest, false) THEN 'resolved' ELSE 'mismatch' END AS state,
    row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC, f.record_id DESC) AS n
  FROM revisit r LEFT JOIN full_ f ON r.canonical = f.canonical AND (f.ts < r.ts OR (f.ts = r.ts AND f.record_id < r.record_id))
)
SELECT record_id, canonical, refers_to, refers_ts, state, array_to_string(list_sort(list_filter(CASE WHEN state = 'resolved'
    THEN ['Content-Type=text/html', CASE WHEN etag IS NULL THEN 'ETag=' || old_etag ELSE 'etag=' || etag END, 'Last-Modified=' || old_modified, 'Date=d' || p]
    ELSE ['etag=' || etag, 'Date=d' || p, 'Server=s'] END, lambda h: h IS NOT NULL)), ';') AS headers
FROM ranked WHERE n = 1
"""
