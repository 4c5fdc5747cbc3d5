"""Masking of positioned page text: items to lines, lines to matches, matches to rectangles.

Inputs are tables of items (doc_id, page, item_idx, str, x, y, width, height), page sizes (doc_id, page, width, height) and detections (doc_id, det_idx, type, value); a PDF reader that fills
them is pluggable. Items are dealt by page once, for the windows and groupings of lines; matching meets them with the detections by document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions import text as T
from ..functions.automaton import every_start_of_each
from ..functions.spans import by_portions, let, strip_white

ITEM = "struct<str:string,x:double,y:double,width:double,height:double>"
ITEMS = f"array<{ITEM}>"


def page_text(items: DataFrame, joint: str = "") -> DataFrame:
    """(doc_id, page, text): a page's items in order."""
    ordered = F.sort_array(F.collect_list(F.struct("item_idx", F.coalesce("str", F.lit("")).alias("str"))))
    return items.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda i: i.str), joint).alias("text"))


def document_text(items: DataFrame) -> DataFrame:
    """(doc_id, text, n_pages, is_scanned): pages parted by an empty line, the whole trimmed; under 100 characters on at least a page is a scan."""
    ordered = F.sort_array(F.collect_list(F.struct("page", "item_idx", F.coalesce("str", F.lit("")).alias("str"))))
    own = items.groupBy("doc_id").agg(ordered.alias("_i"))
    parted = F.transform("_i", lambda i, n: F.concat(F.when((n > 0) & ~F.get("_i", n - 1)["page"].eqNullSafe(i.page), "\n\n").otherwise(""), i.str))
    out = own.select("doc_id", T.trim_ws(F.array_join(parted, "")).alias("text"), F.size(F.array_distinct("_i.page")).alias("n_pages"))
    return out.withColumn("is_scanned", is_scanned(F.col("text"), F.col("n_pages")))


def is_scanned(text: Column, pages: Column) -> Column:
    return (F.length(T.trim_ws(text)) < 100) & (pages > 0)


def lines(items: DataFrame, gap: float = 5.0) -> DataFrame:
    """Items that aren't blank, with ``line_id``: a new line begins where y is gap or more away from the item before."""
    order = Window.partitionBy("doc_id", "page").orderBy("item_idx")
    kept = items.where(~T.is_blank(F.col("str")))
    breaks = F.coalesce((F.abs(F.col("y") - F.lag("y").over(order)) >= gap).cast("int"), F.lit(0))
    return kept.withColumn("_new", breaks).withColumn("line_id", F.sum("_new").over(order).cast("int")).drop("_new")


def line_rows(items: DataFrame, gap: float = 5.0) -> DataFrame:
    """(doc_id, page, line_id, items, text): a row for each line of lines(); its text is the items' with a blank between.

    A page's items are collected and sorted once and cut where a line begins; as windows over the items and a grouping by line each item would be sorted and written twice more.
    """
    item = F.struct("item_idx", "str", "x", "y", "width", "height")
    held = items.where(~T.is_blank(F.col("str"))).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("_i"))

    def cut(own: Column) -> Column:
        away = lambda i: F.coalesce(F.abs(F.get(own, i).y - F.get(own, i - 1).y) >= gap, F.lit(False))
        begins = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | away(i))
        line = lambda at, end: F.transform(F.slice(own, at + 1, end - at), lambda i: F.struct(i.str.alias("str"), i.x.alias("x"), i.y.alias("y"), i.width.alias("width"), i.height.alias("height")))
        return let(begins, lambda at: F.transform(at, lambda s, n: line(s, F.coalesce(F.get(at, n + 1), F.size(own)))))

    out = held.select("doc_id", "page", F.posexplode_outer(let(F.col("_i"), cut)).alias("line_id", "items"))
    return out.select("doc_id", "page", "line_id", "items", F.array_join("items.str", " ").alias("text"))


def distinct_values(detections: DataFrame) -> DataFrame:
    """(doc_id, det_idx, type, value) with trimmed values: the first listing of each, blank ones left out."""
    trimmed = detections.withColumn("value", T.trim_ws(F.col("value"))).where(F.col("value") != "")
    first = trimmed.groupBy("doc_id", "value").agg(F.min_by(F.struct("det_idx", "type"), "det_idx").alias("d"))
    return first.select("doc_id", "d.det_idx", "d.type", "value")


def match_lines(line: DataFrame, detections: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, page, value, det_idx, type, line_id, tier, items): for each page and value the first line that holds it.

    Tiers within a line: 1 as it is, 2 without white space, 3 by digits for card and account numbers. Tier 3 finds a line whose items can't hold the value, so nothing is drawn there, but it counts and ends the
    search of the page; strict=True leaves it out and takes every line.

    A document's values stand nested in one row and meet its lines there, so that no line is repeated for each value. A hit carries its line's items: lines that hold a value are few, while to fetch the items by their keys all lines
    would be shuffled again.
    """
    wanted = distinct_values(detections).where(~T.is_stop_word(F.col("value")))
    value = F.struct("det_idx", "type", "value", T.strip_ws(F.col("value")).alias("bare"), T.digits(F.col("value")).alias("nums"), T.is_card_or_iban(F.col("value")).alias("numeric"))
    nested = wanted.groupBy("doc_id").agg(F.collect_list(value).alias("_values"))
    # values are few beside lines, which with their items are many times the text and would be sorted for a merge
    held = line.select("doc_id", "page", "line_id", "items", "text", T.strip_ws(F.col("text")).alias("_bare")).join(nested.hint("shuffle_hash"), "doc_id")
    held = held.withColumn("_nums", F.when(F.exists("_values", lambda v: v.numeric), T.digits(F.col("text"))))

    def tier(v: Column) -> Column:
        found = F.when(F.contains("text", v.value), 1).when(F.contains("_bare", v.bare), 2)
        return found if strict else found.when(v.numeric & F.contains("_nums", v.nums), 3)

    hits = F.filter(F.transform("_values", lambda v: F.struct(v.det_idx.alias("det_idx"), v.type.alias("type"), v.value.alias("value"), tier(v).alias("tier"))), lambda h: h.tier.isNotNull())
    found = held.select("doc_id", "page", "line_id", "items", F.explode_outer(hits).alias("h")).where("h is not null").select("doc_id", "page", "line_id", "items", "h.*")
    if not strict:
        first = found.groupBy("doc_id", "page", "value").agg(F.min_by(F.struct("line_id", "tier", "det_idx", "type", "items"), "line_id").alias("f"))
        found = first.select("doc_id", "page", "value", "f.*")
    return found.select("doc_id", "page", "value", "det_idx", "type", "line_id", "tier", "items")


def page_counts(matched: DataFrame) -> DataFrame:
    """(doc_id, page, n_values): values matched on each page, drawn or not."""
    return matched.groupBy("doc_id", "page").agg(F.count("*").alias("n_values"))


def part_of(item: Column, start: Column, length: Column) -> Column:
    """A stretch of an item, its place and width in proportion to the characters."""
    each = item.width / F.length(item.str)
    return F.struct(F.substring(item.str, start + 1, length).alias("str"), (item.x + each * start).alias("x"), item.y.alias("y"), (each * length).alias("width"), item.height.alias("height")).cast(ITEM)


def first_run(texts: list[str], value: str, most: int, kind: int) -> tuple[int, int] | None:
    """(start, length) of the first run of neighbouring items, by start and then by length, that together hold the value, white space aside; runs have at most so many items. kind 1 asks for half of a run's characters to be digits, 2 for 0.3 of the
    value's digits.

    The items' lengths summed up give places in the joined line, in which the value is looked for; of an occurrence, a search among the places tells the items it begins and ends in, and these which runs hold it.
    """
    bare = [strip_white(t) for t in texts]
    line, wanted = "".join(bare), strip_white(value)
    starts = [0, *accumulate(map(len, bare))]
    n, low = len(bare), {}
    x = line.find(wanted) if wanted else -1
    while x >= 0:
        first, last = bisect_right(starts, x, 0, n) - 1, bisect_right(starts, x + len(wanted) - 1, 0, n) - 1
        for i in range(max(0, last - most + 1), first + 1):
            low.setdefault(i, last - i + 1)
            if not kind:
                return i, low[i]
        x = line.find(wanted, x + 1)
    digits = [0, *accumulate(sum("0" <= c <= "9" for c in t) for t in bare)] if low else []
    need = 0.3 * sum("0" <= c <= "9" for c in value)
    for i in sorted(low):
        for k in range(low[i], min(most, n - i) + 1):
            has, size = digits[i + k] - digits[i], starts[i + k] - starts[i]
            if has / size >= 0.5 if kind == 1 else has >= need:
                return i, k
    return None


@F.arrow_udf(StructType().add("i", "integer").add("k", "integer"))
@by_portions
def first_runs(texts: pa.Array, value: pa.Array, most: pa.Array, kind: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), value.to_pylist(), most.to_pylist(), kind.to_pylist(), strict=True)
    found = [None if own is None else first_run([t or "" for t in own], v, m, k) for own, v, m, k in rows]
    return pa.array([None if r is None else {"i": r[0], "k": r[1]} for r in found], pa.struct([("i", pa.int32()), ("k", pa.int32())]))


def labelled(run: Column, value: Column) -> Column:
    """Whether a run of items reads ``label: value``: over twice the value's length, and what follows the last colon holds the value."""
    after = F.substring_index(run, ":", -1)
    return F.contains(run, F.lit(":")) & (F.length(run) > 2 * F.length(value)) & (F.length(run) - F.length(after) > 1) & F.contains(T.strip_ws(after), T.strip_ws(value))


def behind_label(run: Column, value: Column) -> Column:
    """The box of a value that stands behind the last colon of a run (items, text) and may span items; null where it can't be placed.

    Places are counted without white space. They are looked for from the colon's place in the text with white space, so that a colon which then lies further on is passed over: that is how the value is drawn.
    """
    find = lambda what, where, at: F.call_function("locate", what, where, at + 1) - 1
    bare = T.strip_ws(run.text)
    colon = F.length(run.text) - F.length(F.substring_index(run.text, ":", -1)) - 1
    base = find(F.lit(":"), bare, colon) + 1
    facts = F.struct(bare.alias("bare"), base.alias("base"), find(T.strip_ws(value), bare, base).alias("start"), F.length(T.strip_ws(value)).alias("size"))

    def placed(f: Column) -> Column:
        behind = F.filter(run["items"], lambda i: F.instr(run.text, i.str) - 1 > colon)
        own = F.transform(behind, lambda i: F.struct(i.alias("item"), find(T.strip_ws(i.str), f.bare, f.base).alias("at"), F.length(T.strip_ws(i.str)).alias("size")))
        return F.struct(f.start.alias("start"), (f.start + f.size).alias("end"), own.alias("own"))

    def ends(p: Column) -> Column:
        first = F.array_position(F.transform(p.own, lambda o: (o.at <= p.start) & (p.start < o.at + o.size)), F.lit(True)).cast("int") - 1
        last = F.array_position(F.transform(p.own, lambda o: (o.at < p.end) & (p.end <= o.at + o.size)), F.lit(True)).cast("int") - 1
        return F.struct(p.start.alias("start"), p.end.alias("end"), p.own.alias("own"), first.alias("first"), last.alias("last"))

    def box(p: Column) -> Column:
        a, b = F.get(p.own, p.first), F.get(p.own, p.last)
        skip, used = F.greatest(F.lit(0), p.start - a.at), p.end - b.at
        share = lambda o, n: o.item.width * n / F.length(o.item.str)
        between = F.aggregate(F.filter(p.own, lambda o, i: (i > p.first) & (i < p.last)), F.lit(0.0), lambda s, o: s + o.item.width)
        spanning = F.struct(
            value.alias("str"), (a.item.x + share(a, skip)).alias("x"), a.item.y.alias("y"), (share(a, F.length(a.item.str) - skip) + share(b, used) + between).alias("width"), a.item.height.alias("height")
        ).cast(ITEM)
        return F.when((p.start >= 0) & (p.first >= 0) & (p.last >= 0), F.when(p.first == p.last, part_of(a.item, skip, F.greatest(F.lit(0), used - skip))).otherwise(spanning))

    return let(let(let(facts, placed), ends), box)


def refined(items: Column, value: Column) -> Column:
    """Items ``label: value`` cut down to the value, if it is what follows the last colon or at least half of it."""

    def cut(i: Column) -> Column:
        after = T.trim_ws(F.substring_index(i.str, ":", -1))
        colon = F.length(i.str) - F.length(F.substring_index(i.str, ":", -1)) - 1
        whole = (T.strip_ws(after) == T.strip_ws(value)) | (F.contains(after, value) & (F.length(value) >= F.length(after) * 0.5))
        at = F.call_function("locate", value, i.str, colon + 1)
        fits = F.contains(i.str, F.lit(":")) & F.contains(i.str, value) & (F.length(i.str) > F.length(value)) & whole & (at > 0)
        return F.when(fits, part_of(i, at - 1, F.length(value))).otherwise(i.cast(ITEM))

    return F.transform(items, cut)


def relevant(items: Column, value: Column) -> Column:
    """Items that hold a part of the value, for values with a known make-up; all of them for others."""
    nums, bare = T.digits(value), F.upper(T.strip_ws(value))
    grams = lambda s, n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    shares = lambda own, whole, n: F.exists(grams(own, n), lambda g: F.contains(whole, g))

    def customer(i: Column) -> Column:
        return F.contains(i.str, F.lit("CUST")) | F.contains(i.str, F.lit("-")) | i.str.rlike("[0-9]")

    def card(i: Column) -> Column:
        own = T.digits(i.str)
        return F.when(F.length(own) >= 3, shares(own, nums, 3)).otherwise((own != "") & F.contains(nums, own))

    def account(i: Column) -> Column:
        own = F.upper(T.strip_ws(i.str))
        return shares(bare, own, 3) | ((F.length(own) <= 4) & F.contains(bare, own))

    def number(i: Column) -> Column:
        own = T.digits(i.str)
        return (nums != "") & F.when(F.length(own) == 1, F.contains(nums, own)).otherwise(shares(own, nums, 2))

    numeric = T.is_card_or_iban(value)
    items = F.when(F.startswith(value, F.lit("CUST-")), F.filter(items, customer)).otherwise(items)
    return F.when(numeric & T.is_strict_card(value), F.filter(items, card)).when(numeric & F.startswith(value, F.lit("DE")), F.filter(items, account)).when(numeric, F.filter(items, number)).otherwise(items)


def match_items(matched: DataFrame, text_mode: bool = False) -> DataFrame:
    """matched with ``found``, the items (or stretches of them) that hold the value, and ``how`` (exact, bare, label, run or null). text_mode is the matcher for replacement text: runs of five items, whatever
    they hold besides, and no stretches behind labels."""
    value, items, bare_value = F.col("value"), F.col("items"), F.col("_v")
    exact = F.filter(items, lambda i: F.contains(i.str, value))
    out = matched.withColumn("_v", T.strip_ws(value)).withColumn("_exact", exact)
    out = out.withColumn("_bare", F.when(F.size("_exact") == 0, F.filter(items, lambda i: F.contains(T.strip_ws(i.str), bare_value))).otherwise(F.array().cast(ITEMS)))
    alone = (F.size("_exact") == 0) & (F.size("_bare") == 0)
    numeric, de = T.is_card_or_iban(value), F.startswith(value, F.lit("DE"))
    most = F.lit(5) if text_mode else F.when(numeric | de, 6).otherwise(5)
    kind = F.lit(0) if text_mode else F.when(numeric & T.is_strict_card(value), 1).when(numeric & de, 2).otherwise(0)
    out = out.withColumn("_at", first_runs(F.when(alone, F.transform(items, lambda i: i.str)), value, most, kind))
    run = F.slice(items, F.col("_at.i") + 1, F.col("_at.k"))
    out = out.withColumn("_run", F.when(F.col("_at").isNotNull(), F.struct(run.alias("items"), F.array_join(F.transform(run, lambda x: x.str), " ").alias("text"))))
    none = F.lit(None).cast(ITEM)
    out = out.withColumn("_label", none if text_mode else F.when(labelled(F.col("_run.text"), value), behind_label(F.col("_run"), value)).otherwise(none))
    label = F.col("_label").isNotNull()
    how = F.when(F.size("_exact") > 0, "exact").when(F.size("_bare") > 0, "bare").when(label, "label").when(F.col("_run").isNotNull(), "run")
    found = F.when(F.size("_exact") > 0, F.col("_exact")).when(F.size("_bare") > 0, F.col("_bare")).when(label, F.array(F.col("_label"))).otherwise(F.coalesce(F.col("_run.items"), F.array().cast(ITEMS)))
    return out.withColumns({"how": how, "found": found.cast(ITEMS)}).drop("_v", "_exact", "_bare", "_at", "_run", "_label")


def rectangles(matched: DataFrame, pad: float = 2.0) -> DataFrame:
    """(doc_id, page, value, det_idx, x, y, width, height, status): what covers each matched value.

    Card, account, customer and invoice numbers over several items get one rectangle around them, other values one for each item. A matched value whose items can't be told has a row without coordinates, status
    ``matched_not_drawn``. A rectangle covers text and doesn't take it out of a file.
    """
    value = F.col("value")
    out = match_items(matched).withColumn("found", relevant(refined(F.col("found"), value), value))
    box = lambda x, y, w, h: F.struct((x - pad).alias("x"), (y - pad).alias("y"), (w + 2 * pad).alias("width"), (h + 2 * pad).alias("height"))
    w, h = (lambda i: F.coalesce(i.width, F.lit(0.0))), (lambda i: F.coalesce(F.nullif(i.height, F.lit(0.0)), F.lit(12.0)))
    x0, y0 = F.array_min(F.transform("found", lambda i: i.x)), F.array_min(F.transform("found", lambda i: i.y))
    x1, y1 = F.array_max(F.transform("found", lambda i: i.x + w(i))), F.array_max(F.transform("found", lambda i: i.y + h(i)))
    joint = (T.is_card_or_iban(value) | F.startswith(value, F.lit("CUST-")) | F.startswith(value, F.lit("INV-"))) & (F.size("found") > 1)
    boxes = F.when(joint, F.array(box(x0, y0, x1 - x0, y1 - y0))).otherwise(F.transform("found", lambda i: box(i.x, i.y, w(i), h(i))))
    out = out.select("doc_id", "page", "value", "det_idx", F.explode_outer(boxes).alias("b"))
    return out.select("doc_id", "page", "value", "det_idx", "b.*", F.when(F.col("b").isNull(), "matched_not_drawn").otherwise("drawn").alias("status"))


def overlays(matched: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, value, text, x, y, size): replacement text in the place of rectangles, with y counted from the top."""
    value = F.col("value")
    out = match_items(matched, text_mode=True).join(pages.select("doc_id", "page", F.col("height").alias("_h")), ["doc_id", "page"])
    out = out.select("doc_id", "page", "value", "_h", F.explode_outer(refined(F.col("found"), value)).alias("i")).where("i is not null")
    height = F.coalesce(F.nullif(F.col("i.height"), F.lit(0.0)), F.lit(12.0))
    return out.select("doc_id", "page", "value", T.overlay_text(F.coalesce(F.col("i.width"), F.lit(0.0))).alias("text"), F.col("i.x").alias("x"), (F.col("_h") - F.col("i.y") - height).alias("y"), height.alias("size"))


def page_positions(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, page_height, positions): a page's items that hold text, as (item_idx, text, x, y, width, height) with y from the top; a width of 0 is taken as 100, a height of 0 as 12.

    Items are many times the text. They are nested where their document is, and their page meets its size there too: for an equality of pages beside that of documents Spark deals both tables anew by the pair, so the page stands in bounds.
    """
    item = F.struct("item_idx", F.col("str").alias("text"), "x", "y", "width", "height")
    held = items.where(F.coalesce("str", F.lit("")) != "").groupBy("doc_id", "page").agg(F.collect_list(item).alias("_i"))
    size = pages.select(F.col("doc_id").alias("_doc"), F.col("page").alias("_page"), F.col("height").alias("page_height")).hint("shuffle_hash")
    both = held.join(size, (F.col("doc_id") == F.col("_doc")) & (F.col("page") >= F.col("_page")) & (F.col("page") <= F.col("_page")))
    some = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    placed = F.transform("_i", lambda i: F.struct(i.item_idx.alias("item_idx"), i.text.alias("text"), i.x.alias("x"), (F.col("page_height") - i.y).alias("y"), some(i.width, 100.0).alias("width"), some(i.height, 12.0).alias("height")))
    return both.select("doc_id", "page", "page_height", placed.alias("positions"))


def text_positions(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page, item_idx, text, x, y, width, height): a row for each of page_positions()."""
    return page_positions(items, pages).select("doc_id", "page", F.explode_outer("positions").alias("i")).select("doc_id", "page", "i.*")


def items_with(texts: list[str], values: list[str]) -> Iterator[tuple[int, int]]:
    """(item, value) by their numbers: which items of a page hold which values. The page is searched as one text, in one pass where the values are many; a search among the items' places tells which one an occurrence stands in."""
    starts = [0, *accumulate(len(t) + 1 for t in texts)]
    for v, places in enumerate(every_start_of_each("\0".join(texts), values)):
        last = -1
        for at in places:
            i = bisect_right(starts, at) - 1
            if i != last and at + len(values[v]) < starts[i + 1]:
                last = i
                yield i, v


@F.arrow_udf(ArrayType(StructType().add("item", "integer").add("value", "integer")))
def _items_with(texts: pa.Array, values: pa.Array) -> pa.Array:
    rows = [[{"item": i, "value": v} for i, v in items_with([t or "" for t in own or ()], list(wanted or ()))] for own, wanted in zip(texts.to_pylist(), values.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("item", pa.int32()), ("value", pa.int32())])))


def position_rectangles(positions: DataFrame, detections: DataFrame, pad: float = 2.0) -> DataFrame:
    """(doc_id, page, det_idx, value, x, y, width, height): every position of page_positions() whose text holds the value. A page's positions and a document's values stand nested in a row each, so no position is repeated for each value."""
    wanted = detections.withColumn("value", T.trim_ws(F.col("value"))).where("value <> ''").groupBy("doc_id").agg(F.collect_list(F.struct("det_idx", "value")).alias("_values"))
    both = positions.join(wanted.hint("shuffle_hash"), "doc_id").withColumn("_hits", _items_with(F.transform("positions", lambda i: i.text), F.transform("_values", lambda v: v.value)))
    found = F.transform("_hits", lambda h: F.struct(F.get("positions", h.item).alias("i"), F.get("_values", h.value).alias("v")))
    hit = both.select("doc_id", "page", "page_height", F.explode_outer(found).alias("h")).where("h is not null").select("doc_id", "page", "page_height", "h.v.*", "h.i.*")
    return hit.select("doc_id", "page", "det_idx", "value", (F.col("x") - pad).alias("x"), (F.col("page_height") - F.col("y") - F.col("height") - pad).alias("y"), (F.col("width") + 2 * pad).alias("width"), (F.col("height") + 2 * pad).alias("height"))


def scan_rectangles(pages: DataFrame, detections: DataFrame) -> DataFrame:
    """(doc_id, page, det_idx, value, x, y, width, height): placeholders for scans, one below the other on every page, whatever the content."""
    both = pages.select("doc_id", "page", F.col("height").alias("_h")).join(detections.select("doc_id", "det_idx", "value"), "doc_id")
    return both.select("doc_id", "page", "det_idx", "value", F.lit(50.0).alias("x"), (F.col("_h") - 100 - 30 * F.col("det_idx")).cast("double").alias("y"), F.lit(300.0).alias("width"), F.lit(20.0).alias("height"))


def fallback_rectangles(detections: DataFrame) -> DataFrame:
    """(doc_id, det_idx, value, x, y, width, height): placeholders for images in which no text could be read."""
    return detections.select("doc_id", "det_idx", "value", F.lit(45.0).alias("x"), (35 + 30 * F.col("det_idx")).cast("double").alias("y"), F.lit(310.0).alias("width"), F.lit(25.0).alias("height"))
