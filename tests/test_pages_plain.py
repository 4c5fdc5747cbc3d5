"""The matchers of page items against plain readings of their rules."""

import random

import pytest
from pyspark.sql import functions as F

from quillmask.functions import text as T
from quillmask.functions.spans import strip_white
from quillmask.operators import pages

ITEM = "struct<str:string,x:double,y:double,width:double,height:double>"


def items(*texts):
    x, out = 0.0, []
    for t in texts:
        out.append((t, x, 100.0, 6.0 * len(t), 12.0))
        x += 6.0 * len(t) + 6
    return out


def matched(spark, rows):
    return spark.createDataFrame([(1, 0, v, i, "T", i, 1, own) for i, (v, own) in enumerate(rows)], f"doc_id int, page int, value string, det_idx int, type string, line_id int, tier int, items array<{ITEM}>")


def bare(s):
    return "".join(s.split())


def plain(value, own, text_mode):
    """(how, strings): items that hold the value, else without white space, else the first run of neighbours, in which a label may stand in front of it."""
    for how, fits in (("exact", lambda i: value in i[0]), ("bare", lambda i: bare(value) in bare(i[0]))):
        if found := [i for i in own if fits(i)]:
            return how, [i[0] for i in found]
    nums, strict = [c for c in value if c.isdigit()], len(value.split(" ")) == 4 and all(len(p) == 4 and p.isdigit() for p in value.split(" "))
    numeric = 12 <= len(nums) <= 19 or (bare(value).startswith("DE") and len(bare(value)) >= 8)
    for i in range(len(own)):
        for k in range(1, min(6 if not text_mode and (numeric or value.startswith("DE")) else 5, len(own) - i) + 1):
            text = " ".join(x[0] for x in own[i : i + k])
            digits = sum(c.isdigit() for c in text)
            if bare(value) not in bare(text):
                continue
            if not text_mode and numeric and strict and digits < 0.5 * len(bare(text)):
                continue
            if not text_mode and numeric and not strict and value.startswith("DE") and digits < 0.3 * len(nums):
                continue
            after = text[text.rfind(":") + 1 :]
            labelled = not text_mode and text.rfind(":") > 0 and len(text) > 2 * len(value) and bare(value) in bare(after)
            return "run" if not labelled else "label", [x[0] for x in own[i : i + k]]
    return None, []


def test_matching_by_a_plain_reading(spark):
    rng, rows = random.Random(7), []
    values = ["Ann Lee", "1234 5678 9012 3456", "DE12 3456 7890 12", "DE77", "ab", "a b c", "12 34 56 78 90 12"]
    for _ in range(400):
        value = rng.choice(values)
        words = [w for w in value.split(" ")]
        noise = lambda: rng.choice(["x", "No", "id", "12", "Lee", "total", "ab", "a", "DE77", "zz9"])
        own = [noise() for _ in range(rng.randrange(0, 4))] + rng.choice([words, [value], ["".join(words)], [*words[:1], noise(), *words[1:]], []]) + [noise() for _ in range(rng.randrange(0, 3))]
        if own:
            rows.append((value, items(*own)))
    for text_mode in (False, True):
        got = {r.det_idx: (r.how, [i.str for i in r.found]) for r in pages.match_items(matched(spark, rows), text_mode).collect()}
        for i, (value, own) in enumerate(rows):
            assert got[i] == plain(value, own, text_mode), (value, own)


def test_text_mode_differs_where_its_rules_do(spark):
    rows = [
        ("1234 5678 9012 3456", items("1234", "5678", "9012", "3456")), ("12 34 56 78 90 12", items("12", "34", "56", "78", "90", "12")), ("1234 5678 9012 3456", items("abcdefghijklmnopqrstuvwxyz1234", "5678", "9012", "3456abc")),
        ("Ann Lee", items("Customer", "name:", "Ann", "Lee")),
    ]
    how = lambda mode: {r.det_idx: r.how for r in pages.match_items(matched(spark, rows), mode).collect()}
    assert how(False) == {0: "run", 1: "run", 2: None, 3: "label"} and how(True) == {0: "run", 1: None, 2: "run", 3: "run"}


@pytest.mark.parametrize(("value", "texts", "box"), [
    ("Ann Lee", ["Customer", "name:", "Ann", "Lee"], ("Ann Lee", 90.0, 36.0)),  # two whole items behind the label
    ("Ann Lee", ["Customer", "full", "name:", "Ann", "Leeds"], ("Ann Lee", 120.0, 36.0)),  # the second in part
    ("nn Lee", ["Customer", "names:", "Ann", "Lee"], ("nn Lee", 102.0, 30.0)),  # the first in part
    ("A B C", ["Some", "label:", "A", "B", "C"], ("A B C", 72.0, 18.0)),  # an item between
])
def test_boxes_behind_labels(spark, value, texts, box):
    r = pages.match_items(matched(spark, [(value, items(*texts))])).first()
    assert r.how == "label" and (r.found[0].str, round(r.found[0].x, 6), round(r.found[0].width, 6)) == box


def test_first_lines_of_pages(spark):
    line = spark.createDataFrame([(1, 0, n, items(*t.split(" ")), t) for n, t in enumerate(["none here", "Ann Lee is here", "Ann Lee again", "card 12345678", "9012"])] + [(1, 1, 0, items("AnnLee"), "AnnLee")], f"doc_id int, page int, line_id int, items array<{ITEM}>, text string")
    dets = spark.createDataFrame([(1, 0, "N", "Ann Lee"), (1, 1, "N", " Ann Lee "), (1, 2, "C", "1234 5678"), (1, 3, "S", "und"), (1, 4, "E", " ")], "doc_id int, det_idx int, type string, value string")
    got = sorted((r.page, r.value, r.det_idx, r.line_id, r.tier, len(r["items"])) for r in pages.match_lines(line, dets).collect())
    assert got == [(0, "1234 5678", 2, 3, 2, 2), (0, "Ann Lee", 0, 1, 1, 4), (1, "Ann Lee", 0, 0, 2, 1)]
    every = sorted((r.page, r.value, r.line_id) for r in pages.match_lines(line, dets, strict=True).collect())
    assert every == [(0, "1234 5678", 3), (0, "Ann Lee", 1), (0, "Ann Lee", 2), (1, "Ann Lee", 0)]
    assert pages.page_counts(pages.match_lines(line, dets)).orderBy("page").select(F.col("n_values")).collect() == [(2,), (1,)]


def test_line_rows_are_the_lines_of_the_items(spark):
    """line_rows() against lines(), item by item, with blank and null texts, null places and pages in any order."""
    rng = random.Random(13)
    rows = [(d, p, n, rng.choice(["a", "bc", "~", "\x7f", "é", " ", "\xa0\u2003", "", None]), 1.0 * n, rng.choice([100.0, 104.9, 95.0, 80.0, None]), 6.0, 12.0) for d in range(6) for p in range(3) for n in range(d * 7)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "doc_id int, page int, item_idx int, str string, x double, y double, width double, height double")
    want = {}
    for r in sorted(pages.lines(table).collect(), key=lambda r: r.item_idx):
        want.setdefault((r.doc_id, r.page, r.line_id), []).append((r.str, r.x, r.y, r.width, r.height))
    got = pages.line_rows(table).collect()
    assert len(got) == len(want) > 40 and {(r.doc_id, r.page, r.line_id): [tuple(i) for i in r["items"]] for r in got} == want
    assert all(r.text == " ".join(i.str for i in r["items"]) for r in got)


def test_blank_words(spark):
    texts = [c + t for c in ["", "\t", "\n", "\x0b", "\f", "\r", " ", "\x1c", "\x85", "\xa0", "\u1680", "\u2000", "\u200a", "\u200b", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "\ufeff", "!", "~", "\x7f", "é", "😀"] for t in ("", "x", "~", " ")]
    rows = spark.createDataFrame([(t,) for t in texts], "s string").select("s", T.is_blank(F.col("s")).alias("blank"), (T.trim_ws(F.col("s")) == "").alias("trimmed"), T.strip_ws(F.col("s")).alias("bare")).collect()
    assert len(rows) == len(texts) and all(r.blank == r.trimmed == (r.bare == "") == (strip_white(r.s) == "") and r.bare == strip_white(r.s) for r in rows)


def test_runs_by_offsets_in_lines_of_any_items():
    """first_run() against every run tried in turn."""
    rng = random.Random(11)
    found = 0
    for _ in range(3000):
        letters = rng.choice(["ab ", "12 ", "a1 :", "DE1 2"])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 5))) for _ in range(rng.randrange(0, 9))]
        value = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))).strip() or "a"
        most, kind = rng.choice([5, 6]), rng.choice([0, 1, 2])
        digits = lambda s: sum(c.isdigit() for c in s)
        enough = lambda t: kind == 0 or (digits(t) / len(bare(t)) >= 0.5 if kind == 1 else digits(t) >= 0.3 * digits(value))
        want = next(((i, k) for i in range(len(texts)) for k in range(1, min(most, len(texts) - i) + 1) if bare(value) in bare(" ".join(texts[i : i + k])) and enough(" ".join(texts[i : i + k]))), None)
        assert pages.first_run(texts, value, most, kind) == want, (texts, value, most, kind)
        found += want is not None
    assert found > 500


def test_positions_that_hold_values():
    rng = random.Random(12)
    for _ in range(1500):
        letters = rng.choice(["ab", "a\0b", "aé😀 "])
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 6))) for _ in range(rng.randrange(0, 9))]
        values = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(rng.choice([3, 40]))]
        got = sorted(pages.items_with(texts, values))
        assert got == [(i, v) for i, t in enumerate(texts) for v in range(len(values)) if values[v] in t]
