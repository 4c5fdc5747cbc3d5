"""Places before and after normalisation, and detections that aren't JSON."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from quillmask.functions.normal import Places
from quillmask.operators import evaluate
from quillmask.sources import detections

LETTERS = ["a", "f", "ﬁ", "ﬃ", "Ｅ", "１", "é", "e\u0301", "\u0301", "\u0327", "ｶ", "ﾞ", "각", "ᄀ", "ᅡ", "ᆨ", "①", "ℌ", "½", " ", "\u00a0", "😀", "ẛ̣", "q\u0307\u0323", "\u0344", "ǆ"]


def nfkc(s):
    return unicodedata.normalize("NFKC", s)


def test_stretches_are_normalised_each_by_itself():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 12)))
        places = Places(text)
        if places.same:
            assert nfkc(text) == text
            continue
        pieces = [text[a:b] for a, b in zip(places.before, places.before[1:])]
        assert "".join(pieces) == text and "".join(map(nfkc, pieces)) == nfkc(text)
        whole = nfkc(text)
        s = rng.randrange(len(whole) + 1)
        e = rng.randrange(s, len(whole) + 1)
        a, b = places.original(s, e)
        if s < e:  # covered, and by no stretch more than needed
            assert len(nfkc(text[:a])) <= s and len(whole) - len(nfkc(text[b:])) >= e
            inner = [c for c in places.before if a < c < b]
            assert all(len(nfkc(text[:c])) > s for c in inner[:1]) and all(len(whole) - len(nfkc(text[c:])) < e for c in inner[-1:])


def plain_masked(text, values):
    """Every character that a hit's characters came from: the text is cut wherever both sides are normalised by themselves."""
    whole, hidden = nfkc(text), set()
    cuts = [i for i in range(len(text) + 1) if nfkc(text[:i]) + nfkc(text[i:]) == whole]
    for v in values:
        for m in re.finditer(re.escape(v), whole):
            a = max(c for c in cuts if len(nfkc(text[:c])) <= m.start())
            b = min(c for c in cuts if len(nfkc(text[:c])) >= m.end())
            hidden |= set(range(a, b))
    return "".join("X" if i in hidden and not c.isspace() else c for i, c in enumerate(text))


def test_hits_are_masked_in_the_text_as_it_came(spark):
    cases = [("The oﬃce of Ｊｏｈｎ ﬁnally", ["John", "office"]), ("ﬁ x ﬁ", ["fi"]), ("cafe\u0301 ｶﾞ!", ["café", "ガ"]), ("plain text", ["text"]), ("① or 1", ["1"]), ("", ["a"]), (None, ["a"])]
    docs = spark.createDataFrame([(i, t, [{"type": "T", "value": v} for v in values]) for i, (t, values) in enumerate(cases)], f"doc_id int, text string, dets {detections.DETECTIONS}")
    out = {r.doc_id: r for r in evaluate.mask_evaluated(docs).collect()}
    for i, (text, values) in enumerate(cases):
        assert out[i].text == (text or "") and out[i].masked_text == plain_masked(text or "", values), (text, out[i].masked_text)
    assert out[0].masked_text == "The XXXX of XXXX ﬁnally"


def test_a_long_text_is_mapped_in_time():
    text, began = "ﬁne Ｅnd e\u0301 " * 60_000, time.time()
    places = Places(text)
    assert [places.original(k, k + 1) for k in range(0, 600_000, 3)] and time.time() - began < 6


def test_what_is_json(spark):
    good, bad = ["{}", "[]", " 1 ", "null", '"a"', '{"a":[1,{}]}'], ["", " ", "{} {}", "{},{}", '{}, "b":1', "1] , [2", "1}", "1]", "{", "a", "1,2"]
    out = {r.raw: r.ok for r in spark.createDataFrame([(x,) for x in good + bad], "raw string").select("raw", detections.is_json(F.col("raw")).alias("ok")).collect()}
    assert [x for x in good if not out[x]] == [] == [x for x in bad if out[x]]


def test_one_bad_record_in_a_thousand(spark):
    good = '{"pii":[{"type":"N","value":"Ann"},{"type":"N"}]}'
    rows = [(i, good) for i in range(996)] + [(996, "{"), (997, None), (998, '{"pii":3}'), (999, '{"pii":[]} {"pii":[]}')]
    read, broken = detections.quarantine(spark.createDataFrame(rows, "doc_id int, raw string").withColumn("error", F.lit("clash")))
    assert read.count() == 998 and read.where(F.size("dets") == 2).count() == 996
    assert sorted((r.doc_id, r.raw) for r in broken.collect()) == [(996, "{"), (999, '{"pii":[]} {"pii":[]}')]
    assert detections.quarantine(spark.createDataFrame(rows[:0], "doc_id int, raw string"))[1].count() == 0
