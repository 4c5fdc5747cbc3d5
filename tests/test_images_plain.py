"""Runs of recognised words over the index, against every run compared in full."""

import random
import re
import time

import pytest

from quillmask.functions import text as T
from quillmask.operators import images


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain(words, target):
    tokens, compact, digit = target.split(), target.replace(" ", ""), re.compile("[0-9]")
    out, at = [], 0
    while tokens and at < len(words):
        window = words[at : at + len(tokens)]
        joined = "".join(window).replace(" ", "")
        strict = len(window) == len(tokens) and all(w == t if digit.search(w) or digit.search(t) or len(t) <= 3 else edits(w, t) <= 1 for w, t in zip(window, tokens))
        slips = digit.findall(joined) == digit.findall(compact) and (d := edits(joined, compact)) <= 2 and d / max(1, len(compact)) <= 0.12
        if joined == compact or strict or slips:
            out.append(at)
            at += len(window)
        else:
            at += 1
    return out


def slipped(rng, word):
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        at = rng.randrange(len(word) + 1)
        word = rng.choice([word[:at] + rng.choice("abc1") + word[at:], word[:at] + word[at + 1 :], word[:at] + rng.choice("ab2") + word[at + 1 :]])
    return word


def test_runs_by_brute_force():
    rng, hits = random.Random(7), 0
    for _ in range(600):
        letters = rng.choice(["ab", "abc1", "a", "abcdefgh 2"])
        vocabulary = [T.ocr_form("".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))) for _ in range(8)] + [""]
        words = [T.ocr_form(slipped(rng, rng.choice(vocabulary))) for _ in range(rng.randrange(0, 40))]
        targets = [T.ocr_form(slipped(rng, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 5))))) for _ in range(rng.choice([3, 40]))]
        got = images.matching_runs(images.Words(words), targets)
        want = [plain(words, t) for t in targets]
        assert got == want, (words, [t for t, g, w in zip(targets, got, want) if g != w])
        hits += sum(map(len, want))
    assert hits > 5000


@pytest.mark.parametrize(("a", "b"), [("", ""), ("abc", "abc"), ("abcd", "acbd"), ("aaaa", "aa"), ("kitten", "sitting"), ("abcdefgh", "xbcdefgy")])
def test_within(a, b):
    for most in range(4):
        assert images.within(a, b, most) == images.within(b, a, most) == (edits(a, b) <= most)


def test_no_image_takes_the_square_of_its_words():
    words = images.Words([f"word{i % 5000}" if i % 3 else "same" for i in range(100_000)] + [""] * 100_000)
    began = time.time()
    found = images.matching_runs(words, ["same", "word1 word2", "wordxseventeenletters and another", "same word1"] + [f"value number {i} here" for i in range(2_000)])
    assert time.time() - began < 5 and len(found[0]) == 33_334


def test_nulls_and_empty_tables(spark):
    words = spark.createDataFrame([(1, 0, "Ann", 0, 0, 10, 5), (1, 1, None, 20, 1, 10, 5), (1, 2, "Lée", 40, 2, 10, 6), (2, 0, "Ann", 0, 0, 1, 1), (None, 0, "Ann", 0, 0, 1, 1)], "doc_id int, word_idx int, text string, x int, y int, width int, height int")
    dets = spark.createDataFrame([(1, 0, "Ann"), (1, 1, None), (1, 2, ""), (1, 3, " lee "), (3, 0, "Ann"), (None, 0, "Ann")], "doc_id int, det_idx int, value string")
    out = sorted(map(tuple, images.cover(images.match_words(words, dets)).collect()))
    assert out == [(1, 0, "Ann", 0, 1, -2, -2, 14, 9), (1, 3, " lee ", 2, 1, 38, 0, 14, 10)]
    assert images.match_words(words.where("false"), dets).count() == images.match_words(words, dets.where("false")).count() == 0
