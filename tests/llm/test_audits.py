"""Repetition, divergence of sources and hard negatives: against plain versions, with hashes that collide, and on awkward rows."""

import re
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmask.llm import divergence, hard_negatives, repetition, slices
from quillmask.llm.registry import QUERIES, SQL

BLANK = re.compile("[\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op11_repetition", "op12_divergence", "op13_hard_negatives"])
def test_query_equals_its_sql(spark, data, same, name):
    same(QUERIES[name](spark, data), SQL[name])


def bad_hashes(data, starts, ends):
    """Only two hashes for everything."""
    return ((ends - starts) % 2).astype(np.uint64)


def texts_of(rows):
    return [t for _, _, t in slices.portions(pa.array(rows, pa.string()), 1 << 20)]


def test_tokens_end_with_their_text_and_colliding_hashes_are_told_apart():
    rows = ["ab cd", "", None, "cd", "ef ", "éa ab", "", "ab"]
    (texts,) = texts_of(rows)
    starts, ends, text = texts.bounds(repetition.WORD)
    words = [bytes(texts.bytes[a:b]).decode() for a, b in zip(starts, ends)]
    assert words == ["ab", "cd", "cd", "ef", "éa", "ab", "ab"] and text.tolist() == [0, 0, 3, 4, 5, 5, 7]
    for hashes in (slices.xxhashes, slices.polynomials, bad_hashes):
        numbers, shown = slices.identify(texts.bytes, starts, ends, hashes)
        assert [words[i] for i in shown[numbers]] == words and len(set(numbers.tolist())) == len(set(words)) == len(shown)


def test_portions_hold_every_row_once_whatever_their_size():
    rows = ["x" * n for n in (0, 5, 100, 3, 0, 0, 7, 50)] + [None]
    column = pa.concat_arrays([pa.array(["skipped"]), pa.array(rows)]).slice(1)
    for size in (1, 8, 60, 1000):
        got = [bytes(t.bytes[a:b]).decode() for _, _, t in slices.portions(column, size) for a, b in pairwise(t.ends.tolist())]
        assert got == [r or "" for r in rows]


def plain_repetition(text):
    text = text or ""
    words = [w for w in BLANK.split(text) if w]
    lines, seen, out = text.split("\n"), set(), Counter()
    for line in lines:
        if BLANK.sub("", line):
            if line in seen:
                out["n_dup_lines"] += 1
                out["dup_line_chars"] += len(BLANK.sub("", line))
            seen.add(line)
    for n in {8, *repetition.SEQUENCES}:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        times = Counter(grams)
        inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(n)}
        if n in repetition.SEQUENCES:
            out[f"dup_{n}_chars"] = sum(len(words[i]) for i in inside)
        if n == 8:
            out["n_repeat_words"] = len(inside)
    out |= {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text)}
    return tuple(out[m] for m in repetition.MEASURES)


AWKWARD = [None, "", " \n\t", "a", "a b c d e f g h " * 3, "x\n\nx\n \nx ", "ü é\nü é\r\nü é", "one two three four five six seven eight\n" * 4, "😀 " * 40, "#*$%&|<> ##", "\x00 \x00 \x1f\x85", "tail\n"]


def test_repetition_equals_a_plain_version(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = AWKWARD + [" ".join(rng.choice(["a", "b", "ç", "dd"], size)) for size in (9, 30, 200)] + [" ".join(f"w{i % 5000}" for i in range(120_000))] + AWKWARD
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"n_words": F.lit("clash"), "kept": F.lit("clash"), "other": F.lit(1)})
    out = repetition.judge(repetition.measure_repetition(docs))
    got = {r.doc_id: r for r in out.collect()}
    assert set(out.columns) == {"doc_id", "other", "base_failed", "kept", *repetition.MEASURES}
    for i, text in enumerate(rows):
        want = plain_repetition(text)
        assert tuple(got[i][m] for m in repetition.MEASURES) == want
        one = dict(zip(repetition.MEASURES, want))
        failed = one["n_words"] < 20 or 100 * one["n_repeat_words"] > 30 * one["n_words"]
        over = 100 * one["dup_line_chars"] > repetition.LINES * one["word_chars"] or any(100 * one[f"dup_{n}_chars"] > s * one["word_chars"] for n, s in repetition.SEQUENCES.items())
        assert (got[i].base_failed, got[i].kept) == (failed, not failed and not over)
    assert repetition.judge(repetition.measure_repetition(docs.where("false"))).count() == 0
    # every hash of a sequence collides
    monkeypatch.setattr(repetition, "mixed", lambda x: np.zeros(len(x), np.uint64))
    for text in rows[:15]:
        (texts,) = texts_of([text, text])
        assert [tuple(int(m[i]) for m in repetition.measures(texts)) for i in (0, 1)] == [plain_repetition(text)] * 2


def test_repetition_decides_where_the_basic_rule_does_not(spark):
    rng = np.random.default_rng(5)
    fresh = lambda n: " ".join(f"v{x}" for x in rng.integers(0, 10**9, n))
    phrase = fresh(6)
    rows = [(1, fresh(300)), (2, " ".join(fresh(7) + " " + phrase for _ in range(20))), (3, "\n".join([fresh(5)] * 5 + [fresh(4) for _ in range(4)]))]
    out = {r.doc_id: (r.base_failed, r.kept) for r in repetition.judge(repetition.measure_repetition(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert out == {1: (False, True), 2: (False, False), 3: (out[3][0], False)}


def plain_divergence(rows):
    rows = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(t for r in own for t in set(r[2]))
        kept = sorted(t for t in df if df[t] >= 3)
        counts = {s: Counter(t for r in own if r[1] == s for t in r[2] if df[t] >= 3) for s in {r[1] for r in own}}
        p_of = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(sum(counts.values(), Counter()))
        for s in p:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in p if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, top in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def test_divergence_equals_a_plain_version_in_units_of_any_size(spark):
    rng = np.random.default_rng(1)
    words = [f"{a}{b}" for a in ("Ab", "ab", "ü", "é", "日本") for b in ("x", "yy", "Z", "ß", "")]
    rows = [("en", f"s{int(rng.integers(0, 5))}", " ".join(rng.choice(words, int(rng.integers(0, 30)), p=np.arange(1, 26) / 325))) for _ in range(80)]
    rows += [("de", "s0", "only twice"), ("de", "s1", "only twice"), ("de", None, None), (None, None, None), ("fr", "a", "mot mot"), ("fr", "b", "mot"), ("fr", "c", "mot"), ("fr", "d", ""), ("en", "s1", " ".join(words * 3000))]
    rows += [("tie", s, "même chose encore") for s in "abc"]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"n": F.lit("clash"), "term": F.lit("clash"), "value": F.lit("clash")})
    want = plain_divergence(rows)
    for size in (3, 200_000):
        got = divergence.audit(docs, entries_in_unit=size)
        assert sorted(map(tuple, got.collect())) == want
    assert divergence.audit(docs.where("false")).count() == 0


def test_shares_are_exact_beyond_64_bits():
    for count, whole in ((10**15, 3 * 10**15), (0, 7), (6, 7), (8 * 10**15, 9 * 10**15 - 1)):
        assert int(divergence.share(np.array([count]), whole)[0]) == 1 + 10**9 * (count + 1) // whole


def plain_negatives(rows, anchors, positives=5, negatives=10):
    rows = [(i, label, v) for i, label, v in rows if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, label, v in rows:
        if a % anchors:
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(v, w)), i, other) for i, other, w in rows if i != a and len(w) == len(v))
        for score, positive, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and 30 * -score <= 100 * -x[0] <= 90 * -score][:negatives]
            out += [(a, positive, k, i, -score, -s) for k, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def test_hard_negatives_equal_a_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-6, 7, 5).astype(float).tolist()) for i in range(900)]
    rows += [(1000 + i, 9, rng.integers(-6, 7, 3).astype(float).tolist()) for i in range(30)] + [(1040 + i, 8, rng.integers(0, 7, 3).astype(float).tolist()) for i in range(30)]  # another length
    rows += [(2000, 1, None), (2001, None, [1.0] * 5), (2002, 1, [1.0, None, 1.0, 1.0, 1.0]), (2003, 1, [float("nan")] * 5), (2004, 1, [float("inf")] * 5), (None, 1, [2.0] * 5), (2005, 1, []), (2010, 2, [0.0] * 5), (2020, 3, [3.0] * 5), (2021, 3, [3.0] * 5), (2030, 77, [5.0] * 5)]
    df = spark.createDataFrame(rows, "id long, label int, vec array<double>").withColumns({"part": F.lit("clash"), "low": F.lit("clash"), "score": F.lit("clash")})
    want = plain_negatives(rows, 10)
    assert len(want) > 1000
    for size in (64, 16384):
        got = hard_negatives.mine(df, F.col("id") % 10 == 0, rows_in_block=size)
        assert sorted(map(tuple, got.collect())) == want
    # rows that are there twice are one
    assert sorted(map(tuple, hard_negatives.mine(df.unionByName(df), F.col("id") % 10 == 0).collect())) == want
    assert hard_negatives.mine(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_whole_groups_of_anchors_are_pruned_where_vectors_lie_in_clusters():
    rng = np.random.default_rng(4)
    centres = np.round(rng.standard_normal((20, 16)) * 100)
    of = rng.integers(0, 20, 6000)
    vectors, labels, ids = centres[of] + rng.integers(-5, 6, (6000, 16)), rng.integers(0, 5, 6000), np.arange(6000)
    search = hard_negatives.Search(ids, labels, vectors)
    asks = ids % 4 == 0
    n = int(asks.sum())
    anchor, _, found, score = search.run(ids[asks], labels[asks], vectors[asks], np.full((n, 1), hard_negatives.LEAST + 1), np.full((n, 1), hard_negatives.LARGEST), 5, True)
    assert search.scored < search.pairs / 20  # by labels alone it would be a fifth
    for a in range(0, n, 71):
        own = ids[asks][a]
        exact = vectors @ vectors[own]
        want = sorted((-s, i) for i, s in enumerate(exact) if labels[i] == labels[own] and i != own)[:5]
        assert [(-s, i) for i, s in zip(found[anchor == a].tolist(), score[anchor == a].tolist())] == want


def test_intervals_hold_every_inner_product():
    rng = np.random.default_rng(6)
    for spread in (1, 50, 1000):
        make = lambda n, leaf: hard_negatives.Tree(np.arange(n), rng.integers(0, 3, n), rng.integers(-spread, spread, (n, 6)) + rng.integers(0, 60, 6).astype(float), leaf)  # noqa: E731, B023
        one, other = make(60, 8), make(200, 16)
        low, high = hard_negatives.intervals(one, other)
        for i, (a, b) in enumerate(zip(one.first, one.last)):
            for j, (c, d) in enumerate(zip(other.first, other.last)):
                exact = one.vectors[a:b] @ other.vectors[c:d].T
                assert low[i, j] <= exact.min() and exact.max() <= high[i, j]


def test_scores_beyond_doubles_are_exact_and_beyond_64_bits_bounded():
    one = np.array([[2.0**40 + 1, 3.0]])
    assert hard_negatives.products(one, np.array([[2.0**20 + 1, 5.0]]), False)[0, 0] == (2**40 + 1) * (2**20 + 1) + 15
    assert hard_negatives.products(one, np.array([[1e300, 0.0]]), False)[0, 0] == hard_negatives.LARGEST
    huge = hard_negatives.Search(np.array([1, 2, 3]), np.array([0, 0, 1]), np.array([[1e300, 1.0], [-1e300, 2.0], [1e150, 3.0]]))
    assert huge.run(np.array([1]), np.array([0]), np.array([[1e300, 1.0]]), np.array([[hard_negatives.LEAST + 1]]), np.array([[hard_negatives.LARGEST]]), 5, True)[2].tolist() == [2]


def test_shingles_and_wide_fingerprints_by_plain_counting():
    from quillmask.llm import shingles as S

    rng = np.random.default_rng(8)
    rows = AWKWARD + [" ".join(rng.choice(["a", "B", "ç", "dd", "A b"], size)) for size in (1, 3, 4, 5, 6, 40, 3000)] + [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 2000))]
    numbers = {}
    for size in (1, 1 << 20):
        found, begin = [], [0]
        for _, _, texts in slices.portions(pa.array(rows, pa.string()), size):
            f, b = S.shingles(texts, 5)
            fp = S.wide_fingerprints(f, b)
            for i in range(len(b) - 1):
                own = f[b[i] : b[i + 1]]
                found.append(own)
                votes = np.concatenate([np.unpackbits(S.mixed(own ^ s).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int) for s in S.mixed(np.arange(4, dtype=np.uint64) + np.uint64(1000))])
                assert (np.unpackbits(fp[i : i + 1].view(np.uint8), bitorder="little") == (2 * votes > len(own))).all()
        for text, own in zip(rows, found, strict=True):
            words = [w for w in BLANK.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
            want = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
            assert len(own) == len(want) == len(set(own.tolist()))
            # one number for one set, whatever it is called
            assert numbers.setdefault(frozenset(want), own.tolist()) == own.tolist()
    assert len({tuple(x) for x in numbers.values()}) == len(numbers)
