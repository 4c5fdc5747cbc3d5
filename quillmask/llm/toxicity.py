"""Toxicity scores by weak supervision.

Voters look at a document: one for each mined lexicon entry (a word, or the beginning of one or of several words), and some for patterns (words of a general lexicon, capitals, exclamation marks, how many and how dense the entries are).
A voter that fires votes for the toxic class and else abstains; that none fires is a vote for the clean class. A generative label model estimates, without any label of a row, how often each voter fires on either class, and with
that its accuracy, and the correlations of voters: a forest of the pairs that depend on each other most given the class, with the rate at which one fires where the other does. A linear classifier is trained on the model's
posterior labels. Scoring is one pass over the texts with a table of at most ``max_entries`` weights and some.

Given labels are used in three places, each time only those of the training folds: they propose voters (entries and patterns that fire over twenty times as often on marked rows as on others; of near copies, told by a min-wise
sketch, one counts; no entry is the beginning of another), they set the prior of the class in the label model, and they scale the classifier's outputs (two numbers). They are taken from at most ``max_rows`` labelled rows,
the ones with the smallest hash of their identifier, copies folded. Nothing but the text is an input of a score.

Null and empty texts are scored like a text without any entry. Without labelled rows of both classes, or without any voter, the general lexicon alone decides. Null labels and identifiers take no part in
training, an identifier that is labelled both ways counts as marked; equally good entries are ranked by length and then by bytes. Repeated rows are scored each; very long texts are read whole; an empty table gives no rows; other
columns are kept as they are, but for one named ``score``, which is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, drop, raw, table

#: Labelled rows used at most, and lexicon entries kept at most.
MAX_ROWS, MAX_ENTRIES = 20_000, 400
#: Entries counted in a task's memory before they are handed on.
HELD_ENTRIES = 200_000
#: How many times as often a voter fires on marked rows.
LIFT = 20
#: Letters in lower case, all else that is ASCII blank.
FOLD = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: A general lexicon of abuse, without words that other languages use innocently.
GENERAL = frozenset(
    b"idiot idiots idiotic moron morons stupid dumb dumbass imbecile loser losers pathetic worthless trash garbage scum scumbag clown disgusting vile filthy filth vermin jerk fool fools retard bastard bitch "
    b"asshole shit shitty crap fuck fucking fucker whore pig swine hate kill ugly freak creep coward liar trolls nazi".split()
)
PREFIXES = (4, 5, 6, 7, 8)
PATTERNS = ("general", "shouting", "marks", "two", "three", "dense")


def beginnings(words: set[bytes]) -> Counter:
    """How many different words begin with each string of PREFIXES bytes."""
    return Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)


def entries_of(words: set[bytes]) -> set[bytes]:
    """The words of three bytes or more, their beginnings with a star, and with two stars the beginnings of two words or more."""
    out = {w for w in words if len(w) >= 3}
    for start, n in beginnings(words).items():
        out.add(start + b"*")
        if n > 1:
            out.add(start + b"**")
    return out


def sketch(words: set[bytes]) -> int:
    """The least hash of the words: near copies share it, so that a group of them counts about once."""
    return min((xxhash.xxh3_64_intdigest(w) for w in words), default=0) >> 1


def apart(entries: list[bytes], most: int) -> list[bytes]:
    """The first entries of a ranked list of which none is the beginning of another."""
    kept: list[bytes] = []
    stems: set[bytes] = set()
    starts: set[bytes] = set()
    for e in entries:
        stem = e.rstrip(b"*")
        if stem in starts or any(stem[:n] in stems for n in range(1, len(stem) + 1)):
            continue
        kept.append(e)
        stems.add(stem)
        starts |= {stem[:n] for n in range(1, len(stem) + 1)}
        if len(kept) == most:
            break
    return kept


def folds(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5


class Lexicon:
    """Entries to numbers, looked up by their first three bytes first."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.number = {e: i for i, e in enumerate(entries)}
        self.first = {e.rstrip(b"*")[:3] for e in entries} | {w[:3] for w in GENERAL}

    def look(self, text: bytes | None) -> tuple[list[int], list[int]]:
        """Which entries occur, and which of PATTERNS hold."""
        if not text:
            return [], []
        words = text.translate(FOLD).split()
        first, number = self.first, self.number
        near = {w for w in set(words) if w[:3] in first}
        found = {number[w] for w in near if w in number}
        for start, n in beginnings(near).items():
            for stars in (b"*", b"**")[:n]:
                if (at := number.get(start + stars)) is not None:
                    found.add(at)
        # words of the general lexicon that no entry stands for
        general = sum(w not in number and not any(w[:n] + b"*" in number for n in PREFIXES) for w in near & GENERAL)
        hits = len(found)
        letters = max(1, sum(map(len, words)))
        upper = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        holds = (general > 0, upper > letters / 2, 10 * text.count(b"!") > len(words), hits >= 2, hits >= 3, 50 * hits > len(words))
        return sorted(found), [i for i, x in enumerate(holds) if x]


def settled(odds: np.ndarray, prior: float) -> np.ndarray:
    """Probabilities of log odds, moved together so that their mean is the prior."""
    low, high = -60.0, 60.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 / (1 + np.exp(-np.clip(odds + mid, -30, 30)))).mean() < prior else (low, mid)
    return 1 / (1 + np.exp(-np.clip(odds + low, -30, 30)))


def forest(fires: np.ndarray, toxic: np.ndarray, least: float = 15.0) -> np.ndarray:
    """For each voter the one it depends on, -1 for none: the spanning forest of the pairs with the largest mutual information given the class, over rows of which toxic says the class. least is on the scale of a
    likelihood ratio statistic."""
    voters, f = fires.shape[1], fires.astype(np.float32)
    gain = np.zeros((voters, voters))
    for rows in (x for x in (f[toxic], f[~toxic]) if len(x)):
        n, both = len(rows), (rows.T @ rows).astype(float)
        one = np.diag(both).copy()
        a, b = one[:, None], one[None, :]
        for seen, left, right in ((both, a, b), (a - both, a, n - b), (b - both, n - a, b), (n - a - b + both, n - a, n - b)):
            gain += np.where(seen > 0, 2 * seen * np.log(np.maximum(seen, 1e-9) * n / np.maximum(left * right, 1e-9)), 0)
    i, j = np.triu_indices(voters, 1)
    part, tied = list(range(voters)), [[] for _ in range(voters)]

    def root(x: int) -> int:
        while part[x] != x:
            x = part[x]
        return x

    for k in np.argsort(-gain[i, j], kind="stable"):
        u, v = int(i[k]), int(j[k])
        if gain[u, v] < least:
            break
        if root(u) != root(v):
            part[root(v)] = root(u)
            tied[u].append(v)
            tied[v].append(u)
    parent, reached = np.full(voters, -1), set()
    for start in range(voters):
        stack = [] if start in reached else [start]
        reached.add(start)
        while stack:
            u = stack.pop()
            for v in tied[u]:
                if v not in reached:
                    reached.add(v)
                    parent[v] = u
                    stack.append(v)
    return parent


class LabelModel:
    """Estimated from votes (rows x voters, true where a voter fires) and the prior of the class.

    rates: how often each voter fires on the toxic and on the clean class; accuracy: the probability of the toxic class where it fires; parent and together: which voter it depends on, and how often it
    fires on either class where that one does; posterior: the rows' probabilities.
    """

    def __init__(self, fires: np.ndarray, prior: float, correlated: bool = True, rounds: int = 100, weight: float = 5.0):
        n, voters = fires.shape
        f, silent, k = fires.astype(float), ~fires.any(1), fires.sum(1)
        self.parent, self.together = np.full(voters, -1), np.zeros((2, 0))
        p = settled(np.where(k >= 2, 2.0, np.where(k == 1, 0.0, -5.0)), prior)
        for step in range(rounds):
            # where a voter is no better than chance, its vote is no evidence
            r0 = ((1 - p) @ f + 1 - prior) / (n - p.sum() + 1)
            r1 = np.maximum((p @ f + prior) / (p.sum() + 1), r0)
            likely = np.log(r1 / r0)
            toxic = p >= 0.5
            if correlated and step in (40, 60, 80):
                self.parent = forest(fires, toxic)
            # abstaining depends on what a text is about and in which language, and tells nothing of its class
            odds = f @ likely
            child = np.flatnonzero(self.parent >= 0)
            if len(child):
                other, both = f[:, self.parent[child]], f[:, self.parent[child]] * f[:, child]
                self.together = np.stack([(rows @ both + weight * r[child]) / (rows @ other + weight) for rows, r in ((toxic * 1.0, r1), (~toxic * 1.0, r0))])
                odds += both @ (np.log(self.together[0] / self.together[1]) - likely[child])
            s1, s0 = (float(np.clip((q @ silent + 1) / (q.sum() + 2), 0.02, 0.98)) for q in (p, 1 - p))
            p = settled(odds + silent * math.log(s1 / s0), prior)
        self.rates, self.posterior = np.stack([r1, r0]), p
        self.accuracy = prior * r1 / (prior * r1 + (1 - prior) * r0)


def logistic(x: np.ndarray, y: np.ndarray, penalty: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by accelerated gradient steps; the last column is the constant."""
    w = np.zeros(x.shape[1])
    ahead, t = w.copy(), 1.0
    step = 1 / (0.25 * np.linalg.norm(x, 2) ** 2 / len(x) + penalty.max())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        new = ahead - step * (x.T @ (p - y) / len(x) + penalty * ahead)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return w


def matrix(found: list[list[int]], patterns: list[list[int]], entries: int) -> np.ndarray:
    """A column for each entry and pattern, and one of ones."""
    x = np.zeros((len(found), entries + len(PATTERNS) + 1), np.float32)
    for i, (a, b) in enumerate(zip(found, patterns, strict=True)):
        x[i, a] = 1
        x[i, [entries + j for j in b]] = 1
    x[:, -1] = 1
    return x


def general_only() -> tuple[Lexicon, np.ndarray]:
    weights = np.zeros(len(PATTERNS) + 1)
    weights[0], weights[-1] = 4.0, -2.0
    return Lexicon([]), weights


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, max_entries: int) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the classifier's weights (as matrix() orders columns)."""
    rows = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("id").isNotNull() & F.col("label").isNotNull() & (folds(F.col("id")) != 0))
    rows = rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sample = cut(texts.join(F.broadcast(rows), "id").groupBy(F.xxhash64("text"), F.length("text")).agg(F.max("label").alias("label"), F.first("text").alias("text")).select("label", "text"))
    total, positive = sample.agg(F.count("*"), F.coalesce(F.sum((F.col("label") > 0).cast("int")), F.lit(0))).first()
    if not 0 < positive < total:
        drop(sample)
        return general_only()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["entry", "sketch", "pos", "neg"]
        clean: Counter = Counter()
        marked: set[tuple[bytes, int]] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            for rows in ([(e, of, 1, 0) for e, of in marked], [(e, 0, 0, n) for e, n in clean.items()]):
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)], columns)
            clean.clear()
            marked.clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), raw(batch.column(1)), strict=True):
                words = set(text.translate(FOLD).split())
                if label > 0:
                    of = sketch(words)
                    marked |= {(e, of) for e in entries_of(words)}
                    marked.add((b"", of))
                else:
                    clean.update(entries_of(words))
                if len(clean) + len(marked) > HELD_ENTRIES:
                    yield from flush()
        yield from flush()

    seen_in = sample.mapInArrow(counted, "entry binary, sketch bigint, pos bigint, neg bigint").groupBy("entry", "sketch").agg(F.max("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = seen_in.groupBy("entry").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # the empty entry stands for every marked text
    kinds = seen_in.where(F.length("entry") == 0).agg(F.sum("pos")).first()[0]
    least = max(5, math.ceil(0.005 * kinds))
    lift = F.log(((F.col("pos") + 0.1) / kinds) / ((F.col("neg") + 0.1) / (total - positive)))
    mined = counts.where((F.col("pos") >= least) & (F.length("entry") > 0)).withColumn("gain", lift * F.sqrt("pos")).where(lift > math.log(LIFT)).orderBy(F.desc("gain"), F.desc(F.length("entry")), "entry").limit(10 * max_entries)
    lexicon = Lexicon(apart([bytes(r.entry) for r in mined.select("entry").collect()], max_entries))

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lexicon.look(t) for t in raw(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1))], ["label", "found", "patterns"])

    rows = sample.mapInArrow(looked, f"label {sample.schema['label'].dataType.simpleString()}, found array<int>, patterns array<int>").toPandas()
    drop(sample)
    return lexicon, fit(matrix([list(a) for a in rows["found"]], [list(a) for a in rows["patterns"]], len(lexicon.entries)), rows["label"].to_numpy() > 0, least)


def fit(x: np.ndarray, marked: np.ndarray, least: int) -> np.ndarray:
    """The classifier's weights, one for each column of matrix()."""
    fires, prior = x[:, :-1] > 0, marked.mean()
    # entries are proposed already; patterns are by the same rule
    on, off = fires[marked].sum(0), fires[~marked].sum(0)
    proposed = (on >= least) & ((on + 0.1) / marked.sum() > LIFT * (off + 0.1) / (~marked).sum())
    proposed[: fires.shape[1] - len(PATTERNS)] = True
    if not proposed.any():
        return general_only()[1] if x.shape[1] == len(PATTERNS) + 1 else np.zeros(x.shape[1])
    voters = np.flatnonzero(proposed)
    features = [*voters.tolist(), x.shape[1] - 1]
    penalty = np.full(len(features), 1e-4)
    penalty[-1] = 1e-6
    own = logistic(x[:, features], LabelModel(fires[:, voters], prior).posterior, penalty)
    scale = logistic(np.stack([x[:, features] @ own, np.ones(len(x))], 1), marked.astype(float), np.array([1e-4, 1e-6]), 500)
    own = own * max(scale[0], 1e-3)
    own[-1] += scale[1]
    weights = np.zeros(x.shape[1])
    weights[features] = own
    return weights


def score_toxicity(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_entries: int = MAX_ENTRIES) -> DataFrame:
    """docs with ``score`` in 0 to 1. training: the documents that the labels are about, if other than docs."""
    lexicon, weights = train(docs if training is None else training, labels, id_col, text_col, label_col, max_rows, max_entries)
    held = docs.sparkSession.sparkContext.broadcast((lexicon, weights))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ours, w = held.value
        n = len(ours.entries)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(raw(batch.column(text_col))):
                found, patterns = ours.look(text)
                out[i] = w[-1] + sum(w[j] for j in found) + sum(w[n + j] for j in patterns)
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "score"])

    kept = docs.drop("score")
    return kept.mapInArrow(scored, type(kept.schema)([*kept.schema.fields]).add("score", "double"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", (folds(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
